"""Errors against issue profiles, block by block: the pairs that can be among a result.

Profiles are dealt into blocks by a hash of their id. A task holds one block: which profile
has which word, how often each letter stands in its head, and the heads. All queries pass by
in batches. Where the level asks for shared words, the most frequent words of a query start no
pair: one that shares enough has one of the others as well, and lists of rare words are short.
Where texts alone can reach the level, shared words are counted for all pairs of a batch. A pair
whose score cannot reach the level by its words, the lengths and the letters of both texts goes;
where texts alone can reach the level, so does one whose letters, taken apart into a few kinds
that are compared in order, cannot (see ``in_order``). Only the rest is compared by the edit
measure. A query that wants k matches is scored best bound first, and a pair whose bound is
below the k-th best of its block is not scored at all.

Pairs are neither shuffled nor sorted, and a text is moved once per block, not once per pair.
Words are compared by 64-bit hashes. Nothing is capped: every pair of the level comes out,
less those that k others of its block beat.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import similarity as S
from .editjoin import edit_head
from .stage import staged

#: Profiles that a task holds, at most about ...
BLOCK_ROWS = 131_072
#: ... and the blocks that a smaller table is cut into, of at least ...
BLOCKS = 24
#: ... so many rows.
LEAST_ROWS = 1024
#: Letters that are counted one by one to bound the edit measure; others count together.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 _"


def block_pairs(queries: DataFrame, profiles: DataFrame, level: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query, profile, n_both, n_all, edit_score of the pairs that reach ``level``.

    ``queries`` has query, signature, error_keywords, ``first`` (words one of which an issue
    must hold; null: any issue will do) and ``wanted`` (the number of matches, null: all);
    ``profiles`` has profile, words, settled, head. With ``wanted``, pairs that so many others
    of their block beat may be missing. Only pairs whose profile has one of the ``first``
    words count as others, as the rest may yet turn out to be no candidates.
    """
    return judged_pairs(queries, profiles, level, block_rows).drop("settled", "sure")


def judged_pairs(queries: DataFrame, profiles: DataFrame, level: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same with settled and whether the pair counts as another (``sure``)."""
    hashes = lambda c: F.transform(F.array_distinct(c), lambda w: F.xxhash64(w))
    empty = F.lit("")
    held = profiles.select(
        F.lit(False).alias("asks"), F.col("profile").alias("id"), hashes("words").alias("words"),
        F.lit(None).cast("array<bigint>").alias("first"), F.lit(None).cast("int").alias("wanted"), "settled",
        F.coalesce(edit_head("head"), empty).alias("head"))
    asked = queries.where(F.col("error_keywords").isNotNull()).select(
        F.lit(True).alias("asks"), F.col("query").alias("id"), hashes("error_keywords").alias("words"),
        hashes("first").alias("first"), F.col("wanted").cast("int").alias("wanted"), F.lit(False).alias("settled"),
        F.coalesce(edit_head("signature"), empty).alias("head"))
    n = profiles.count()
    blocks = max(1, math.ceil(n / min(max(1, block_rows), max(LEAST_ROWS, n // BLOCKS))))
    rows = held.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).unionByName(
        staged(asked).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    return rows.repartitionById(blocks, "block").sortWithinPartitions("block", "asks").mapInArrow(
        _pairs_of_blocks(level), "query string, profile string, n_both int, n_all int, edit_score double, settled boolean, sure boolean")


def _pairs_of_blocks(level: float, cells: int = 4_000_000, starts: int = 1 << 18):
    """For mapInArrow on rows ordered by block, profiles first: the pairs of each query.

    ``cells`` bounds the pairs whose words are counted at once, ``starts`` the places in lists
    of words that are read at once, but for one query. The function carries its code.
    """
    import numpy as np
    import pyarrow as pa

    lengths = S.common_lengths()
    letters, groups, slack = LETTERS, 8, 1e-9
    width, kinds, few = len(LETTERS) + 1, 4, 64  # of letters; pairs of a query that are too few for ``in_order``
    w_words, w_edit, bonus = S.KEYWORD_WEIGHT, S.EDIT_WEIGHT, S.SETTLED_BONUS
    least = (level / bonus - w_edit) / w_words  # the similarity of words that any pair needs

    def lists(col):
        """The numbers of a list column, which row each belongs to, and the sizes."""
        sizes = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
        return col.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(col)), sizes), sizes

    def numbered(heads):
        """The letters of all texts as numbers below ``width``, the text of each, and the lengths."""
        size = np.fromiter(map(len, heads), np.int64, len(heads))
        flat = np.frombuffer("".join(heads).encode("utf-32-le", "surrogatepass"), np.uint32)
        number = np.full(129, len(letters))
        number[[ord(c) for c in letters]] = np.arange(len(letters))
        return number[np.minimum(flat, 128)], np.repeat(np.arange(len(heads)), size), size

    def counted(heads):
        """How often each letter stands in each text, and the lengths."""
        letter, row, size = numbered(heads)
        at = row * width + letter
        return np.bincount(at, minlength=len(heads) * width).reshape(-1, width).astype(np.uint16), size

    def coarse(count):
        """Counts of a few groups of letters, group by group: a looser bound, sooner found."""
        return [count[:, k::groups].sum(1, dtype=np.uint16) for k in range(groups)]

    def score(kw, edit, settled):
        found = kw * w_words + edit * w_edit
        return np.minimum(1.0, np.where(settled, found * bonus, found))

    class Block:
        def __init__(self, parts):
            found = [lists(p.column("words")) for p in parts]
            n_words = np.concatenate([s for _, _, s in found])
            by_size = np.argsort(n_words, kind="stable")  # profiles are numbered by how many words they have
            self.n_words = n_words[by_size]
            self.ids = pa.concat_arrays([p.column("id") for p in parts]).take(pa.array(by_size))
            heads = [h for p in parts for h in p.column("head").to_pylist()]
            self.heads = [heads[i] for i in by_size]
            settled = np.concatenate([p.column("settled").to_numpy(zero_copy_only=False) for p in parts])
            self.settled = settled.astype(bool)[by_size]
            self.count, self.size = counted(self.heads)
            self.coarse = coarse(self.count)
            self.kind = None  # until a query has many pairs
            if least <= 0:
                self.order = np.argsort(self.size, kind="stable")  # by length
                self.sorted_size, self.sorted_count = self.size[self.order], np.ascontiguousarray(self.count[self.order].T)
            number = np.empty(len(by_size), np.int64)
            number[by_size] = np.arange(len(by_size))
            shift = np.cumsum([0, *[len(p) for p in parts]])
            doc = number[np.concatenate([d + s for (_, d, _), s in zip(found, shift)])]
            words = np.concatenate([w for w, _, _ in found]).astype(np.int64)
            order = np.lexsort((doc, words))
            self.words, self.starts, df = np.unique(words[order], return_index=True, return_counts=True)
            self.starts = np.append(self.starts, len(words))
            self.docs = doc[order]
            # Word and profile as one number, ascending.
            self.held = np.repeat(np.arange(len(self.words)), df) * len(self.ids) + self.docs

        def take_apart(self):
            """Deals letters into kinds of about equal use, and notes where each letter stands among its kind."""
            uses = self.count.sum(0, dtype=np.int64)
            self.by_letter = np.ascontiguousarray(self.count.T)
            self.kind, load = np.empty(width, np.int64), np.zeros(kinds)
            for x in np.argsort(-uses, kind="stable"):
                self.kind[x] = load.argmin()
                load[self.kind[x]] += uses[x]
            letter, row, _ = numbered(self.heads)
            n = len(self.heads)
            self.bits = np.zeros((width, n), np.uint64)
            self.beyond = np.zeros((kinds, n), np.int64)  # letters of a kind after the first 64
            for k in range(kinds):
                i = np.flatnonzero(self.kind[letter] == k)
                key, place = letter[i] * n + row[i], np.arange(len(i)) - np.searchsorted(row[i], row[i])
                self.beyond[k] = np.bincount(row[i][place >= 64], minlength=n)
                for half in (0, 32):  # sums of different powers below 2 ** 32 are exact
                    use = (place >= half) & (place < half + 32)
                    held = np.bincount(key[use], 2.0 ** (place[use] - half), width * n).astype(np.uint64)
                    self.bits |= held.reshape(width, n) << np.uint64(half)

        def in_order(self, head, count, p, most, settled, total, by_letters):
            """The most that the texts of one query and of profiles ``p`` can have in common, and which may reach the level.

            A common subsequence falls into one for each kind of letters, so it is no longer than the
            longest ones of the kinds together. Those are found for all profiles at once, as rows of
            64 bits; a kind's letters beyond 64 count in full. Pairs that cannot reach the level go
            after every kind.
            """
            if self.kind is None:
                self.take_apart()
            letter, _, _ = numbered([head])
            both = by_letters.astype(np.int64)
            left = np.arange(len(p))
            for k in range(kinds):
                own = letter[self.kind[letter] == k]
                at = p[left]
                plain, where = np.zeros(len(at), np.uint16), {}
                for x in np.unique(own).tolist():
                    plain += np.minimum(self.by_letter[x].take(at), count[x])
                    where[x] = self.bits[x].take(at)
                row, hit, rest = np.full(len(at), ~np.uint64(0)), np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
                for x in own.tolist():
                    np.bitwise_and(row, where[x], out=hit)
                    np.bitwise_xor(row, hit, out=rest)
                    np.add(row, hit, out=row)
                    np.bitwise_or(row, rest, out=row)
                found = 64 - np.bitwise_count(row).astype(np.int64) + self.beyond[k].take(at)
                both[left] -= np.maximum(plain - found, 0)
                left = left[score(most[left], 2.0 * both[left] / np.maximum(total[left], 1), settled[left]) >= level - slack]
                if not len(left):
                    break
            return both, left

        def known(self, words):
            """The numbers of words, -1 for those that no profile has."""
            if not len(self.words):
                return np.full(len(words), -1)
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            return np.where(self.words[at] == words, at, -1)

        def common(self, at, row, q, p):
            """How many of the words of each row in q its profile in p has; ``row`` ascends."""
            out = np.zeros(len(q), np.int64)
            if not len(self.held):
                return out
            a, b = np.searchsorted(row, q), np.searchsorted(row, q, "right")
            for k in range(int((b - a).max(initial=0))):
                i = np.flatnonzero(a + k < b)
                word = at[a[i] + k]
                i, word = i[word >= 0], word[word >= 0]
                key = word * len(self.ids) + p[i]
                out[i] += self.held[np.minimum(np.searchsorted(self.held, key), len(self.held) - 1)] == key
            return out

        def started(self, at, row, n_words):
            """Rows, profiles and the most words they can share, of the pairs that may reach the level, part by part.

            Of the n words of a row, from rare to frequent, the one with m words from it on starts
            the pairs that m shared words would be enough for. That depends on how many words the
            profile has, and profiles are numbered by that, so it is the head of the word's list.
            """
            n = len(self.ids)
            df = np.where(at >= 0, self.starts[at + 1] - self.starts[at], 0)
            order = np.lexsort((df, row))
            at, row = at[order], row[order]
            left = n_words[row] - (np.arange(len(row)) - np.searchsorted(row, row))
            upto = np.searchsorted(self.n_words, left / least + left - n_words[row] + slack, "right")
            use = np.flatnonzero(at >= 0)
            at_, row_ = at[use], row[use]
            first = self.starts[at_]
            size_of = np.searchsorted(self.held, at_ * n + upto[use]) - first
            ends = np.cumsum(size_of)
            last = np.searchsorted(row_, np.arange(len(n_words)), "right")  # rows stay whole
            done = np.concatenate([[0], ends])[last]
            lo = 0
            while lo < len(n_words):
                before = done[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(done, before + starts, "right")))
                s = slice(last[lo - 1] if lo else 0, last[hi - 1])
                count = size_of[s]
                place = np.arange(count.sum()) + np.repeat(first[s] - (np.cumsum(count) - count), count)
                pair, hits = np.unique(np.repeat(row_[s], count) * n + self.docs[place], return_counts=True)
                q, p = pair // n, pair % n
                sizes = n_words[q] + self.n_words[p]
                # what the words that started nothing may add
                more = ((n_words[q] + self.n_words[p]) * least / (1 + least) + slack).astype(np.int64)
                yield lo, hi, q, p, np.minimum(hits + more, np.minimum(n_words[q], self.n_words[p]))
                lo = hi

        def counted_all(self, words, row, n_words, count, size):
            """The same with what each row shares with every profile, and those whose texts alone suffice."""
            n, step = len(self.ids), max(1, cells // len(self.ids))
            for lo in range(0, len(n_words), step):
                hi = min(lo + step, len(n_words))
                a, b = np.searchsorted(row, [lo, hi])
                shared = self.shared(words[a:b], row[a:b] - lo, hi - lo)
                cell = [np.flatnonzero(shared)]
                for q in range(lo, hi):
                    cell.append((q - lo) * n + self.alone(count[q], size[q], shared[(q - lo) * n:(q - lo + 1) * n]))
                cell = np.concatenate(cell)
                yield lo, hi, cell // n + lo, cell % n, shared[cell].astype(np.int64)

        def shared(self, words, row, rows):
            """How many of the words of each row each profile has, as cells row by row."""
            out = np.zeros(rows * len(self.ids), np.int16)
            if not len(self.words):
                return out
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            known = self.words[at] == words
            at, row = at[known], row[known]
            df = self.starts[at + 1] - self.starts[at]
            part = (np.cumsum(df) - df) // cells  # frequent words take turns
            for k in np.unique(part):
                i = np.flatnonzero(part == k)
                n, ends = df[i], np.cumsum(df[i])
                place = np.arange(ends[-1]) + np.repeat(self.starts[at[i]] - (ends - n), n)
                hit = np.repeat(row[i] * len(self.ids), n) + self.docs[place]
                a, b = hit.min(), hit.max() + 1
                out[a:b] += np.bincount(hit - a, minlength=b - a).astype(np.int16)
            return out

        def alone(self, count, size, shared):
            """Profiles without a shared word whose letters let the texts alone reach the level."""
            ratio = level / (w_edit * bonus) - slack
            if ratio > 1 or not size:
                return np.empty(0, np.int64)
            lo = np.searchsorted(self.sorted_size, size * ratio / (2 - ratio) - slack)
            hi = np.searchsorted(self.sorted_size, size * (2 - ratio) / ratio + slack, "right") if ratio > 0 else len(shared)
            both = np.zeros(hi - lo, np.uint16)
            for k in np.flatnonzero(count):
                both += np.minimum(self.sorted_count[k, lo:hi], count[k])
            near = 2.0 * both >= ratio * (size + self.sorted_size[lo:hi]) - slack
            found = self.order[lo:hi][near]
            return found[shared[found] == 0]

        def matches(self, part):
            words, row, n_words = lists(part.column("words"))
            at = self.known(words)
            first, first_row, _ = lists(part.column("first"))
            first = self.known(first)
            asks_any = np.asarray(part.column("first").is_null())
            wanted = part.column("wanted").fill_null(0).to_numpy(zero_copy_only=False)
            heads = part.column("head").to_pylist()
            size = np.fromiter(map(len, heads), np.int64, len(heads))
            if least > 1 + slack:  # no words are enough
                return
            found = (self.started(at, row, n_words) if least > 0
                     else self.counted_all(words, row, n_words, counted(heads)[0], size))
            waiting, n_waiting = [], 0
            for lo, hi, q, p, o in found:
                sizes = n_words[q] + self.n_words[p]
                x, y, settled = size[q], self.size[p], self.settled[p]
                total = x + y
                most = o / np.maximum(sizes - o, 1)
                bound = score(most, 2.0 * np.minimum(x, y) / np.maximum(total, 1), settled)
                keep = np.flatnonzero(bound >= level - slack)
                q, p, o, sizes, settled, total, most = (v[keep] for v in (q, p, o, sizes, settled, total, most))
                used, of = np.unique(q, return_inverse=True)
                count = counted([heads[i] for i in used])[0]
                edit = np.zeros(len(q), np.uint16)
                for mine, theirs in zip(coarse(count), self.coarse):
                    edit += np.minimum(mine[of], theirs[p])
                keep = np.flatnonzero(score(most, 2.0 * edit / np.maximum(total, 1), settled) >= level - slack)
                q, p, o, sizes, settled, total, most, of = (v[keep] for v in (q, p, o, sizes, settled, total, most, of))
                edit = np.empty(len(q))
                for k in range(0, len(q), 1 << 16):
                    i = slice(k, k + (1 << 16))
                    edit[i] = np.minimum(count[of[i]], self.count[p[i]]).sum(1)
                keep = np.flatnonzero(score(most, 2.0 * edit / np.maximum(total, 1), settled) >= level - slack)
                q, p, o, sizes, settled, total, edit, of = (v[keep] for v in (q, p, o, sizes, settled, total, edit, of))
                if least > 0:
                    o = self.common(at, row, q, p)
                n_all = sizes - o
                kw = o / np.maximum(n_all, 1)
                keep = np.flatnonzero(score(kw, 2.0 * edit / np.maximum(total, 1), settled) >= level - slack)
                keep = keep[np.argsort(q[keep], kind="stable")]
                q, p, o, n_all, kw, settled, total, edit, of = (
                    v[keep] for v in (q, p, o, n_all, kw, settled, total, edit, of))
                edges = np.flatnonzero(np.diff(q)) + 1
                keep = []
                for a, b in zip([0, *edges], [*edges, len(q)]):
                    left = np.arange(b - a)
                    if least <= 0 and b - a >= few:  # else words leave few pairs
                        edit[a:b], left = self.in_order(
                            heads[q[a]], count[of[a]], p[a:b], kw[a:b], settled[a:b], total[a:b], edit[a:b])
                    keep.append(left + a)
                keep = np.concatenate(keep)
                q, p, o, n_all, kw, settled, total, edit = (v[keep] for v in (q, p, o, n_all, kw, settled, total, edit))
                bound = score(kw, 2.0 * edit / np.maximum(total, 1), settled)
                keep = np.flatnonzero(bound >= level - slack)
                waiting.append([v[keep] for v in (q, p, o, n_all, kw, settled, total, bound)])
                n_waiting += len(keep)
                if n_waiting >= cells // 4:  # all pairs of a row lie in one part
                    yield from self.compared(waiting, heads, size, wanted, asks_any, first, first_row)
                    waiting, n_waiting = [], 0
            if n_waiting:
                yield from self.compared(waiting, heads, size, wanted, asks_any, first, first_row)

        def compared(self, waiting, heads, size, wanted, asks_any, first, first_row):
            """Of the pairs that may reach the level, those that do and may be among the best."""
            q, p, o, n_all, kw, settled, total, bound = map(np.concatenate, zip(*waiting))
            some = (size[q] > 0) & (self.size[p] > 0)
            sure = asks_any[q].copy()
            if len(q) and not sure.all():
                sure |= self.common(first, first_row, q, p) > 0
            edit, best = np.full(len(q), -1.0), np.full(len(q), -1.0)
            beat = np.full(len(heads), level)  # the score that a pair of the query must reach
            order = np.lexsort((-bound, q))
            start = np.searchsorted(q[order], np.arange(len(heads)))
            place = np.empty(len(q), np.int64)
            place[order] = np.arange(len(q)) - start[q[order]]
            open_, below = order, 0
            while len(open_):
                k = wanted[q[open_]]
                below = max(8, below * 2)
                now = (place[open_] < np.maximum(k, 1) * below // 4) | (k == 0)
                todo, open_ = open_[now], open_[~now]
                if len(todo):
                    used, of = np.unique(q[todo], return_inverse=True)
                    theirs, to = np.unique(p[todo], return_inverse=True)
                    both = lengths([heads[i] for i in used], [self.heads[i] for i in theirs], of, to)
                    edit[todo] = np.where(some[todo], 2.0 * both / np.maximum(total[todo], 1), 0.0)
                    best[todo] = score(kw[todo], edit[todo], settled[todo])
                if not len(open_) and not (wanted > 0).any():
                    break
                # The k-th best so far of what is sure to count.
                done = np.flatnonzero((edit >= 0) & sure & (best >= level) & (wanted[q] > 0))
                done = done[np.lexsort((-best[done], q[done]))]
                nth = np.arange(len(done)) - np.searchsorted(q[done], q[done])
                kth = done[nth == wanted[q[done]] - 1]
                beat[q[kth]] = np.maximum(beat[q[kth]], best[kth])
                open_ = open_[bound[open_] >= beat[q[open_]] - slack]
            found = np.flatnonzero((edit >= 0) & (best >= beat[q] - slack))
            if len(found):
                yield q[found], p[found], o[found], n_all[found], edit[found], settled[found], sure[found]

    def run(batches):
        number, parts, now = None, [], None
        for batch in batches:
            block, asks = np.asarray(batch.column("block")), batch.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(block)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if block[a] != number:
                    number, parts, now = block[a], [], None
                if not asks[a]:
                    parts.append(part)
                    continue
                if now is None:
                    if not parts:
                        continue
                    now, parts = Block(parts), []
                for q, p, o, n_all, edit, settled, sure in now.matches(part):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(q)), now.ids.take(pa.array(p)), pa.array(o, pa.int32()),
                         pa.array(n_all, pa.int32()), pa.array(edit, pa.float64()), pa.array(settled), pa.array(sure)],
                        ["query", "profile", "n_both", "n_all", "edit_score", "settled", "sure"])

    return run
