"""Suffix-array dedup: every byte under a long string that starts anywhere else goes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.stage import staged
from .common import HashFilter, documents, small_batches

#: Bytes of a repeated string, and of the grams that align its copies.
LENGTH, GRAM = 400, 64
#: Neighbouring starts that are judged together.
CELL = 32
#: Different surroundings of one gram that are sorted in a task; more go the other way.
CLASS = 4_000
#: Starts of a long text that are hashed at once.
SEGMENT = 1 << 20
#: Suffixes sorted at once.
SORTED = 20_000

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LOW = np.uint64((1 << 24) - 1)
U = np.uint64


# ---- prefix polynomial hashes -------------------------------------------------------

class PrefixHashes:
    """Hashes of all substrings of some bytes, modulo 2**64."""

    #: Powers of a base and of its inverse, as far as they were needed.
    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: bytes, base: int = BASES[0]):
        n = len(data)
        if base not in self._powers or len(self._powers[base][0]) <= n:
            size = 1 << max(12, n.bit_length())
            up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
            up[0] = down[0] = 1
            self._powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        up, self.down = self._powers[base]
        self.sums = np.zeros(n + 1, U)
        np.cumsum((np.frombuffer(data, np.uint8).astype(U) + U(1)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


# ---- anchors: where copies of a string meet -----------------------------------------

def window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    rows = -(-len(v) // width)
    x = np.full(rows * width, np.iinfo(U).max, U)
    x[:len(v)] = v
    x = x.reshape(rows, width)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(v) - width + 1
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of starts whose strings have their smallest gram in common.

    Arrays (at, first, last, gram, part): the gram's place, the first and last start, the
    gram's hash, and the hash of the run's bytes and places. Equal strings have equal grams
    at equal places in them, so copies of a string are always in runs of the same gram.
    """
    width = LENGTH - GRAM + 1
    for begin in range(0, len(text) - LENGTH + 1, SEGMENT):
        data = text[begin:begin + SEGMENT + LENGTH - 1]
        with np.errstate(over="ignore"):
            h = PrefixHashes(data)
            grams = mixed(h.of(np.arange(len(data) - GRAM + 1), np.arange(GRAM, len(data) + 1)))
            least = window_minima((grams & ~LOW) | np.arange(len(grams), dtype=U), width)
            place = (least & LOW).astype(np.int64)
            first = np.flatnonzero(np.diff(place, prepend=-1))
            last = np.append(first[1:], len(place)) - 1
            at = place[first]
            part = mixed(h.of(first, last + LENGTH) ^ mixed(((at - first) << 32 | (at - last)).astype(U)))
        yield at + begin, first + begin, last + begin, grams[at], part


ANCHOR = "cid bigint, at bigint, first bigint, last bigint, gram bigint, part bigint"


def anchor_rows(batches):
    """For mapInArrow: (cid, text) to anchors."""
    for batch in batches:
        for cid, text in zip(*(batch.column(k).to_pylist() for k in range(2))):
            for cols in anchors(text or b""):
                n = len(cols[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, cid)), *[pa.array(c.view(np.int64)) for c in cols]],
                    names=["cid", "at", "first", "last", "gram", "part"])


# ---- the suffix sort ----------------------------------------------------------------

class Suffixes:
    """Suffixes of some bytes, compared by prefix hashes."""

    def __init__(self, data: bytes, bound: int):
        self.hash = PrefixHashes(data)
        self.data = np.frombuffer(data, np.uint8)
        self.bound = bound

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that suffixes share, up to the bound: a binary search on equal hashes."""
        low = np.zeros(len(a), np.int64)
        room = np.minimum(self.bound, len(self.data) - np.maximum(a, b))
        high = room.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = self.hash.of(a, a + mid) == self.hash.of(b, b + mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b; equal up to the bound: no."""
        n = self.common(a, b)
        end = n >= np.minimum(self.bound, len(self.data) - np.maximum(a, b))
        last = len(self.data) - 1
        x, y = self.data[np.minimum(a + n, last)], self.data[np.minimum(b + n, last)]
        return np.where(end, (n < self.bound) & (a > b), x < y)

    def sort(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The order of suffixes by (group, string): a mergesort of all groups at once.

        ``group`` ascends. At each level every item of a run looks up its place in the
        run it is merged with, by binary search.
        """
        n = len(start)
        order = np.arange(n)
        begin = np.searchsorted(group, group, "left")
        end = np.searchsorted(group, group, "right")
        width = 1
        while width < (end - begin).max(initial=0):
            local = np.arange(n) - begin
            run = local // width
            left = run % 2 == 0
            other = begin + np.where(left, run + 1, run - 1) * width  # the run it meets
            lo = np.minimum(other, end)
            hi = np.minimum(other + width, end)
            base = lo.copy()
            while True:
                active = np.flatnonzero(lo < hi)
                if not len(active):
                    break
                mid = (lo[active] + hi[active]) // 2
                mine, theirs = start[order[active]], start[order[mid]]
                # Ties keep the left run first.
                after = np.where(left[active], self.less(theirs, mine), ~self.less(mine, theirs))
                lo[active] = np.where(after, mid + 1, lo[active])
                hi[active] = np.where(after, hi[active], mid)
            into = np.where(left, np.arange(n), np.arange(n) - width) + (lo - base)
            merged = np.empty(n, np.int64)
            merged[into] = order
            order = merged
            width *= 2
        return order


def repeated_starts(rows: list[tuple]) -> list[tuple[int, int, int]]:
    """Runs (cid, first, last) of starts whose strings repeat, of rows that were unique.

    ``rows`` hold (gram, cid, at, first, last, n, bytes), ordered by gram; the bytes are
    those of the run's strings. Starts are judged in cells of CELL neighbours, aligned at
    the gram. The suffixes at the core that all strings of a cell share are sorted; where
    neighbours share the core, the cell's strings are compared one by one.
    """
    data = b"".join(r[6] for r in rows)
    gram, at, first, last, n = (np.array([r[k] for r in rows], np.int64) for k in (0, 2, 3, 4, 5))
    offset = np.cumsum([0] + [len(r[6]) for r in rows])[:-1] - first  # place of a text's byte 0
    class_of = np.cumsum(np.diff(gram, prepend=gram[0]) != 0)
    # One unit per row and cell of starts.
    g0, g1 = (at - last) // CELL, (at - first) // CELL
    row = np.repeat(np.arange(len(rows)), g1 - g0 + 1)
    cell = np.arange(len(row)) - np.repeat(np.cumsum(g1 - g0 + 1) - (g1 - g0 + 1), g1 - g0 + 1) + g0[row]
    group = class_of[row] * (LENGTH // CELL + 1) + cell
    by_group = np.argsort(group, kind="stable")
    row, cell, group = row[by_group], cell[by_group], group[by_group]
    core = offset[row] + at[row] - cell * CELL
    with np.errstate(over="ignore"):
        suffixes = Suffixes(data, LENGTH - CELL + 1)
        order = suffixes.sort(core, group)
        row, cell, group, core = row[order], cell[order], group[order], core[order]
        same = (group[1:] == group[:-1]) & (suffixes.common(core[1:], core[:-1]) >= LENGTH - CELL + 1)
        for i in np.flatnonzero(same):  # collision check
            a, b = int(core[i]), int(core[i + 1])
            same[i] = data[a:a + LENGTH - CELL + 1] == data[b:b + LENGTH - CELL + 1]
        shared = np.append(same, False) | np.insert(same, 0, False)
        core_id = np.cumsum(np.insert(~same, 0, True))
        u = np.flatnonzero(shared)
        # The strings of cells that share a core.
        start = core[u][:, None] - np.arange(CELL)
        begin = (start - offset[row[u]][:, None]).ravel()
        valid = (begin >= np.repeat(first[row[u]], CELL)) & (begin <= np.repeat(last[row[u]], CELL))
        unit, shift = np.repeat(u, CELL)[valid], np.tile(np.arange(CELL), len(u))[valid]
        start, begin = start.ravel()[valid], begin[valid]
        keys = [suffixes.hash.of(start, start + LENGTH)]
        by = np.lexsort((keys[0], shift, core_id[unit]))
        equal = ((core_id[unit[by]][1:] == core_id[unit[by]][:-1]) & (shift[by][1:] == shift[by][:-1])
                 & (keys[0][by][1:] == keys[0][by][:-1]))
        if equal.any():  # collision check by another base
            second = PrefixHashes(data, BASES[1])
            x = second.of(start[by], start[by] + LENGTH)
            equal &= x[1:] == x[:-1]
    hit = np.zeros(len(by), bool)
    hit[by] = np.append(equal, False) | np.insert(equal, 0, False)
    hit &= n[row[unit]] == 1  # strings of the others are known to repeat
    r, b = row[unit[hit]], begin[hit]
    order = np.lexsort((b, r))
    r, b = r[order], b[order]
    if not len(r):
        return []
    head = np.insert((r[1:] != r[:-1]) | (b[1:] != b[:-1] + 1), 0, True)
    ends = np.append(np.flatnonzero(head)[1:], len(r)) - 1
    return [(rows[i][1], int(s), int(e)) for i, s, e in zip(r[head], b[head], b[ends])]


def sorted_classes(batches):
    """For mapInArrow: rows as in ``repeated_starts``, ordered by gram, to runs of starts."""
    held: list[tuple] = []

    def flush(rows):
        cols = list(zip(*repeated_starts(rows))) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["cid", "first", "last"])

    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if len(held) * 6 > SORTED and r[0] != held[-1][0]:
                yield flush(held)
                held = []
            held.append(r)
    if held:
        yield flush(held)


# ---- the operator -------------------------------------------------------------------

def text_parts(batches):
    """For mapInArrow: (text, list of runs) to a row per run with its bytes."""
    for batch in batches:
        rows = []
        for cid, text, runs in zip(*(batch.column(k).to_pylist() for k in range(3))):
            rows += [(r["gram"], cid, r["at"], r["first"], r["last"], r["n"], text[r["first"]:r["last"] + LENGTH], r["many"])
                     for r in runs]
        kinds = [pa.int64()] * 6 + [pa.binary(), pa.bool_()]
        cols = list(zip(*rows)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         names=["gram", "cid", "at", "first", "last", "n", "bytes", "many"])


def many_starts(parts: DataFrame) -> DataFrame:
    """Repeated starts in classes too large for one task, by counts of strings.

    Cells whose core occurs once hold no repeated string; the strings of the others are
    counted. Counting combines copies before the shuffle.
    """
    g = lambda c: F.floor((F.col("at") - F.col(c)) / CELL).cast("bigint")
    base = F.col("at") - F.col("cell") * CELL
    cells = parts.withColumn("cell", F.explode(F.sequence(g("last"), g("first")))).withColumn(
        "core", F.xxhash64("gram", "cell", F.substring("bytes", (base - F.col("first") + 1).cast("int"),
                                                       F.lit(LENGTH - CELL + 1))))
    counts = staged(cells.select("core", "cid", "at", "first").groupBy("core").count().where("count > 1").select("core"))
    shared = HashFilter(counts)
    found = shared.keep(cells, F.col("core")).join(counts, "core", "left_semi")
    start = F.explode(F.sequence(F.greatest(F.col("first"), base - CELL + 1), F.least(F.col("last"), base)))
    strings = staged(found.withColumn("start", start).select(
        "cid", "n", "start", F.xxhash64(
            "core", F.col("start") - base,
            F.substring("bytes", (F.col("start") - F.col("first") + 1).cast("int"), F.lit(LENGTH))).alias("string")))
    twice = staged(strings.groupBy("string").count().where("count > 1").select("string"))
    return strings.where("n = 1").join(twice, "string", "left_semi").select(
        "cid", F.col("start").alias("first"), F.col("start").alias("last"))


def repeats(texts: DataFrame) -> DataFrame:
    """(cid, text as binary) to (cid, spans, copied): runs of repeated starts by text.

    ``copied`` texts stand in several rows, so that all their strings repeat.
    """
    copied = staged(texts.where(F.octet_length("text") >= LENGTH).groupBy("cid").count().where("count > 1").select("cid"))
    maybe = HashFilter(copied)
    cols = ["cid", "at", "first", "last", "gram", "part"]
    single = maybe.rest(texts, F.col("cid")).select("cid", "text").mapInArrow(anchor_rows, ANCHOR)
    several = maybe.keep(texts, F.col("cid")).select("cid", "text").mapInArrow(anchor_rows, ANCHOR)
    runs = staged(single.union(several.distinct()))
    # Grams at more than one place.
    grams = staged(runs.groupBy("gram").count().where("count > 1").select("gram"))
    likely = HashFilter(grams)
    runs = staged(likely.keep(runs, F.col("gram")).join(grams, "gram", "left_semi").select(cols))
    # Equal runs are copies of each other; one of them stands for all when runs differ.
    parts = staged(runs.groupBy("gram", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("cid", "at", "first", "last")).alias("one")))
    kinds = staged(parts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    mixed_parts = parts.join(kinds, "gram").select(
        F.col("one.cid").alias("cid"), F.struct(
            "gram", "one.at", "one.first", "one.last", "n", (F.col("kinds") > CLASS).alias("many")).alias("run"))
    wanted = staged(mixed_parts.groupBy("cid").agg(F.collect_list("run").alias("runs")))
    needed = HashFilter(wanted.select("cid"))
    one_each = needed.keep(texts, F.col("cid")).groupBy("cid").agg(F.first("text").alias("text"))
    pieces = staged(one_each.join(wanted, "cid").select("cid", "text", "runs").mapInArrow(
        text_parts, "gram bigint, cid bigint, at bigint, first bigint, last bigint, n bigint, bytes binary, many boolean"))
    few = pieces.where("not many").drop("many").repartition("gram").sortWithinPartitions("gram")
    starts = few.mapInArrow(sorted_classes, "cid bigint, first bigint, last bigint")
    starts = staged(starts.union(many_starts(pieces.where("many"))))
    same = staged(parts.where("n > 1").select("gram", "part"))
    whole = runs.join(same, ["gram", "part"], "left_semi").select("cid", "first", "last")
    spans = starts.union(whole).groupBy("cid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return spans.join(copied.withColumn("copied", F.lit(True)), "cid", "full").select(
        "cid", F.coalesce("spans", F.array().cast("array<struct<first:bigint,last:bigint>>")).alias("spans"),
        F.coalesce("copied", F.lit(False)).alias("copied"))


def cut_text(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes that no repeated string covers, and the maximal removed runs."""
    gone: list[list[int]] = []
    for first, last in sorted(spans):
        if gone and first <= gone[-1][1]:
            gone[-1][1] = max(gone[-1][1], last + LENGTH)
        else:
            gone.append([first, last + LENGTH])
    kept, at = [], 0
    for a, b in gone:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), [(a, b) for a, b in gone]


def cut_rows(batches):
    for batch in batches:
        rows = []
        for doc_id, text, copied, spans in zip(*(batch.column(k).to_pylist() for k in range(4))):
            runs = [(0, len(text) - LENGTH)] if copied else [(s["first"], s["last"]) for s in spans or ()]
            kept, gone = cut_text(text, runs)
            rows.append((doc_id, len(text), kept, [{"first": a, "last": b - 1} for a, b in gone]))
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), span))],
            names=["doc_id", "n_bytes", "kept", "removed"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Returns doc_id, n_bytes, kept (binary) and removed, the maximal runs of bytes cut.

    A byte goes if it lies in a string of LENGTH bytes that also starts anywhere else, in
    this or another document; strings are those of the input. Texts are UTF-8 bytes; a
    missing text is an empty one; shorter texts have no such string. Rows that repeat a
    text are documents each, so all their strings repeat. A missing doc_id is kept as it
    is. An empty table gives an empty table; other columns take no part.

    Runs of starts are named by the smallest gram their strings share, and only grams at
    two places or more are looked at further. Equal runs are copies, known by their
    hash. Where runs of one gram differ, their strings are compared by a suffix sort,
    or by counts where more than CLASS runs differ. Texts are shuffled only if they hold
    such runs or are cut.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    texts = texts.withColumn("cid", F.xxhash64("text"))
    spans = staged(repeats(texts.select("cid", "text")))
    cut = HashFilter(spans.select("cid"))
    touched = cut.keep(texts, F.col("cid")).join(spans, "cid", "left").select(
        "doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "spans")
    schema = "doc_id bigint, n_bytes bigint, kept binary, removed array<struct<first:bigint,last:bigint>>"
    rest = cut.rest(texts, F.col("cid")).select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.col("text").alias("kept"),
        F.array().cast("array<struct<first:bigint,last:bigint>>").alias("removed"))
    return touched.mapInArrow(cut_rows, schema).union(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
