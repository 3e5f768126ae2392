"""Best-fit packing of tokenised documents after dominance reduction."""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, rank_in_group, with_row_id, worker_state
from .words import WordBatch, byte_batches, byte_kinds, lower_bytes, spans

CAPACITY = 2048
#: Id that ends every document.
END = 0
#: Words whose ids a Python worker remembers.
KNOWN_WORDS = 800_000
#: Bytes of a long text that are split into words at once.
CHUNK = 1 << 20

#: ASCII white space parts words; letters A-Z are lower-cased.
KINDS, LOWER = byte_kinds(b" \t\n\r\x0b\x0c"), lower_bytes()

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


# ---- tokens -------------------------------------------------------------------------

def text_parts(text: bytes) -> Iterator[bytes]:
    """A text in bounded parts, cut at white space."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end]
        at = end


class WordIds:
    """Token ids by word, as little-endian 32-bit bytes.

    The tokenizer never joins what ASCII white space separates, and lower-cases, so a
    text's ids are those of its words in turn, and frequent words are encoded once.
    """

    #: Letters that normalising keeps letters, and marks that end a letter run.
    LETTERS = "[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"
    TAIL = re.compile(f"({LETTERS})([.,;:!?|)\\]}}]*)")
    #: Words encoded as one text.
    RUN = 512

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[ends] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in out]

    def encode_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, each of which is one unit to the tokenizer: many
        are encoded as one text and parted after the ids that end a word."""
        out = []
        for at in range(0, len(words), self.RUN):
            run = words[at:at + self.RUN]
            ids = np.frombuffer(self.encode([" ".join(run)])[0], "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            assert len(cuts) == len(run)
            data, places = ids.tobytes(), (4 * cuts).tolist()
            out += [data[i:j] for i, j in zip([0, *places], places)]
        return out

    def learn(self, missing: set[bytes]) -> dict[bytes, bytes]:
        """Ids of new words; a letter run and the marks that end it are encoded apart."""
        parts = {w: m.groups() if (m := self.TAIL.fullmatch(w.decode())) else None for w in missing}
        ids = {x: self.known.get(x.encode()) for p in parts.values() if p for x in p if x}
        stems = list({p[0] for p in parts.values() if p and ids[p[0]] is None})
        others = list({p[1] for p in parts.values() if p and p[1] and ids[p[1]] is None}
                      | {w.decode() for w, p in parts.items() if not p})
        ids.update(zip(stems, self.encode_letters(stems)))
        ids.update(zip(others, self.encode(others)))
        new = {w: ids[p[0]] + ids[p[1]] if p and p[1] else ids[w.decode()] for w, p in parts.items()}
        if len(self.known) + len(new) <= KNOWN_WORDS:
            self.known.update(new)
        return new

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids."""
        parts, of, out = [], [], [[] for _ in texts]
        for i, text in enumerate(texts):
            if b"<|" in text:  # may hold the name of a special token, in any case
                out[i] = self.encode([text.decode()])
                continue
            for part in text_parts(text):
                parts.append(part)
                of.append(i)
        for a, b in spans(parts):
            data, ends = self._flat(WordBatch(parts[a:b], KINDS, LOWER), b - a)
            for i, x, y in zip(of[a:b], [0, *ends], ends):
                out[i].append(data[x:y])
        return [b"".join(x) for x in out]

    def _flat(self, batch: WordBatch, n: int) -> tuple[bytes, list[int]]:
        """The ids of n texts in turn, and where each text's bytes end. A distinct word is
        looked up once; its ids are gathered for all its places together."""
        found = list(map(self.known.get, batch.words))
        if None in found:
            new = self.learn({w for w, f in zip(batch.words, found) if f is None})
            found = [f if f is not None else new[w] for w, f in zip(batch.words, found)]
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        pool = np.frombuffer(b"".join(found), "<u4")
        size = sizes[batch.code]
        ends = np.cumsum(size, dtype=np.int64)
        shift = (np.cumsum(sizes, dtype=np.int64) - sizes)[batch.code] - (ends - size)
        ids = pool[np.repeat(shift, size) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.searchsorted(batch.text, np.arange(n), side="right")
        return ids.tobytes(), (4 * np.append(0, ends)[last]).tolist()


def cut_documents(path: str, capacity: int = CAPACITY, end: int = END, ids: bool = False):
    """A function for mapInArrow: batches of (doc_id, text as binary) to pieces; with
    ``ids`` also the tokens of each document and the ids of pieces shorter than capacity."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["doc_tokens", "ids"] * ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.int64(), pa.binary()] * ids
    width, last = 4 * capacity, end.to_bytes(4, "little")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("word_ids")
        words = state.get(path) or state.setdefault(path, WordIds(path))
        for batch in batches:
            rows = []
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for doc_id, tokens in zip(batch.column(0).to_pylist(), words.ids(texts)):
                tokens += last
                for piece, at in enumerate(range(0, len(tokens), width)):
                    part = tokens[at:at + width]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, len(tokens) // 4, part if len(part) < width else None) if ids else row)
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return cut


# ---- the plan: on counts by length, never on documents ------------------------------

class Plan:
    """How many items of each length go where: groups of bins that are filled alike."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.left)
        #: (bins, [(length, copies in a bin), ...])
        self.groups: list[tuple[int, list[tuple[int, int]]]] = []
        self.reduced = 0

    def _largest(self, bound: int) -> int | None:
        """The largest length that is left, up to a bound."""
        at = bisect.bisect_right(self.sizes, bound)
        return self.sizes[at - 1] if at else None

    def _fix(self, bins: int, items: dict[int, int]) -> None:
        self.groups.append((bins, sorted(items.items(), reverse=True)))
        self.reduced += bins
        for s, n in items.items():
            self.left[s] -= bins * n
            if not self.left[s]:
                del self.left[s]
                self.sizes.remove(s)

    def _smallest(self, n: int, without: int) -> int:
        """Sum of the n smallest items besides one of length ``without``; too few: inf."""
        total = 0
        for s in self.sizes:
            have = self.left[s] - (s == without)
            take = min(n, have)
            total, n = total + take * s, n - take
            if not n:
                return total
        return self.capacity + 1

    def _dominating(self, j: int) -> dict[int, int] | None:
        """A set with an item of length j that dominates every other feasible one."""
        room = self.capacity - j
        fits = self._largest(room) if self.left[j] > 1 else self._largest_but(room, j)
        if fits is None:
            return {j: 1}  # nothing else fits
        pair = {j: 2} if fits == j else {j: 1, fits: 1}
        if fits == room or self._smallest(2, j) > room:
            return pair  # fills the bin, or no two others fit
        if self._smallest(3, j) > room:
            # At most two others fit. The best two dominate if the first is the largest
            # that fits and no pair has a longer second.
            spare = dict(self.left)
            for s in (j, fits):
                spare[s] -= 1
            second = next((s for s in reversed(self.sizes) if s <= room - fits and spare[s] > 0), None)
            half = self._largest(room // 2)
            if second is not None and half is not None and half <= second:
                items: dict[int, int] = {}
                for s in (j, fits, second):
                    items[s] = items.get(s, 0) + 1
                return items
        return None

    def _largest_but(self, bound: int, j: int) -> int | None:
        found = self._largest(bound)
        return self._largest(j - 1) if found == j else found

    def reduce(self) -> None:
        """Martello-Toth reduction, from the longest items down, until nothing more is fixed."""
        changed = True
        while changed:
            changed = False
            for j in reversed(list(self.sizes)):
                while j in self.left and (items := self._dominating(j)):
                    # The set stays dominating while its lengths last, save when a
                    # length nears its end: then it is judged again.
                    bins = min(self.left[s] // n for s, n in items.items())
                    self._fix(max(1, bins - 1), items)
                    changed = True

    def best_fit(self) -> None:
        """Best-fit decreasing on what is left; equal bins are filled together."""
        spaces: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
        rooms: list[int] = []

        def put(room: int, bins: int, items: list[tuple[int, int]]) -> None:
            if not bins:
                return
            if room not in spaces:
                bisect.insort(rooms, room)
            spaces.setdefault(room, []).append((bins, items))

        for s in sorted(self.left, reverse=True):
            n = self.left[s]
            while n:
                at = bisect.bisect_left(rooms, s)
                if at < len(rooms):
                    room = rooms[at]
                    bins, items = spaces[room].pop()
                    if not spaces[room]:
                        del spaces[room], rooms[at]
                else:
                    room, items = self.capacity, []
                    bins = -(-n // (room // s))
                q = room // s
                full = min(bins, n // q)
                put(room - q * s, full, [*items, (s, q)])
                n, bins = n - full * q, bins - full
                if bins and n:
                    put(room - n * s, 1, [*items, (s, n)])
                    n, bins = 0, bins - 1
                if items:
                    put(room, bins, items)
        self.groups += [g for room in rooms for g in spaces[room]]
        self.left, self.sizes = {}, []

    def table(self) -> dict[str, np.ndarray]:
        """One row per group and length: items of rank first..first+n-1 of that length go
        to bins from ``bin`` on, ``copies`` in each, from ``offset`` on."""
        rows, used, bin_at = [], {}, 0
        for bins, items in self.groups:
            offset = 0
            for s, q in items:
                first = used.get(s, 0)
                rows.append((s, first, bin_at, q, offset))
                used[s] = first + bins * q
                offset += s * q
            bin_at += bins
        rows.sort()
        cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
        return dict(zip(("length", "first", "bin", "copies", "offset"), cols))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    out = Plan(counts, capacity)
    out.reduce()
    out.best_fit()
    return out


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that ``with_row_id`` has staged.

    Packing needs only how many pieces have each length, at most ``capacity`` counts. The
    reduction fixes whole groups of bins for sets of up to three pieces that dominate all
    others; best fit places the rest. The plan says for each length which ranks go to
    which bins, and its size depends on the capacity alone, never on the data.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # <= capacity rows
    table = plan(counts, capacity).table()
    ranked = rank_in_group(pieces, ["length"], "_rank")

    def place(frames):
        for f in frames:
            length, rank = f["length"].to_numpy(), f["_rank"].to_numpy()
            at = np.searchsorted(table["length"] * (1 << 48) + table["first"],
                                 length * (1 << 48) + rank, side="right") - 1
            nth = rank - table["first"][at]
            copies = table["copies"][at]
            f["sequence_id"] = table["bin"][at] + nth // copies
            f["offset"] = table["offset"][at] + nth % copies * length
            yield f[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInPandas(
        place, PIECES + ", sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents as token pieces in as few sequences of ``capacity`` as can be found.

    Each document is its ids and the id 0; one longer than a sequence is cut into pieces
    of ``capacity``, the last of which may be shorter. Returns a row per piece: doc_id,
    piece, start, length, ids_crc32, sequence_id, offset. Missing and empty texts are one
    id 0. Rows that repeat a doc_id are packed each; a missing doc_id stays missing. Other
    columns take no part. An empty table gives an empty table.
    """
    byte_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return placed(with_row_id(texts.mapInArrow(cut_documents(tokenizer, capacity), PIECES)), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), str(public_tokenizers.path("word_bpe_49k.json")))
