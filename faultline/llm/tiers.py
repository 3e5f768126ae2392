"""Hierarchical packing of tokenised documents into windows of several lengths."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.stage import staged
from .common import documents, rank_in_group, with_row_id
from .packing import cut_documents
from .words import byte_batches

#: Context sizes, longest first. All are powers of two, so a full window needs no padding.
TIERS = (4096, 2048, 1024, 512)
#: Id that ends every document.
END = 2
#: Tokens that a step trains on.
STEP_TOKENS = 32 * 4096


class TierPlan:
    """Where items of each length go, worked out on their counts alone.

    An item belongs to the shortest tier that holds it. Tiers are packed from the longest
    down, and gaps of their windows are filled with the longest items of shorter tiers that
    fit. Windows that still have a gap are sorted by how full they are; the emptiest are
    taken apart, just as many as their tokens fill the gaps of the others: the tokens form
    one line, the gaps another, and both are laid side by side. What is left at the end,
    less than a window, is cut at powers of two.

    The work and the tables depend on the number of lengths, never on the number of items.
    """

    def __init__(self, counts: dict[int, int], tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.left)
        #: (tier, windows, [(length, copies in each), ...], gap)
        self.packed: list[tuple[int, int, list[tuple[int, int]], int]] = []
        for tier in tiers:
            self._pack(tier)
        self._close()
        self._number()

    def _take(self, s: int, n: int) -> None:
        self.left[s] -= n
        if not self.left[s]:
            del self.left[s]
            self.sizes.remove(s)

    def _pack(self, tier: int) -> None:
        shorter = max((t for t in self.tiers if t < tier), default=0)
        while self.sizes and self.sizes[-1] > shorter:
            open_windows = [(self._count(self.sizes[-1], tier), [], tier)]
            while open_windows:
                windows, items, gap = open_windows.pop()
                at = bisect.bisect_right(self.sizes, gap)
                if not at:
                    self.packed.append((tier, windows, items, gap))
                    continue
                s = self.sizes[at - 1]
                copies, n = gap // s, self.left[s]
                full = min(windows, n // copies)
                if full:
                    open_windows.append((full, [*items, (s, copies)], gap - full_size(s, copies)))
                    self._take(s, full * copies)
                rest, over = windows - full, n - full * copies
                if rest and over:
                    open_windows.append((1, [*items, (s, over)], gap - full_size(s, over)))
                    self._take(s, over)
                    rest -= 1
                if rest:
                    open_windows.append((rest, items, gap))

    def _count(self, s: int, tier: int) -> int:
        """Windows that the items of the longest length open."""
        return -(-self.left[s] // (tier // s))

    def _close(self) -> None:
        self.kept = [w for w in self.packed if w[3] == 0]
        partly = sorted((w for w in self.packed if w[3]), key=lambda w: ((w[0] - w[3]) / w[0], w[0], w[3]))
        need = sum(n * gap for _, n, _, gap in partly)
        #: (windows, items) whose tokens go into gaps.
        self.apart: list[tuple[int, list[tuple[int, int]]]] = []
        for tier, n, items, gap in partly:
            gone = min(n, max(0, -(-need // tier)))
            need -= gone * tier
            if gone:
                self.apart.append((gone, items))
            if n > gone:
                self.kept.append((tier, n - gone, items, gap))
        #: Lengths of the last sequences.
        self.tail = [1 << b for b in reversed(range(max(0, -need).bit_length())) if -need >> b & 1]

    def _number(self) -> None:
        cost = lambda w: sum(q * s * s for s, q in w[2])
        self.kept.sort(key=lambda w: (-w[0], -cost(w)))
        used: dict[int, int] = {}
        whole, gaps, lines = [], [], []
        at = 0
        for tier, n, items, gap in self.kept:
            offset = 0
            for s, q in items:
                first = used.get(s, 0)
                whole.append((s, first, at, q, offset, tier))
                used[s] = first + n * q
                offset += s * q
            if gap:
                gaps.append((n, gap, at, offset, tier))
            at += n
        for size in self.tail:
            gaps.append((1, size, at, 0, size))
            at += 1
        place = 0
        for n, items in self.apart:
            for s, q in items:
                first = used.get(s, 0)
                lines.append((s, first, place))
                used[s] = first + n * q
                place += n * q * s
        self.sequences = at
        self.tokens = sum(n * (t - g) for t, n, _, g in self.packed)
        places, place = [], 0
        for n, gap, *rest in gaps:
            places.append((place, gap, *rest))
            place += n * gap
        table = lambda rows, names: dict(zip(
            names, np.array(sorted(rows), np.int64).reshape(-1, len(names)).T))
        #: Items of rank ``first`` on go into windows as they are; ``apart`` ones to a place in the line.
        self.whole = table(whole, ("length", "first", "window", "copies", "offset", "tier"))
        self.line = table(lines, ("length", "first", "place"))
        self.gaps = table(places, ("place", "gap", "window", "offset", "tier"))
        #: From this rank on, items of a length are taken apart.
        self.lengths_apart = sorted({s for s, _, _ in lines})
        self.first_apart = {s: min(f for t, f, _ in lines if t == s) for s in self.lengths_apart}


def full_size(s: int, copies: int) -> int:
    return s * copies


def _row_of(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    key = lambda a, b: a * (1 << 48) + b
    return np.searchsorted(key(table["length"], table["first"]), key(length, rank), side="right") - 1


def laid(plan: TierPlan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of items: item, start in it, length, sequence, offset, tier, and whether the item
    was taken apart."""
    far = np.array([plan.first_apart.get(int(s), 1 << 62) for s in length], np.int64)
    apart = rank >= far
    a = np.flatnonzero(~apart)
    at = _row_of(plan.whole, length[a], rank[a])
    t = {k: v[at] for k, v in plan.whole.items()}
    nth = rank[a] - t["first"]
    whole = (a, np.zeros(len(a), np.int64), length[a], t["window"] + nth // t["copies"],
             t["offset"] + nth % t["copies"] * length[a], t["tier"])
    b = np.flatnonzero(apart)
    at = _row_of(plan.line, length[b], rank[b])
    begin = plan.line["place"][at] + (rank[b] - plan.line["first"][at]) * length[b] if len(b) else b
    end = begin + length[b]
    cut: list[tuple[np.ndarray, ...]] = []
    item, place = b, begin
    while len(item):
        g = np.searchsorted(plan.gaps["place"], place, side="right") - 1
        t = {k: v[g] for k, v in plan.gaps.items()}
        nth, inside = np.divmod(place - t["place"], t["gap"])
        size = np.minimum(end - place, t["gap"] - inside)
        cut.append((item, place - begin, size, t["window"] + nth, t["offset"] + inside, t["tier"]))
        more = place + size < end
        item, begin, end, place = item[more], begin[more], end[more], (place + size)[more]
    cols = [np.concatenate([whole[i], *(c[i] for c in cut)]) for i in range(6)]
    return (*cols, np.repeat([False, True], [len(a), len(cols[0]) - len(a)]))


def step_of(sequence: np.ndarray, steps: int) -> np.ndarray:
    """Deal sequences, longest and costliest first, to and fro over the steps."""
    lap, at = np.divmod(sequence, steps)
    return np.where(lap % 2 == 0, at, steps - 1 - at)


PLACED = ("doc_id bigint, _rid bigint, start bigint, inside bigint, length bigint, ids_crc32 bigint, "
          "doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint, apart boolean")


def pack_tiers(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end: int = END,
               step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Documents as token pieces in windows of several lengths, all of them full.

    Each document is its ids and the id ``end``; what is longer than the longest tier is cut
    there into whole windows, and the rest is routed to the shortest tier that holds it.
    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, tier (the sequence's length) and step_group: groups of sequences of about
    ``step_tokens`` tokens, which hold as many of each tier, give or take one, and like
    amounts of attention work.

    Missing and empty texts are one id ``end``. Rows that repeat a doc_id are packed each; a
    missing doc_id stays missing. Other columns take no part. An empty table gives an empty
    table. ``tiers`` are powers of two, longest first.
    """
    byte_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    pieces = with_row_id(texts.mapInArrow(
        cut_documents(tokenizer, tiers[0], end, ids=True),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"))
    slim = pieces.drop("ids", "piece")
    counts = {r[0]: r[1] for r in slim.groupBy("length").count().collect()}  # <= tiers[0] rows
    plan = TierPlan(counts, tiers)
    steps = max(1, -(-plan.tokens // step_tokens))
    ranked = rank_in_group(slim, ["length"], "_rank")

    def place(batches):
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))
            length, rank = (col(c).to_numpy().astype(np.int64) for c in ("length", "_rank"))
            item, inside, size, sequence, offset, tier, apart = laid(plan, length, rank)
            of = pa.array(item)
            yield pa.RecordBatch.from_arrays(
                [col("doc_id").take(of), col("_rid").take(of),
                 pa.array(col("start").to_numpy()[item] + inside), pa.array(inside), pa.array(size),
                 col("ids_crc32").take(of), col("doc_tokens").take(of), pa.array(sequence), pa.array(offset),
                 pa.array(tier.astype(np.int32)), pa.array(step_of(sequence, steps)), pa.array(apart)],
                names=["doc_id", "_rid", "start", "inside", "length", "ids_crc32", "doc_tokens", "sequence_id",
                       "offset", "tier", "step_group", "apart"])

    cols = ["doc_id", "_rid", "start", "length", "ids_crc32", "doc_tokens", "_rank"]
    placed = staged(ranked.select(*cols).mapInArrow(place, PLACED))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    whole = placed.where(~F.col("apart")).select(*out)
    if not plan.lengths_apart:
        return whole
    # Only items that were taken apart need their ids again.
    ids = pieces.where(F.col("length").isin(plan.lengths_apart)).select("_rid", "ids")
    part = F.substring("ids", F.col("inside").cast("int") * 4 + 1, F.col("length").cast("int") * 4)
    cut = placed.where("apart").join(ids, "_rid").withColumn("ids_crc32", F.crc32(part)).select(*out)
    return whole.union(cut)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_tiers(documents(spark, sf_dir), str(public_tokenizers.path("word_bpe_49k.json")))
