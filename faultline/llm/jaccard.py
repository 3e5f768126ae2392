"""N-gram Jaccard join with signature trees."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.skew import salted_join
from ..operators.stage import staged
from .common import HashFilter, documents, no_worker_state, plain, row_key, small_batches, without
from .components import components

#: Chance that a link at the very threshold shares no bucket; links above share more.
MISS = 1e-9
#: Minimum hashes in a bucket's key.
ROWS = 4
#: Bits of a set's bitmap.
BITS = 2048
#: Sets that one cell of a large bucket holds on either side.
CELL = 2_000
#: Children of a tree node, and sets of a leaf.
FANOUT = 8

M = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(29)


# ---- sets ---------------------------------------------------------------------------

def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    width = min(width, n)
    h = np.full(n - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = (h ^ codes[k:n - width + 1 + k]) * M
            h ^= h >> SHIFT
    return np.unique(h)


def band_count(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-threshold**ROWS))


def bucket_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """Keys of the buckets of a set: ROWS minimum hashes each."""
    rng = np.random.default_rng(10)
    a = rng.integers(0, 1 << 63, bands * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * ROWS, dtype=np.uint64)
    low = np.full(bands * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(values), 1024):
            part = values[at:at + 1024, None] * a
            part += b
            np.minimum(low, part.min(axis=0), out=low)
        key = np.arange(bands, dtype=np.uint64) * M
        for k in range(ROWS):
            key = (key ^ low[k::ROWS]) * M
            key ^= key >> SHIFT
    return key.view(np.int64)


def bitmap(values: np.ndarray) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    bits[(values % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def set_id(values: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())).view(np.int64))


def sketch(width: int, bands: int):
    """For mapInArrow: (doc_id, text) to a row per document without its shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_worker_state()
        for batch in batches:
            sets = [shingles(t or b"", width) for t in batch.column(1).to_pylist()]
            keys = [bucket_keys(s, bands) if len(s) else np.zeros(0, np.int64) for s in sets]
            ends = np.cumsum([0] + [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([set_id(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bitmap(s) for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                         pa.array(np.concatenate(keys) if keys else [], pa.int64())),
                batch.column(2),
            ], names=["doc_id", "cid", "n", "bits", "keys", "_key"])

    return run


def whole_sets(width: int):
    """For mapInArrow: text to (cid, shingle hashes)."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t or b"", width) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["cid", "items"])

    return run


# ---- signature trees ----------------------------------------------------------------

class Node:
    """Sets of similar size: bits that some or all of them hold, sizes, component if one."""

    __slots__ = ("some", "all", "least", "most", "comp", "kids", "cid")

    def __init__(self, kids: list["Node"]):
        self.kids, self.cid = kids, None
        self.some = self.all = kids[0].some
        for k in kids:
            self.some |= k.some
            self.all &= k.all
        self.least, self.most = min(k.least for k in kids), max(k.most for k in kids)
        comps = {k.comp for k in kids}
        self.comp = comps.pop() if len(comps) == 1 else None

    @classmethod
    def leaf(cls, cid: int, comp: int, n: int, bits: bytes) -> "Node":
        self = cls.__new__(cls)
        self.some = self.all = int.from_bytes(bits, "little")
        self.least = self.most = n
        self.comp, self.cid, self.kids = comp, cid, ()
        return self


def tree(rows: list[tuple]) -> Node:
    """Over (cid, comp, n, bits): sets ordered by component and size, then grouped upwards."""
    level = [Node.leaf(*r) for r in sorted(rows, key=lambda r: (r[1], r[2], r[0]))]
    while len(level) > 1:
        level = [Node(level[i:i + FANOUT]) for i in range(0, len(level), FANOUT)]
    return level[0]


def joined(a: Node, b: Node, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs of sets of different components that may reach num/den, by dual traversal.

    A shingle of a set whose bit no set of the other node holds can't be shared. So at
    most ``most`` less those bits are shared, and that must reach the overlap that the
    smallest sizes ask for.
    """
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if x.comp is not None and x.comp == y.comp:
            continue
        if den * x.most < num * y.least or den * y.most < num * x.least:
            continue
        shared = min(x.most - (x.all & ~y.some).bit_count(), y.most - (y.all & ~x.some).bit_count())
        if (num + den) * shared < num * (x.least + y.least):
            continue
        if x.cid is not None and y.cid is not None:
            yield min(x.cid, y.cid), max(x.cid, y.cid)
        elif y.cid is not None or (x.cid is None and x.most - x.least >= y.most - y.least):
            stack.extend((k, y) for k in x.kids)
        else:
            stack.extend((x, k) for k in y.kids)


def candidate_pairs(num: int, den: int):
    """For mapInArrow on rows ordered by cell: (cell, side, cid, comp, n, bits) to pairs."""

    def pairs_of(left, right):
        if not left or not right:
            return []
        return joined(tree(left), tree(right), num, den)

    def run(batches):
        cell, sides = None, ([], [])
        for batch in batches:
            out = []
            for c, side, *row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if c != cell:
                    out += pairs_of(*sides)
                    cell, sides = c, ([], [])
                sides[side].append(tuple(row))
            yield _pairs(out)
        yield _pairs(list(pairs_of(*sides)))

    def _pairs(rows):
        rows = list(set(rows))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


# ---- the join -----------------------------------------------------------------------

def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose whole sets reach num/den."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def of(side: str) -> DataFrame:
        wanted = HashFilter(pairs.select(side))
        return wanted.keep(sets, F.col("cid")).select(
            F.col("cid").alias(side), F.col("items").alias(f"{side}_items"))

    both = pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "u_items", "v_items")
    return staged(both.mapInArrow(run, "u bigint, v bigint").distinct())


def link_components(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Returns doc_id, n_shingles, component_id, _key (its ``row_key``) and _root (the same
    for all documents of a component, null without shingles) per document.

    A document's set holds its distinct shingles of ``width`` words (A-Z lower-cased, split
    at ASCII white space); with fewer words the whole sequence is one shingle. Documents
    link when the Jaccard index of their sets is num/den or more. component_id is the
    smallest doc_id that links reach. A missing or empty text, or one without words, has
    no shingle and links with nothing. Rows that repeat a doc_id take part each; a missing
    doc_id links like any other but is never the smallest. Other columns take no part.

    Equal sets are one class. Classes meet in buckets keyed by four minimum hashes, as many
    as leave a link at the threshold out with a chance of 1e-9 at most. First each class is
    compared with the most central class it shares a bucket with, which gives most components.
    Then signature trees over each bucket that still holds several components find the
    pairs between them whose overlap bound reaches the threshold. All pairs are verified on
    whole sets. Pairs inside a component change nothing and are not compared.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), row_key().alias("_key"))
    rows = staged(texts.mapInArrow(sketch(width, band_count(num / den)),
                                   "doc_id bigint, cid bigint, n bigint, bits binary, keys array<bigint>, _key bigint"))
    classes = staged(rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first")))
    keyed = rows.where("n > 0").join(
        classes, (rows["cid"] == classes["cid"]) & rows["doc_id"].eqNullSafe(classes["first"])
    ).drop(classes["cid"])
    keyed = staged(keyed.select("cid", "n", F.explode("keys").alias("bucket")).distinct())
    sizes = staged(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = staged(keyed.join(sizes, "bucket").select("bucket", "cid", "size"))

    first = HashFilter(members.select("cid").distinct().join(classes, "cid").select(F.xxhash64("first")))
    sets = staged(first.keep(texts, F.xxhash64("doc_id")).select("text")
                  .mapInArrow(whole_sets(width), "cid bigint, items binary").dropDuplicates(["cid"]))

    links = verified(staged(stars(members)), sets, num, den)
    comps = components(links)
    more = verified(staged(between(members, comps, rows, num, den)), sets, num, den)
    comps = components(links.union(more))

    # The smallest id of each component, back to the documents by class.
    named = classes.join(comps, classes["cid"] == comps["node"], "left").select(
        "cid", "first", F.coalesce("root", "cid").alias("root"))
    least = staged(named.groupBy("root").agg(F.min("first").alias("component_id")))
    by_class = staged(named.join(least, "root").select("cid", "component_id", "root"))
    out = rows.select("doc_id", "n", "_key", F.when(F.col("n") > 0, F.col("cid")).alias("cid")).join(by_class, "cid", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "_key",
        F.col("root").alias("_root"))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest doc_id, a
    missing id last; of several rows with that id the one of the smallest ``row_key``.

    Of rows that are equal in doc_id, lang and text one stays. Documents without shingles
    all stay. Columns that begin with an underscore are dropped.
    """
    docs = plain(docs)
    linked = staged(link_components(docs, width, num, den).where(F.col("_root").isNotNull()).select(
        "_root", "_key", "doc_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    stays = linked.groupBy("_root").agg(F.min(order).alias("s")).select("_root", F.col("s._key").alias("_stays"))
    # A component may hold a third of all rows; the side of those that stay has one row of each.
    gone = salted_join(linked, staged(stays), ["_root"], F.col("_key")).where("_key <> _stays")
    left = without(docs, gone)
    repeated = HashFilter(linked.groupBy("_key").count().where("count > 1").select("_key"))
    single = repeated.keep(left, row_key()).withColumn("_key", row_key())
    with_words = linked.select("_key").distinct()
    single = single.join(with_words, "_key", "left_semi").dropDuplicates(["_key"]).union(
        single.join(with_words, "_key", "left_anti"))
    return repeated.rest(left, row_key()).union(single.select(left.columns))


def stars(members: DataFrame) -> DataFrame:
    """Pairs (u, v) of each class with the most central class that it shares a bucket with.

    Copies of one text are nearer to it than to each other, so the class that meets most
    others is tried first.
    """
    central = members.groupBy("cid").agg(F.sum("size").alias("met"))
    ranked = staged(members.join(central, "cid").select("bucket", "cid", F.struct("met", "cid").alias("rank")))
    pivots = staged(ranked.groupBy("bucket").agg(F.max("rank").alias("pivot")))
    return (
        ranked.join(pivots, "bucket").where(F.col("cid") != F.col("pivot.cid"))
        .groupBy("cid").agg(F.max("pivot").alias("best"))
        .select(F.col("cid").alias("u"), F.col("best.cid").alias("v"))
    )


def between(members: DataFrame, comps: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs (u, v) between components, from buckets that hold several.

    In a bucket, one side of the join is every class, the other all but those of its
    largest component. Large buckets are cut into cells of at most CELL classes a side.
    """
    placed = staged(members.join(comps.withColumnRenamed("node", "cid"), "cid", "left").select(
        "bucket", "cid", F.coalesce("root", "cid").alias("comp")))
    sizes = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = staged(sizes.groupBy("bucket").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all_n"),
        F.max("n").alias("main_n"), F.count(F.lit(1)).alias("comps")).where("comps > 1"))
    a = F.ceil(F.col("all_n") / CELL).cast("int")
    b = F.ceil((F.col("all_n") - F.col("main_n")) / CELL).cast("int")
    inside = placed.join(mixed.select("bucket", "main", a.alias("a"), b.alias("b")), "bucket")
    at = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    cell = lambda i, j: F.struct(F.col("bucket"), i.alias("i"), j.alias("j")).alias("cell")
    left = inside.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).select(
        cell(at(F.col("a")), F.col("k")), F.lit(0).alias("side"), "cid", "comp")
    right = inside.where("comp <> main").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("a") - 1))).select(
        cell(F.col("k"), at(F.col("b"))), F.lit(1).alias("side"), "cid", "comp")
    known = staged(rows.where("n > 0").select("cid", "n", "bits").join(
        inside.select("cid").distinct(), "cid", "left_semi").dropDuplicates(["cid"]))
    dealt = (
        left.union(right).join(known, "cid")
        .select(F.xxhash64("cell").alias("cell"), "side", "cid", "comp", "n", "bits")
        .repartition("cell").sortWithinPartitions("cell")
    )
    return dealt.mapInArrow(candidate_pairs(num, den), "u bigint, v bigint").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(documents(spark, sf_dir)).drop("_key", "_root")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT x, y FROM (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter
    FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id)
  JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * inter >= 85 * (p.n + q.n - inter)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""
