"""Approximate nearest neighbours with a hash-prefix forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Trees, and bits of a hash string.
TREES, BITS = 64, 32
#: Share of a block that a query looks at before it stops ascending.
SHARE = 0.7
#: Vectors of a block, and queries that meet a block at once.
BLOCK, QUERIES = 16_384, 4_096
#: What rounding may put between two ways of summing a product, relative to the norms.
ROUNDING = 1e-9


def hash_strings(x: np.ndarray) -> np.ndarray:
    """A string of sign bits per vector and tree, as integers: (trees, vectors)."""
    planes = np.random.default_rng(5).standard_normal((x.shape[1], TREES * BITS))
    out = np.empty((TREES, len(x)), np.uint64)
    weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    for t in range(TREES):
        signs = (x @ planes[:, t * BITS:(t + 1) * BITS]) > 0
        out[t] = signs.astype(np.uint64) @ weights
    return out


class Forest:
    """Sorted arrays of hash strings, one per tree, over a block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        strings = hash_strings(x)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def ranges(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings with the queries' prefix of this depth lie: (trees, queries)."""
        drop = np.uint64(BITS - depth)
        low = (strings >> drop) << drop
        high = low + (np.uint64(1) << drop)
        ends = [(np.searchsorted(s, lo, "left"), np.searchsorted(s, hi, "left"))
                for s, lo, hi in zip(self.sorted, low, high)]
        return np.array([e[0] for e in ends]), np.array([e[1] for e in ends])

    def candidates(self, q: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """A mask of the block per query.

        Each tree is descended to its longest prefix match; then all trees ascend in step,
        a bit at a time, until together they hold ``least`` different vectors or all.
        """
        strings = hash_strings(q)
        levels = [self.ranges(strings, d) for d in range(BITS + 1)]
        total = np.array([(hi - lo).sum(axis=0) for lo, hi in levels])  # (depth, query)
        for i in range(len(q)):
            # Ranges at this depth and deeper hold too few, however they overlap.
            depth = min(int(np.flatnonzero(total[:, i] >= min(least, len(self.ids)))[-1]) + 1, BITS)
            mask, seen = np.zeros(len(self.ids), bool), 0
            while depth >= 0 and seen < least:
                lo, hi = levels[depth][0][:, i], levels[depth][1][:, i]
                for t in range(TREES):
                    mask[self.order[t, lo[t]:hi[t]]] = True
                    if t % 8 == 7 and total[depth, i] >= least:
                        seen = np.count_nonzero(mask)
                        if seen >= least:
                            break
                depth -= 1
            yield mask

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
        least = max(4 * k, int(np.ceil(SHARE * len(self.ids))))
        norms = np.sqrt((self.x**2).sum(axis=1).max() * (q**2).sum(axis=1))
        found = []
        for i, mask in enumerate(self.candidates(q, least)):
            mask &= self.ids != query_ids[i]
            at = np.flatnonzero(mask)
            if len(at) > k:  # all that may be among the k best once summed exactly
                rough = self.x[at] @ q[i]
                worst = np.partition(rough, len(at) - k)[len(at) - k]
                at = at[rough >= worst - ROUNDING * norms[i]]
            score = (self.x[at] * q[i]).sum(axis=1)  # one order of summing for equal vectors
            best = np.lexsort((self.ids[at], -score))[:k]
            found.append(pd.DataFrame({"query_id": query_ids[i], "vec_id": self.ids[at][best], "score": score[best]}))
        return pd.concat(found) if found else pd.DataFrame(
            {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
            vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Each query's ``k`` nearest found among all other rows, by largest inner product.

    Returns query_id, rank (from 1), vec_id, score: nearest first, ties to the smaller
    vec_id. The score is the inner product in double precision of the original vectors.

    Rows are dealt into blocks by the hash of their id and vector; in each block a forest is built
    once and every query meets every block: it descends to the longest prefix match of
    each tree and ascends in all trees at once until it has seen SHARE of the block. What
    it has seen is scored exactly; the best of all blocks are merged.

    Vectors that are null, zero, or hold a null or a non-finite component take no part,
    nor do rows without an id. Only vectors of equal length are compared. Rows that repeat
    an id and vector count once. An id with several vectors is found by the best of them and,
    as a query, asks with each: a vec_id may then come twice, with different scores. A query
    never finds its own id. A query with fewer than
    ``k`` candidates gets all of them. An empty table gives an empty table.
    """
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = (
        vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"), is_query.alias("q"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound & F.exists("v", lambda c: c != 0))
        .dropDuplicates(["vec_id", "v"])
    )
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    blocks, chunks = max(1, -(-n // block)), max(1, -(-asked // QUERIES))
    part = lambda m, seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(m)).cast("int")
    index = rows.select(F.size("v").alias("dim"), part(blocks, 1).alias("block"), "vec_id", "v")
    queries = rows.where("q").select(
        F.size("v").alias("dim"), part(chunks, 2).alias("chunk"), "vec_id", "v",
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    index = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        left = left.sort_values("vec_id", kind="stable")
        forest = Forest(left["vec_id"].to_numpy(), matrix(left["v"]))
        parts = [forest.search(right["vec_id"].to_numpy()[i:i + 256], matrix(right["v"][i:i + 256]), k)
                 for i in range(0, len(right), 256)]
        return pd.concat(parts)

    keys = ["dim", "block", "chunk"]
    found = index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(
        search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.dropDuplicates(["query_id", "vec_id", "score"])
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 20 == 0)
