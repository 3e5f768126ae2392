"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.stage import staged
from .common import plain

#: A Poisson law with a larger mean is drawn as a sum of equal parts, so that exp() of its
#: mean stays far from underflow.
PART_MEAN = 16.0
#: Terms of the distribution function; beyond them it is 1 in double precision.
TERMS = 96
#: Pieces that a frequent source is spread over when rates are joined to documents.
SALTS = 32


def rates(docs: DataFrame, weights: dict[str, float] | None = None, key: str = "source",
          epochs: float = 1.0) -> DataFrame:
    """Mean repetitions of a document per source: (key, n, rate).

    A source with weight w and n of all N documents gets the rate epochs * N * w / n, with
    the weights of the sources present summing to 1. No weights: equal shares. Sources
    without a weight get the rate 0; a missing source is a source of its own.
    """
    sizes = docs.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighted = sizes.withColumn("w", F.lit(1.0))
    else:
        table = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
        known = F.when(F.col("_key").isNull(), F.lit(0.0)).otherwise(table[F.col("_key")])
        weighted = sizes.withColumn("w", F.coalesce(known, F.lit(0.0)))
    all_n, all_w = weighted.agg(F.sum("n"), F.sum("w")).first()
    rate = F.lit(float(epochs)) * F.lit(float(all_n or 0)) * F.col("w") / (F.col("n") * F.lit(float(all_w or 1)))
    return staged(weighted.select("_key", "n", rate.alias("rate")))


def distribution(mean: Column) -> Column:
    """The array P(X <= 0), P(X <= 1), ... of a Poisson law."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    ks = F.sequence(F.lit(1), F.lit(TERMS)).cast("array<double>")
    return F.aggregate(ks, start, step, lambda acc: acc["c"])


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the hash of some texts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("bigint") / F.lit(float(2**48))


def identity(docs: DataFrame) -> Column:
    """What seeds a document's draw: its id, or the hash of its text if it has none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, key: str = "source",
              epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """Repeat documents so that sources reach their target weights, in a global shuffle.

    Each document's number of copies is the inverse of the Poisson distribution function
    with its source's rate, at a uniform number hashed from the seed and its doc_id. It is
    exploded by that number and dealt out by a hash of (seed, doc_id, copy); inside each
    partition the rows are ordered by that hash. Adds ``copy`` (from 1) and
    ``shuffle_key``; input columns of these names, or that begin with an underscore, are
    dropped.

    Rows that repeat a doc_id get equal counts and equal keys; their order among each other
    is that of their languages, sources and texts. A missing doc_id is seeded by the text. A
    missing source counts as one source. Empty and missing texts are documents like any
    other. An empty table gives an empty table.
    """
    docs = plain(docs, "copy", "shuffle_key")
    table = rates(docs, weights, key, epochs)
    # At most SALTS sources can each hold more than 1/SALTS of the rows.
    all_n = table.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in table.where(F.col("n") * SALTS > all_n).select("_key").collect()]
    is_hot = lambda c: F.coalesce(c.isin([h for h in hot if h is not None]), F.lit(None in hot))
    copies = F.when(is_hot(F.col("_key")), SALTS).otherwise(1)
    parts = F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int")
    facts = staged(  # small as a rule: Spark sees its size and need not shuffle the texts for it
        table.withColumn("_parts", parts)
        .withColumn("_cdf", distribution(F.col("rate") / F.col("_parts")))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
        .select("_key", "_salt", "_parts", "_cdf")
    )
    who = identity(docs)
    salted = docs.withColumn(
        "_salt", F.when(is_hot(F.col(key)), F.pmod(F.xxhash64(who), F.lit(SALTS)).cast("int")).otherwise(0)
    )
    joined = salted.join(facts, salted[key].eqNullSafe(facts["_key"]) & (salted["_salt"] == facts["_salt"])).drop(
        "_key", "_salt")
    draw = lambda part: F.size(F.filter(
        F.col("_cdf"), lambda c: c <= uniform(F.lit(seed), who, part.cast("string"))))
    count = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda acc, p: acc + draw(p))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), who,
                                                 F.col("copy").cast("string"))), 1, 15), 16, 10).cast("bigint")
    return (
        joined.withColumn("_count", count)
        .where(F.col("_count") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_count"))))
        .drop("_cdf", "_parts", "_count")
        .withColumn("shuffle_key", order)
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key", *[c for c in ("lang", "source", "text") if c in docs.columns])
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return replicate(documents(spark, sf_dir)).select(
        "doc_id", "copy", "source", "lang", "n_chars", "text", "shuffle_key")


SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
totals AS (SELECT sum(n)::DOUBLE AS all_n, count(*)::DOUBLE AS all_w FROM sizes),
rated AS (SELECT source, 1.0::DOUBLE * all_n * 1.0::DOUBLE / (n * all_w) AS rate FROM sizes, totals),
cut AS (SELECT source, greatest(ceil(rate / {PART_MEAN}), 1)::INT AS parts, rate FROM rated),
law AS (
  SELECT source, parts, rate / parts AS mean, 0 AS k, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS c FROM cut
  UNION ALL
  SELECT source, parts, mean, k + 1, p * mean / (k + 1)::DOUBLE, c + p * mean / (k + 1)::DOUBLE
  FROM law WHERE k < {TERMS}),
who AS (SELECT *, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS id FROM documents),
draws AS (
  SELECT w.id, w.source, p.part,
         ('0x' || substr(md5('mix|' || w.id || '|' || p.part), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM (SELECT DISTINCT id, source FROM who) w JOIN cut ON w.source IS NOT DISTINCT FROM cut.source,
       LATERAL (SELECT unnest(range(1, cut.parts + 1)) AS part) p),
counts AS (
  SELECT d.id, d.source, count(*) AS copies FROM draws d JOIN law l
  ON d.source IS NOT DISTINCT FROM l.source AND l.c <= d.u GROUP BY d.id, d.source)
SELECT w.doc_id, c.copy::INT AS copy, w.source, w.lang, w.n_chars, w.text,
       ('0x' || substr(md5('mix|order|' || w.id || '|' || c.copy), 1, 15))::BIGINT AS shuffle_key
FROM who w JOIN counts k ON w.id = k.id AND w.source IS NOT DISTINCT FROM k.source,
     LATERAL (SELECT unnest(range(1, k.copies + 1)) AS copy) c
"""
