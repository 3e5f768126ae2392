"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.stage import staged
from .common import documents, small_batches
from .perplexity import KINDS, text_counts
from .words import WordBatch, spans

#: Labelled documents, at most, that the document classifier is fitted on: those with the
#: smallest hashes of their doc_id.
FIT_ROWS = 40_000
#: Probabilities of single documents stay this far from 0 and 1.
MARGIN = 1e-4

FEATURES = ("symbols", "bars", "marked", "capitals", "bangs", "digits", "dup_lines", "repeats",
            "distinct", "word_length", "ends", "log_words")
SYMBOL = re.compile(r"[#*$%&<>]")
MARKED = re.compile(rb"[#*$%&<>!]{2,}")
DIGIT = re.compile(r"[0-9]")


def features(raw: bytes, n: int, chars: int, dup_lines: int, repeats: int) -> tuple[float, ...]:
    """The dense features of a text, given its counts; all are 0 for one without words."""
    if not n:
        return (0.0,) * len(FEATURES)
    words, text = raw.split(), raw.decode("utf-8", "replace")
    lower = text.lower()
    capitals = sum(a != b for a, b in zip(text, lower)) if lower != text and len(lower) == len(text) else 0
    return (
        len(SYMBOL.findall(text)) / chars, text.count("|") / n, len(MARKED.findall(raw)) / n,
        capitals / chars, text.count("!") / n, len(DIGIT.findall(text)) / chars,
        dup_lines / (text.count("\n") + 1), repeats / n, len(set(words)) / n, chars / n / 10,
        (text.count(".") + text.count(",")) / n, float(np.log1p(n)) / 10,
    )


def features_of(texts: list[bytes]) -> list[tuple[float, ...]]:
    out = []
    for a, b in spans(texts):
        some = texts[a:b]
        words, chars, _, dup_lines, repeats = (
            c.tolist() for c in text_counts(some, WordBatch(some, KINDS)))
        out += map(features, some, words, chars, dup_lines, repeats)
    return out


def featured(rows: DataFrame, keep: str) -> DataFrame:
    """Rows with ``text`` as binary to the features, besides the ``keep`` columns (DDL)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            cols = list(zip(*features_of([t or b"" for t in texts]))) or [()] * len(FEATURES)
            rest = [(c, batch.column(c)) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [v for _, v in rest] + [pa.array(c, pa.float64()) for c in cols],
                names=[c for c, _ in rest] + list(FEATURES))

    return rows.mapInArrow(run, f"{keep}, " + ", ".join(f"{f} double" for f in FEATURES))


def fit(docs: DataFrame, labels: DataFrame, label: str, rows: int):
    """A logistic regression on a bounded sample, or None without labels of both kinds.

    A labelled id counts once, with its first text, however often it repeats.
    """
    known = staged(
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.join(known, "doc_id").groupBy("doc_id", "label").agg(
        F.min("text").cast("binary").alias("text")).drop("doc_id")
    data = staged(featured(texts, "label double"))
    if data.agg(F.countDistinct("label")).first()[0] < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data)
    return LogisticRegression(regParam=1e-4, maxIter=60).fit(vectors.select("features", "label").coalesce(4))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def concentration(sites: DataFrame, mean: str, n: str, prior: str) -> float:
    """Strength of a beta prior, by moments of the site means around their prior means.

    The spread of site means beyond what their documents' number explains is the variance
    of the prior; without such spread, sites are all but their prior.
    """
    spread = F.sum(F.col(n) * (F.col(mean) - F.col(prior)) ** 2)
    noise = F.sum(F.col(prior) * (1 - F.col(prior)))
    r = sites.agg(
        spread.alias("spread"), noise.alias("noise"), F.sum(n).alias("n"),
        F.sum(F.col(n) * F.col(prior) * (1 - F.col(prior))).alias("scale")).first()
    if not r["n"] or not r["scale"]:
        return 1.0
    between = max(0.0, (r["spread"] - r["noise"]) / r["n"])
    limit = r["scale"] / r["n"]
    return float(min(1e6, max(1.0, limit / between - 1))) if between > 0 else 1e6


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
            label: str = "quality", threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Returns doc_id, host, path, p_document, host_quality, path_quality, quality, kept.

    A document classifier, fitted on at most ``fit_rows`` labelled documents, gives
    p_document. Hosts and paths (pairs of host and path) are judged by all their documents:
    a host's quality is its mean shrunk towards the mean of all documents, a path's its
    mean shrunk towards its host, each by a prior strength that the spread between sites
    suggests, so that sites with few documents stay near the prior. A document is no
    evidence for its own path. Its quality has the log odds of p_document, less those of
    the mean of all documents, plus those of its path. It is kept from ``threshold`` on.

    Missing hosts and paths are sites of their own (''). Missing and empty texts have all
    features 0. Without labels of both kinds p_document is 0.5 and all are kept. Rows that
    repeat a doc_id are judged each. An empty table gives an empty table; other columns
    take no part.
    """
    small_batches(docs.sparkSession)
    classifier = fit(docs.select("doc_id", "text"), labels, label, fit_rows)
    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = docs.select("doc_id", site(host).alias("host"), site(path).alias("path"),
                        F.col("text").cast("binary").alias("text"))
    if classifier is None:
        rows = named.withColumn("p", F.lit(0.5))
    else:
        data = featured(named, "doc_id bigint, host string, path string")
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data)
        rows = classifier.transform(vectors).withColumn("p", vector_to_array("probability")[1])
    p = F.least(F.greatest(F.col("p"), F.lit(MARGIN)), F.lit(1 - MARGIN))
    rows = staged(rows.select("doc_id", "host", "path", p.alias("p_document")))

    paths = staged(rows.groupBy("host", "path").agg(
        F.sum("p_document").alias("path_sum"), F.count(F.lit(1)).alias("path_n")))
    total, n = paths.agg(F.sum("path_sum"), F.sum("path_n")).first()
    mean = total / n if n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"))
    hosts = hosts.withColumn("host_mean", F.col("host_sum") / F.col("host_n")).withColumn("prior", F.lit(mean))
    k = concentration(hosts, "host_mean", "host_n", "prior")
    hosts = staged(hosts.select(
        "host", ((F.col("host_sum") + k * mean) / (F.col("host_n") + k)).alias("host_quality")))
    paths = paths.join(hosts, "host").withColumn("path_mean", F.col("path_sum") / F.col("path_n"))
    k = concentration(paths, "path_mean", "path_n", "host_quality")
    sites = staged(paths.select("host", "path", "host_quality", "path_sum", "path_n"))
    others = F.col("path_sum") - F.col("p_document") + k * F.col("host_quality")
    path_quality = others / (F.col("path_n") - 1 + k)
    odds = logit(F.col("p_document")) - logit(F.lit(mean)) + logit(F.col("path_quality"))
    return (
        rows.join(sites, ["host", "path"])
        .withColumn("path_quality", path_quality)
        .withColumn("quality", 1 / (1 + F.exp(-odds)))
        .select("doc_id", "host", "path", "p_document", "host_quality", "path_quality", "quality",
                (F.col("quality") >= threshold if classifier is not None else F.lit(True)).alias("kept"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
