"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.stage import staged
from .common import documents, small_batches

#: Labelled rows, at most, that the lexicon, the trees and the calibration are fitted on:
#: those with the smallest hashes of their doc_id.
FIT_ROWS = 40_000
#: Entries of the lexicon learned from the labels, at most; those of the highest
#: likelihood ratio stay.
LEXICON_ENTRIES = 1_000
#: Lengths of word beginnings that may be entries, as insults are inflected.
STEMS = (4, 5, 6)
#: An entry stands in this share of the toxic texts at least, this many times as often as
#: in the others, and has this likelihood ratio.
SUPPORT, TIMES, RATIO = 0.01, 20.0, 20.0
#: Words whose features a task remembers.
KNOWN_WORDS = 200_000
TREES, DEPTH = 20, 4

#: Characters written for letters, and the letters. Fixed values.
LOOKALIKES = str.maketrans("01345789@$!|", "oieastbgasil")
#: Second-person words of the languages at hand. Fixed values.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch sie "
    "tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
MARKS = re.compile(r"[^\w\s]", re.ASCII)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words on either side within which a second person counts as near.
NEAR = 4

FEATURES = ("hits", "density", "masked_hits", "near_second_person", "capitals", "shouted", "marks",
            "bangs", "masked", "log_words")


def plain(word: str) -> str:
    """A word's letters, lower-cased."""
    return "".join(ch for ch in word.lower() if ch.isalpha())


def unmasked(word: str) -> str:
    """A word with look-alike characters read as letters."""
    return "".join(ch for ch in word.lower().translate(LOOKALIKES) if ch.isalpha())


def entries(word: str) -> list[str]:
    """What of a word may stand in the lexicon: itself, and its beginnings with a dash."""
    return [word] + [word[:k] + "-" for k in STEMS if k < len(word)]


def distinct_entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (label, text) to counts of texts with an entry, (entry, label, n)."""
    held: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def flush() -> pa.RecordBatch:
        rows = [(e, label, n) for label, c in held.items() for e, n in c.items()]
        cols = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int64()))],
            names=["entry", "label", "n"])

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = {plain(w) for w in WORD.findall(text or "")} - {""}
            held[label].update({e for w in words for e in entries(w)})
        if sum(map(len, held.values())) > 4 * KNOWN_WORDS:
            yield flush()
            held = {0: Counter(), 1: Counter()}
    yield flush()


def learn_lexicon(labelled: DataFrame) -> list[str]:
    """Entries that mark toxic texts. Copies of a text count once."""
    texts = labelled.dropDuplicates(["text"])
    counts = texts.select("label", "text").mapInArrow(distinct_entries, "entry string, label int, n bigint")
    of = lambda k: F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0))
    n = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}  # two rows
    n1, n0 = float(n.get(1, 0)), float(n.get(0, 0))
    if not n1 or not n0:
        return []
    bad, good = F.col("bad"), F.col("good")
    all_n = (bad + good) / (n1 + n0)
    term = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    found = (
        counts.groupBy("entry").agg(of(1).alias("bad"), of(0).alias("good"))
        .where((F.length("entry") > 2) & (bad >= max(3.0, SUPPORT * n1)) & (bad / n1 >= TIMES * (good + 0.5) / n0))
        .withColumn("ratio", 2 * (term(bad, all_n * n1) + term(good, all_n * n0)))
        .where(F.col("ratio") >= RATIO)
    )
    top = found.orderBy(F.desc("ratio"), "entry").limit(LEXICON_ENTRIES).collect()
    return [r["entry"] for r in top]


def word_marks(word: str, lexicon: frozenset) -> tuple[bool, bool, bool, bool]:
    """Whether a word is in the lexicon, is so once unmasked, is a second person, is masked."""
    bare = plain(word)
    hit = any(e in lexicon for e in entries(bare))
    core = word.strip(".,;:!?()\"'")
    odd = bool(bare) and not core.isalpha()
    hidden = odd and not hit and any(e in lexicon for e in entries(unmasked(core)))
    return hit, hidden, bare in SECOND_PERSON, odd


def features(text: str, lexicon: frozenset, known: dict) -> tuple[float, ...]:
    """The dense features of a text; all are 0 for one without words."""
    words = WORD.findall(text)
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    if len(known) > KNOWN_WORDS:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = word_marks(w, lexicon)
    hit, hidden, second, odd = zip(*map(known.__getitem__, words))
    at = [i for i, (a, b) in enumerate(zip(hit, hidden)) if a or b] if any(hit) or any(hidden) else []
    you = [i for i, m in enumerate(second) if m] if at else []
    near = sum(1 for i in at if (k := bisect.bisect_left(you, i - NEAR)) < len(you) and you[k] <= i + NEAR)
    hits, masked = sum(hit), sum(hidden)
    lower = text.lower()
    capitals = sum(a != b for a, b in zip(text, lower)) if lower != text and len(lower) == len(text) else 0
    return (
        float(hits), 100.0 * hits / n, float(masked), float(near), capitals / len(text),
        sum(map(str.isupper, words)) / n, len(MARKS.findall(text)) / len(text),
        (text.count("!") + text.count("?")) / n, sum(odd) / n, float(np.log1p(n)),
    )


def featured(rows: DataFrame, lexicon: list[str], keep: str) -> DataFrame:
    """(doc_id, text, ``keep`` columns as DDL) to the features, one column each."""
    entries_ = frozenset(lexicon)

    def run(batches):
        known: dict = {}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            cols = list(zip(*[features(t or "", entries_, known) for t in texts])) or [()] * len(FEATURES)
            rest = [(c, batch.column(c)) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [v for _, v in rest] + [pa.array(c, pa.float64()) for c in cols],
                names=[c for c, _ in rest] + list(FEATURES))

    return rows.mapInArrow(run, f"{keep}, " + ", ".join(f"{f} double" for f in FEATURES))


def in_test(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is held out: crc32 of its id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


class Scorer:
    """Fitted lexicon, trees and calibration."""

    def __init__(self, labelled: DataFrame):
        """``labelled`` holds doc_id, text and label (0 or 1), at most FIT_ROWS rows."""
        self.lexicon = learn_lexicon(labelled)
        rows = staged(featured(labelled.select("doc_id", "label", "text"), self.lexicon, "doc_id bigint, label int"))
        self.assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        self.prior = rows.agg(F.avg("label")).first()[0]
        self.trees = self.calibration = None
        if rows.agg(F.countDistinct("label")).first()[0] < 2:
            return  # nothing to tell apart
        data = self.assemble.transform(rows).withColumn("label", F.col("label").cast("double"))
        # A fifth calibrates the trees that the rest has grown.
        aside = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
        grow, tune = data.where(~aside), data.where(aside)
        if grow.agg(F.countDistinct("label")).first()[0] < 2:
            grow = data
        self.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, maxMemoryInMB=64).fit(
            grow.select("features", "label").coalesce(4))
        if tune.agg(F.countDistinct("label")).first()[0] == 2:
            scored = self.margin(tune).select(F.col("margin").alias("m"), "label")
            self.calibration = IsotonicRegression(featuresCol="m", labelCol="label").fit(scored)

    def margin(self, data: DataFrame) -> DataFrame:
        scored = self.trees.transform(data)
        return scored.withColumn("margin", vector_to_array("probability")[1])

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``score`` to rows with the features."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(float(self.prior or 0.0)))
        out = self.margin(self.assemble.transform(rows))
        if self.calibration is None:
            return out.withColumn("score", F.col("margin"))
        self.calibration.setFeaturesCol("margin").setPredictionCol("level")
        # Calibration makes steps; inside a step the trees still order the texts.
        level = F.least(F.greatest(F.col("level"), F.lit(0.0)), F.lit(1.0))
        return self.calibration.transform(out).withColumn("score", level * 0.98 + F.col("margin") * 0.02)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> Scorer:
    """Fit on at most ``rows`` labelled documents outside the held-out fold.

    Null labels and ids take no part. A doc_id with several labels counts as toxic if one
    of them says so.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~in_test(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    known = staged(known)
    texts = docs.select("doc_id", "text").join(known, "doc_id").dropDuplicates(["doc_id"])
    return Scorer(staged(texts))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Returns doc_id, held_out, score, predicted for every document.

    The score is a calibrated probability of the label ``toxic``. The lexicon, the trees
    and their calibration come from labelled documents whose crc32(doc_id) mod 5 is not 0;
    ids, languages, sources and labels are no inputs of a score. Missing and empty texts
    have all features 0 and get the score of that. Without labels of both kinds all scores
    are the labels' mean (0 without labels). Rows that repeat a doc_id are scored each; a
    missing doc_id is not held out. Other columns take no part.
    """
    small_batches(docs.sparkSession)
    scorer = fit(docs, labels)
    rows = featured(docs.select("doc_id", "text"), scorer.lexicon, "doc_id bigint")
    out = scorer.score(rows)
    return out.select(
        "doc_id", in_test(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
