"""The corpus pipeline: each stage works on all documents that the one before it kept.

Every stage takes documents with any columns beside COLUMNS, which are dropped, and an empty
table, which stays empty. All but the last return COLUMNS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import jaccard, mixing, packing, perplexity, templates
from faultline.operators.stage import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their language's perplexity band go.

    A missing or empty text has too few words and goes; a missing language is one of its own.
    Rows that repeat are judged each, and alike.
    """
    return perplexity.filter_documents(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; documents stay, even with nothing left.

    n_chars is counted anew where a line went. A missing text stays missing.
    """
    cut = templates.drop_recurring_lines(docs.select(*COLUMNS))
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard 0.8.

    It is the one of the smallest doc_id, a missing id last. Texts without words all stay.
    """
    return jaccard.one_of_each(docs.select(*COLUMNS), width=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal shares of all sources, by Poisson replication in a global shuffle.

    Rows of a document repeat, or are none. A missing source is one of its own; a missing
    doc_id is drawn by its text.
    """
    return mixing.replicate(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048; a missing or empty text is one end token."""
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near copies", near_copies),
    ("mix sources", mix_sources),
    ("pack", pack),
]

#: SQL can't express the language model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
