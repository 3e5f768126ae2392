import pytest
from pyspark.sql import types as T

from faultline.operators.stage import staging

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
#: Names that operators use for columns of their own.
CLASHES = ["_key", "_rid", "_doc", "cid", "copy", "size", "shard", "slot", "n_lines", "kept", "host", "gram",
           "text_crc32", "score", "rank", "piece", "bucket", "node", "root", "n", "lexicon", "label"]


@pytest.fixture(autouse=True)
def released(spark):
    """Nothing staged outlives a test."""
    with staging(spark):
        yield


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows."""

    def build(rows):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, *("en", "s")[len(r) - 2:]) if len(r) < 4 else r
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture
def odd(make):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns."""
    from pyspark.sql import functions as F

    words = [f"w{i % 977}x{i % 31}" for i in range(30_000)]
    rows = [
        (1, "one two three four five six seven eight nine ten eleven"),
        (1, "one two three four five six seven eight nine ten eleven"),
        (2, "One two three four five six seven eight nine ten eleven"),
        (None, "a text without an id but with words enough to be judged as one"),
        (None, None, None, None), (3, None), (4, ""), (5, " \n\t \n"), (6, "short", None, "s"),
        (7, " ".join(words), "de", None), (8, "x" * 50_000), (9, "naïve ümlaut     日本語 😀 words " * 3, "", ""),
    ]
    docs = make(rows)
    return docs.withColumns({c: F.lit(f"{c}?") for c in CLASHES})


@pytest.fixture
def empty(odd):
    return odd.limit(0)
