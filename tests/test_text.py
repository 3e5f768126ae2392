"""Text and similarity expressions against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from faultline.functions import similarity as S
from faultline.functions import text as T

ALPHABET = "abcXYZ019_ .,|é²ßñ漢́\n\tſK"


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")


def run(spark, values, expr, kind="string"):
    rows = column(spark, values, kind).select("i", expr.alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def random_texts(n=300, size=40):
    rnd = random.Random(3)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(size))) for _ in range(n)]


def plain_keywords(text, limit):
    found = []
    for w in re.findall(r"\b[a-z0-9_]+\b", (text or "").lower()):
        if len(w) > 2 and w not in T.NOISE_WORDS and w not in found:
            found.append(w)
    return found[:limit]


def test_keywords(spark):
    texts = random_texts() + ["The DMA dma engine failed at 0x10 with the_error", "", None]
    assert run(spark, texts, T.keywords("v", 10)) == [plain_keywords(t, 10) for t in texts]


@pytest.mark.parametrize("name, words", [
    ("test_memory_allocation", ["memory", "allocation"]),
    ("test_dma_transfer_basic", ["dma", "transfer", "basic"]),
    ("tc_abc_abc_ab_the", ["abc", "abc"]),
    ("testcase_x_long", ["long"]),
    ("test_tc_boot", ["boot"]),
    (None, []),
])
def test_name_words(spark, name, words):
    assert run(spark, [name], T.test_name_keywords("v")) == [words]


def test_clean_and_truncate(spark):
    texts = random_texts() + [None]
    clean = [" ".join(re.sub(r"[^a-z0-9\s]", " ", (t or "").lower()).split()) for t in texts]
    assert run(spark, texts, T.clean_text("v")) == clean
    short = [(t or "") if len(t or "") <= 12 else t[:9] + "..." for t in texts]
    assert run(spark, texts, T.truncate_text("v", 12)) == short


def test_strip(spark):
    texts = ["　 a b\x1c\n", "\xa0", "x", " y "]
    assert run(spark, texts, T.strip("v")) == [t.strip() for t in texts]


def test_one_decimal_is_exact(spark):
    rnd = random.Random(5)
    values = [0.25, 0.35, 6.25, 2.675, 99.95, 0.05, 1e6 + 0.45] + [
        rnd.randrange(100000) / 400 for _ in range(300)] + [rnd.random() * 100 for _ in range(300)]
    assert run(spark, values, T.one_decimal("v"), "DOUBLE") == ["%.1f" % v for v in values]


def test_format_duration(spark):
    got = run(spark, [5.0, 59.96, 185.9, 3725.2, None], T.format_duration("v"), "DOUBLE")
    assert got == ["5.0s", "60.0s", "3m 5s", "1h 2m 5s", None]


def test_highlight_nests_and_escapes(spark):
    df = spark.createDataFrame([("DMA dma.x a", ["a", "dma", "a.x"])], "t STRING, w ARRAY<STRING>")
    got = df.select(T.highlight_keywords("t", "w")).first()[0]
    text = "DMA dma.x a"
    for w in sorted(["a", "dma", "a.x"], key=len, reverse=True):
        text = re.sub(re.escape(w), lambda m: f"**{m[0]}**", text, flags=re.I)
    assert got == text


def plain_ratio(a, b):
    a, b = (a or "")[:200].lower(), (b or "")[:200].lower()
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b, 1):
            row[j] = prev[j - 1] + 1 if x == y else max(prev[j], row[j - 1])
    return 2.0 * row[-1] / (len(a) + len(b))


def test_edit_similarity(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcAB é") for _ in range(rnd.randrange(260)))
    pairs = [("kitten", "sitting"), ("abcd", "ABCD"), ("ab", "cd"), ("", "x"), (None, "x")]
    pairs += [(word(), word()) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i INT, a STRING, b STRING")
    got = [r.r for r in df.select("i", S.edit_similarity("a", "b").alias("r")).orderBy("i").collect()]
    assert got == pytest.approx([plain_ratio(a, b) for a, b in pairs])
    assert got[0] == 8 / 13 and got[1] == 1.0 and got[2] == 0.0


def test_jaccard_is_symmetric(spark):
    sets = [["a", "B", "b"], ["b", "c"], [], ["A"]]
    rows = [(i, j, a, b) for i, a in enumerate(sets) for j, b in enumerate(sets)]
    df = spark.createDataFrame(rows, "i INT, j INT, a ARRAY<STRING>, b ARRAY<STRING>")
    got = {(r.i, r.j): r.s for r in df.select("i", "j", S.keyword_jaccard("a", "b").alias("s")).collect()}
    for (i, j), s in got.items():
        a, b = ({x.lower() for x in sets[k]} for k in (i, j))
        want = len(a & b) / len(a | b) if a and b else 0.0
        assert s.score == want == got[j, i].score
        assert s.matching == (sorted(a & b) if a and b else [])
        assert s.total == (len(a | b) if a and b else 0)


def test_solution_sentences(spark):
    rows = [
        (1, "Fixed", "no help here", [("All fine. A workaround helps! fix it.",)]),
        (2, "Fixed", "Use the prefix. Then patch!", [("nothing",)]),
        (3, "Open", "We applied it. ok", [("A fix",)]),
        (4, None, None, None),
        (5, "Done", "It was updated. Later.", []),
    ]
    df = spark.createDataFrame(
        rows, "i INT, resolution STRING, description STRING, comments ARRAY<STRUCT<body STRING>>")
    got = df.select("i", S.solution_for_match(comments="comments").alias("m"),
                    S.solution_for_issue(comments="comments").alias("s")).orderBy("i").collect()
    assert [r.m for r in got] == ["fix it", "Use the prefix", "We applied it", None, None]
    assert [r.s for r in got] == [
        "A workaround helps! fix it", "Use the prefix", None, None, "It was updated"]


def test_issue_text(spark):
    rows = [("s", "d", ["x", "y"], [("c1",), ("",), ("c3",), ("c4",)]), ("", None, [], None)]
    df = spark.createDataFrame(
        rows, "summary STRING, description STRING, labels ARRAY<STRING>, comments ARRAY<STRUCT<body STRING>>")
    got = [r[0] for r in df.select(S.issue_text(comments="comments")).collect()]
    assert got == ["ss d x y c1 c3", ""]


def test_suggest_keywords(spark):
    words = ["abc", "longer", "dma", "cache_line", "zzz", "abc", "other1"]
    df = spark.createDataFrame([("the DMA failed in abc", words)], "s STRING, w ARRAY<STRING>")

    def weight(w):
        return (1 + 2 * (w in "the dma failed in abc") + (len(w) > 5)
                + 1.5 * any(t in w for t in S.TECHNICAL_TERMS))

    want = sorted(dict.fromkeys(words), key=weight, reverse=True)[:5]
    assert df.select(S.suggest_keywords("s", "w")).first()[0] == want
