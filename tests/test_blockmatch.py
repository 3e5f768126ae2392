"""Pairs of errors and issues found block by block, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.functions import similarity as S
from faultline.operators import matching as M
from faultline.operators.blockmatch import block_pairs


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
        row = out
    return row[-1]


def test_common_lengths():
    rnd = random.Random(3)
    text = lambda: "".join(rnd.choice("abc dé😀\0") for _ in range(rnd.choice([0, 1, 5, 63, 64, 65, 128, 200])))
    a, b = [text() for _ in range(12)], [text() for _ in range(15)]
    ai, bi = np.repeat(np.arange(12), 15), np.tile(np.arange(15), 12)
    got = S.common_lengths()(a, b, ai, bi)
    assert got.tolist() == [plain_common(a[i], b[j]) for i, j in zip(ai, bi)]


def sample(seed, n):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.expovariate(0.1))}" for _ in range(400)]
    pick = lambda k: list(dict.fromkeys(rnd.choices(words, k=k)))
    return [(f"i{i:03d}", pick(rnd.randrange(0, 12)), rnd.random() < 0.5) for i in range(n)]


@pytest.mark.parametrize("level, block_rows", [(0.05, 10), (0.17, 40), (0.3, 7), (0.5, 1000)])
def test_block_pairs(spark, monkeypatch, level, block_rows):
    from faultline.operators import blockmatch

    monkeypatch.setattr(blockmatch, "LEAST_ROWS", 1)
    queries = [(q, " ".join(w[::-1]) or "none", w) for q, w, _ in sample(1, 30)]
    profiles = [(p, w, settled, " ".join(w)) for p, w, settled in sample(2, 80)] + [("empty", [], True, "")]
    q = spark.createDataFrame(queries, "query string, signature string, error_keywords array<string>")
    p = spark.createDataFrame(profiles, "profile string, words array<string>, settled boolean, head string")
    q = q.withColumn("first", F.lit(None).cast("array<string>")).withColumn("wanted", F.lit(None).cast("int"))
    want = {}
    for qid, text, words in queries:
        for pid, mine, settled, head in profiles:
            both, all_ = len(set(words) & set(mine)), len(set(words) | set(mine))
            edit = 2.0 * plain_common(text, head) / (len(text) + len(head)) if text and head else 0.0
            score = both / max(1, all_) * 0.5 + edit * 0.2
            if (score * 1.1 if settled else score) >= level:
                want[qid, pid] = (both, all_, pytest.approx(edit))
    got = {(r[0], r[1]): tuple(r[2:]) for r in block_pairs(q, p, level, block_rows).collect()}
    assert got == want and want


@pytest.mark.parametrize("search", [False, True])
def test_only_the_best_are_scored(spark, monkeypatch, search):
    """Issues that many better ones beat are not scored and not written down."""
    issues = spark.range(300).select(
        F.format_string("I-%03d", "id").alias("issue_key"),
        F.concat(F.lit("shared "), F.expr("array_join(transform(sequence(0, cast(id % 97 as int)), x -> 'xy'), ' ')")).alias("summary"),
        F.when(F.col("id") < 5, "one two three").alias("description"), F.lit("Closed").alias("status"),
        F.lit(None).cast("string").alias("resolution"), F.array().cast("array<string>").alias("labels"))
    errors = spark.createDataFrame([("e", "shared xy", ["shared", "one", "two", "three"])],
                                   "id string, signature string, error_keywords array<string>")
    written, candidates = [], M._candidates

    def counted(*how):
        out = candidates(*how)
        written.append(out.count())
        return out

    monkeypatch.setattr(M, "_candidates", counted)
    found = M.rank_matches(M.error_queries(errors), issues, 0.05, 2, search=search).orderBy("rank").collect()
    assert len(found) == 2 and {r.issue_key for r in found} <= {f"I-00{i}" for i in range(5)}
    assert written[0] < 40


def test_frequent_words_start_no_pairs(monkeypatch):
    """What is read grows with the rare words of the queries, not with all profiles."""
    import pyarrow as pa

    from faultline.operators import blockmatch

    n, common = 4000, [1, 2, 3]
    kinds = [("asks", pa.bool_()), ("id", pa.string()), ("words", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())),
             ("wanted", pa.int32()), ("settled", pa.bool_()), ("head", pa.string()), ("block", pa.int32())]
    batch = lambda rows: pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[name for name, _ in kinds])
    profiles = [(False, f"p{i}", [*common, *range(100 + 17 * i, 117 + 17 * i)], None, None, True, "x" * 50, 0) for i in range(n)]
    asked = [(True, f"q{i}", [*common, *range(100 + 17 * i, 107 + 17 * i)], None, 10, False, "x" * 50, 0) for i in range(0, n, 40)]
    read, places = [], np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda a: read.append(len(a)) or places(a))
    found = list(blockmatch._pairs_of_blocks(0.3)([batch(profiles), batch(asked)]))
    pairs = {(q, p) for b in found for q, p in zip(b.column("query").to_pylist(), b.column("profile").to_pylist())}
    assert pairs == {(f"q{i}", f"p{i}") for i in range(0, n, 40)}
    assert max(read) < 2 * n  # of n * len(asked) pairs


def test_only_the_best_of_all_blocks_are_joined(spark, monkeypatch):
    from faultline.operators import blockmatch

    monkeypatch.setattr(blockmatch, "LEAST_ROWS", 1)
    profiles = spark.createDataFrame(
        [(f"p{i:02d}", ["a", "b", *[f"w{i}_{k}" for k in range(i // 2)]], True, "") for i in range(60)],
        "profile string, words array<string>, settled boolean, head string")
    queries = spark.createDataFrame(
        [("q", "s", ["a", "b"], None, 3), ("all", "s", ["a", "b"], None, None), ("late", "s", ["b", "a"], ["w1_0"], 3)],
        "query string, signature string, error_keywords array<string>, first array<string>, wanted int")
    got = M._candidates(queries, profiles, 0.2, None).groupBy("query").count().collect()
    # Profiles score alike two by two; two pairs beat no third, and no sure one beats those of "late".
    assert {r["query"]: r["count"] for r in got} == {"q": 4, "all": 8, "late": 8}


def test_letters_in_order_spare_the_edit_measure(monkeypatch):
    """Texts of the same letters in another order are hardly ever compared letter by letter."""
    import pyarrow as pa

    from faultline.operators import blockmatch

    rnd = random.Random(5)
    parts = ["the", "on", "re", "an", "ti", "sh", "ing", "é", "7", "zz"]
    text = lambda n: " ".join("".join(rnd.choices(parts, k=rnd.randrange(1, 4))) for _ in range(n))
    heads = [text(rnd.choice([3, 30, 30, 40]))[:200] for _ in range(300)] + ["e" * 200, "e" * 90 + "t" * 90]
    signatures = heads[:8] + [heads[9][:100] + text(30)[:80], "e" * 150, "é", ""]
    kinds = [("asks", pa.bool_()), ("id", pa.string()), ("words", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())),
             ("wanted", pa.int32()), ("settled", pa.bool_()), ("head", pa.string()), ("block", pa.int32())]
    batch = lambda rows: pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[name for name, _ in kinds])
    words = lambda i: [1, 2, 3, *range(10 * i, 10 * i + 5)]
    profiles = [(False, f"{i}", words(i + 100), None, None, i % 2 == 0, h, 0) for i, h in enumerate(heads)]
    asked = [(True, f"{i}", [1] if i > 8 else [7], None, None, False, s, 0) for i, s in enumerate(signatures)]
    level, compared, made = 0.17, [], S.common_lengths

    def watched():
        measure = made()
        return lambda a, b, ai, bi: compared.append(len(ai)) or measure(a, b, ai, bi)

    monkeypatch.setattr(S, "common_lengths", watched)
    found = list(blockmatch._pairs_of_blocks(level)([batch(profiles), batch(asked)]))
    got = {(int(q), int(p)): e for b in found for q, p, e in zip(*[b.column(c).to_pylist() for c in ("query", "profile", "edit_score")])}
    want = {}
    for q, (_, _, mine, *_, text_) in enumerate((*a[:6], a[6]) for a in asked):
        for p, (_, _, theirs, _, _, settled, head, _) in enumerate(profiles):
            edit = 2.0 * plain_common(text_, head) / (len(text_) + len(head)) if text_ and head else 0.0
            score = len({*mine} & {*theirs}) / len({*mine} | {*theirs}) * 0.5 + edit * 0.2
            if (score * 1.1 if settled else score) >= level:
                want[q, p] = pytest.approx(edit)
    assert got == want and want
    assert sum(compared) < 2 * len(want) + 100  # of 3,624 pairs
