import numpy as np
from pyspark.sql import functions as F

from faultline.llm import forest


def exact(rows, queries, k):
    out = {}
    for q, v in rows:
        if q not in queries:
            continue
        v = np.asarray(v, float)
        scored = sorted((-float((np.asarray(w, float) * v).sum()), i) for i, w in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = results(forest.nearest(vectors, F.col("vec_id") % 20 == 0, block=200))
    want = exact(rows, set(got), 20)
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    found = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in got]
    assert np.mean(found) >= 0.9
    dots = {q: dict(exact(rows, {q}, len(rows))[q]) for q in list(got)[:5]}
    assert all(abs(dots[q][i] - s) < 1e-12 for q in dots for i, s in got[q])


def test_few_rows_ties_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (3, [0.5, 0.0]), (2, [0.5, 0.0]), (1, [0.5, 0.0]), (4, [-1.0, 0.0]), (0, [1.0, 0.0]),
            (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [9.0, 9.0]),
            (10, [1.0, 2.0, 3.0]), (20, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = results(forest.nearest(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(1, 0.5), (2, 0.5), (3, 0.5), (4, -1.0)], 20: [(10, 6.0)]}
    assert forest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_many_copies_of_a_vector(spark):
    rows = [(i, [0.6, 0.8, 0.0] if i % 3 else [float(i % 7), 1.0, 2.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = results(forest.nearest(df, F.col("vec_id").isin(100, 200), block=64))
    want = exact([(i, np.asarray(v, np.float32)) for i, v in rows], {100, 200}, 20)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}


def test_prefix_ranges():
    x = np.random.default_rng(3).standard_normal((200, 8))
    f = forest.Forest(np.arange(200), x)
    strings = forest.hash_strings(x)
    for depth in (0, 1, 5, forest.BITS):
        lo, hi = f.ranges(strings[:, :3], depth)
        for t in (0, 7):
            for q in range(3):
                same = (strings[t] >> np.uint64(forest.BITS - depth)) == (strings[t, q] >> np.uint64(forest.BITS - depth))
                assert set(f.order[t, lo[t, q]:hi[t, q]]) == set(np.flatnonzero(same))


def test_recall_of_a_full_block():
    x = np.random.default_rng(8).standard_normal((forest.BLOCK, 64))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    f, asked = forest.Forest(np.arange(len(x)), x), np.arange(0, len(x), 400)
    got = f.search(asked, x[asked], 20)
    hits = 0
    for i in asked:
        scores = x @ x[i]
        scores[i] = -np.inf
        hits += len(set(np.argsort(-scores)[:20]) & set(got.vec_id[got.query_id == i]))
    assert hits / (20 * len(asked)) >= 0.9


def test_an_id_with_many_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(7 if i % 3 else i, rng.standard_normal(4).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = forest.nearest(df, F.col("vec_id").isin(7, 3), k=5, block=40).collect()
    want = []
    for q in (3, 7):
        pairs = {(-float((np.array(v) * np.array(w)).sum()), j) for i, v in rows if i == q for j, w in rows if j != q}
        want += [(q, r, j) for r, (_, j) in enumerate(sorted(pairs)[:5], 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == want
