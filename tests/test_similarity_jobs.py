"""Edit-similarity join, groups over a whole table, and the search by cosine, against plain loops."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultline.functions.text import ENGLISH_STOP_WORDS, keywords
from faultline.operators import groups as G
from faultline.operators import tfidf
from faultline.operators.editjoin import near_texts
from test_text import plain_keywords, plain_ratio


def texts_of(rnd, n):
    """Copies, near copies, short texts, odd letters."""
    base = ["".join(rnd.choice("abcde fgé#") for _ in range(rnd.randrange(0, 60))) for _ in range(n // 3)]
    out = list(base)
    for t in base:
        edited = list(t)
        for _ in range(rnd.randrange(0, 8)):
            at = rnd.randrange(len(edited) + 1)
            edited[at:at + rnd.randrange(2)] = rnd.choice("abX 😀")
        out += ["".join(edited), t.upper() if rnd.random() < 0.5 else t[: rnd.randrange(len(t) + 1)]]
    return out + ["", "a", "A", "ab", "x" * 500, "x" * 199 + "y", None]


@pytest.mark.parametrize("ratio", [1.0, 0.9, 0.8, 0.6, 0.3])
def test_near_texts(spark, ratio):
    rnd = random.Random(7)
    a, b = texts_of(rnd, 60), texts_of(rnd, 30)
    b += a[:20]
    frame = lambda ts: spark.createDataFrame(list(enumerate(ts)), "id INT, text STRING")
    got = {(r.left_id, r.right_id): r.ratio for r in near_texts(frame(a), frame(b), ratio).collect()}
    want = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if x and y and plain_ratio(x, y) >= ratio - 1e-12:
                want[i, j] = plain_ratio(x, y)
    assert got == pytest.approx(want) and len(want) >= 10


def test_near_texts_needs_a_ratio(spark):
    some = spark.createDataFrame([(1, "x")], "id INT, text STRING")
    with pytest.raises(ValueError):
        near_texts(some, some, 0)


def plain_groups(sets, threshold):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for i in sets:
        for j in sets:
            a, b = set(sets[i]), set(sets[j])
            if i != j and a and len(a & b) / len(a | b) >= threshold - 1e-9 and a & b:
                links[i] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {(i, find(i), links[i]) for i in sets}


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_groups_over_a_table(spark, threshold):
    rnd = random.Random(3)
    sets = {}
    for i in range(150):
        sets[f"r{i:03d}"] = ["hot", "same"] if i % 3 == 0 else rnd.sample([f"w{k}" for k in range(25)], rnd.randrange(0, 7))
    # a chain, which takes several rounds
    for i in range(20):
        sets[f"z{i:03d}"] = [f"c{i}", f"c{i + 1}", f"c{i + 2}"]
    df = spark.createDataFrame(list(sets.items()), "id STRING, words ARRAY<STRING>")
    got = {tuple(r) for r in G.alike_groups(df, threshold).collect()}
    assert got == plain_groups(sets, threshold)


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)]
    edges += [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300), (301, 302), (302, 301)]
    df = spark.createDataFrame(edges, "u LONG, v LONG")
    got = {r.id: r.root for r in G.connected(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)},
                   **{200 + i: 200 for i in range(9)}, 301: 301, 302: 301}
    assert G.connected(df.limit(0)).count() == 0


def test_text_groups_and_report(spark):
    texts = ["disk write error", "disk write error", "write error disk full", "alpha beta", "", None, "disk"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    sets = {i: plain_keywords(t or "", 10) for i, t in enumerate(texts)}
    groups = G.text_groups(df, "text", 0.3, lambda c: keywords(c, 10))
    assert {tuple(r) for r in groups.collect()} == plain_groups(sets, 0.5)
    report = {r.group_id: (r.n_rows, r.n_texts, r.text, r.n_text) for r in G.group_report(df, groups).collect()}
    assert report[0] == (3, 2, "disk write error", 2)
    with pytest.raises(ValueError):
        G.text_groups(df, "text", 0.7, lambda c: keywords(c, 10))


def plain_search(queries, docs, k):
    stop = set(ENGLISH_STOP_WORDS)

    def terms(t):
        words = [w for w in re.sub("[^a-z0-9]+", " ", (t or "").lower()).split() if len(w) > 1 and w not in stop]
        return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])

    counted = {i: terms(t) for i, t in docs.items()}
    df = Counter(w for c in counted.values() for w in c)
    idf = {w: math.log((1 + len(docs)) / (n + 1)) + 1 for w, n in df.items() if n <= 0.9 * len(docs)}

    def unit(c):
        v = {w: n * idf[w] for w, n in c.items() if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = {i: unit(c) for i, c in counted.items()}
    out = set()
    for q, t in queries.items():
        v = unit(terms(t))
        scores = [(-round(min(1.0, sum(x * d.get(w, 0.0) for w, x in v.items())), 9), i) for i, d in vectors.items()]
        for rank, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1):
            out.add((q, rank, i, -s))
    return out


@pytest.mark.parametrize("k, cell_rows", [(1, 20_000), (5, 3), (1000, 20_000)])
def test_search_by_cosine(spark, k, cell_rows):
    rnd = random.Random(11)
    word = lambda: f"t{int(rnd.expovariate(0.08))}"
    docs = {f"d{i:03d}": " ".join(["common"] * (i % 8 > 0) + [word() for _ in range(rnd.randrange(0, 25))])
            for i in range(120)}
    docs |= {f"c{i}": docs["d007"] for i in range(12)} | {"none": None, "blank": ""}
    queries = {f"q{i}": " ".join(word() for _ in range(rnd.randrange(1, 9))) for i in range(30)}
    queries |= {"same": docs["d007"], "copy": docs["d007"], "other": "nothing known", "empty": "", "null": None}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id STRING, text STRING")
    got = tfidf.tfidf_search(frame(queries), frame(docs), k, cell_rows=cell_rows)
    got = {(r.query_id, r["rank"], r.id, round(r.cosine, 9)) for r in got.collect()}
    want = plain_search(queries, docs, k)
    assert got == want and any(q == "copy" for q, *_ in want)


@pytest.mark.parametrize("k, weights", [(1, 50), (5, 300), (5, 200_000), (1000, 100)])
def test_search_by_cosine_in_blocks(spark, monkeypatch, k, weights):
    """Frequent terms are in nearly all lists: pairs are never rows, and the best are the same."""
    from faultline.operators import cosineblocks

    monkeypatch.setattr(tfidf, "LIST_POSTINGS", 0)
    monkeypatch.setattr(cosineblocks, "LEAST_WEIGHTS", weights)
    monkeypatch.setattr(tfidf, "met", None)  # pairs by list
    rnd = random.Random(5)
    word = lambda: f"t{int(rnd.expovariate(0.08))}"
    docs = {f"d{i:03d}": " ".join(["common"] * (i % 8 > 0) + [word() for _ in range(rnd.randrange(0, 25))])
            for i in range(150)}
    docs |= {f"c{i}": docs["d007"] for i in range(12)} | {"none": None, "blank": ""}
    queries = {f"q{i}": " ".join(word() for _ in range(rnd.randrange(1, 9))) for i in range(30)}
    queries |= {"same": docs["d007"], "copy": docs["d007"], "other": "nothing known", "empty": "", "null": None}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id STRING, text STRING")
    got = tfidf.tfidf_search(frame(queries), frame(docs), k).collect()
    got = {(r.query_id, r["rank"], r.id, r.cosine) for r in got}
    assert got == plain_search(queries, docs, k)


def test_search_reads_few_lists(spark):
    """Once the best are known, lists of frequent terms are left out."""
    docs = spark.range(400).select(
        F.format_string("d%03d", "id").alias("id"),
        F.concat(F.lit("shared words everywhere "), F.when(F.col("id") < 350, F.lit("often ")).otherwise(F.lit("")),
                 F.concat(F.lit("rare"), (F.col("id") % 40).cast("string"))).alias("text"))
    queries = spark.createDataFrame([("q", "often rare7 rare7 rare7")], "id STRING, text STRING")
    lists = []
    met = tfidf.met

    def watched(q, p, cells):
        lists.append({r.term for r in q.select("term").distinct().collect()})
        return met(q, p, cells)

    tfidf.met = watched
    try:
        got = tfidf.tfidf_search(queries, docs, 3).collect()
    finally:
        tfidf.met = met
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == ["d007", "d047", "d087"]
    assert lists[1] and "often" not in lists[1]


def test_rare_terms_are_not_repeated(spark, monkeypatch):
    """Frequencies are repeated for frequent terms only; one row a term, whatever the number of tasks."""
    from faultline.operators import tfidf

    repeated, join = [], tfidf.salted_join

    def recorded(many, few, on, salt, **how):
        out = join(many, few, on, salt, **how)
        repeated.append("sequence(0, 15" in out._jdf.queryExecution().analyzed().toString() or "salts" in how)
        return out

    monkeypatch.setattr(tfidf, "salted_join", recorded)
    docs = spark.createDataFrame([("a", "red disk failed"), ("b", "red disk was slow"), ("c", "blue")], "id STRING, text STRING")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "left_id STRING, right_id STRING")
    got = {(r.left_id, r.right_id): r.cosine for r in tfidf.tfidf_cosine(docs, pairs, max_share=1.0).collect()}
    assert repeated == [False] and 0 < got["a", "b"] < 1 and got["a", "c"] == 0


def test_terms_and_blocks_take_turns(spark, monkeypatch):
    """Parts of the terms and rounds of blocks give what one part and one round give."""
    from faultline.operators import cosineblocks

    rnd = random.Random(11)
    text = lambda: " ".join(rnd.choices(["red", "disk", "failed", "slow", "blue", "node", "link", "down"], k=rnd.randrange(0, 9)))
    docs = spark.createDataFrame([(f"d{i:02d}", text()) for i in range(40)] + [("none", None)], "id STRING, text STRING")
    pairs = spark.createDataFrame([(f"d{i:02d}", f"d{i // 2:02d}") for i in range(40)] + [("d01", "gone")], "left_id STRING, right_id STRING")

    def both():
        found = tfidf.tfidf_cosine(docs, pairs, max_share=1.0).collect(), tfidf.tfidf_search(docs.limit(6), docs, 3).collect()
        return [{tuple(r)[:-1]: round(r.cosine, 8) for r in rows} for rows in found]

    monkeypatch.setattr(tfidf, "LIST_POSTINGS", 0)
    monkeypatch.setattr(cosineblocks, "BLOCK_DOCS", 12)
    want, rounds, search = both(), [], tfidf.best_of_blocks
    monkeypatch.setattr(tfidf, "PART_CHARS", 500)
    monkeypatch.setattr(tfidf, "blocks_at_once", lambda n_asked: 2)
    monkeypatch.setattr(tfidf, "best_of_blocks", lambda *a: rounds.append(a[5:]) or search(*a))
    assert both() == want and want[0] and want[1]
    assert rounds[0] == (0, 2) and rounds[1][0] == 2
