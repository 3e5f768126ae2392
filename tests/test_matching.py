"""Similarity join and matching against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.functions import similarity as S
from faultline.operators import matching as M
from faultline.operators.simjoin import similar_sets
from test_text import plain_keywords, plain_ratio


def sets_frame(spark, sets):
    return spark.createDataFrame(list(sets.items()), "id STRING, words ARRAY<STRING>")


def skewed_sets(prefix, n, rnd):
    """A third of the sets are copies and nearly all hold the same two words."""
    out = {}
    for i in range(n):
        if i % 3 == 0:
            out[f"{prefix}{i}"] = ["hot", "warm", "copy1", "copy2", "copy3"]
        else:
            size = rnd.randrange(1, 12)
            words = {"hot", "warm"} | {f"w{int(rnd.expovariate(0.1))}" for _ in range(size)}
            out[f"{prefix}{i}"] = sorted(words, key=lambda w: rnd.random())[: rnd.randrange(1, 13)]
    return out


@pytest.mark.parametrize("threshold, cell_rows", [(0.145, 50_000), (0.3, 7), (0.8, 3)])
def test_similar_sets(spark, threshold, cell_rows):
    rnd = random.Random(2)
    left, right = skewed_sets("a", 60, rnd), skewed_sets("b", 80, rnd)
    right["long"] = [f"w{i}" for i in range(60)]
    left["long"] = [f"w{i}" for i in range(40)]
    left["none"], right["none"] = [], []
    got = similar_sets(sets_frame(spark, left), sets_frame(spark, right), threshold, cell_rows)
    got = sorted(tuple(r) for r in got.collect())
    want = sorted(
        (i, j, len(set(a) & set(b)), len(set(a) | set(b)))
        for i, a in left.items() for j, b in right.items()
        if set(a) & set(b) and len(set(a) & set(b)) / len(set(a) | set(b)) >= threshold - 1e-9
    )
    assert got == want


def test_threshold_must_be_positive(spark):
    some = sets_frame(spark, {"a": ["x"]})
    with pytest.raises(ValueError):
        similar_sets(some, some, 0)
    with pytest.raises(ValueError):
        M.rank_matches(None, None, min_score=0)


WORDS = [f"word{i}" for i in range(14)] + ["error", "memory", "timeout"]


def corpus(seed):
    rnd = random.Random(seed)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    issues = []
    for i in range(60):
        summary, status = say(rnd.randrange(1, 8)), rnd.choice(["Resolved", "Closed", "Open"])
        if i % 3 == 0:
            summary, status = "error word1 word2 memory", "Closed"
        body = say(3) if i % 3 == 0 else say(rnd.randrange(0, 30))
        if i % 3 == 0:
            body = "word3 word4 word5 word6 word7 word8 word9 word10 word11 word12 word13"
            body += " alpha beta gamma delta epsilon zeta eta " + rnd.choice(["late1", "late2", "x"])
        issues.append((f"K-{i:02d}", summary, body, status, rnd.choice(["Fixed", None]), ["lab"], None))
    errors = []
    for i in range(40):
        text = "ERROR: " + say(rnd.randrange(1, 9))
        if i % 3 == 0:
            text = "late1 late2 word3 word4 word5 word6 word7 word8"
        errors.append((f"e{i}", text, plain_keywords(text, 10)))
    errors.append(("empty", "", []))
    return errors, issues


def plain_matches(errors, issues, k, search, min_score=0.3):
    out = set()
    for eid, text, words in errors:
        found = []
        for key, summary, body, status, resolution, labels, _ in issues:
            settled = status.lower() in S.SETTLED_STATUS
            full = " ".join(p for p in (summary + summary, body, " ".join(labels)) if p)
            mine = set(plain_keywords(full, 20))
            if search:
                every = plain_keywords(" ".join([summary, body, " ".join(labels)]), 10**6)
                if not settled or not set(words[:5]) & set(every):
                    continue
            both = set(words) & mine
            score = len(both) / max(1, len(set(words) | mine)) * 0.5 + plain_ratio(text, summary) * 0.2
            score = min(1.0, score * 1.1 if settled else score)
            if score >= min_score:
                found.append((-score, key))
        for rank, (score, key) in enumerate(sorted(found)[:k], 1):
            out.add((eid, rank, key, round(-score, 9)))
    return out


def frames(spark, errors, issues):
    e = spark.createDataFrame(errors, "id STRING, signature STRING, error_keywords ARRAY<STRING>")
    i = spark.createDataFrame(
        issues, "issue_key STRING, summary STRING, description STRING, status STRING,"
                " resolution STRING, labels ARRAY<STRING>, priority STRING")
    return e, i


@pytest.mark.parametrize("search, k, seed", [(False, 10, 1), (True, 4, 2), (True, 50, 3), (False, 2, 4)])
def test_match_issues(spark, search, k, seed):
    errors, issues = corpus(seed)
    e, i = frames(spark, errors, issues)
    got = M.match_issues(e, i, "http://x/", max_results=k, search=search).collect()
    want = plain_matches(errors, issues, k, search)
    assert {(r.id, r["rank"], r.issue_key, round(r.similarity_score, 9)) for r in got} == want
    assert want


@pytest.mark.parametrize("min_score, search, k", [
    (0.22, False, 5), (0.19, False, 100), (0.1, False, 7), (0.1, True, 100), (0.04, False, 100)])
def test_any_min_score(spark, min_score, search, k):
    """Below 0.22 issues match by their text alone, and errors without keywords match too."""
    errors, issues = corpus(5)
    errors.append(("nokeys", "word1 word2", []))
    e, i = frames(spark, errors, issues)
    got = M.match_issues(e, i, min_score=min_score, max_results=k, search=search).collect()
    want = plain_matches(errors, issues, k, search, min_score)
    assert {(r.id, r["rank"], r.issue_key, round(r.similarity_score, 9)) for r in got} == want
    if not search and min_score < 0.19:
        assert any(not r.matching_keywords for r in got) and any(r.id == "nokeys" for r in got)


@pytest.mark.parametrize("rounds", [(0.6, 0.45, 0.35), (0.31,)])
@pytest.mark.parametrize("search, k, min_score", [(False, 3, 0.3), (True, 2, 0.3), (False, 4, 0.15), (True, 1, 0.05)])
def test_rounds_find_the_same(spark, monkeypatch, search, k, min_score, rounds):
    errors, issues = corpus(6)
    e, i = frames(spark, errors, issues)
    keyed = M.error_queries(e)
    asked = []
    candidates = M._candidates
    monkeypatch.setattr(M, "_candidates", lambda q, p, level, before: (
        asked.append((level, q.count())), candidates(q, p, level, before))[1])
    rows = lambda r: sorted(tuple(x) for x in M.rank_matches(
        keyed, i, min_score, k, search=search, rounds=r).collect())
    assert rows(rounds) == rows(())
    *levels, (last, alone) = asked
    assert (last, [x for x, _ in levels]) == (min_score, [*rounds, min_score])
    # Queries with enough matches take no part in later rounds.
    assert levels[-1][1] < alone == levels[0][1]


def test_groups_follow_rank_order(spark):
    rows = [("t", 1, "A", "alpha beta gamma"), ("t", 2, "B", "delta epsilon"),
            ("t", 3, "C", "alpha beta delta"), ("t", 4, "D", "delta epsilon zeta"),
            ("u", 1, "E", "alpha")]
    df = spark.createDataFrame(rows, "id STRING, rank INT, issue_key STRING, summary STRING")
    got = {(r.id, r["rank"]): r.leader_rank for r in M.match_groups(df, 0.3).collect()}
    assert got == {("t", 1): 1, ("t", 2): 2, ("t", 3): 1, ("t", 4): 2, ("u", 1): 1}
    alone = {(r.id, r["rank"]): r.leader_rank for r in M.match_groups(df).collect()}
    assert all(rank == leader for (_, rank), leader in alone.items())


def test_filters(spark):
    rows = [("A", "P", "boot hang", None, ["x"], "Open", None), ("B", "P", "Boot", "memory", [], "Closed", ""),
            ("C", "Q", "other", "boot", ["y"], "resolved", "Fixed")]
    df = spark.createDataFrame(rows, "issue_key STRING, project STRING, summary STRING,"
                                     " description STRING, labels ARRAY<STRING>, status STRING, resolution STRING")
    keys = lambda d: sorted(r.issue_key for r in d.collect())
    assert keys(M.candidate_issues(df, ["BOOT"])) == ["A", "B", "C"]
    assert keys(M.candidate_issues(df, ["boot"], status="Resolved")) == ["B", "C"]
    assert keys(M.candidate_issues(df, ["memory", "hang"], project="P")) == ["A", "B"]
    assert keys(M.candidate_issues(df, [], status="open")) == ["A"]
    assert keys(M.resolved_matches(df)) == ["B", "C"]
