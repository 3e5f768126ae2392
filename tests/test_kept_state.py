"""Rules in a table, matches kept between runs, statistics kept by day."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from faultline.functions import rules as R
from faultline.operators import daily as D
from faultline.operators import logscan as L
from faultline.operators import matchstore as MS
from faultline.operators import rulesets as RS
from test_matching import corpus, frames


def test_rules_of_each_project(spark):
    texts = ["UVM_ERROR @ 3: x", "custom thing", "Custom THING", "ASSERTION FAILED y", "", "   ", "plain", "simctrl UVM_ERROR",
             "Segmentation fault and custom thing"]
    rows = [(p, f"{p}/log", i, t) for p in ("a", "b", "none", None) for i, t in enumerate(texts, 1)]
    lines = spark.createDataFrame(rows, "project STRING, log_file STRING, line_no INT, line STRING")
    own = (R.Rule("^custom", 4, "own:start"), R.Rule("custom thing", 3, "own:any", ignore_case=True)) + R.ERROR_RULES
    got = RS.classified_by_project(lines, RS.rule_table(spark, {"a": own, "b": R.ERROR_RULES}))
    key = lambda df: sorted((r.log_file, r.line_no, r.line, r.level, r.pos) for r in df.collect())
    want = [x for p, rules in (("a", own), ("b", R.ERROR_RULES))
            for x in key(L.classified_lines(lines.where(F.col("project") == p).drop("project"), rules))]
    assert key(got) == sorted(want) and len({x[0] for x in want}) == 2


@pytest.mark.parametrize("k, search", [(3, False), (2, True), (None, False)])
def test_updates_equal_a_full_computation(spark, k, search):
    rnd = random.Random(9)
    errors, issues = corpus(8)
    old_issues, now = [], []
    for row in issues:
        kind = rnd.randrange(5)
        if kind != 0:  # 0: new
            old_issues.append(row if kind != 1 else (row[0], "other text", "none", "Open", *row[4:]))
        if kind != 2:  # 2: gone
            now.append(row)
    touched = sorted({r[0] for r in old_issues} ^ {r[0] for r in now} | {a[0] for a in old_issues for b in now if a[0] == b[0] and a != b})
    e, before = frames(spark, errors, old_issues)
    _, after = frames(spark, errors, now)
    first = e.where("id < 'e2'")
    how = {"search": search, "min_score": 0.25}
    stored = MS.all_matches(first, before, k, **how)
    keys = spark.createDataFrame([(t,) for t in touched], "issue_key STRING")
    found, known = MS.updated_matches(stored, MS.distinct_errors(first), e, after, keys, k, **how)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(found) == rows(MS.all_matches(e, after, k, **how)) and rows(found) != rows(stored)
    assert rows(known) == rows(MS.distinct_errors(e).select(known.columns))


def test_days_merge_to_any_span(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(6000):
        at = 86_400 * rnd.randrange(30) + rnd.randrange(86_400)
        rows.append((rnd.choice(["Resolved", "Closed", "Open"]), rnd.choice([None, "Fixed"]), f"p{rnd.randrange(40)}",
                     at - int(rnd.expovariate(1 / 50_000)), at))
    df = spark.createDataFrame(rows, "status STRING, resolution STRING, project STRING, made LONG, seen LONG")
    days = D.issue_days(df, "made", "seen")
    for first, last in ((None, None), (3, 20), (7, 7), (40, 50)):
        mine = [r for r in rows if (first is None or r[4] // 86_400 >= first) and (last is None or r[4] // 86_400 <= last)]
        got = {r.status: r for r in D.over_days(days, first, last).collect()}
        assert set(got) == {r[0] for r in mine}
        for status, r in got.items():
            took = sorted(x[4] - x[3] for x in mine if x[0] == status) if status != "Open" else []
            assert (r.n_issues, r.n_settled) == (sum(x[0] == status for x in mine), len(took))
            if not took:
                assert r.median_seconds is None and r.avg_seconds is None
                continue
            assert (r.min_seconds, r.max_seconds) == (took[0], took[-1])
            assert r.avg_seconds == pytest.approx(statistics.mean(took))
            below, upto = (sum(t < r.median_seconds for t in took), sum(t <= r.median_seconds for t in took))
            assert below <= (0.5 + D.RANK_ERROR) * len(took) + 1 and upto >= (0.5 - D.RANK_ERROR) * len(took) - 1
            names = len({x[2] for x in mine if x[0] == status})
            assert abs(r.n_projects - names) <= max(1, 3 * D.DISTINCT_ERROR * names)


def test_days_by_other_keys(spark):
    df = spark.createDataFrame([("Closed", "Fixed", "p", 0, 10), ("Closed", None, "q", 0, 86_500)],
                               "status STRING, resolution STRING, project STRING, made LONG, seen LONG")
    got = D.over_days(D.issue_days(df, "made", "seen"), by=("status", "resolution")).collect()
    assert {(r.resolution, r.n_issues, r.median_seconds) for r in got} == {("Fixed", 1, 10), ("Unresolved", 1, 86_500)}
