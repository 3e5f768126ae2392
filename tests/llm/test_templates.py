import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import check_queries
from faultline.llm import mixing, templates

SF = "/root/testdata/sf0.001"


def run_sql(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    return con.execute(sql).df()


def test_queries_match_sql(spark):
    con = check_queries.connect(SF)
    for module in (templates, mixing):
        assert check_queries.compare(module.query(spark, SF).toPandas(), con.execute(module.SQL).df()) == ""


def test_recurring_templates_go(make):
    body = lambda i: f"Alpha{'x' * i} beta gamma{'y' * i} delta words here."
    rows = [(i, f"Page {i} of 99 printed\n{body(i)}\nAll rights reserved, {1990 + i} edition") for i in range(12)]
    rows += [(50 + i, f"Lonely line {i} stays\nPage one of none printed") for i in range(9)]
    got = {r.doc_id: r for r in templates.drop_recurring_lines(make(rows)).collect()}
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0  # the first keeps its copy
    assert all(got[i].text == body(i) and got[i].n_dropped == 2 for i in range(1, 12))
    assert all(got[50 + i].n_dropped == 0 for i in range(9))  # nine texts are too few


def test_copies_count_once(make):
    rows = [(i, "the very same line of text\nand another one") for i in range(30)]
    assert all(r.n_dropped == 0 for r in templates.drop_recurring_lines(make(rows)).collect())


def test_fields_beyond_the_lead_vary(make):
    rows = [(i, f"user logged in from host{i} after a{'b' * (i + 1)} long wait today") for i in range(15)]
    got = templates.drop_recurring_lines(make(rows)).collect()
    assert sum(r.n_dropped for r in got) == 14


def test_a_leaf_holds_several_templates(make):
    lines = ["See the terms of use before posting here"] * 20 + ["See the terms for members of this forum"] * 30
    got = templates.drop_recurring_lines(make([(i, f"{x}\nown{'x' * i}") for i, x in enumerate(lines)])).collect()
    assert {r.doc_id for r in got if not r.n_dropped} == {0, 20}
    # Neither has a majority; the second varies where it is not fixed; prose dilutes both.
    rows = [f"See the terms of use before posting here a{'b' * i}" for i in range(12)]
    rows += [f"See the terms for members z{'y' * i} this forum now" for i in range(12)]
    rows += [f"See the terms p{'q' * i} r{'s' * i} t{'u' * i} v{'w' * i} k{'l' * i} m{'n' * i}" for i in range(40)]
    got = templates.drop_recurring_lines(make([(i, f"{x}\nown{'x' * i}") for i, x in enumerate(rows)])).collect()
    assert sorted(r.doc_id for r in got if r.n_dropped) == [*range(1, 12), *range(13, 24)]


def test_no_python_on_the_way(spark):
    plan = templates.query(spark, SF)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_odd_documents(odd, empty):
    rows = templates.drop_recurring_lines(odd).collect()
    assert sorted((repr((r.doc_id, r.text)) for r in rows)) == sorted(repr((r.doc_id, r.text)) for r in odd.collect())
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].n_lines == 0 and by_id[3].text is None and by_id[4].n_lines == 1 and by_id[5].n_lines == 3
    assert "n_lines" in rows[0].asDict() and "_doc" not in rows[0].asDict()
    assert templates.drop_recurring_lines(empty).count() == 0


def test_sql_on_odd_documents(odd):
    docs = odd.select("doc_id", "text").distinct()
    got = templates.drop_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped", "text").toPandas()
    assert check_queries.compare(got, run_sql(templates.SQL, docs)) == ""


def plain_drops(docs, least, depth, similarity):
    """The whole rule, from the docstring, line by line: {(doc_id, text, line_no)}."""
    rows = []
    for doc_id, text in docs:
        for at, line in enumerate((text or "").split("\n") if text is not None else []):
            t = tuple("<*>" if re.search("[0-9]", x) else x for x in re.split(r"[ \t\x0b\f\r]+", line) if x)
            if t:
                rows.append((doc_id, text, at, t))
    dropped = set()

    def texts_by_leaf(leaf_of):
        out = defaultdict(set)
        for doc_id, text, at, t in rows:
            if leaf_of(t) is not None:
                out[leaf_of(t)].add(text)
        return out

    def majority(leaf_of):
        """Of each leaf the lines that its majority template holds."""
        votes, sizes = Counter(), Counter()
        for *_, t in rows:
            leaf = leaf_of(t)
            if leaf is not None:
                sizes[leaf] += 1
                votes.update((leaf, i, x) for i, x in enumerate(t))
        return {t for *_, t in rows if leaf_of(t) is not None and sum(
            votes[leaf_of(t), i, x] * 2 > sizes[leaf_of(t)] for i, x in enumerate(t)) >= similarity * len(t)
            and any(votes[leaf_of(t), i, x] * 2 > sizes[leaf_of(t)] for i, x in enumerate(t))}

    def drop(members, leaf_of):
        """Drops recurring members; returns the lines whose template recurs."""
        texts, first, used = defaultdict(set), {}, set()
        for doc_id, text, at, t in rows:
            if t in members:
                leaf = leaf_of(t)
                texts[leaf].add(text)
                if doc_id is not None:
                    first[leaf] = min(first.get(leaf, doc_id), doc_id)
        for doc_id, text, at, t in rows:
            if t in members and len(texts[leaf_of(t)]) >= least:
                used.add(t)
                if doc_id is None or doc_id != first.get(leaf_of(t)):
                    dropped.add((doc_id, text, at))
        return used

    lead = lambda t: (len(t), t[:depth])
    many = {leaf for leaf, x in texts_by_leaf(lead).items() if len(x) >= least}
    leaf = {t: lead(t) for *_, t in rows if lead(t) in many}
    at_leaf = lambda t: leaf.get(t)
    for t in drop(majority(at_leaf), at_leaf):
        del leaf[t]

    def able():
        votes, n = Counter(), Counter(t for *_, t in rows if t in leaf)
        for t, k in n.items():
            for i, x in enumerate(t):
                votes[leaf[t], i, x] += k
        held = {t for t in n if sum(votes[leaf[t], i, x] * 2 > least for i, x in enumerate(t)) >= similarity * len(t)
                and any(votes[leaf[t], i, x] * 2 > least for i, x in enumerate(t))}
        sizes = Counter()
        for t in held:
            sizes[leaf[t]] += n[t]
        return {t: leaf[t] for t in held if sizes[leaf[t]] >= least}, n

    leaf, n = able()
    own = {t for t in leaf if n[t] >= least}
    for t in drop(own, lambda t: (leaf.get(t), t)):
        del leaf[t]
    while True:
        leaf, n = able()
        if not leaf:
            return dropped
        votes, sizes = Counter(), Counter()
        for t in leaf:
            sizes[leaf[t]] += n[t]
            for i, x in enumerate(t):
                votes[leaf[t], i, x] += n[t]
        parts = {}
        for t in leaf:
            best = max(((votes[leaf[t], i, x], -i, x) for i, x in enumerate(t)
                        if votes[leaf[t], i, x] < sizes[leaf[t]]), default=None)
            if best:
                parts[t] = (leaf[t], best[1], best[2])
        leaf = parts
        for t in drop(majority(at_leaf), at_leaf):
            del leaf[t]


@pytest.mark.parametrize("seed, least", [(1, 3), (2, 4)])
def test_whole_rule_against_plain_python(make, seed, least):
    rnd = random.Random(seed)
    heads = ["see the terms", "all rights are", "page x of"]
    words = ["of", "use", "for", "members", "today", "now", "here"]
    docs = []
    for i in range(70):
        lines = []
        for _ in range(rnd.randrange(0, 7)):
            tail = [rnd.choice(words) if rnd.random() < 0.8 else rnd.choice([f"n{i}", f"v{'w' * i}"])
                    for _ in range(rnd.randrange(2, 5))]
            lines.append("  ".join([rnd.choice(heads), *tail]))
        docs.append((None if i % 23 == 0 else i, "\n".join(lines)))
    docs += [(100, docs[5][1]), (5, docs[5][1]), (200, None), (201, ""), (202, " \n")]
    got = templates.dropped_lines(make(docs).select("doc_id", "text"), least, 3, 0.7).join(
        make(docs).select(F.col("doc_id").alias("i"), "text", F.xxhash64("text").alias("h")),
        F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("_doc") == F.col("h")))
    want = plain_drops(docs, least, 3, 0.7)
    assert {(r.doc_id, r.text, r.line_no) for r in got.collect()} == want and len(want) > 20
