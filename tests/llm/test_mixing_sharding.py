import math
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from faultline.llm import mixing, sharding


# ---- mixing -------------------------------------------------------------------------

def test_replication_follows_the_hash(make):
    docs = make([(i, f"t{i}", "en", "big" if i % 3 else "small") for i in range(300)])
    got = Counter(r.doc_id for r in mixing.replicate(docs, {"big": 1.0, "small": 3.0}, seed="a").collect())
    import hashlib

    n = {"big": 200, "small": 100}
    want = Counter()
    for i in range(300):
        source = "big" if i % 3 else "small"
        rate = 300 * {"big": 0.25, "small": 0.75}[source] / n[source]
        u = int(hashlib.md5(f"a|{i}|1".encode()).hexdigest()[:12], 16) / 2**48
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        if k:
            want[i] = k
    assert got == want


def test_shares_reach_their_targets(make):
    docs = make([(i, "t", "en", "hot" if i % 10 else "cold") for i in range(4000)])
    got = Counter(r.source for r in mixing.replicate(docs, {"hot": 1, "cold": 1}).select("source").collect())
    assert abs(got["hot"] - 2000) < 200 and abs(got["cold"] - 2000) < 200


def test_large_rates_are_sums_of_parts(make):
    docs = make([(1, "t", "en", "rare")] + [(i, "t", "en", "rest") for i in range(2, 2002)])
    got = Counter(r.source for r in mixing.replicate(docs, {"rare": 9, "rest": 1}).select("source").collect())
    assert abs(got["rare"] - 1800) < 220  # one document, a mean far beyond exp()'s reach


def test_unnamed_sources_get_nothing(make):
    docs = make([(i, "t", "en", s) for i, s in enumerate(["a", "b", None] * 20)])
    assert {r.source for r in mixing.replicate(docs, {"a": 1}).select("source").collect()} == {"a"}


def test_odd_documents_mix(odd, empty):
    rows = mixing.replicate(odd, epochs=3.0).collect()
    by_id = Counter((r.doc_id, r.text, r.copy) for r in rows)
    assert all(n == (2 if k[0] == 1 else 1) for k, n in by_id.items())  # repeated rows draw alike
    assert "cid" in rows[0].asDict() and "_key" not in rows[0].asDict()
    assert mixing.replicate(empty).count() == 0


# ---- sharding -----------------------------------------------------------------------

def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, left = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > left:
                used, left = used + 1, mid
            left -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low




@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(-(2**63), 2**63 - 1), st.integers(1, 10**6), min_size=1, max_size=60),
       st.integers(1, 9), st.integers(2, 4))
def test_plan_is_minimal(groups, shards, bits):
    ordered = sorted(groups.items())

    class Runs(sharding.Runs):
        def _look(self, ranges, shift):
            parts = {}
            for k, s in ordered:
                if ranges[0][0] is None or any(lo <= k <= hi for lo, hi in ranges):
                    parts.setdefault(k >> shift, []).append((k, s))
            return sorted((p[0][0], p[-1][0], sum(s for _, s in p), len(p), max(s for _, s in p))
                          for p in parts.values())

    keep = sharding.Runs, sharding.LEVEL_BITS
    sharding.Runs, sharding.LEVEL_BITS = Runs, bits
    try:
        cap, cuts = sharding.plan(None, shards)
    finally:
        sharding.Runs, sharding.LEVEL_BITS = keep
    assert cap == smallest_capacity([s for _, s in ordered], shards)
    totals = Counter()
    for k, s in ordered:
        totals[sum(k > c for c in cuts)] += s
    assert len(cuts) < shards and max(totals.values()) <= cap


def test_shards_hold_groups_and_slots(make):
    docs = make([(i, f"text {i % 40} " * (i % 40 + 1)) for i in range(400)])
    rows = sharding.shard(docs, 8).collect()
    assert len(rows) == 400
    by_text, slots, sizes = {}, {}, Counter()
    for r in rows:
        assert r.size == len(r.text.encode()) + 1
        assert by_text.setdefault(r.text, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    keys = {r.text: r.k for r in docs.select("text", F.xxhash64("text").alias("k")).collect()}
    groups = Counter()
    for r in rows:
        groups[r.text] += r.size
    assert max(sizes.values()) == smallest_capacity([groups[t] for t in sorted(groups, key=keys.get)], 8)


@pytest.mark.parametrize("n,share", [(60_000, 0.35), (200_000, 0.2)])
def test_a_large_group_among_many(spark, monkeypatch, n, share):
    """Looks stay few and small, whatever one group holds, and the capacity stays minimal."""
    hot = int(n * share)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") < hot, F.lit("the same text " * 3)).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    looked = []
    look = sharding.Runs._look
    monkeypatch.setattr(sharding.Runs, "_look", lambda self, ranges, shift: looked.append(
        (len(ranges), found := look(self, ranges, shift))) or found)
    rows = sharding.shard(docs, 8).select(F.xxhash64("text").alias("key"), "size", "shard").groupBy(
        "key", "shard").agg(F.sum("size").alias("size")).collect()
    totals = Counter()
    for r in rows:
        totals[r.shard] += r["size"]
    ordered = [r["size"] for r in sorted(rows, key=lambda r: r.key)]
    assert len({r.key for r in rows}) == len(rows) and max(totals.values()) == smallest_capacity(ordered, 8)
    assert max(k for k, _ in looked) <= 14 and max(len(f) for _, f in looked) <= 14 * 2**sharding.LEVEL_BITS
    assert len(looked) < 40 and sum(len(f) for _, f in looked) < 40_000


def test_odd_documents_shard(odd, empty):
    rows = sharding.shard(odd, 3).collect()
    assert len(rows) == odd.count() and min(r.size for r in rows) == 1
    assert len({r.shard for r in rows if not r.text}) == 1  # missing texts count as empty ones
    assert sharding.shard(empty, 3).count() == 0


def test_query_digest(spark):
    row = sharding.query(spark, "/root/testdata/sf0.001").where("doc_id = 7").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id = 7").first().text.encode()
    assert (row["size"], row.text_crc32, row.law, row.grown_shard) == (len(text) + 1, zlib.crc32(text), "bytes", None)
