import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from faultline.llm import tiers

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def power_of_two(n):
    return n & (n - 1) == 0


def gapless(rows, most):
    """(sequence, offset, length) rows: every sequence filled from 0 on; its length."""
    ends = {}
    for seq, offset, length in sorted(rows):
        assert length > 0 and offset == ends.get(seq, 0)
        ends[seq] = offset + length
    assert all(n <= most for n in ends.values())
    return ends


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_plan_fills_every_window(counts):
    plan = tiers.TierPlan(counts, (64, 32, 16, 8))
    length = np.repeat(list(counts), list(counts.values())).astype(np.int64)
    rank = np.concatenate([np.arange(n) for n in counts.values()] or [np.zeros(0)]).astype(np.int64)
    item, inside, size, seq, offset, tier, apart = tiers.laid(plan, length, rank)
    ends = gapless(zip(seq.tolist(), offset.tolist(), size.tolist()), 64)
    assert all(power_of_two(n) for n in ends.values()) and len(ends) == plan.sequences
    assert all(ends[s] == t for s, t in zip(seq.tolist(), tier.tolist()))
    gapless(zip(item.tolist(), inside.tolist(), size.tolist()), 64)
    assert np.bincount(item, size, len(length)).tolist() == length.tolist()


def test_gaps_of_long_windows_take_shorter_documents():
    plan = tiers.TierPlan({50: 3, 14: 3, 20: 2, 12: 2}, (64, 32, 16, 8))
    assert not plan.apart and {w[:2] for w in plan.packed} == {(64, 3), (32, 2)}


def test_steps_are_alike():
    rng = np.random.default_rng(1)
    sizes, n = np.unique(rng.integers(1, 4097, 20_000), return_counts=True)
    plan = tiers.TierPlan(dict(zip(sizes.tolist(), n.tolist())))
    length = np.repeat(sizes, n)
    rank = np.concatenate([np.arange(k) for k in n])
    item, _, size, seq, _, tier, _ = tiers.laid(plan, length, rank)
    steps = -(-plan.tokens // tiers.STEP_TOKENS)
    step = tiers.step_of(seq, steps)
    tokens = np.bincount(step, size)
    assert tokens.max() - tokens.min() <= 2 * sum(tiers.TIERS)
    work = np.bincount(step, size.astype(float) ** 2)
    assert work.max() / work.min() < 1.1
    assert len(np.unique(item)) == len(length)


def check(rows, docs):
    tokenizer = Tokenizer.from_file(PATH)
    assert all(power_of_two(n) for n in gapless(
        ((r.sequence_id, r.offset, r.length) for r in rows), 4096).values())
    want, got = {}, {}
    for r in docs:
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(r.doc_id, []).append(ids)
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert set(want) == set(got)
    for doc_id, texts in want.items():
        pieces = got[doc_id]
        assert sum(r.length for r in pieces) == sum(map(len, texts))
        for r in pieces:
            assert any(r.doc_tokens == len(t) and zlib.crc32(t[r.start:r.start + r.length].tobytes()) == r.ids_crc32
                       for t in texts)
        if len(texts) == 1:
            assert np.cumsum([0] + [r.length for r in sorted(pieces, key=lambda r: r.start)])[:-1].tolist() \
                == sorted(r.start for r in pieces)


def test_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(tiers.pack_tiers(docs, PATH).collect(), docs.collect())


def test_odd_tables(odd, empty):
    check(tiers.pack_tiers(odd, PATH).collect(), odd.collect())
    assert tiers.pack_tiers(empty, PATH).count() == 0


def test_many_equal_documents(make):
    docs = make([(i, "the same words in each " * 40) for i in range(500)] + [(-1, "short")])
    rows = tiers.pack_tiers(docs, PATH).collect()
    check(rows, docs.collect())
    assert len(rows) < 800
