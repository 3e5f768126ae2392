import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from faultline.llm import packing

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def fewest(items, cap):
    """Fewest bins, by search."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= cap}.values():
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def counted(items):
    return {s: items.count(s) for s in set(items)}


@settings(max_examples=150, deadline=None)
@given(st.integers(6, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=9))))
def test_reduction_loses_nothing(case):
    cap, items = case
    plan = packing.Plan(counted(items), cap)
    plan.reduce()
    rest = [s for s, n in plan.left.items() for _ in range(n)]
    assert plan.reduced + (fewest(rest, cap) if rest else 0) == fewest(items, cap)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(
    lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 50), max_size=12))))
def test_plan_places_every_item(case):
    cap, counts = case
    plan, used = packing.plan(counts, cap), {}
    for bins, items in plan.groups:
        assert bins > 0 and sum(s * q for s, q in items) <= cap
        for s, q in items:
            used[s] = used.get(s, 0) + bins * q
    assert used == counts


def expected(rows, cap=2048):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for r in rows:
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        out += [(r.doc_id, k // cap, k, len(ids[k:k + cap]), zlib.crc32(ids[k:k + cap].tobytes()))
                for k in range(0, len(ids), cap)]
    return sorted(out, key=repr)


def check(rows, docs):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == expected(docs)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    return len(ends)


def test_pieces_and_places(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    assert check(rows, docs.collect()) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_odd_documents_pack(odd, empty):
    check(packing.pack(odd, PATH).collect(), odd.collect())
    assert packing.pack(empty, PATH).count() == 0


def test_words_are_encoded_as_texts(make):
    texts = ["It's 3.5% of don't-know... (really)!? Été,İ ß क़x áb naïve.", "<|ENDOFTEXT|> x", "a\x1cb\x85c\xa0d  e",
             "ΣΣ Σ. 12ab ab12 'S 's x's", "ﬁx ẞ. ǅx ʰx, ªx"]
    docs = make([(i, t) for i, t in enumerate(texts)])
    check(packing.pack(docs, PATH).collect(), docs.collect())
