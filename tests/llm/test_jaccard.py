import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from faultline.llm import jaccard
from faultline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[k:k + width]) for k in range(len(words) - width + 1))


def brute(rows, width, num, den):
    """doc index to (set size, smallest id reachable) by comparing all pairs."""
    sets = [shingle_set(r.text, width) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r.doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted((repr(r.doc_id), len(sets[i]), repr(least[find(i)])) for i, r in enumerate(rows))


def check(docs, width=4, num=85, den=100):
    got = jaccard.link_components(docs, width, num, den).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute(
        docs.collect(), width, num, den)


def near_copies(rng):
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(4000))
    rows, i = [], 0
    for length in (5, 8, 12, 30, 80, 200):
        for _ in range(4):
            base = [word() for _ in range(length)]
            for _ in range(12):  # copies with edits around the threshold, and chains of them
                base = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2])):
                    base[rng.randrange(length)] = word()
                rows.append((i, " ".join(base)))
                i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cell", [jaccard.CELL, 3])
def test_components(make, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)
    check(make(near_copies(random.Random(cell))))


def test_pipeline_measure(make):
    check(make(near_copies(random.Random(9))), 5, 80, 100)


def test_bitmaps_prune_only_what_cannot_link():
    rng = random.Random(4)
    import numpy as np

    sets = []
    for _ in range(60):
        base = rng.sample(range(10**9), rng.randrange(3, 60))
        for _ in range(3):
            sets.append(np.array(sorted(set(rng.sample(base, max(1, len(base) - rng.randrange(0, 8)))) | set(
                rng.sample(range(10**9), rng.randrange(0, 4)))), np.uint64))
    rows = [(i, i, len(s), jaccard.bitmap(s)) for i, s in enumerate(sets)]
    pairs = set(jaccard.joined(jaccard.tree(rows), jaccard.tree(rows), 85, 100))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                assert (j, i) in pairs


def test_components_of_graphs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_documents(odd, empty):
    check(odd)
    rows = jaccard.one_of_each(odd).collect()
    by_id = [r.doc_id for r in rows]
    assert by_id.count(1) == 1 and 2 not in by_id and {3, 4, 5, 6, 7, 8, 9} <= set(by_id)
    assert jaccard.link_components(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "near copies", "mix sources", "pack"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), before.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
        if name == "near copies":
            kept = brute(before.collect(), 5, 80, 100)
            want = sorted(i for i, _, c in kept if i == c)
            assert sorted(repr(r.doc_id) for r in docs.collect()) == want
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    ends = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, last)) == sorted(map(key, ends))


def test_pipeline_on_odd_documents(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()


def test_one_document_stays_whatever_its_id(make):
    text = " ".join(f"word{i}" for i in range(60))
    near = text + " more"
    rows = [(5, text, "en", "s"), (5, text, "de", "s"), (5, near, "en", "s"), (9, text, "en", "s"),
            (None, "other " + near[6:], None, "s"), (1, "a b c", "en", "s"), (2, None, "en", "s"), (2, None, "en", "s"),
            (3, "", "en", "s"), (3, "", "en", "s")]
    alone = [(None, text.upper().replace("WORD", "term"), "en", "s"), (None, text.replace("word", "term") + " x", "en", "s")]
    kept = jaccard.one_of_each(make(rows + alone)).collect()
    assert [r.doc_id for r in kept].count(5) == 1 and 9 not in [r.doc_id for r in kept]
    assert sum(r.doc_id is None for r in kept) == 1  # of the group without ids; the other group has one
    assert sorted(r.doc_id for r in kept if r.doc_id in (1, 2, 3)) == [1, 2, 2, 3, 3]
    again = jaccard.one_of_each(make(list(reversed(rows + alone)))).collect()
    assert sorted(map(repr, kept)) == sorted(map(repr, again))


def test_workers_keep_the_state_of_one_operator():
    """What a Python worker remembers of scored words makes room for the operators that follow."""
    import pyarrow as pa

    from faultline.llm.common import worker_state

    worker_state("word_facts")["job"] = "facts"
    assert worker_state("word_facts") == {"job": "facts"}
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1]), pa.array([b"a few words"]), pa.array([7])], names=["doc_id", "text", "_key"])
    assert sum(b.num_rows for b in jaccard.sketch(2, 3)([batch])) == 1
    assert worker_state("word_facts") == {}
    worker_state("word_facts")["job"] = "facts"
    worker_state("word_ids")
    assert worker_state("word_facts") == {}
