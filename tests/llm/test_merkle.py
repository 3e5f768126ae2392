import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from faultline.llm import merkle as M


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    out = []
    for v in (r.doc_id, r.source, r.lang, r.n_chars, text):
        v = None if v is None else str(v)
        out.append("-" if v is None else f"{len(v.encode())}:{v}")
    return h(*out)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[i:i + 3]) for i in range(0, len(now), 3)])
    return levels


def climb(levels, at, node):
    proof = ""
    for level in levels[:-1]:
        run = level[at // 3 * 3:at // 3 * 3 + 3]
        own = at % 3
        proof += "".join(run[:own] + run[own + 1:])
        node = h(*run[:own], node, *run[own + 1:])
        at //= 3
    return proof, node


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(("" if r.source is None else "s" + r.source).encode(), []).append(r)
    trees = {}
    for g, rs in by.items():
        rs.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees[g] = tree([leaf(r, r.text) for r in rs])
    names = sorted(by)
    top = tree([trees[g][-1][0] for g in names])
    root, out = top[-1][0], []
    for k, g in enumerate(names):
        for i, r in enumerate(by[g]):
            own = leaf(r, r.text)
            shown = own
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text is not None:
                shown = leaf(r, r.text.replace("\n", ""))
            low, node = climb(trees[g], i, shown)
            high, node = climb(top, k, node)
            out.append((r.doc_id, own, trees[g][-1][0], root, h(low + high), node, node == root))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.fixture
def many(make):
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 9, "f": 10, "g": 28, "h": 81, None: 5, "": 7, "é": 2}
    rows, at = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            at += 7
            rows.append((at, f"line {at}\nmore {at % 5}" if at % 3 else f"one line {at}", "en", s))
    return make(rows)


@pytest.mark.parametrize("levels", [1, 2, 9])
def test_equals_a_plain_tree(many, levels):
    """Whatever a superblock holds; small ones make several exchanges."""
    got = M.manifest(many, M.without_line_ends, paths=False, levels=levels)
    assert found(got) == expected(many.collect())


def test_proofs_fold_to_the_root(many):
    for r in M.manifest(many, levels=2).collect():
        assert r.verified and r.folded_root == r.root == M.fold(r.leaf, r.proof)
        assert h(M.siblings(r.proof)) == r.proof_sha256
        assert M.fold(h("other"), r.proof) != r.root


def test_one_source_holds_most(make):
    rows = [(i, f"t{i}\n", "en", "hot" if i % 3 else f"s{i}") for i in range(400)]
    docs = make(rows)
    assert found(M.manifest(docs, M.without_line_ends, paths=False, levels=2)) == expected(docs.collect())


def test_odd_tables(odd, empty):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    assert found(M.manifest(odd, M.without_line_ends, paths=False, levels=1)) == expected(plain.collect())
    assert M.manifest(empty).count() == 0
    alone = odd.where(F.col("doc_id") == 4)
    (r,) = M.manifest(alone).collect()
    assert r.leaf == r.subroot == r.root and r.proof == [] and r.proof_sha256 == h("")
