import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from faultline.llm import suffix


def brute(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, kept))
    return out


def corpus(rng):
    """Copies, near copies, shared passages, periods, and passages cut at any place."""
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(400)
    passage = prose(110)
    texts = [base, base, prose(300), passage + prose(30), prose(50) + passage, "abc " * 300, "x" * 1500, "short", ""]
    for _ in range(12):
        words = base.split()
        for _ in range(rng.randint(1, 12)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    for _ in range(12):
        a = rng.randrange(0, 60)
        texts.append(prose(rng.randint(0, 40)) + " " + passage[a:rng.randint(a + 380, len(passage))] + prose(3))
    texts.append(prose(20) + base[500:1100] + prose(20) + base[500:1100])
    return texts


def check(df, texts):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())
    want = [(i, n, removed, spans, hashlib.sha256(kept).hexdigest())
            for i, (n, removed, spans, kept) in enumerate(brute([t.encode() for t in texts], suffix.LENGTH))]
    assert got == want


def digest(docs):
    from pyspark.sql import functions as F

    return suffix.remove_repeats(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@pytest.mark.parametrize("limit", [suffix.CLASS, 1])
def test_removed_bytes(make, monkeypatch, limit):
    """With the limit 1 every class goes the way of large ones."""
    monkeypatch.setattr(suffix, "CLASS", limit)
    texts = corpus(random.Random(limit))
    check(digest(make(list(enumerate(texts)))), texts)


def test_long_texts_in_segments(make, monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    texts = corpus(random.Random(5))
    check(digest(make(list(enumerate(texts)))), texts)


def test_suffix_sort_is_lexicographic():
    rng = random.Random(2)
    data = bytes(rng.choice(b"ab") for _ in range(600)) + b"ab" * 100
    start = np.array(rng.sample(range(700), 300))
    group = np.sort(np.array([rng.randrange(4) for _ in start]))
    with np.errstate(over="ignore"):
        s = suffix.Suffixes(data, 50)
        order = s.sort(start, group)
        got = [(int(group[i]), data[start[i]:start[i] + 50]) for i in order]
        assert got == sorted(got)
        a, b = start[:-1], start[1:]
        for x, y, n in zip(a, b, s.common(a, b)):
            k = 0
            while k < 50 and max(x, y) + k < len(data) and data[x + k] == data[y + k]:
                k += 1
            assert k == n


def test_odd_documents(odd, empty):
    rows = suffix.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].n_bytes == 0 and by_id[3].kept == b"" and by_id[8].kept == b"" and len(by_id[8].removed) == 1
    assert suffix.remove_repeats(empty).count() == 0
