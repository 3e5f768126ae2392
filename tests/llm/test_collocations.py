import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultline.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, min_count, max_words=5, top=None):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    out = {}
    for (lang, *p), a in f.items():
        if len(p) < 2 or a < min_count:
            continue
        covered = any(
            q[0] == lang and len(q) - 1 > len(p) and f[q] >= a and f[q] >= min_count
            and any(list(q[1 + i:1 + i + len(p)]) == p for i in range(len(q) - len(p))) for q in f)
        if covered:
            continue
        cuts = [(1000 * a * n[lang] // (f[(lang, *p[:k])] * f[(lang, *p[k:])]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        row = (-score, -a, " ".join(p).encode(), " ".join(p), a, f[(lang, *p[:k])], f[(lang, *p[k:])], n[lang], score)
        out.setdefault(lang, []).append(row)
    return sorted((lang, i, *r[3:]) for lang, rs in out.items() for i, r in enumerate(sorted(rs)[:top], 1))


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


TEXTS = [
    ("en", "New York is big. new york is Big, a a a a b; New\tYork\nhere"), ("en", "a a a new york is big! big is a"),
    (None, "x y z x y z x y"), ("und", "x y z"), ("en", None), ("en", ""), ("en", " . , \t"),
    ("de", "groß ist Groß ist ÄPFEL äpfel"), ("en", "a\x01 b a\x01 b a b a a\x00 b a\x00 b"), ("", "x y x y x y"),
]


@pytest.mark.parametrize("min_count,max_words", [(1, 5), (2, 5), (2, 3), (3, 2), (2, 4)])
def test_equals_plain_counting(make, min_count, max_words):
    docs = make([(i, t, lang, "s") for i, (lang, t) in enumerate(TEXTS)])
    got = C.collocations(docs, min_count, max_words, None)
    assert found(got) == expected(TEXTS, min_count, max_words)


def test_ranges_cut_anywhere(spark, make):
    """Streams cut into many ranges, so that phrases and their parts lie apart."""
    texts = [("en", f"the the w{i % 7} w{i % 5} the w{i % 3} v{i % 11}, the w{i % 2} the") for i in range(200)]
    docs = make([(i, t, lang, "s") for i, (lang, t) in enumerate(texts)])
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        got = found(C.collocations(docs, 5, 5, None))
        walked = C.frequent_grams(docs, 5)[0].repartitionByRange(60, "lang", "gram")
        assert walked.rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert got == expected(texts, 5)


def test_first_of_each_language(make):
    texts = [("en" if i % 3 else "fr", f"p{i % 40} q{i % 20} r{i % 10}") for i in range(2000)]
    docs = make([(i, t, lang, "s") for i, (lang, t) in enumerate(texts)])
    assert found(C.collocations(docs, 10, 5, 7)) == expected(texts, 10, 5, 7)


def test_scores_beyond_64_bits():
    import pyarrow as pa

    a, n = 3 * 10**12 + 1, 10**15 + 7
    names = ["lang", "gram", "f", "parts", "longer", "n", "side"]
    rows = [("en", b"x\ny", a, [a + 5], 0, n, 0), ("en", b"x\ny", a, [a + 9], a - 1, None, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
    (out,) = C.merge([batch])
    assert out.to_pylist()[0]["score"] == 1000 * a * n // ((a + 5) * (a + 9))


def test_long_text_is_cut_at_stops():
    text = b"ab cd. " * 50 + b"x" * 100
    parts = list(C.parts_of(text, 64))
    assert b"".join(parts) == text and len(parts) > 4
    assert all(p.rstrip(b" ").endswith(b".") or i == len(parts) - 1 or parts[i + 1][:1] == b"."
               for i, p in enumerate(parts))


def test_odd_tables(odd, empty):
    assert C.collocations(empty).count() == 0
    rows = [(r.lang, r.text) for r in odd.collect()]
    short = odd.where(F.coalesce(F.length("text"), F.lit(0)) < 5000)
    assert found(C.collocations(short, 2, 5, None)) == expected([r for r in rows if len(r[1] or "") < 5000], 2)
    C.collocations(odd, 1, 5).count()
