"""Quality rules, quality classifier, toxicity."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from faultline.llm import perplexity, quality, toxicity
from faultline.llm.words import WordBatch

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- quality rules ------------------------------------------------------------------

def brute_counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = {i for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for i in range(k, k + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é#*\n\t\x0b\x1c\x85|", max_size=80))
def test_counts(text):
    assert counts_of([text]) == [brute_counts(text)]


def counts_of(texts):
    raw = [t.encode() for t in texts]
    batch = WordBatch(raw, perplexity.KINDS)
    return list(zip(*(c.tolist() for c in perplexity.text_counts(raw, batch))))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é#\n |", max_size=40), max_size=8))
def test_counts_of_many_texts_at_once(texts):
    assert counts_of(texts) == [brute_counts(t) for t in texts]


def brute_model(words, order=5):
    """Interpolated modified Kneser-Ney over n-grams inside words, from the formulas."""
    counts = [None] * (order + 1)
    counts[order] = Counter()
    for w, n in words.items():
        p = " " * (order - 1) + w + " "
        for i in range(len(w) + 1):
            counts[order][p[i:i + order]] += n
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def level(k):
        t = Counter(min(c, 5) for c in counts[k].values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else None
        d = {}
        for j in (1, 2, 3):
            v = j - (j + 1) * y * t[j + 1] / t[j] if y is not None and t[j] else None
            d[j] = v if v is not None and 0 < v < j else 0.5 * j
        total, left = defaultdict(float), defaultdict(float)
        for g, c in counts[k].items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        return {g: (max(c - d[min(c, 3)], 0) / total[g[:-1]], left[g[:-1]] / total[g[:-1]]) for g, c in counts[k].items()}

    p = {g: a + b / (len(counts[1]) + 1) for g, (a, b) in level(1).items()}
    for k in range(2, order + 1):
        p = {g: a + b * p[g[1:]] for g, (a, b) in level(k).items()}
    return p


def test_model_and_scores(make, monkeypatch):
    texts = [("en", "the theme of the thesis is the theory of the other thing " * (i + 1) + f"word{i}") for i in range(6)]
    texts += [("de", "das ist ein text und noch ein text mit wörtern"), (None, "no language here")]
    docs = make([(i, t, lang, "s") for i, (lang, t) in enumerate(texts)])
    words = defaultdict(Counter)
    for lang, t in texts:
        words[lang or ""].update(t.split())
    want = {lang: brute_model(c) for lang, c in words.items()}
    got = {(r.lang, r.gram): r.p for r in perplexity.model(perplexity.vocabulary(docs)).collect()}
    assert set(got) == {(lang, g) for lang, p in want.items() for g in p}
    assert all(math.isclose(p, want[lang][g], rel_tol=1e-9) for (lang, g), p in got.items())

    def score(lang, text):
        total = 0.0
        for w in text.split():
            padded = " " * 4 + w + " "
            total += sum(math.log(want[lang][padded[i:i + 5]]) for i in range(len(w) + 1))
        return total

    shipped = {r.doc_id: r for r in perplexity.measured(docs).collect()}
    joined = {r.doc_id: r for r in perplexity.measured(docs, shipped_ngrams=0).collect()}
    for i, (lang, t) in enumerate(texts):
        assert math.isclose(shipped[i].logp, score(lang or "", t), rel_tol=1e-9)
        assert math.isclose(joined[i].logp, shipped[i].logp, rel_tol=1e-9)


def test_junk_goes_and_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = perplexity.query(spark, SF).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert len(rows) == len(text)
    for r in rows:
        counts = brute_counts(text[r.doc_id])
        assert tuple(r[n] for n in names) == counts
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [r for r in rows if r.doc_id in labels and not r.base_failed]
    assert all(r.kept for r in judged if labels[r.doc_id] == 1)
    assert sum(not r.kept for r in judged if labels[r.doc_id] == 0) >= 10


def test_words_in_context(make):
    """Class trigrams against plain loops; order and repeats move the perplexity."""
    texts = ["the cat and the dog and the bird sat on the mat by the door , not far"] * 5
    texts = [t + f" from w{i}" for i, t in enumerate(texts)] + ["a | a | b | a", "so so so Well, well", ""]
    docs = make([(i, t) for i, t in enumerate(texts)])
    vocab = Counter(w for t in texts for w in t.split())
    named = {w: perplexity.NAMED + i for i, (w, _) in enumerate(
        sorted(vocab.items(), key=lambda x: (-x[1], x[0]))[:perplexity.FREQUENT])}
    counts, lines = Counter(), []
    for t in texts:
        w, c = t.split(), [0, 0]
        for i, x in enumerate(w):
            c.append(1 if i and w[i - 1] == x else 2 if i > 1 and w[i - 2] == x else named[x])
        lines.append((w, c))
        counts.update(zip(c, c[1:], c[2:]))

    levels = {3: counts}
    for k in (2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    p = {}
    for k in (1, 2, 3):
        t = Counter(min(n, 5) for n in levels[k].values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else None
        d = {}
        for j in (1, 2, 3):
            v = j - (j + 1) * y * t[j + 1] / t[j] if y is not None and t[j] else None
            d[j] = v if v is not None and 0 < v < j else 0.5 * j
        total, left = defaultdict(float), defaultdict(float)
        for g, n in levels[k].items():
            total[g[:-1]] += n
            left[g[:-1]] += d[min(n, 3)]
        p = {g: (max(n - d[min(n, 3)], 0) + left[g[:-1]] * (p[g[1:]] if k > 1 else 1 / (len(levels[1]) + 1)))
             / total[g[:-1]] for g, n in levels[k].items()}
    words = brute_model(vocab)
    alone = {w: sum(math.log(words[("    " + w + " ")[i:i + 5]]) for i in range(len(w) + 1)) for w in vocab}

    for shipped in (0, perplexity.SHIPPED_NGRAMS):
        got = {r.doc_id: r.context for r in perplexity.measured(docs, shipped).collect()}
        for i, (w, c) in enumerate(lines):
            want = sum(math.log(p[g]) for g in zip(c, c[1:], c[2:])) - sum(
                alone[x] if k < 3 else math.log(vocab[x] / sum(vocab.values())) for x, k in zip(w, c[2:]))
            assert math.isclose(got[i], want, rel_tol=1e-9, abs_tol=1e-9)


def test_word_order_moves_perplexity(make):
    import random

    rng = random.Random(1)
    nouns = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("n", "l", "rt", "sk")]
    plain = [" ".join(f"the {rng.choice(nouns)} of a {rng.choice(nouns)} is in {rng.choice(nouns)} ."
                      for _ in range(15)) for _ in range(60)]
    salad = plain[0].split()
    rng.shuffle(salad)
    got = {r.doc_id: r.log_ppl for r in perplexity.quality_rules(
        make([*enumerate(plain), (100, " ".join(salad))])).collect()}
    assert got[100] > max(got[i] for i in range(60)) + 0.5


def test_share_of_junk_that_goes(spark):
    """Of labelled junk that passes the base rules; the documents are those of sf0.1."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    rows = perplexity.quality_rules(docs).join(labels, "doc_id").where("not base_failed").collect()
    junk, clean = ([r.kept for r in rows if r.quality == q] for q in (0, 1))
    assert len(junk) >= 300 and np.mean(junk) < 0.05
    assert np.mean(clean) > 0.995


def test_rules_on_odd_documents(odd, empty):
    rows = perplexity.quality_rules(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.base_failed and not r.kept and r.log_ppl is None for r in rows if r.n_words == 0)
    kept = perplexity.filter_documents(odd).collect()
    assert sorted(repr(r.doc_id) for r in kept) == sorted(repr(r.doc_id) for r in rows if r.kept)
    assert perplexity.quality_rules(empty).count() == 0 and perplexity.filter_documents(empty).count() == 0


# ---- quality classifier -------------------------------------------------------------

def test_sites_shrink_towards_their_priors(spark, make):
    rows = [(i, "t", "good" if i % 2 else "bad", "big") for i in range(400)] + [(1000, "t", "good", "tiny")]
    docs = make(rows)
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert all(r.kept and r.quality == pytest.approx(0.5) for r in got)  # one label tells nothing apart
    stats = spark.createDataFrame(
        [("a", 90.0, 100, 0.5), ("b", 10.0, 100, 0.5), ("c", 1.0, 1, 0.5)], "host string, s double, n long, prior double"
    ).withColumn("m", F.col("s") / F.col("n"))
    k = quality.concentration(stats, "m", "n", "prior")
    between = ((100 * 0.16 + 100 * 0.16 + 0.25) - 0.75) / 201
    assert k == pytest.approx(max(1.0, 0.25 / between - 1))
    flat = spark.createDataFrame([("a", 0.5, 100, 0.5), ("b", 0.5, 100, 0.5)], "host string, m double, n long, prior double")
    assert quality.concentration(flat, "m", "n", "prior") == 1e6


def test_classifier_tells_junk(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    # judged on documents whose labels it has not seen
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = quality.quality(docs, labels.where(~unseen)).join(
        labels.where(unseen).withColumnRenamed("quality", "label"), "doc_id").collect()
    assert np.mean([r.kept == (r.label == 1) for r in got]) > 0.95
    assert np.mean([r.kept for r in got if r.label == 1]) > 0.98


def test_classifier_on_odd_documents(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (2, None, None), (7, 1, 0), (8, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = quality.quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 < r.quality < 1 and r.kept is not None for r in rows)
    assert {(r.host, r.path) for r in rows} >= {("", ""), ("", "de"), ("s", "")}
    assert quality.quality(empty, labels).count() == 0
    assert quality.quality(odd, labels.limit(0)).where("not kept").count() == 0


def plain_strength(sites):
    """Moments of (mean, n, prior) rows."""
    spread = sum(n * (m - p) ** 2 for m, n, p in sites)
    noise = sum(p * (1 - p) for _, _, p in sites)
    n, scale = sum(x[1] for x in sites), sum(x[1] * x[2] * (1 - x[2]) for x in sites)
    between = max(0.0, (spread - noise) / n)
    return min(1e6, max(1.0, scale / n / between - 1)) if between > 0 else 1e6


def test_thousands_of_sparse_sites(spark, make):
    """Sums, shrinking and odds of every document against plain Python."""
    rnd = np.random.default_rng(4)
    good, bad = "plain words that follow each other in a quiet line of text", "BUY | NOW | !!! | $$$ | BUY | NOW"
    rows, quality_of = [], []
    for i in range(5000):
        host = f"dense{i % 3}" if i % 4 == 0 else f"h{rnd.integers(1500)}"
        # one dense host is junk, sparse sites are of either kind
        is_good = rnd.random() < (0.05 if host == "dense0" else 0.95 if host == "dense1" else 0.6)
        rows.append((i, f"{good if is_good else bad} {'x' * int(rnd.integers(9))}", f"p{rnd.integers(3)}", host))
        quality_of.append((i, int(is_good)))
    docs = make(rows)
    labels = spark.createDataFrame(quality_of[::7], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    mean = sum(r.p_document for r in got) / len(got)
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in got:
        hosts[r.host].append(r.p_document)
        paths[r.host, r.path].append(r.p_document)
    k = plain_strength([(np.mean(v), len(v), mean) for v in hosts.values()])
    host_q = {h: (sum(v) + k * mean) / (len(v) + k) for h, v in hosts.items()}
    k = plain_strength([(np.mean(v), len(v), host_q[h]) for (h, _), v in paths.items()])
    logit = lambda p: math.log(p / (1 - p))
    for r in got:
        v = paths[r.host, r.path]
        path_q = (sum(v) - r.p_document + k * host_q[r.host]) / (len(v) - 1 + k)
        odds = logit(r.p_document) - logit(mean) + logit(path_q)
        assert r.host_quality == pytest.approx(host_q[r.host], rel=1e-9)
        assert r.path_quality == pytest.approx(path_q, rel=1e-9)
        assert r.quality == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-9)
    assert len(paths) > 2000
    # Sparse sites stay nearer to the prior than their own mean; dense ones follow theirs.
    sparse = [h for h, v in hosts.items() if len(v) <= 2 and abs(np.mean(v) - mean) > 0.2]
    assert len(sparse) > 100
    assert all(abs(host_q[h] - mean) < 0.8 * abs(np.mean(hosts[h]) - mean) for h in sparse)
    assert abs(host_q["dense0"] - np.mean(hosts["dense0"])) < 0.05


def test_a_labelled_id_counts_once(spark, make):
    """However often a labelled document repeats, the classifier is the same."""
    rows = [(i, "calm words in a line " * 3 if i % 2 else "BUY ! $ | BUY ! $", "en", "s") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = quality.fit(make(rows).select("doc_id", "text"), labels, "quality", 100)
    often = quality.fit(make(rows + [rows[0]] * 300).select("doc_id", "text"), labels, "quality", 100)
    assert np.allclose(once.coefficients.toArray(), often.coefficients.toArray())


# ---- toxicity -----------------------------------------------------------------------

def test_features_see_what_they_name():
    words = frozenset(["idiot", "lowe-"])
    names = toxicity.FEATURES
    f = dict(zip(names, toxicity.features("You are an IDIOT and an id1ot, loweisch!!", words, {})))
    assert f["hits"] == 2 and f["masked_hits"] == 1 and f["near_second_person"] == 1 and f["shouted"] > 0
    assert toxicity.features("", words, {}) == toxicity.features(" \n", words, {}) == (0.0,) * len(names)


def test_held_out_documents_are_ranked(spark):
    import zlib

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = toxicity.query(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    bad = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 1]
    good = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 0]
    assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) > 0.9
    assert np.mean([s < 0.5 for s in good]) > 0.98


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.withColumn("toxic", F.when(toxicity.in_test(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score_documents(docs, x).orderBy("doc_id").collect() for x in (labels, other))
    assert a == b


def test_toxicity_on_odd_documents(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 1, 1), (3, 1, None), (7, 1, 0), (8, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = toxicity.score_documents(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.score is not None and r.held_out is not None for r in rows)
    assert toxicity.score_documents(empty, labels).count() == 0
    assert {r.score for r in toxicity.score_documents(odd, labels.limit(0)).collect()} == {0.0}
