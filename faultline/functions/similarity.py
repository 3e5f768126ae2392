"""Similarity measures and the texts they compare."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from .text import _col, keywords, strip

# Weights of the combined score and the bonus of settled issues.
KEYWORD_WEIGHT = 0.5
TEXT_WEIGHT = 0.3
EDIT_WEIGHT = 0.2
SETTLED_BONUS = 1.1
COMPARE_KEYWORD_WEIGHT = 0.6
COMPARE_TEXT_WEIGHT = 0.4

# How much of a text the edit measure reads, and what is kept of a sentence.
EDIT_CHARS = 200
SENTENCE_CHARS = 200

# Fixed value: comments that count as text of an issue.
TEXT_COMMENTS = 3

# Words that mark a sentence as a solution, in search order.
MATCH_SOLUTION_WORDS = ("solution", "fix", "resolved", "patch", "workaround", "applied")
ISSUE_SOLUTION_WORDS = MATCH_SOLUTION_WORDS + ("implemented", "corrected", "updated")

# Statuses and resolutions that count as settled.
SETTLED_STATUS = ("resolved", "closed")
SETTLED_RESOLUTION = ("fixed", "done", "resolved")

# Terms that raise a keyword's rank when a search is suggested.
TECHNICAL_TERMS = (
    "memory", "allocation", "dma", "cache", "buffer",
    "timeout", "assertion", "segmentation", "fatal",
)


def settled(status) -> Column:
    return F.coalesce(F.lower(_col(status)).isin(*SETTLED_STATUS), F.lit(False))


def keyword_jaccard(left, right) -> Column:
    """struct(score, matching, total) of two keyword arrays, case-insensitive."""
    low = lambda a: F.array_distinct(F.transform(_col(a), F.lower))
    a, b = low(left), low(right)
    some = (F.size(a) > 0) & (F.size(b) > 0)
    total = F.size(F.array_union(a, b))
    both = F.array_sort(F.array_intersect(a, b))
    return F.struct(
        F.when(some, F.size(both) / total).otherwise(F.lit(0.0)).alias("score"),
        F.when(some, both).otherwise(F.array().cast("array<string>")).alias("matching"),
        F.when(some, total).otherwise(F.lit(0)).alias("total"),
    )


def simple_similarity(left, right) -> Column:
    return keyword_jaccard(keywords(left, 20), keywords(right, 20))["score"]


def compare_errors(left, right, text_score=None) -> Column:
    """Similarity of two error texts; the text part is 0 unless a score is passed in."""
    score = keyword_jaccard(keywords(left, 10), keywords(right, 10))["score"]
    score = score * COMPARE_KEYWORD_WEIGHT
    if text_score is not None:
        score = score + _col(text_score) * COMPARE_TEXT_WEIGHT
    return F.least(F.lit(1.0), score)


def common_lengths():
    """A function ``(a texts, b texts, ai, bi)``: the length of the longest common subsequence
    of a[ai[i]] and b[bi[i]] for each i, as an array.

    Rows of bits as in the bit-parallel measure of one pair, but for thousands of pairs at
    once, 64 letters of a to a number. All of it is nested here, so that it travels with the
    job and executors need no copy of this package.
    """
    import numpy as np

    pairs, cells = 4096, 1 << 20  # pairs worked on at once; numbers in a table of letters
    full = np.uint64(0xFFFFFFFFFFFFFFFF)

    def codes(texts):
        """Letters as numbers from 1, padded with 0."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.zeros((len(texts), max(1, int(lens.max(initial=0)))), np.uint32)
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        out[np.arange(out.shape[1]) < lens[:, None]] = flat + 1
        return out, lens

    def tables(a, lens):
        """Numbers of the letters of a, and where each letter stands in each text."""
        known = np.unique(a)
        known = known[known > 0]
        number = np.zeros(0x110001, np.int32)
        number[known] = np.arange(1, len(known) + 1)
        width = (int(lens.max(initial=0)) + 63) // 64
        where = np.zeros((len(a), len(known) + 1, max(1, width)), np.uint64)
        row = np.arange(len(a))
        for at in range(a.shape[1]):
            where[row, number[a[:, at]], at // 64] |= np.uint64(1 << (at % 64))
        where[:, 0] = 0
        return number, where

    def common(number, where, ai, b, lens):
        width = where.shape[2]
        rows = [np.full(len(ai), full) for _ in range(width)]
        letters = np.ascontiguousarray(number[b[:, :int(lens.max(initial=0))]].T)
        for column in letters:
            mask = where[ai, column]
            carry = None
            for k in range(width):
                row, m = rows[k], mask[:, k]
                total = row + (row & m)
                over = total < row
                if carry is not None:
                    total += carry
                    over |= total < carry
                rows[k] = total | (row & ~m)
                carry = over.astype(np.uint64)
        return sum(64 - np.bitwise_count(r).astype(np.int64) for r in rows)

    def lengths(a, b, ai, bi):
        out = np.zeros(len(ai), np.int64)
        if not len(ai):
            return out
        ca, na = codes(a)
        cb, nb = codes(b)
        order = np.lexsort((nb[bi], na[ai] > 128))
        at = 0
        while at < len(order):
            part, step = order[at:at + pairs], pairs
            while True:  # fewer pairs where their letters are very many
                used, inverse = np.unique(ai[part], return_inverse=True)
                sub = ca[used][:, :max(1, int(na[used].max()))]
                if len(part) <= 64 or len(used) * len(np.unique(sub)) * ((sub.shape[1] + 63) // 64) <= cells:
                    break
                step //= 2
                part = order[at:at + step]
            number, where = tables(sub, na[used])
            out[part] = common(number, where, inverse, cb[bi[part]], nb[bi[part]])
            at += len(part)
        return out

    return lengths


def _edit_ratio_udf():
    """The measure as a pandas UDF, with its code."""
    lengths = common_lengths()

    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        a, ua = pd.factorize(left.fillna(""))
        b, ub = pd.factorize(right.fillna(""))
        if len(ua) > len(ub):
            a, ua, b, ub = b, ub, a, ua
        both = lengths(list(ua), list(ub), a, b)
        x, y = ua.str.len().to_numpy()[a], ub.str.len().to_numpy()[b]
        some = (x > 0) & (y > 0)
        return pd.Series((2.0 * both / (x + y).clip(1)) * some, dtype="float64")

    return F.pandas_udf(ratio, T.DoubleType())


def edit_similarity(left, right) -> Column:
    """2 * LCS / (length + length) of the lower-cased heads; 0 when a side is empty.

    Spark's levenshtein counts a replaced letter once and is a different measure, so the
    pairs go to Python in Arrow batches. Call it on pruned pairs only.
    """
    head = lambda c: F.lower(F.substring(_col(c), 1, EDIT_CHARS))
    return _edit_ratio_udf()(head(left), head(right))


def issue_text(summary="summary", description="description", labels="labels", comments=None):
    """The searchable text of an issue: summary doubled, description, labels, 3 comments."""
    empty = lambda c: F.nullif(c, F.lit(""))
    parts = [F.repeat(empty(_col(summary)), 2), empty(_col(description))]
    if labels is not None:
        parts.append(F.when(F.size(_col(labels)) > 0, F.array_join(_col(labels), " ")))
    if comments is not None:
        bodies = F.transform(F.slice(_col(comments), 1, TEXT_COMMENTS), lambda c: empty(c["body"]))
        kept = F.filter(bodies, lambda b: b.isNotNull())
        parts.append(F.when(F.size(kept) > 0, F.array_join(kept, " ")))
    return F.concat_ws(" ", *parts)


def _first(array) -> Column:
    return F.get(array, F.lit(0))


def _let(value, body) -> Column:
    """``body(value)`` with the value evaluated once."""
    return _first(F.transform(F.array(value), body))


def holds_any(low, words) -> Column:
    held = low.contains(words[0])
    for w in words[1:]:
        held = held | low.contains(w)
    return held


def _comment_with(comments, words) -> Column:
    return _first(F.filter(_col(comments), lambda c: _let(
        F.lower(c["body"]), lambda low: holds_any(low, words))))["body"]


def _sentence(text, pattern, test) -> Column:
    """First sentence that passes, trimmed and cut."""
    hits = F.filter(F.split(text, pattern), lambda s: test(F.lower(s)))
    return F.substring(strip(_first(hits)), 1, SENTENCE_CHARS)


def _sentence_by_word(text, words) -> Column:
    """First word of the list that occurs anywhere; then the first sentence holding it."""

    def pick(low):
        word = F.when(low.contains(words[0]), F.lit(words[0]))
        for w in words[1:]:
            word = word.when(low.contains(w), F.lit(w))
        return word

    return _let(_let(F.lower(text), pick), lambda word: F.when(
        word.isNotNull(), _sentence(text, "[.!?]", lambda s: s.contains(word))))


def _sentence_any_word(text, words) -> Column:
    """First sentence that holds any of the words."""
    held = _let(F.lower(text), lambda low: holds_any(low, words))
    return F.when(held, _sentence(text, "\\.", lambda s: _let(
        s, lambda low: holds_any(low, words))))


def solution_for_match(resolution="resolution", description="description", comments=None):
    """Solution sentence of a matched issue: comments of a fixed issue, then description."""
    words = MATCH_SOLUTION_WORDS
    from_text = _sentence_by_word(_col(description), words)
    if comments is None:
        return from_text
    fixed = F.lower(_col(resolution)).isin(*SETTLED_RESOLUTION)
    from_comment = F.when(fixed, _sentence_by_word(_comment_with(comments, words), words))
    return F.coalesce(from_comment, from_text)


def solution_for_issue(resolution="resolution", description="description", comments=None):
    """Solution sentence of a looked-up issue; only fixed issues have one."""
    words = ISSUE_SOLUTION_WORDS
    found = _sentence_any_word(_col(description), words)
    if comments is not None:
        found = F.coalesce(_sentence_any_word(_comment_with(comments, words), words), found)
    return F.when(F.lower(_col(resolution)).isin(*SETTLED_RESOLUTION), found)


def match_score(keyword_score, edit_score, is_settled, text_score=None) -> Column:
    """Weighted sum, raised for settled issues, kept within 0..1."""
    score = _col(keyword_score) * KEYWORD_WEIGHT
    if text_score is not None:
        score = score + _col(text_score) * TEXT_WEIGHT
    score = score + _col(edit_score) * EDIT_WEIGHT
    score = F.when(_col(is_settled), score * SETTLED_BONUS).otherwise(score)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def _percent(c) -> Column:
    return F.floor(_col(c) * 100).cast("string")


def match_reason(keyword_score, matching, total, edit_score, is_settled, text_score=None):
    """Why an issue was matched, parts joined by semicolons."""
    kw = F.when(
        _col(keyword_score) > 0.5,
        F.concat(
            F.lit("Keyword match: "), _percent(keyword_score), F.lit("% match ("),
            F.size(_col(matching)).cast("string"), F.lit("/"),
            _col(total).cast("string"), F.lit(" keywords)"),
        ),
    )
    parts = [kw]
    if text_score is not None:
        parts.append(
            F.when(
                _col(text_score) > 0.5,
                F.concat(F.lit("Text similarity: "), _percent(text_score), F.lit("%")),
            )
        )
    parts.append(
        F.when(
            _col(edit_score) > 0.5,
            F.concat(F.lit("Summary match: "), _percent(edit_score), F.lit("%")),
        )
    )
    parts.append(F.when(_col(is_settled), F.lit("Issue is resolved")))
    reason = F.concat_ws("; ", *parts)
    return F.when(reason == "", F.lit("Low similarity")).otherwise(reason)


def suggest_keywords(signature, words, max_keywords: int = 5) -> Column:
    """The most telling keywords of an error, best first, as an array."""
    low = F.lower(_col(signature))

    def weight(w):
        score = F.lit(1.0)
        score = score + F.when(low.contains(F.lower(w)), 2.0).otherwise(0.0)
        score = score + F.when(F.length(w) > 5, 1.0).otherwise(0.0)
        technical = F.lower(w).rlike("|".join(TECHNICAL_TERMS))
        return score + F.when(technical, 1.5).otherwise(0.0)

    scored = F.transform(
        F.array_distinct(_col(words)),
        lambda w, i: F.struct((-weight(w)).alias("cost"), i.alias("i"), w.alias("word")),
    )
    return F.transform(F.slice(F.array_sort(scored), 1, max_keywords), lambda s: s["word"])
