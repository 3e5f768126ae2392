"""Text helpers as plain column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that never count as keywords.
NOISE_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "were", "are", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "should", "could", "may", "might", "must", "can", "this",
    "that", "these", "those", "i", "you", "he", "she", "it", "we", "they",
    "what", "which", "who", "when", "where", "why", "how", "all", "each",
    "every", "both", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s",
    "t", "just", "don", "now", "ve", "ll", "m", "o", "re", "d", "y",
)

# Test-name prefixes, tried in this order.
NAME_PREFIXES = ("test_", "tc_", "testcase_")

# Characters removed from both ends of a line (Unicode white space plus U+001C..U+001F).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A keyword is a whole word of ASCII letters, digits and underscores. The look-arounds
# spell out the Unicode word boundary, which differs between JDK releases.
_WORD = r"[\p{L}\p{N}_]"
_KEYWORD = rf"(?<!{_WORD})[a-z0-9_]{{3,}}+(?!{_WORD})"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.btrim(_col(c), F.lit(WHITE_SPACE))


def keyword_set(c) -> Column:
    """All keywords of a text: distinct, in first-seen order. Null gives an empty array."""
    words = F.regexp_extract_all(F.lower(_col(c)), F.lit(_KEYWORD), F.lit(0))
    noise = F.split(F.lit(" ".join(w for w in NOISE_WORDS if len(w) > 2)), " ")
    return F.coalesce(F.array_except(words, noise), F.array().cast("array<string>"))


def keywords(c, max_keywords: int = 10) -> Column:
    """The first ``max_keywords`` keywords of a text."""
    return F.slice(keyword_set(c), 1, max_keywords)


def test_name_keywords(c) -> Column:
    """Parts of a test name split at underscores, without the usual prefixes and noise."""
    name = F.lower(_col(c))
    stripped = F.regexp_replace(name, "^(?:" + "|".join(NAME_PREFIXES) + ")", "")
    noise = [w for w in NOISE_WORDS if len(w) > 2]
    parts = F.transform(F.split(stripped, "_"), strip)
    kept = F.filter(parts, lambda w: (F.length(w) > 2) & ~w.isin(noise))
    return F.coalesce(kept, F.array().cast("array<string>"))


test_name_keywords.__test__ = False  # not a pytest case


def clean_text(c) -> Column:
    """Lower case, every run of other characters becomes one space."""
    cleaned = F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " "))
    return F.coalesce(cleaned, F.lit(""))


def truncate_text(c, max_length: int = 100) -> Column:
    c = F.coalesce(_col(c), F.lit(""))
    short = F.concat(F.substring(c, 1, max_length - 3), F.lit("..."))
    return F.when(F.length(c) <= max_length, c).otherwise(short)


def one_decimal(x) -> Column:
    """Text of a non-negative double with one decimal, ties of the exact value to even.

    ``format_string`` rounds the printed decimal half up instead. Ten times x is 8x + 2x;
    both products are exact, and the error of their sum is recovered exactly, so the
    comparison with one half sees the true value.
    """
    x = _col(x).cast("double")
    big, small = x * F.lit(8.0), x * F.lit(2.0)
    total = big + small
    lost = small - (total - big)
    whole = F.floor(total)
    part = total - whole
    up = (
        (part > 0.5)
        | ((part == 0.5) & (lost > 0))
        | ((part == 0.5) & (lost == 0) & (whole % 2 == 1))
    )
    tenths = whole + up.cast("bigint")
    return F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")
    )


def format_duration(seconds) -> Column:
    """45.0s, 3m 5s or 1h 2m 5s."""
    s = _col(seconds).cast("double")
    minutes, rest = F.floor(s / 60), F.floor(s % 60)
    return (
        F.when(s < 60, F.concat(one_decimal(s), F.lit("s")))
        .when(minutes < 60, F.format_string("%dm %ds", minutes, rest))
        .when(
            s.isNotNull(),
            F.format_string("%dh %dm %ds", F.floor(minutes / 60), minutes % 60, rest),
        )
    )


def token_estimate(c) -> Column:
    return F.floor(F.coalesce(F.length(_col(c)), F.lit(0)) / 4).cast("int")


def highlight_keywords(text, words, marker: str = "**") -> Column:
    """Wrap every occurrence of each word (an array column), longest word first.

    Later, shorter words may match inside earlier marks; that is part of the result.
    """
    longest_first = F.array_sort(
        _col(words), lambda a, b: F.length(b) - F.length(a)
    )
    mark = marker.replace("\\", "\\\\").replace("$", "\\$")
    return F.aggregate(
        F.coalesce(longest_first, F.array().cast("array<string>")),
        _col(text),
        lambda done, w: F.regexp_replace(
            done, F.concat(F.lit("(?iu)\\Q"), w, F.lit("\\E")), F.lit(f"{mark}$0{mark}")
        ),
    )


def issue_link(base_url, key) -> Column:
    base = F.lit(base_url) if isinstance(base_url, str) else base_url
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/browse/"), _col(key))


# Spark's English stop words.
ENGLISH_STOP_WORDS = tuple("""
    i me my myself we our ours ourselves you your yours yourself yourselves he him his
    himself she her hers herself it its itself they them their theirs themselves what which
    who whom this that these those am is are was were be been being have has had having do
    does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will
    just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
    they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't
    wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't
    shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
    what's when's where's who's why's would
""".split())
