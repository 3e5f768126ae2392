"""Edit-similarity join: texts whose ratio 2 * LCS / (both lengths) reaches a threshold.

Both sides become bags of tokens, a token being a letter, or two neighbouring letters, with
the number of its occurrence, so that a bag is a set. A common subsequence of m letters
means m common letters, and at least 3m - (both lengths) - 1 common neighbours: each letter
that is left out or put in parts at most one more pair that the subsequence keeps together.
From the ratio follows a Jaccard similarity that the bags must have, found by the prefix
filter of ``similar_sets``. Neighbours tell texts apart far better than letters do, yet say
nothing below a ratio of 2/3 or of short texts; there letters are used. What passes is
compared exactly. No pair is lost at any threshold above 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import similarity as S
from .simjoin import similar_sets
from .stage import staged

#: Neighbours are used for ratios from here on ...
NEIGHBOUR_RATIO = 0.8
#: ... and for texts of at least so many letters.
NEIGHBOUR_CHARS = 16


def edit_head(text) -> Column:
    """What the edit measure reads of a text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.lower(F.substring(text, 1, S.EDIT_CHARS))


def letter_bag(head: str) -> Column:
    """Letters with the number of their occurrence."""
    low = F.col(head)
    times = lambda c: F.length(low) - F.length(F.replace(low, c, F.lit("")))
    return F.flatten(F.transform(F.array_distinct(F.split(low, "")), lambda c: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), times(c))), lambda i: F.concat(c, F.lit("#"), i.cast("string")))))


def neighbour_bag(head: str) -> Column:
    """Pairs of neighbouring letters with the number of their occurrence."""
    low = F.col(head)
    pairs = F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2)))
    counted = F.array_sort(pairs)
    # In order, equal pairs stand together: the number is the distance to the first of them.
    return F.transform(counted, lambda p, i: F.concat(
        p, F.lit("#"), (i - F.array_position(counted, p)).cast("string")))


def letters_needed(ratio: float) -> float:
    """Jaccard similarity of the letter bags of two texts with this ratio."""
    return ratio / (2.0 - ratio)


def neighbours_needed(ratio: float, chars: int = NEIGHBOUR_CHARS) -> float:
    """The same for neighbours, if both texts have at least so many letters."""
    share = ((1.5 * ratio - 1.0) * 2 * chars - 1.0) / (2 * chars - 2)
    return share / (1.0 - share)


def near_texts(left: DataFrame, right: DataFrame, ratio: float) -> DataFrame:
    """left_id, right_id, ratio of pairs that reach ``ratio``, from ``(id, text)`` tables.

    Equal heads are compared once, whatever their number of ids. A missing or empty text is
    like no other. The ratio must be above 0.
    """
    if not ratio > 0:
        raise ValueError("the ratio must be above 0")

    def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        named = staged(rows.select("id", edit_head("text").alias("head")).where(F.length("head") > 0)
                       .withColumn("hid", F.md5("head")))
        return named, staged(named.groupBy("hid").agg(F.any_value("head").alias("head")))

    (a, heads_a), (b, heads_b) = sides(left), sides(right)

    def found(bag, needed: float, where: Column) -> DataFrame:
        sets = [h.where(where).select(F.col("hid").alias("id"), bag("head").alias("words")) for h in (heads_a, heads_b)]
        return similar_sets(*sets, needed).select("left_id", "right_id")

    if ratio >= NEIGHBOUR_RATIO:
        chars = F.length("head")
        # The partner of a short text is not much longer.
        longest = int((NEIGHBOUR_CHARS - 1) * (2.0 - ratio) / ratio + 1e-9)
        near = found(neighbour_bag, neighbours_needed(ratio), chars >= NEIGHBOUR_CHARS).union(
            found(letter_bag, letters_needed(ratio), chars <= longest)).distinct()
    else:
        near = found(letter_bag, letters_needed(ratio), F.lit(True))
    texts = lambda h, s: h.select(F.col("hid").alias(f"{s}_id"), F.col("head").alias(f"{s}_head"))
    pairs = near.join(texts(heads_a, "left"), "left_id").join(texts(heads_b, "right"), "right_id")
    x, y = F.length("left_head"), F.length("right_head")
    pairs = pairs.where(2 * F.least(x, y) >= ratio * (x + y) - 1e-9)
    scored = staged(pairs.select("left_id", "right_id", S.edit_similarity("left_head", "right_head").alias("ratio")))
    scored = scored.where(F.col("ratio") >= ratio - 1e-12)
    ids = lambda h, s: h.select(F.col("hid").alias(f"{s}_id"), F.col("id").alias(f"_{s}"))
    return scored.join(ids(a, "left"), "left_id").join(ids(b, "right"), "right_id").select(
        F.col("_left").alias("left_id"), F.col("_right").alias("right_id"), "ratio")
