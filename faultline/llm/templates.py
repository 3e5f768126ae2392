"""Line dedup with a log-template tree, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.stage import staged
from .common import HashFilter, plain

#: What separates tokens inside a line.
SPACE = r"[ \t\x0B\f\r]"
#: Stands for a variable field.
FIELD = "<*>"


def masked(line: Column) -> Column:
    """The line with single spaces, and every token that holds a digit as a variable field."""
    plain = F.when(
        F.regexp_like(line, F.lit("[0-9]")),
        F.regexp_replace(line, r"[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*", FIELD),
    ).otherwise(line)
    return F.array_join(F.filter(F.split(plain, SPACE + "+"), lambda t: t != ""), " ")


def numbered_lines(docs: DataFrame, depth: int) -> DataFrame:
    """One row per line with a token: (doc_id, _doc, line_no, tokens, _leaf, _line)."""
    lines = docs.select(
        "doc_id", F.xxhash64("text").alias("_doc"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "_raw"),
    )
    rows = lines.select("doc_id", "_doc", "line_no", masked(F.col("_raw")).alias("_line")).where("_line <> ''")
    n = F.length("_line") - F.length(F.replace(F.col("_line"), F.lit(" "))) + 1
    return rows.withColumn("tokens", n).withColumn(
        "_leaf", F.xxhash64("tokens", F.substring_index("_line", " ", depth)))


def dropped_lines(docs: DataFrame, min_documents: int = 10, depth: int = 3,
                  similarity: float = 0.7) -> DataFrame:
    """The lines that repeat a recurring template: (doc_id, _doc, line_no)."""
    lines = staged(numbered_lines(docs, depth))
    # Texts per leaf, copies counted once; a leaf needs enough of them to hold a template.
    leaves = staged(
        lines.select("_leaf", "_doc").distinct().groupBy("_leaf").count()
        .where(F.col("count") >= min_documents).select("_leaf")
    )
    likely = HashFilter(leaves)
    found = staged(likely.keep(lines, F.col("_leaf")).join(leaves, "_leaf", "left_semi"))

    # Equal lines meet once, before their tokens are counted by position.
    forms = staged(found.groupBy("_leaf", "_line").agg(F.count(F.lit(1)).alias("n")))
    drops, used = recurring_lines(found, alike_lines(forms, similarity), min_documents)
    rest = forms.join(used, ["_leaf", "_line"], "left_anti")
    rest = staged(supported(rest, min_documents, similarity))

    # What the majority hides: first lines that recur as they are, each a leaf of its own.
    own = rest.where(F.col("n") >= min_documents).select(
        "_leaf", "_line", F.xxhash64("_leaf", "_line").alias("_next"))
    more, used = recurring_lines(renamed(found, own), own.select(F.col("_next").alias("_leaf"), "_line"), min_documents)
    drops = drops.union(more)
    rest = rest.withColumn("_own", F.xxhash64("_leaf", "_line")).join(
        used.select(F.col("_leaf").alias("_own")), "_own", "left_anti").drop("_own")

    # Then the templates of ever smaller leaves. A leaf's lines share one more token each
    # round, so this ends; it goes on only with lines that may still have a template.
    while True:
        rest = staged(supported(rest, min_documents, similarity))
        if not rest.limit(1).count():
            return drops
        parts = staged(split(rest))
        found = staged(renamed(found, parts))
        rest = staged(parts.select(F.col("_next").alias("_leaf"), "_line", "n"))
        more, used = recurring_lines(found, alike_lines(rest, similarity), min_documents)
        drops = drops.union(more)
        rest = rest.join(used, ["_leaf", "_line"], "left_anti")


def renamed(found: DataFrame, parts: DataFrame) -> DataFrame:
    """The lines of ``parts`` (_leaf, _line, _next), with _next as their leaf."""
    return found.join(parts.select("_leaf", "_line", "_next"), ["_leaf", "_line"]).drop("_leaf").withColumnRenamed(
        "_next", "_leaf").select(found.columns)


def supported(forms: DataFrame, min_documents: int, similarity: float) -> DataFrame:
    """The lines that a template of some part of their leaf may hold.

    Such a template has ``min_documents`` lines at least, and a token is fixed if more than
    half of them have it; a line needs its share of tokens that stand so often in the leaf.
    """
    spread = forms.select("_leaf", "_line", "n", F.posexplode(F.split("_line", " ")).alias("at", "token"))
    often = staged(spread.groupBy("_leaf", "at", "token").agg(F.sum("n").alias("votes"))
                   .where(F.col("votes") * 2 > min_documents))
    enough = spread.join(often, ["_leaf", "at", "token"]).groupBy("_leaf", "_line").agg(
        F.count(F.lit(1)).alias("held")).where(F.col("held") >= F.lit(similarity) * F.size(F.split("_line", " ")))
    able = staged(forms.join(enough.select("_leaf", "_line"), ["_leaf", "_line"], "left_semi"))
    large = able.groupBy("_leaf").agg(F.sum("n").alias("all_n")).where(F.col("all_n") >= min_documents)
    return able.join(large.select("_leaf"), "_leaf", "left_semi")


def split(forms: DataFrame) -> DataFrame:
    """Each line with the leaf of its most frequent token that not all lines of its leaf have.

    Lines without such a token are alone in their leaf and left out. (_leaf, _line, n, _next)
    """
    spread = forms.select("_leaf", "_line", "n", F.posexplode(F.split("_line", " ")).alias("at", "token"))
    votes = spread.groupBy("_leaf", "at", "token").agg(F.sum("n").alias("votes"))
    sizes = forms.groupBy("_leaf").agg(F.sum("n").alias("all_n"))
    votes = staged(votes.join(sizes, "_leaf").where("votes < all_n").select("_leaf", "at", "token", "votes"))
    best = spread.join(votes, ["_leaf", "at", "token"]).groupBy("_leaf", "_line").agg(
        F.first("n").alias("n"), F.max(F.struct("votes", F.negative("at").alias("at"), "token")).alias("best"))
    return best.select("_leaf", "_line", "n", F.xxhash64("_leaf", "best.at", "best.token").alias("_next"))


def alike_lines(forms: DataFrame, similarity: float) -> DataFrame:
    """The lines (_leaf, _line) that belong to the majority template of their leaf."""
    spread = forms.select("_leaf", "n", F.posexplode(F.split("_line", " ")).alias("at", "token"))
    votes = spread.groupBy("_leaf", "at", "token").agg(F.sum("n").alias("n"))
    sizes = forms.groupBy("_leaf").agg(F.sum("n").alias("all_n"))
    fixed = votes.join(sizes, "_leaf").where(F.col("n") * 2 > F.col("all_n")).select("_leaf", "at", "token")
    # Tokens of a line that agree with the template's fixed tokens.
    template = staged(fixed.groupBy("_leaf").agg(  # on its own, so that a join can split a hot leaf
        F.map_from_entries(F.collect_list(F.struct("at", "token"))).alias("_fixed")))
    agree = F.aggregate(
        F.transform(F.split("_line", " "), lambda t, i: (F.col("_fixed")[i] == t).cast("int")),
        F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    size = F.size(F.split("_line", " "))
    return staged(forms.join(template, "_leaf").where(agree >= F.lit(similarity) * size).select("_leaf", "_line"))


def recurring_lines(found: DataFrame, alike: DataFrame, min_documents: int) -> tuple[DataFrame, DataFrame]:
    """Lines to drop (doc_id, _doc, line_no), and the (_leaf, _line) whose template recurs.

    One template a leaf, that of the lines ``alike``.
    """
    members = found.join(alike, ["_leaf", "_line"], "left_semi").select("_leaf", "doc_id", "_doc", "line_no")
    members = staged(members)
    recurring = (
        members.select("_leaf", "_doc").distinct().groupBy("_leaf").agg(F.count(F.lit(1)).alias("texts"))
        .join(members.groupBy("_leaf").agg(F.min("doc_id").alias("_first")), "_leaf")
        .where(F.col("texts") >= min_documents).select("_leaf", "_first")
    )
    recurring = staged(recurring)
    kept = F.coalesce(F.col("doc_id") == F.col("_first"), F.lit(False))
    return (members.join(recurring, "_leaf").where(~kept).select("doc_id", "_doc", "line_no"),
            staged(alike.join(recurring, "_leaf", "left_semi").select("_leaf", "_line")))


def drop_recurring_lines(docs: DataFrame, min_documents: int = 10, depth: int = 3,
                         similarity: float = 0.7) -> DataFrame:
    """Documents without the lines of templates that recur across documents.

    A line's tokens are split at white space, and tokens with a digit become variable
    fields. The tree is of fixed depth: lines part by their number of tokens, then by
    their first ``depth`` tokens. In a leaf, a position that holds one token in more than
    half of the lines is fixed, any other is variable. A line belongs to the leaf's
    template if its share of tokens equal to fixed ones is at least ``similarity``. If such
    lines stand in ``min_documents`` or more different texts, they are dropped, save in the
    document of the smallest doc_id that has one, so that one copy stays.

    A leaf may hold further templates. Of the lines left, each that stands by itself in
    ``min_documents`` texts is a template; the others part by their most frequent token
    that not all lines of the leaf have, and the rule above holds in these smaller leaves,
    until no lines are left that could make up a template.

    Adds ``n_lines`` and ``n_dropped``; the kept lines are joined as before. Documents stay,
    even with nothing left. A missing text stays missing with 0 lines, an empty text has
    one line. Lines without a token are kept. Copies of one text count once towards a
    template. Rows that repeat a doc_id and text get equal results; a missing doc_id is
    never the first. Input columns of the added names, or that begin with an underscore, are
    dropped.
    """
    docs = plain(docs, "n_lines", "n_dropped")
    drops = dropped_lines(docs.select("doc_id", "text"), min_documents, depth, similarity).groupBy(
        F.col("doc_id").alias("_id"), "_doc").agg(F.collect_set("line_no").alias("_drop"))
    lines = F.split("text", "\n")
    n = F.coalesce(F.size(lines), F.lit(0))
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drop"))
    text = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n"))
    joined = docs.withColumn("_key", F.xxhash64("text")).join(
        drops, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_doc")), "left")
    return joined.select(
        *[c for c in docs.columns if c != "text"],
        F.when(F.col("text").isNull(), 0).otherwise(n).alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).alias("n_dropped"), text.alias("text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import documents

    return drop_recurring_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "text")


SQL = r"""
WITH raw AS (
  SELECT doc_id, md5(text) AS doc, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents WHERE text IS NOT NULL),
tok AS (
  SELECT doc_id, doc, line_no,
    list_transform(list_filter(string_split_regex(line, '[ \t\x0B\f\r]+'), lambda t: t <> ''),
                   lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t
  FROM raw),
lines AS (SELECT *, (len(t), t[1:3]) AS leaf FROM tok WHERE len(t) > 0),
leaves AS (SELECT leaf FROM lines GROUP BY leaf HAVING count(DISTINCT doc) >= 10),
found AS (SELECT l.* FROM lines l JOIN leaves USING (leaf)),
sizes AS (SELECT leaf, count(*) AS n FROM found GROUP BY leaf),
pos AS (SELECT leaf, doc_id, doc, line_no, unnest(t) AS token, unnest(range(len(t))) AS place FROM found),
fixed AS (
  SELECT leaf, place, token FROM pos JOIN sizes USING (leaf)
  GROUP BY leaf, place, token HAVING count(*) * 2 > any_value(n)),
members AS (
  SELECT p.leaf, p.doc_id, p.doc, p.line_no
  FROM pos p LEFT JOIN fixed f ON p.leaf = f.leaf AND p.place = f.place AND p.token = f.token
  GROUP BY p.leaf, p.doc_id, p.doc, p.line_no HAVING count(f.token) >= 0.7::DOUBLE * count(*)),
recurring AS (
  SELECT leaf, min(doc_id) AS first FROM members GROUP BY leaf HAVING count(DISTINCT doc) >= 10),
drops AS (
  SELECT DISTINCT m.doc_id, m.doc, m.line_no FROM members m JOIN recurring r USING (leaf)
  WHERE m.doc_id IS DISTINCT FROM r.first OR m.doc_id IS NULL),
kept AS (
  SELECT r.doc_id, r.doc, count(*) AS n_lines, count(d.line_no) AS n_dropped,
         string_agg(r.line, chr(10) ORDER BY r.line_no) FILTER (d.line_no IS NULL) AS text
  FROM raw r LEFT JOIN drops d
    ON r.doc_id IS NOT DISTINCT FROM d.doc_id AND r.doc = d.doc AND r.line_no = d.line_no
  GROUP BY r.doc_id, r.doc)
SELECT o.doc_id, coalesce(k.n_lines, 0)::INT AS n_lines, coalesce(k.n_dropped, 0)::INT AS n_dropped,
       CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents o LEFT JOIN kept k ON o.doc_id IS NOT DISTINCT FROM k.doc_id AND md5(o.text) = k.doc
"""
