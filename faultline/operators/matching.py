"""Matching errors to issues: candidates, scores, ranking, grouping.

Errors and issues both come in copies. Equal errors are matched once and the result is
joined back; issues that score alike by construction (same keywords, same settled state,
same summary head) form one profile and are scored once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import similarity as S
from ..functions.text import issue_link, keyword_set, keywords
from .blockmatch import LETTERS, judged_pairs
from .skew import salted_join
from .stage import staged

# Fixed values, all defaults of arguments: keywords read from an issue, keywords that
# select candidates, and the length of a description in a result.
ISSUE_KEYWORDS = 20
SEARCH_KEYWORDS = 5
DESCRIPTION_CHARS = 500



def jaccard_bound(min_score: float, any_settled: bool = True) -> float:
    """Smallest keyword similarity with which min_score can still be reached."""
    bonus = S.SETTLED_BONUS if any_settled else 1.0
    return (min_score / bonus - S.EDIT_WEIGHT) / S.KEYWORD_WEIGHT


def _fingerprint(*parts) -> Column:
    return F.md5(F.concat_ws("\x01", *[F.coalesce(p, F.lit("\x02")) for p in parts]))


def error_queries(errors: DataFrame) -> DataFrame:
    """Adds ``query``: equal for errors with the same signature and keywords."""
    return errors.withColumn(
        "query", _fingerprint(F.col("signature"), F.array_join("error_keywords", " "))
    )


def letter_counts(text: str) -> Column:
    """How often each of LETTERS, and anything else, stands in what the edit measure reads."""
    head = F.lower(F.substring(text, 1, S.EDIT_CHARS))
    of = [F.length(head) - F.length(F.replace(head, F.lit(c), F.lit(""))) for c in LETTERS]
    rest = F.length(F.translate(head, LETTERS, ""))
    return F.array(*of, rest)


def issue_profiles(
    issues: DataFrame, comments: str | None = None, issue_keywords: int | None = ISSUE_KEYWORDS
) -> DataFrame:
    """What scoring reads of each issue: words, settled, head, and the profile they form.

    ``comments`` names an array column with the first comments, if they count. Without a
    number of ``issue_keywords`` all count.
    """
    text = S.issue_text(labels="labels", comments=comments)
    rows = issues.select(
        "issue_key",
        (keyword_set(text) if issue_keywords is None else keywords(text, issue_keywords)).alias("words"),
        S.settled("status").alias("settled"),
        F.coalesce(F.substring("summary", 1, S.EDIT_CHARS), F.lit("")).alias("head"),
    )
    return rows.withColumn(
        "profile",
        _fingerprint(F.array_join("words", " "), F.col("settled").cast("string"), F.col("head")),
    )


def _profile_table(rows: DataFrame) -> DataFrame:
    """One row per profile."""
    return rows.groupBy("profile").agg(
        F.any_value("words").alias("words"), F.any_value("settled").alias("settled"),
        F.any_value("head").alias("head"),
    )


def _first_keys(rows: DataFrame, by: list[str], keep: int | None) -> DataFrame:
    """The first ``keep`` issue keys per group, as no more can rank; None keeps all."""
    if keep is None:
        return rows
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("issue_key"))
    return rows.withColumn("n", rank).where(F.col("n") <= keep).drop("n")


def _found_by_search(
    pairs: DataFrame, rows: DataFrame, issues: DataFrame, keep: int | None, search_keywords: int
) -> DataFrame:
    """Pairs whose issue holds one of the first keywords of the error, with issue keys.

    Most pairs share such a word among the issue's own keywords; then any issue of the
    profile will do. For the rest the full text of the profile's issues is searched, and
    each (profile, word) keeps its first ``keep`` issues.
    """
    first = F.slice("error_keywords", 1, search_keywords)
    direct = F.arrays_overlap(first, F.col("words"))
    keys = _first_keys(rows.select("issue_key", "profile"), ["profile"], keep)
    sure = pairs.where(direct).join(keys, "profile")
    open_pairs = pairs.where(~direct).withColumn("word", F.explode(F.array_distinct(first)))
    asked = open_pairs.select("profile", "word").distinct()
    members = rows.select("issue_key", "profile").join(
        asked.select("profile").distinct(), "profile", "left_semi"
    )
    text = F.concat_ws(" ", "summary", "description", F.array_join("labels", " "))
    asked_of = asked.groupBy("profile").agg(F.collect_set("word").alias("asked"))  # few per profile
    held = (
        issues.select("issue_key", text.alias("text"))
        .join(members, "issue_key").join(asked_of, "profile")  # before any text is taken apart
        .select("profile", "issue_key", F.explode(
            F.array_intersect("asked", keyword_set("text"))).alias("word"))
    )
    held = _first_keys(held, ["profile", "word"], keep)
    late = open_pairs.join(held, ["profile", "word"]).drop("word").dropDuplicates(
        ["query", "issue_key"]
    )
    return sure.unionByName(late)


def _candidates(queries: DataFrame, profiles: DataFrame, level: float, before: float | None) -> DataFrame:
    """Scored pairs that reach ``level``, for queries that are left after the level ``before``.

    A query without a limit gets all of them, another all that may be among its best. Every
    block yields its best; those that as many sure ones of all blocks beat as are wanted go
    before words and texts are joined, and ties stay.
    """
    pairs = (
        judged_pairs(queries, profiles, level)
        .withColumn("keyword_score", F.when(F.col("n_both") > 0, F.col("n_both") / F.col("n_all")).otherwise(0.0))
        .withColumn("score", S.match_score("keyword_score", "edit_score", "settled")))
    sure = F.sum(F.col("sure").cast("int"))
    as_good = sure.over(Window.partitionBy("query").orderBy(F.desc("score")))
    equal = sure.over(Window.partitionBy("query", "score"))
    pairs = (
        pairs.join(queries.select("query", "wanted"), "query").withColumn("better", as_good - equal)
        .where(F.col("wanted").isNull() | (F.col("better") < F.col("wanted"))))
    known = queries.select("query", "signature", "error_keywords")
    return pairs.drop("sure", "wanted", "better").join(known, "query").join(profiles.drop("settled"), "profile")


def rank_matches(
    errors: DataFrame,
    issues: DataFrame,
    min_score: float = 0.3,
    max_results: int | None = 10,
    comments: str | None = None,
    search: bool = False,
    issue_keywords: int | None = ISSUE_KEYWORDS,
    search_keywords: int = SEARCH_KEYWORDS,
    rounds: tuple[float, ...] | None = None,
) -> DataFrame:
    """query, rank, issue_key and score parts for distinct errors; all matches without a limit.

    ``errors`` has query, signature, error_keywords and is read several times, so pass a
    staged table. ``search`` applies the candidate rule of the one-call report: settled
    issues that hold one of the first keywords.

    Pairs are found block by block (see ``blockmatch``), and with a limit only those that may
    be among the best are scored. ``rounds`` names scores of which the best are looked for
    first (none: one round): a query that has enough of them takes no part in the next round.
    Results are the same.
    """
    if not min_score > 0:
        raise ValueError("min_score must be above 0; at 0 all pairs match")
    if search:
        issues = issues.where(S.settled("status"))
    rows = staged(issue_profiles(issues, comments, issue_keywords))
    profiles = staged(_profile_table(rows))
    # Without keywords an error can match by its text alone, if that is ever enough.
    some = F.size("error_keywords") > 0 if search or jaccard_bound(min_score) > 0 else F.lit(True)
    queries = staged(
        errors.where(some)
        .groupBy("query")
        .agg(F.any_value("signature").alias("signature"),
             F.any_value("error_keywords").alias("error_keywords"))
        .withColumn("first", F.slice("error_keywords", 1, search_keywords) if search
                    else F.lit(None).cast("array<string>"))
        .withColumn("wanted", F.lit(max_results).cast("int"))
    )
    if max_results is None or rounds is None:
        rounds = ()
    levels = [s for s in sorted(rounds, reverse=True) if s > min_score and jaccard_bound(s) > 0] + [min_score]
    rank = F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("score"), F.asc("issue_key"))
    )
    before, best = None, None
    for level in levels:
        # Written down before the filter: each pair is scored once, whoever reads it.
        scored = staged(_candidates(queries, profiles, level, before))
        hits = scored.where(F.col("score") >= level)
        if search:
            hits = _found_by_search(hits, rows, issues, max_results, search_keywords)
        else:
            keys = _first_keys(rows.select("issue_key", "profile"), ["profile"], max_results)
            hits = hits.join(keys, "profile")
        found = hits.withColumn("rank", rank)
        if max_results is not None:
            found = found.where(F.col("rank") <= max_results)
        if level != min_score:
            found = staged(found)
            done = found.where(F.col("rank") == max_results).select("query")
            found = found.join(done, "query", "left_semi")
            queries = staged(queries.join(done, "query", "left_anti"))
        best = found if best is None else best.unionByName(found)
        before = level
    matching = F.array_sort(F.array_intersect(F.array_distinct("error_keywords"), "words"))
    return best.select(
        "query", "rank", "issue_key", F.col("score").alias("similarity_score"),
        matching.alias("matching_keywords"),
        S.match_reason("keyword_score", matching, "n_all", "edit_score", "settled")
        .alias("relevance_reason"),
    )


def issue_report(
    issues: DataFrame, base_url: str, comments: str | None = None,
    description_chars: int = DESCRIPTION_CHARS,
) -> DataFrame:
    """What a match shows of an issue, short enough to shuffle."""
    return issues.withColumn("solution_summary", S.solution_for_match(comments=comments)).select(
        "issue_key", "summary",
        F.substring("description", 1, description_chars).alias("description"),
        "status", "resolution", "solution_summary",
        issue_link(base_url, "issue_key").alias("link"),
    )


def match_issues(
    errors: DataFrame,
    issues: DataFrame,
    base_url: str = "",
    min_score: float = 0.3,
    max_results: int = 10,
    with_comments: bool = False,
    search: bool = False,
) -> DataFrame:
    """Matches of every error ``(id, signature, error_keywords)``, best first by rank.

    A ``min_score`` that issues without a shared keyword can reach (0.22 or less) adds an
    edit-similarity join; it must be above 0.

    With comments, ``issues`` carries the columns ``issues.with_comments`` adds.
    """
    first, telling = ("first_comments", "match_comments") if with_comments else (None, None)
    keyed = staged(error_queries(errors.select("id", "signature", "error_keywords")))
    ranked = rank_matches(keyed, issues, min_score, max_results, first, search)
    ranked = staged(ranked)
    found = issues.join(ranked.select("issue_key").distinct(), "issue_key", "left_semi")
    reported = ranked.join(issue_report(found, base_url, telling), "issue_key")
    ids = keyed.select("id", "query")
    return salted_join(ids, reported, ["query"], F.xxhash64("id")).drop("query")


def score_pairs(pairs: DataFrame, text_score: str | None = None) -> DataFrame:
    """Score of given pairs (signature, error_keywords, summary, status, issue_words)."""
    parts = S.keyword_jaccard("error_keywords", "issue_words")
    out = (
        pairs.withColumn("kw", parts)
        .withColumn("keyword_score", F.col("kw.score"))
        .withColumn("edit_score", S.edit_similarity("signature", "summary"))
        .withColumn("settled", S.settled("status"))
    )
    return (
        out.withColumn(
            "similarity_score", S.match_score("keyword_score", "edit_score", "settled", text_score)
        )
        .withColumn("matching_keywords", F.col("kw.matching"))
        .withColumn("relevance_reason", S.match_reason(
            "keyword_score", "kw.matching", "kw.total", "edit_score", "settled", text_score))
        .drop("kw", "settled")
    )


def candidate_issues(
    issues: DataFrame, words: list[str], project: str | None = None, status: str | None = None
) -> DataFrame:
    """Issues that hold any of the words, of one project and status."""
    if words:
        text = F.concat_ws(" ", "summary", "description", F.array_join("labels", " "))
        asked = F.array(*[F.lit(w.lower()) for w in words])
        issues = issues.where(F.arrays_overlap(keyword_set(text), asked))
    return with_status(in_project(issues, project), status)


def in_project(issues: DataFrame, project: str | None) -> DataFrame:
    return issues if project is None else issues.where(F.col("project") == project)


def with_status(issues: DataFrame, status: str | None) -> DataFrame:
    """Issues of a status; ``resolved`` also takes closed ones."""
    if status is None:
        return issues
    if status.lower() == "resolved":
        return issues.where(S.settled("status"))
    return issues.where(F.lower("status") == status.lower())


def resolved_matches(matches: DataFrame) -> DataFrame:
    return matches.where(
        S.settled("status") | (F.coalesce("resolution", F.lit("")) != "")
    )


def match_groups(matches: DataFrame, threshold: float = 0.8, key: str = "id") -> DataFrame:
    """Groups similar matches of one error: each joins the first leader it resembles.

    Leaders depend on rank order, so the ranked matches of an error (at most max_results
    of them) are folded in order inside one row.
    """
    item = F.struct("rank", "issue_key", keywords("summary", 10).alias("words"))
    ranked = matches.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.array().cast(
        "array<struct<rank:int,issue_key:string,words:array<string>,leader:int>>"
    )

    def place(done, x):
        alike = F.filter(
            done,
            lambda d: (d["rank"] == d["leader"])
            & (S.keyword_jaccard(d["words"], x["words"])["score"] * S.COMPARE_KEYWORD_WEIGHT
               >= threshold),
        )
        leader = F.coalesce(F.get(alike, F.lit(0))["rank"], x["rank"])
        return F.concat(done, F.array(F.struct(
            x["rank"].alias("rank"), x["issue_key"].alias("issue_key"),
            x["words"].alias("words"), leader.alias("leader"),
        )))

    return ranked.select(
        key, F.explode(F.aggregate("items", start, place)).alias("m")
    ).select(key, "m.rank", "m.issue_key", F.col("m.leader").alias("leader_rank"))
