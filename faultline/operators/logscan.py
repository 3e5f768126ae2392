"""Log analysis over ``log_lines(log_file, line_no, line)``.

A log has state: a marker turns warnings into errors, tool lines name the running tool,
the first action line names the test. A log may also be huge. Lines are therefore cut
into blocks of a fixed number of lines; state is followed inside a block, each block
shrinks to a few rows, and only those rows meet in one task per log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules as R
from ..functions.text import WHITE_SPACE, keywords, strip, test_name_keywords
from ..sources.logs import existing_logs
from .skew import salted_join

BLOCK_LINES = 65_536

# The fields of an analysis, in their order.
RECORD = (
    "log_file", "suite", "test", "signature", "tool", "line_number", "error_level",
    "error_line", "pattern_pos", "num_lines_scanned", "error_keywords",
)


def block_of(line_no="line_no", block_lines: int = BLOCK_LINES) -> Column:
    return F.floor((F.col(line_no) - 1) / block_lines).cast("int")


def _before(*keys) -> Window:
    return Window.partitionBy(*keys).orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, -1
    )


def _so_far(*keys) -> Window:
    return Window.partitionBy(*keys).orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )


# --------------------------------------------------------------------------- per line


def _once(value) -> Column:
    """``value(line)`` evaluated once per row, outside the generated code of the stage.

    The rule chain is too long for the method size the JVM compiles, and a filter on its
    result would be pushed below it and evaluate it twice. As the output of a generator
    it is neither inlined nor repeated.
    """
    return F.explode(F.transform(F.array("line"), value))


def _unless_ignored(value) -> Column:
    """The same, null for ignored lines."""
    pair = F.array(F.struct("line", R.folded("line").alias("low")))
    return F.explode(F.transform(
        pair, lambda t: F.when(~R.ignored(t["line"], t["low"]), value(t["line"]))
    ))


def ignored_lines(lines: DataFrame) -> DataFrame:
    kept = lines.withColumn("kept", _unless_ignored(lambda t: F.lit(True)))
    return kept.where(F.col("kept").isNull()).drop("kept")


def classified_lines(lines: DataFrame, rules=R.ERROR_RULES) -> DataFrame:
    """Lines an error rule matches, with level and pos; ignored lines are left out."""
    return (
        lines.where(R.may_match("line", rules))
        .withColumn("rule", _unless_ignored(lambda t: R.classify(t, rules)))
        .where(F.col("rule").isNotNull())
        .withColumn("level", R.rule_level("rule", rules))
        .withColumn("pos", R.rule_pos("rule", rules))
        .drop("rule")
    )


def _state_lines(lines: DataFrame, rules, detect: bool, tools: bool) -> DataFrame:
    """Lines that can change the result, with the part each of them plays.

    action and tool lines play that part only when asked for; otherwise they are ordinary
    lines. Columns: action, tool, marker, level, pos, warning.
    """
    line = F.col("line")
    wanted = R.may_match(line, tuple(rules) + R.WARNING_RULES) | R.is_marker(line)
    if tools:
        wanted = wanted | line.contains(R.TOOL_HEAD)
    if detect:
        wanted = wanted | line.startswith(R.ACTION_HEAD)
    no_action = F.lit(None).cast("struct<suite:string,test:string,tool:string>")
    no_tool = F.lit(None).cast("string")

    def state(t):
        return F.struct(
            (R.action(t) if detect else no_action).alias("action"),
            (R.tool_name(t) if tools else no_tool).alias("tool"),
            R.is_marker(t).alias("marker"),
        )

    rows = lines.where(wanted).withColumn("state", _unless_ignored(state)).where(
        F.col("state").isNotNull()
    )
    plain = F.col("state.tool").isNull() & ~F.col("state.marker")
    rows = rows.withColumn("rule", _once(lambda t: F.when(plain, R.classify(t, rules))))
    warning = plain & F.col("rule").isNull() & R.is_warning(line)
    return (
        rows.select(
            "log_file", "line_no", "line", "state.action", "state.tool",
            (F.col("state.tool").isNull() & F.col("state.marker")).alias("marker"),
            warning.alias("warning"),
            R.rule_level("rule", rules).alias("level"), R.rule_pos("rule", rules).alias("pos"),
        )
        .where(
            F.col("action").isNotNull() | F.col("tool").isNotNull() | F.col("marker")
            | F.col("level").isNotNull() | F.col("warning")
        )
    )


def tool_events(lines: DataFrame) -> DataFrame:
    """Every tool line with the tool it names."""
    return (
        lines.where(F.col("line").contains(R.TOOL_HEAD))
        .withColumn("tool", _unless_ignored(R.tool_name))
        .where(F.col("tool").isNotNull())
        .select("log_file", "line_no", "tool")
    )


def log_identity(lines: DataFrame) -> DataFrame:
    """Suite, test and tool of the first action line of each log."""
    found = (
        lines.where(F.col("line").startswith(R.ACTION_HEAD))
        .withColumn("action", _unless_ignored(R.action))
        .where(F.col("action").isNotNull())
    )
    return (
        found.groupBy("log_file")
        .agg(F.min(F.struct("line_no", "action")).alias("a"))
        .select("log_file", "a.line_no", "a.action.*")
    )


def has_error(lines: DataFrame, rules=R.ERROR_RULES) -> DataFrame:
    """log_file, has_error: whether any line that is not ignored matches a rule."""
    found = classified_lines(lines, rules).groupBy("log_file").agg(F.lit(True).alias("found"))
    return existing_logs(lines).join(found, "log_file", "left").select(
        "log_file", F.coalesce("found", F.lit(False)).alias("has_error")
    )


def warnings_as_errors(lines: DataFrame, rules=R.ERROR_RULES) -> DataFrame:
    """Warning lines that count as errors: after the marker, matched by no error rule."""
    marks = lines.where(R.is_marker("line")).withColumn(
        "kept", _unless_ignored(lambda t: F.lit(True))
    )
    marked = (
        marks.where(F.col("kept")).groupBy("log_file")
        .agg(F.min("line_no").alias("marker_line"))
    )
    rows = _state_lines(lines, rules, detect=False, tools=False)
    warned = rows.where("warning").select("log_file", "line_no", "line")
    return (
        salted_join(warned, marked, ["log_file"], block_of())
        .where(F.col("line_no") > F.col("marker_line"))
        .select("log_file", "line_no", "line", F.lit(R.WARNING_RULES[0].level).alias("level"),
                F.lit(R.WARNING_RULES[0].pos).alias("pos"))
    )


# ----------------------------------------------------------------------------- per log


def _segments(rows: DataFrame, block_lines: int) -> DataFrame:
    """One row per stretch of lines whose outcome depends on earlier state as a whole.

    A block is cut at its first action line (consumed only if no earlier block has one)
    and at its first marker. Between the cuts all lines meet the same state.
    """
    rows = rows.withColumn("block", block_of("line_no", block_lines))
    key = ("log_file", "block")
    rows = rows.withColumn(
        "a", F.min(F.when(F.col("action").isNotNull(), F.col("line_no"))).over(_so_far(*key))
    )
    at_action = F.coalesce(F.col("line_no") == F.col("a"), F.lit(False))
    rows = rows.withColumn(
        "m", F.min(F.when(F.col("marker") & ~at_action, F.col("line_no"))).over(_so_far(*key))
    )
    step = lambda c: F.coalesce(
        F.lit(1) + (F.col("line_no") > F.col(c)).cast("int"), F.lit(0)
    )
    rows = rows.withColumn("seg", step("a") + step("m"))
    named = F.when(F.col("tool").isNotNull(), F.struct("seg", "tool"))
    rows = rows.withColumn("seen", F.last(named, ignorenulls=True).over(_before(*key)))
    rows = rows.withColumn(
        "tool_at", F.when(F.col("seen.seg") == F.col("seg"), F.col("seen.tool"))
    )
    error = F.col("level").isNotNull()
    return rows.groupBy("log_file", "block", "seg").agg(
        F.min("line_no").alias("start"),
        F.min(F.when(at_action, F.struct("line_no", "action"))).alias("act"),
        F.max("marker").alias("marker"),
        F.max(F.when(F.col("tool").isNotNull(), F.struct("line_no", "tool"))).alias("last"),
        F.max(F.when(error, F.struct(
            "level", (-F.col("line_no")).alias("neg"), "pos", "line", "tool_at",
        ))).alias("worst"),
        F.min(F.when(error, F.struct("line_no", "line"))).alias("first"),
        F.min(F.when(F.col("warning"), F.struct("line_no", "line", "tool_at"))).alias("warn"),
    )


def _resolve_segments(segments: DataFrame, keep_tool: bool) -> DataFrame:
    """Follow the state over the segments of a log and keep one row per log."""
    before = Window.partitionBy("log_file").orderBy("start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    s = segments.withColumn(
        "consumed",
        F.col("act").isNotNull()
        & ~F.coalesce(F.max(F.col("act").isNotNull()).over(before), F.lit(False)),
    )
    taken = F.lit(None).cast("string") if keep_tool else F.col("act.action.tool")
    s = s.withColumn("tool", F.when(F.col("consumed"), taken).otherwise(F.col("last.tool")))
    s = s.withColumn("marks", F.col("marker") & ~F.col("consumed"))
    s = s.withColumn(
        "warns",
        ~F.col("consumed") & F.coalesce(F.max("marks").over(before), F.lit(False))
        & F.col("warn").isNotNull(),
    ).withColumn("tool_before", F.last("tool", ignorenulls=True).over(before))
    rule = R.WARNING_RULES[0]
    as_error = F.when(F.col("warns"), F.struct(
        F.lit(rule.level).alias("level"), (-F.col("warn.line_no")).alias("neg"),
        F.lit(rule.pos).alias("pos"), F.col("warn.line").alias("line"),
        F.col("warn.tool_at").alias("tool_at"),
    ))
    s = s.withColumn(
        "best",
        F.when(~F.col("consumed"), F.greatest(F.col("worst"), as_error)),
    ).withColumn(
        "head",
        F.when(~F.col("consumed"), F.least(
            F.col("first"),
            F.when(F.col("warns"), F.struct(
                F.col("warn.line_no").alias("line_no"), F.col("warn.line").alias("line"))),
        )),
    )
    best = F.when(F.col("best").isNotNull(), F.struct(
        "best.level", "best.neg", "best.pos", "best.line",
        F.coalesce("best.tool_at", "tool_before").alias("tool"),
    ))
    return s.groupBy("log_file").agg(
        F.max(best).alias("best"),
        F.min("head").alias("head"),
        F.max(F.when(F.col("tool").isNotNull(), F.struct("start", "tool"))).alias("last"),
        F.min(F.when(F.col("consumed"), F.col("act"))).alias("act"),
    )


def analyze_logs(
    lines: DataFrame,
    rules=R.ERROR_RULES,
    detect: bool = True,
    tool: str | None = None,
    max_lines: int | None = None,
    ends_only: int | None = None,
    block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """Failure analysis: one row per log.

    The worst error is the earliest line of the highest level. ``detect`` looks for suite
    and test in the log; pass False when the caller knows them. ``max_lines`` stops early,
    and reports one line more than the limit as scanned when it does. ``ends_only`` looks
    at the first and last bytes of a log only.
    """
    nothing = F.lit("unknown")
    if ends_only is not None:
        lines = head_tail_lines(lines, ends_only, block_lines)
        totals = lines.groupBy("log_file").agg(
            F.count(F.lit(1)).cast("int").alias("n_lines"),
            F.max("file_size").alias("file_size"),
        )
        # Fixed values, here and below: what a log without an error is said to hold.
        cut = f"unknown, did not find error in first/last {ends_only} bytes"
        nothing = F.when(F.col("file_size") > ends_only, F.lit(cut)).otherwise(nothing)
    else:
        totals = existing_logs(lines)
    if max_lines is not None:
        lines = lines.where(F.col("line_no") <= max_lines)
        totals = totals.withColumn("n_lines", F.least("n_lines", F.lit(max_lines + 1)))
        cut = f"unknown, did not find error in first {max_lines} lines"
        nothing = F.when(F.col("n_lines") > max_lines, F.lit(cut)).otherwise(nothing)
    rows = _state_lines(lines, rules, detect=detect, tools=True)
    found = _resolve_segments(_segments(rows, block_lines), keep_tool=tool is not None)
    given = F.lit(tool).cast("string")
    out = totals.join(found, "log_file", "left").select(
        "log_file",
        F.col("act.action.suite").alias("suite"),
        F.col("act.action.test").alias("test"),
        F.coalesce(strip(F.col("best.line")), nothing).alias("signature"),
        F.coalesce(F.col("best.tool"), F.when(F.col("best").isNotNull(), given),
                   F.col("last.tool"), given, F.lit("unknown")).alias("tool"),
        F.coalesce(-F.col("best.neg"), F.lit(0)).alias("line_number"),
        F.coalesce("best.level", F.lit(1)).alias("error_level"),
        F.coalesce(F.col("best.line"), nothing).alias("error_line"),
        F.coalesce("best.pos", F.lit("unknown")).alias("pattern_pos"),
        F.col("n_lines").alias("num_lines_scanned"),
        F.coalesce(strip(F.col("head.line")), nothing).alias("first_error"),
        F.col("head.line_no").alias("first_error_line"),
    )
    words = keywords("signature")
    by_name = F.when(F.col("test").isNotNull(), test_name_keywords("test"))
    out = out.withColumn(
        "error_keywords",
        F.when(F.size(words) > 0, words).otherwise(
            F.coalesce(by_name, F.array().cast("array<string>"))
        ),
    )
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown")).alias(c)
    return out.select(
        *[unknown(c) if c in ("suite", "test") else c for c in RECORD],
        "first_error", "first_error_line",
    )


def first_error(lines: DataFrame, rules=R.ERROR_RULES) -> DataFrame:
    """The earliest error line of each log that has one."""
    return (
        analyze_logs(lines, rules)
        .where(F.col("first_error_line").isNotNull())
        .select("log_file", F.col("first_error_line").alias("line_no"),
                F.col("first_error").alias("line"))
    )


def all_errors(
    lines: DataFrame, max_errors: int = 10, rules=R.ERROR_RULES, block_lines: int = BLOCK_LINES
) -> DataFrame:
    """The first ``max_errors`` error lines of each log, in order.

    Warnings count once a marker was seen, which a block alone cannot know. A block keeps
    the lines that are among its first ones under any state, plus its first marker, and
    the rows of all blocks decide per log.
    """
    rows = _state_lines(lines, rules, detect=False, tools=False).withColumn(
        "block", block_of("line_no", block_lines)
    )
    key = ("log_file", "block")
    rows = rows.withColumn(
        "marker_line", F.min(F.when(F.col("marker"), F.col("line_no"))).over(_so_far(*key))
    )
    error = F.col("level").isNotNull()
    after = F.col("warning") & F.coalesce(F.col("line_no") > F.col("marker_line"), F.lit(False))
    count = lambda c: F.sum(c.cast("int")).over(_so_far(*key))
    rows = rows.select(
        "*", error.alias("error"), after.alias("after"),
        count(error).alias("n_error"), count(error | after).alias("n_after"),
        count(error | F.col("warning")).alias("n_any"),
    )
    first_marker = F.col("marker") & (F.col("line_no") == F.col("marker_line"))
    kept = rows.where(
        first_marker
        | (F.col("error") & (F.col("n_error") <= max_errors))
        | ((F.col("error") | F.col("after")) & (F.col("n_after") <= max_errors))
        | ((F.col("error") | F.col("warning")) & (F.col("n_any") <= max_errors))
    )
    per_log = ("log_file",)
    marked = F.coalesce(F.max(F.col("marker")).over(_before(*per_log)), F.lit(False))
    kept = kept.withColumn("marked", marked).where(
        F.col("error") | (F.col("warning") & F.col("marked"))
    )
    rank = F.row_number().over(Window.partitionBy("log_file").orderBy("line_no"))
    return (
        kept.withColumn("n", rank)
        .where(F.col("n") <= max_errors)
        .select("log_file", "line_no", strip("line").alias("line"),
                F.coalesce("level", F.lit(R.WARNING_RULES[0].level)).alias("level"))
    )


# ------------------------------------------------------------------- parts of a log


def log_tail(lines: DataFrame, num_lines: int = 100, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The last ``num_lines`` lines of each log, one row per line."""
    last = existing_logs(lines)
    numbered = lines.withColumn("block", block_of("line_no", block_lines))
    wanted = last.withColumn(
        "block",
        F.explode(F.sequence(
            F.floor(F.greatest(F.col("n_lines") - num_lines, F.lit(0)) / block_lines).cast("int"),
            F.floor((F.col("n_lines") - 1) / block_lines).cast("int"),
        )),
    )
    return (
        numbered.join(wanted, ["log_file", "block"])
        .where(F.col("line_no") > F.col("n_lines") - num_lines)
        .select("log_file", "line_no", "line")
    )


def log_tail_text(lines: DataFrame, num_lines: int = 100) -> DataFrame:
    """The last lines of each log as one text; at most ``num_lines`` rows per group."""
    rows = log_tail(lines, num_lines)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy("log_file").agg(
        F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("log_tail")
    )


def error_context(lines: DataFrame, hits: DataFrame, context_lines: int = 5) -> DataFrame:
    """Lines around each hit ``(log_file, error_line)``, with the hit marked.

    A hit asks for each line number it needs, so the join key is (log, line): unique on
    the big side, whatever the size of a log.
    """
    asked = hits.select(
        "log_file", "error_line",
        F.explode(F.sequence(
            F.col("error_line") - context_lines, F.col("error_line") + context_lines
        )).alias("line_no"),
    )
    mark = F.when(F.col("line_no") == F.col("error_line"), ">>> ").otherwise("    ")
    tail = F.rtrim(F.col("line"), F.lit(WHITE_SPACE))
    return lines.join(asked, ["log_file", "line_no"]).select(
        "log_file", "error_line", "line_no",
        F.concat(mark, F.format_string("%5d: ", F.col("line_no")), tail).alias("context"),
    )


def _byte_places(lines: DataFrame, block_lines: int) -> DataFrame:
    """Lines with byte_start and the file_size of their log.

    A line counts its UTF-8 bytes and one line feed. Positions are summed inside blocks
    and shifted by the size of earlier blocks.
    """
    rows = lines.withColumn("block", block_of("line_no", block_lines)).withColumn(
        "size", F.octet_length("line") + F.lit(1).cast("bigint")
    )
    sizes = rows.groupBy("log_file", "block").agg(F.sum("size").alias("block_size"))
    whole = Window.partitionBy("log_file")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        "log_file", "block",
        F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("shift"),
        F.sum("block_size").over(whole).alias("file_size"),
    )
    inside = F.coalesce(F.sum("size").over(_before("log_file", "block")), F.lit(0))
    return rows.join(shifts, ["log_file", "block"]).withColumn(
        "byte_start", F.col("shift") + inside
    )


def head_tail_lines(lines: DataFrame, ends_only: int, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Lines that start in the first or the last ``ends_only`` bytes of their log."""
    return (
        _byte_places(lines, block_lines)
        .where(
            (F.col("byte_start") <= ends_only)
            | (F.col("byte_start") >= F.col("file_size") - ends_only)
        )
        .select("log_file", "line_no", "byte_start", "file_size", "line")
    )
