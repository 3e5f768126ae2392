"""The registered queries as SQL for another engine, from the driver's tables up.

Log lines are classified by the full rule list without any shortcut, keyword sets come
from unnested words, matches from all pairs: a separate statement of each result.
"""

from __future__ import annotations

import re

from ..functions import rules as R
from ..functions import similarity as S
from ..functions import text as T
from ..operators import matching as M
from . import registry as Q
from . import triage as P
from .fixtures import TRACKER


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return ", ".join(_q(w) for w in words)


_WS = "concat(chr(9), chr(10), chr(11), chr(12), chr(13), ' ')"
_NOISE = _list(T.NOISE_WORDS)
_HEAD = "split_part({}, chr(10), 1)"

# ------------------------------------------------------------------------------ inputs

CTE: dict[str, str] = {}

CTE["runs"] = """
SELECT c.c_custkey AS regression_run_id, r.r_name AS project_name, n.n_name AS regression_name,
       c.c_nationkey AS regression_ref, c.c_mktsegment AS status, c.c_custkey * 10 AS changelist,
       CAST(c.c_custkey % 4 AS INTEGER) AS iteration, o.st AS start_time, o.et AS end_time,
       c.c_name AS username, concat('client', c.c_custkey % 8) AS client,
       concat('/runs/', c.c_custkey) AS log_directory
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS st, max(o_orderdate) AS et
           FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey"""

CTE["tor"] = """
SELECT o.o_orderkey AS test_object_run_id, o.o_custkey AS regression_run_id,
       concat('test_', replace(p.p_name, ' ', '_'), '_', lower(p.p_type)) AS test_name,
       p.p_brand AS block_name, o.o_orderpriority AS arch, p.p_type AS conf,
       concat('size_', p.p_size) AS test_group,
       CASE o.o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'passed' ELSE 'running' END AS status,
       o.o_orderdate AS start_time,
       CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE o.o_orderdate END AS end_time,
       o.o_totalprice AS cpu_time, o.o_totalprice / 1000 AS sim_time,
       CAST(o.o_orderkey % 7 AS INTEGER) AS num_error, CAST(o.o_orderkey % 5 AS INTEGER) AS num_warning,
       concat('host', o.o_orderkey % 64) AS host, o.o_orderkey * 7919 % 100003 AS random_seed,
       CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 13 <> 0 THEN
         row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) END AS failed_job_run_ref,
       o.o_totalprice / 100 AS mem_usage, CAST(o.o_orderkey % 4 * 1024 AS INTEGER) AS lsf_req_mb
FROM orders o CROSS JOIN (SELECT count(*) AS n FROM part) k
JOIN part p ON p.p_partkey = o.o_orderkey % k.n"""

CTE["job_run"] = """
SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS job_run_id, o_custkey AS regression_run_id, concat('job_', o_orderkey) AS job_run_name,
       o_orderstatus AS status, concat('host', o_orderkey % 64) AS host, o_orderdate AS start_time,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END AS end_time,
       o_totalprice AS cpu_time, CAST(o_orderkey % 5 AS INTEGER) AS num_warning,
       CAST(o_orderkey % 7 AS INTEGER) AS num_error
FROM orders"""

CTE["job_cmd"] = """
SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
         l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS job_cmd_id,
       o.o_custkey AS regression_run_ref, o.job AS job_run_ref, concat('run ', l_partkey) AS cmd,
       CASE WHEN l_partkey % 19 = 0 THEN NULL
            ELSE concat('log/', l_orderkey % k.n) END AS log_file,
       CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS exit_code, l_shipdate AS start_time,
       l_shipdate AS end_time, concat('host', l_orderkey % 64) AS host
FROM lineitem CROSS JOIN (SELECT max(user_id) + 1 AS n FROM events) k
JOIN (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS job
      FROM orders) o ON o.o_orderkey = l_orderkey"""

CTE["doc_lines"] = """
SELECT doc_id, unnest(l) AS txt, generate_subscripts(l, 1) AS p
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""

CTE["log_lines"] = """
SELECT log_file, line_no,
       CASE
         WHEN num % 16 = 0 THEN concat('UVM_ERROR @ ', num, ': ', txt)
         WHEN num % 16 = 1 THEN 'UVM_ERROR : 0'
         WHEN num % 16 = 2 THEN concat('ASSERTION FAILED ', txt)
         WHEN num % 16 = 3 THEN 'x error_count 7'
         WHEN num % 16 = 4 THEN concat('ERROR: ', txt)
         WHEN num % 16 = 5 THEN concat('dv: ... running tool tool', num % 7)
         WHEN num % 16 = 6 AND num % 5 = 1 THEN 'cc1plus: warnings being treated as errors'
         WHEN num % 16 = 7 AND num % 6 = 1
           THEN concat('# action: gc(a)::suite', num % 3, '/case', num % 11, '.tool9')
         WHEN num % 16 < 8 THEN concat('warning: ', txt)
         ELSE concat('info ', txt)
       END AS line
FROM (SELECT concat('log/', d.doc_id % k.n) AS log_file, d.txt, d.doc_id * 7 + d.p AS num,
             CAST(row_number() OVER (PARTITION BY d.doc_id % k.n ORDER BY d.doc_id, d.p) AS INTEGER) AS line_no
      FROM doc_lines d CROSS JOIN (SELECT max(user_id) + 1 AS n FROM events) k)"""

CTE["issues"] = f"""
SELECT concat('DOC-', d.doc_id) AS issue_key, d.source AS project, {_HEAD.format('d.text')} AS summary,
       CASE WHEN d.doc_id % 4 = 0 THEN concat(d.text, '. A workaround is to restart. End')
            ELSE d.text END AS description,
       CASE WHEN l.quality = 1 THEN 'Resolved' WHEN l.quality = 0 THEN 'Open' ELSE 'Closed' END AS status,
       CASE WHEN l.quality = 1 THEN 'Fixed' END AS resolution,
       [d.lang, d.source] AS labels,
       1704067200 + d.doc_id * 3600 AS created_s,
       1704067200 + d.doc_id * 3600 + d.n_chars * 60 AS updated_s
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""

CTE["comments"] = """
SELECT concat('DOC-', conv_id) AS issue_key, turn AS seq, role AS author,
       concat(text, '. Fix applied in turn ', turn, '. End') AS body
FROM conversations"""

CTE["nested"] = """
SELECT issue_key, list(body ORDER BY seq) AS bodies, count(*) AS n_comments
FROM comments GROUP BY issue_key"""

CTE["links"] = """
SELECT concat('DOC-', doc_id) AS src_key,
       CASE WHEN doc_id % 11 = 0 THEN concat('GONE-', doc_id) ELSE concat('DOC-', doc_id - doc_id % 5) END AS dst_key,
       CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'duplicates' ELSE 'is duplicated by' END AS relation
FROM documents WHERE doc_id % 5 <> 0"""

# ------------------------------------------------------------------------ log analysis

_REWRITTEN = {  # the engine's regexes have no look-ahead
    r"ASSERTION FAILED(?!.*GcLog\.Assert)":
        "regexp_matches(regexp_replace(line, '^.*GcLog\\.Assert', ''), 'ASSERTION FAILED')",
    r"ERROR(?!_)": "regexp_matches(line, 'ERROR([^_]|$)')",
    r"\serror(?!s_are_warnings)(?!type)(?!_)(?!log)(?!To reproduce the error using the)":
        "regexp_matches(regexp_replace(line, '\\serror(s_are_warnings|type|_|log)', chr(1), 'g'), '\\serror')",
}


def _rule_case(rules, what) -> str:
    whens = []
    for r in rules:
        flag = "(?i)" if r.ignore_case else ""
        test = _REWRITTEN.get(r.regex) or f"regexp_matches(line, {_q(flag + r.regex)})"
        value = r.level if what == "level" else _q(r.pos)
        whens.append(f"WHEN {test} THEN {value}")
    return "CASE WHEN trim(line) = '' THEN NULL " + " ".join(whens) + " END"


def _classified(rules) -> str:
    ignore = "|".join(f"(?:{p})" for p, _ in R.IGNORE_PATTERNS)
    return f"""
SELECT log_file, line_no, line, ign,
       CASE WHEN NOT ign THEN {_rule_case(rules, 'level')} END AS level,
       CASE WHEN NOT ign THEN {_rule_case(rules, 'pos')} END AS pos,
       NOT ign AND regexp_matches(line, '(?i)warning') AS warns,
       NOT ign AND contains(line, {_q(R.WARNINGS_MARKER)}) AS marks,
       CASE WHEN ign THEN NULL ELSE coalesce(
         nullif(regexp_extract(line, {_q(R.TOOL_PATTERNS[0])}, 1), ''),
         nullif(regexp_extract(line, {_q(R.TOOL_PATTERNS[1])}, 1), '')) END AS tool,
       NOT ign AND regexp_matches(line, {_q(R.ACTION_PATTERN)}) AS acts
FROM (SELECT *, (contains(line, 'simctrl') AND NOT regexp_matches(line, {_q(R.CAUGHT_SIGNAL)}))
             OR regexp_matches(line, {_q('(?i)' + ignore)}) AS ign FROM log_lines)"""


CTE["classified"] = _classified(R.ERROR_RULES)
CTE["custom"] = _classified(Q.CUSTOM_RULES)


def _analysis(detect: bool, limit: int | None = None) -> str:
    """Failure analysis as SQL: roles by line, then aggregates by log."""
    source = "classified" if limit is None else f"(SELECT * FROM classified WHERE line_no <= {limit})"
    nothing = "'unknown'"
    scanned = "n.n_lines"
    if limit is not None:
        nothing = (f"CASE WHEN n.n_lines > {limit} THEN 'unknown, did not find error in first "
                   f"{limit} lines' ELSE 'unknown' END")
        scanned = f"least(n.n_lines, {limit + 1})"
    first_action = "min(CASE WHEN acts THEN line_no END) OVER (PARTITION BY log_file)" if detect else "NULL"
    part = lambda i: f"regexp_extract(line, {_q(R.ACTION_PATTERN)}, {i})"
    return f"""
SELECT n.log_file, coalesce(a.suite, 'unknown') AS suite, coalesce(a.test, 'unknown') AS test,
       coalesce(trim(e.line, {_WS}), {nothing}) AS signature,
       coalesce(e.tool_before, a.last_tool, 'unknown') AS tool,
       coalesce(e.line_no, 0) AS line_number, coalesce(e.lvl, 1) AS error_level,
       coalesce(e.line, {nothing}) AS error_line, coalesce(e.ps, 'unknown') AS pattern_pos,
       {scanned} AS num_lines_scanned, f.line_no AS first_line, f.line AS first_text
FROM (SELECT log_file, max(line_no) AS n_lines FROM log_lines GROUP BY log_file) n
LEFT JOIN (
  SELECT log_file, max(suite) AS suite, max(test) AS test, arg_max(tool, line_no) AS last_tool
  FROM ROLES GROUP BY log_file) a ON a.log_file = n.log_file
LEFT JOIN (SELECT * FROM ROLES WHERE lvl IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY log_file ORDER BY lvl DESC, line_no) = 1) e
  ON e.log_file = n.log_file
LEFT JOIN (SELECT log_file, line_no, trim(line, {_WS}) AS line FROM ROLES WHERE lvl IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY log_file ORDER BY line_no) = 1) f
  ON f.log_file = n.log_file""".replace("ROLES", f"""(
  SELECT log_file, line_no, line, suite, test, tool,
    last_value(tool IGNORE NULLS) OVER (PARTITION BY log_file ORDER BY line_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tool_before,
    CASE WHEN used THEN NULL WHEN level IS NOT NULL THEN level
         WHEN warns AND line_no > marker THEN 3 END AS lvl,
    CASE WHEN used THEN NULL WHEN level IS NOT NULL THEN pos
         WHEN warns AND line_no > marker THEN 'builtin:warning' END AS ps
  FROM (SELECT *, consumed OR tool IS NOT NULL OR marks AS used,
          min(CASE WHEN marks AND NOT consumed AND otool IS NULL THEN line_no END)
            OVER (PARTITION BY log_file) AS marker
        FROM (SELECT log_file, line_no, line, level, pos, warns, marks, tool AS otool,
                line_no IS NOT DISTINCT FROM first_action AS consumed,
                CASE WHEN line_no = first_action THEN {part(1)} END AS suite,
                CASE WHEN line_no = first_action THEN {part(2)} END AS test,
                CASE WHEN line_no = first_action THEN {part(3)} ELSE tool END AS tool
              FROM (SELECT *, {first_action} AS first_action FROM {source}))))""")


CTE["analysis"] = _analysis(detect=True)
CTE["analysis_capped"] = _analysis(detect=True, limit=Q.LINE_LIMIT)
CTE["analysis_plain"] = _analysis(detect=False)


def _words(source: str, limit: int | None) -> str:
    """(id, words): the first keywords of (id, txt), by unnesting and ranking words."""
    cut = f"WHERE n <= {limit}" if limit else ""
    return f"""
SELECT id, list(w ORDER BY p) AS words FROM (
  SELECT id, w, p, row_number() OVER (PARTITION BY id ORDER BY p) AS n FROM (
    SELECT id, w, min(p) AS p FROM (
      SELECT id, unnest(l) AS w, generate_subscripts(l, 1) AS p FROM (
        SELECT id, regexp_extract_all(lower(txt), '[\\p{{L}}\\p{{N}}_]+') AS l FROM ({source})))
    WHERE regexp_full_match(w, '[a-z0-9_]+') AND length(w) > 2 AND w NOT IN ({_NOISE})
    GROUP BY id, w)) {cut} GROUP BY id"""


def _name_words(col: str) -> str:
    prefixes = "|".join(T.NAME_PREFIXES)
    return (f"list_filter(string_split(regexp_replace(lower({col}), '^({prefixes})', ''), '_'), "
            f"lambda w: length(w) > 2 AND w NOT IN ({_NOISE}))")


_EMPTY = "CAST([] AS VARCHAR[])"
for _name, _source in (("analysis", "analysis"), ("capped", "analysis_capped"), ("plain", "analysis_plain")):
    CTE[f"words_{_name}"] = _words(f"SELECT log_file AS id, signature AS txt FROM {_source}", 10)


def _jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {both}::DOUBLE / "
            f"(len({a}) + len({b}) - {both}) END")


# ------------------------------------------------------------------------ edit measure

# Bit rows of 200 letters in two halves of 100 bits; one step per letter of b.
_HALF = 100


def _edit(pairs: str) -> dict[str, str]:
    """CTEs that end in edit(a, b, ratio) for the distinct texts of ``pairs(a, b)``."""
    ones = f"((1::HUGEINT << {_HALF}) - 1)"
    return {
        "edit_pairs": f"""
SELECT row_number() OVER () AS pid, a, b FROM (
  SELECT DISTINCT lower(left(a, 200)) AS a, lower(left(b, 200)) AS b FROM ({pairs}))
WHERE a <> '' AND b <> ''""",
        "edit_masks": f"""
SELECT a, ch, sum(CASE WHEN i < {_HALF} THEN 1::HUGEINT << i::INTEGER ELSE 0 END)::HUGEINT AS lo,
       sum(CASE WHEN i >= {_HALF} THEN 1::HUGEINT << (i - {_HALF})::INTEGER ELSE 0 END)::HUGEINT AS hi
FROM (SELECT a, unnest(string_split(a, '')) AS ch, generate_subscripts(string_split(a, ''), 1) - 1 AS i
      FROM (SELECT DISTINCT a FROM edit_pairs))
GROUP BY a, ch""",
        "edit_steps": f"""
SELECT pid, a, b, 0 AS i, {ones} AS lo, {ones} AS hi FROM edit_pairs
UNION ALL
SELECT pid, a, b, i + 1,
       (((lo + ulo) & {ones}) | (lo - ulo)),
       (((hi + uhi + ((lo + ulo) >> {_HALF})) & {ones}) | (hi - uhi))
FROM (SELECT s.pid, s.a, s.b, s.i, s.lo, s.hi,
             s.lo & coalesce(m.lo, 0::HUGEINT) AS ulo, s.hi & coalesce(m.hi, 0::HUGEINT) AS uhi
      FROM edit_steps s LEFT JOIN edit_masks m
        ON m.a = s.a AND m.ch = substring(s.b, s.i + 1, 1)
      WHERE s.i < length(s.b))""",
        "edit": f"""
SELECT a, b, 2.0::DOUBLE * (
         {2 * _HALF} - bit_count(lo) - bit_count(hi)) / (length(a) + length(b)) AS ratio
FROM edit_steps WHERE i = length(b)""",
    }


def _ratio(left: str, right: str) -> str:
    """Join condition that finds the ratio of two texts in edit."""
    return f"edit.a = lower(left({left}, 200)) AND edit.b = lower(left({right}, 200))"


_SETTLED = f"lower({{}}) IN ({_list(S.SETTLED_STATUS)})"


def _score(kw: str, edit: str, status: str) -> str:
    total = f"({kw} * {S.KEYWORD_WEIGHT}::DOUBLE + {edit} * {S.EDIT_WEIGHT}::DOUBLE)"
    raised = (f"CASE WHEN {_SETTLED.format(status)} THEN {total} * {S.SETTLED_BONUS}::DOUBLE "
              f"ELSE {total} END")
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {raised}))"


def _reason(kw, n_both, n_all, edit, status) -> str:
    parts = (
        f"nullif(concat_ws('; ', "
        f"CASE WHEN {kw} > 0.5 THEN concat('Keyword match: ', CAST(floor({kw} * 100) AS INTEGER), "
        f"'% match (', {n_both}, '/', {n_all}, ' keywords)') END, "
        f"CASE WHEN {edit} > 0.5 THEN concat('Summary match: ', CAST(floor({edit} * 100) AS INTEGER), '%') END, "
        f"CASE WHEN {_SETTLED.format(status)} THEN 'Issue is resolved' END), '')"
    )
    return f"coalesce({parts}, 'Low similarity')"


def _first_with(array: str, cond: str) -> str:
    return f"list_filter({array}, lambda s: {cond})[1]"


def _sentence_by_word(text: str) -> str:
    found = " ".join(
        f"WHEN contains(lower({text}), {_q(w)}) THEN "
        + _first_with(f"regexp_split_to_array({text}, '[.!?]')", f"contains(lower(s), {_q(w)})")
        for w in S.MATCH_SOLUTION_WORDS
    )
    return f"left(trim(CASE {found} END, {_WS}), 200)"


def _sentence_any(text: str) -> str:
    words = "|".join(S.ISSUE_SOLUTION_WORDS)
    return (f"left(trim({_first_with(f'''string_split({text}, '.')''', f'regexp_matches(lower(s), {_q(words)})')}"
            f", {_WS}), 200)")


def _comment(words) -> str:
    return _first_with("bodies", f"regexp_matches(lower(s), {_q('|'.join(words))})")


_FIXED = f"lower(resolution) IN ({_list(S.SETTLED_RESOLUTION)})"
_MATCH_COMMENT = f"CASE WHEN {_FIXED} THEN {_comment(S.MATCH_SOLUTION_WORDS)} END"
CTE["solved"] = f"""
SELECT i.*, n.n_comments,
       coalesce({_sentence_by_word(f'({_MATCH_COMMENT})')}, {_sentence_by_word('description')}) AS match_solution,
       {_sentence_by_word('description')} AS plain_solution,
       CASE WHEN {_FIXED} THEN coalesce({_sentence_any(f'({_comment(S.ISSUE_SOLUTION_WORDS)})')},
            {_sentence_any('description')}) END AS issue_solution
FROM issues i LEFT JOIN nested n ON n.issue_key = i.issue_key"""

_TEXT = "concat_ws(' ', concat(nullif(i.summary, ''), nullif(i.summary, '')), nullif(i.description, ''), array_to_string(i.labels, ' '))"
CTE["texts_plain"] = f"SELECT i.issue_key AS id, {_TEXT} AS txt FROM issues i"
CTE["texts"] = (
    f"SELECT i.issue_key AS id, concat_ws(' ', {_TEXT}, nullif(array_to_string(n.bodies[1:3], ' '), '')) AS txt "
    "FROM issues i LEFT JOIN nested n ON n.issue_key = i.issue_key"
)
CTE["issue_words"] = _words("SELECT * FROM texts", M.ISSUE_KEYWORDS)
CTE["issue_words_plain"] = _words("SELECT * FROM texts_plain", M.ISSUE_KEYWORDS)
CTE["full_words"] = _words(
    "SELECT issue_key AS id, concat_ws(' ', summary, description, array_to_string(labels, ' ')) AS txt FROM issues",
    None,
)


def _match(errors: str, words: str, solution: str, k: int, search: bool,
           min_score: float = 0.3) -> dict[str, str]:
    """CTEs that end in matches(query, ...) for distinct errors(query, signature, words)."""
    # A cheap bound leaves out pairs that can't score enough; at a low score there is none.
    low = min_score <= S.EDIT_WEIGHT * S.SETTLED_BONUS
    some = "" if low else "WHERE len(words) > 0"
    reach = "" if low else """
WHERE len(list_intersect(e.words, w.words))::DOUBLE >= 0.14
      * (len(e.words) + len(w.words) - len(list_intersect(e.words, w.words)))"""
    only = "AND " + _SETTLED.format("i.status") if search else ""
    held = (
        f"AND (list_has_any(p.words[1:{M.SEARCH_KEYWORDS}], p.iwords) OR "
        f"list_has_any(p.words[1:{M.SEARCH_KEYWORDS}], (SELECT f.words FROM full_words f WHERE f.id = p.issue_key)))"
        if search else ""
    )
    cand = f"""
SELECT e.query, e.signature, e.words, i.issue_key, i.summary, i.description, i.status, i.resolution,
       i.{solution} AS solution_summary, w.words AS iwords,
       len(list_intersect(e.words, w.words)) AS n_both,
       len(e.words) + len(w.words) - len(list_intersect(e.words, w.words)) AS n_all
FROM (SELECT query, signature, list_distinct(words) AS wset, words FROM {errors} {some}) e
JOIN issues_solved i ON true {only}
JOIN {words} w ON w.id = i.issue_key{reach}"""
    scored = f"""
SELECT p.*, kw, coalesce(ratio, 0.0::DOUBLE) AS ed,
       {_score('kw', 'coalesce(ratio, 0.0::DOUBLE)', 'p.status')} AS similarity_score
FROM (SELECT *, n_both::DOUBLE / greatest(n_all, 1) AS kw FROM cand) p
LEFT JOIN edit ON {_ratio('p.signature', 'p.summary')}"""
    matches = f"""
SELECT query, rank, issue_key, summary, left(description, {M.DESCRIPTION_CHARS}) AS description, status,
       resolution, similarity_score, matching_keywords, relevance_reason, solution_summary,
       concat({_q(TRACKER.rstrip('/'))}, '/browse/', issue_key) AS link
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity_score DESC, issue_key) AS INTEGER) AS rank,
        array_to_string(list_sort(list_intersect(words, iwords)), ' ') AS matching_keywords,
        {_reason('kw', 'n_both', 'n_all', 'ed', 'status')} AS relevance_reason
      FROM scored p WHERE similarity_score >= {min_score} {held})
WHERE rank <= {k}"""
    return {
        "issues_solved": "SELECT * FROM solved", "cand": cand,
        **_edit("SELECT signature AS a, summary AS b FROM cand"),
        "scored": scored, "matches": matches,
    }


CTE["log_errors"] = f"""
SELECT a.log_file AS query, a.signature, coalesce(w.words, CASE WHEN a.test <> 'unknown' THEN {_name_words('a.test')} END, {_EMPTY}) AS words
FROM analysis a LEFT JOIN words_analysis w ON w.id = a.log_file"""

CTE["paths"] = """
SELECT t.test_object_run_id, nullif(c.log_file, '') AS log_file
FROM tor t LEFT JOIN (SELECT regression_run_ref, job_run_ref, arg_max_null(log_file, job_cmd_id) AS log_file
                      FROM job_cmd GROUP BY ALL) c
  ON c.job_run_ref = t.failed_job_run_ref AND c.regression_run_ref = t.regression_run_id"""

CTE["details"] = """
SELECT * FROM tor QUALIFY row_number() OVER (PARTITION BY regression_run_id, test_name
  ORDER BY end_time DESC NULLS FIRST, test_object_run_id) = 1"""

CTE["failed"] = "SELECT * FROM tor WHERE status = 'failed'"


def _analysed(tests: str) -> str:
    return f"""
SELECT t.*, p.log_file AS path, a.log_file AS log_file, a.signature, a.tool, a.line_number, a.error_level,
       a.error_line, a.pattern_pos, a.num_lines_scanned,
       CASE WHEN a.log_file IS NOT NULL THEN coalesce(w.words, {_name_words('t.test_name')}) END AS words
FROM {tests} t JOIN paths p ON p.test_object_run_id = t.test_object_run_id
LEFT JOIN analysis_plain a ON a.log_file = p.log_file
LEFT JOIN words_plain w ON w.id = a.log_file"""


def _test_errors(tests: str) -> str:
    return f"""
SELECT *, md5(concat(sig, chr(1), array_to_string(kws, ' '))) AS query FROM (
  SELECT *, coalesce(signature, concat('Test ', test_name, CASE WHEN failed_job_run_ref IS NOT NULL
           THEN ' failed (log not accessible)' ELSE ' failed' END)) AS sig,
         coalesce(words, {_name_words('test_name')}) AS kws
  FROM ({_analysed(tests)}))"""


def _solutions(tests: str, k: int) -> dict[str, str]:
    return {
        "errors": _test_errors(tests),
        "queries": "SELECT query, any_value(sig) AS signature, any_value(list_distinct(kws)) AS dwords, "
                   "any_value(kws) AS words FROM errors GROUP BY query",
        **_match("queries", "issue_words_plain", "plain_solution", k, search=True),
        "totals": "SELECT query, count(*) AS relevant_matches, max(similarity_score) AS top_match_score "
                  "FROM matches GROUP BY query",
    }


# ------------------------------------------------------------------------------- build

_NEWEST = "ORDER BY end_time DESC NULLS FIRST, test_object_run_id"


def _sql(body: str, extra: dict[str, str] | None = None) -> str:
    """A statement with just the named parts it needs, in order of need."""
    parts = {**CTE, **(extra or {})}
    order: list[str] = []

    def need(text: str, doing: tuple = ()):
        for name in parts:
            if name in order or name in doing:
                continue
            if re.search(rf"(?<![\w.'%]){name}(?![\w(.'])", text) or re.search(
                    rf"(FROM|JOIN)\s+{name}\b", text):
                need(parts[name], doing + (name,))
                order.append(name)

    need(body)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({parts[n]})" for n in order) + "\n" + body


_TEST = ("test_object_run_id, test_name, block_name, status, arch, conf, test_group, start_time, end_time, "
         "cpu_time, num_error, num_warning, host, random_seed, failed_job_run_ref, mem_usage, lsf_req_mb, "
         "regression_run_id")
_RUN = ("regression_run_id, project_name, regression_name, changelist, iteration, start_time, end_time, status")
_BRIEF = "issue_key, project, summary, status, resolution, updated_s"
_TOP = "ORDER BY updated_s DESC, issue_key LIMIT {}"
_LINKED = """(SELECT l.src_key, l.dst_key, s.summary AS src_summary, d.summary AS dst_summary,
  s.description AS src_description, d.description AS dst_description, d.status AS dst_status
  FROM links l JOIN issues s ON s.issue_key = l.src_key JOIN issues d ON d.issue_key = l.dst_key)"""
_RECORD = ("a.log_file, a.suite, a.test, a.signature, a.tool, a.line_number, a.error_level, a.error_line, "
           "a.pattern_pos, a.num_lines_scanned")


def _record(analysis: str, words: str) -> str:
    return (f"SELECT {_RECORD}, array_to_string(coalesce(w.words, CASE WHEN a.test <> 'unknown' "
            f"THEN {_name_words('a.test')} END, {_EMPTY}), ' ') AS error_keywords "
            f"FROM {analysis} a LEFT JOIN {words} w ON w.id = a.log_file")


def _pair_words(column: str, n: int | None) -> dict[str, str]:
    return {"pair_words": _words(f"SELECT issue_key AS id, {column} AS txt FROM issues", n)}


_PAIR = """(SELECT l.src_key, l.dst_key, coalesce(s.words, CAST([] AS VARCHAR[])) AS a,
  coalesce(d.words, CAST([] AS VARCHAR[])) AS b
  FROM links l JOIN issues t ON t.issue_key = l.dst_key
  LEFT JOIN pair_words s ON s.id = l.src_key LEFT JOIN pair_words d ON d.id = l.dst_key)"""


def _duration(x: str) -> str:
    m = f"CAST(floor({x} / 60) AS BIGINT)"
    s = f"CAST(floor({x} % 60) AS BIGINT)"
    return (f"CASE WHEN {x} < 60 THEN printf('%.1fs', {x}) WHEN {m} < 60 THEN printf('%dm %ds', {m}, {s}) "
            f"ELSE printf('%dh %dm %ds', {m} // 60, {m} % 60, {s}) END")


def _highlight() -> str:
    longest = "list_sort(list_transform(words, lambda w, i: {'n': -length(w), 'i': i, 'w': w}))"
    marked = (f"list_reduce(list_transform({longest}, lambda s: s.w), "
              "lambda t, w: regexp_replace(t, '(?i)' || w, '**\\0**', 'g'), d.text)")
    return (f"SELECT d.doc_id, CASE WHEN k.words IS NULL THEN d.text ELSE {marked} END AS marked "
            "FROM documents d LEFT JOIN doc_words k ON k.id = d.doc_id")


def _suggest() -> str:
    terms = "|".join(S.TECHNICAL_TERMS)
    weight = (f"1 + CASE WHEN contains(lower(signature), w) THEN 2 ELSE 0 END + CASE WHEN length(w) > 5 THEN 1 "
              f"ELSE 0 END + CASE WHEN regexp_matches(w, '{terms}') THEN 1.5 ELSE 0 END")
    return f"""
SELECT e.query AS id, coalesce(s.words, '') AS words FROM log_errors e LEFT JOIN (
  SELECT query, string_agg(w, ' ' ORDER BY n) AS words FROM (
    SELECT query, w, row_number() OVER (PARTITION BY query ORDER BY {weight} DESC, p) AS n
    FROM (SELECT query, signature, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM log_errors))
  WHERE n <= 5 GROUP BY query) s ON s.query = e.query"""


def _all_errors() -> str:
    return f"""
SELECT log_file, line_no, trim(line, {_WS}) AS line, lvl AS level FROM (
  SELECT *, CASE WHEN marks THEN NULL WHEN level IS NOT NULL THEN level
            WHEN warns AND line_no > marker THEN 3 END AS lvl
  FROM (SELECT *, min(CASE WHEN marks THEN line_no END) OVER (PARTITION BY log_file) AS marker
        FROM classified))
WHERE lvl IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY log_file ORDER BY line_no) <= 10"""


def _tail(n: int) -> str:
    return (f"SELECT log_file, string_agg(line, chr(10) ORDER BY line_no) AS log_tail FROM ("
            f"SELECT *, max(line_no) OVER (PARTITION BY log_file) AS n FROM log_lines) "
            f"WHERE line_no > n - {n} GROUP BY log_file")


CTE["tails"] = _tail(P.REPORT_TAIL)


def _batch_cte() -> dict[str, str]:
    return {
        **_solutions("failed", P.BATCH_RESULTS),
        "batch": f"""
SELECT e.regression_run_id, e.test_object_run_id, e.test_name, m.issue_key IS NOT NULL AS has_solution,
       array_to_string(e.kws, ' ') AS error_keywords, m.rank, m.issue_key, m.similarity_score,
       m.matching_keywords, m.relevance_reason, m.solution_summary
FROM errors e LEFT JOIN matches m ON m.query = e.query WHERE coalesce(m.rank, 1) <= {P.BATCH_SHOWN}""",
    }


def _groups() -> dict[str, str]:
    """Leaders one rank after another, as a recursion over ranks."""
    threshold = Q.GROUP_THRESHOLD
    return {
        **_match("log_errors", "issue_words", "match_solution", 10, search=False),
        "sum_words": _words("SELECT issue_key AS id, summary AS txt FROM issues", 10),
        "items": f"""
SELECT m.query AS id, m.rank, m.issue_key, coalesce(w.words, {_EMPTY}) AS words
FROM matches m LEFT JOIN sum_words w ON w.id = m.issue_key""",
        "alike": f"""
SELECT x.id, x.rank AS later, y.rank AS earlier FROM items x JOIN items y ON y.id = x.id AND y.rank < x.rank
WHERE ({_jaccard('x.words', 'y.words')}) * {S.COMPARE_KEYWORD_WEIGHT}::DOUBLE >= {threshold}""",
        "led": """
SELECT id, 1 AS rank, [1] AS leaders, 1 AS leader FROM items WHERE rank = 1
UNION ALL
SELECT id, rank, CASE WHEN leader = rank THEN list_append(leaders, rank) ELSE leaders END, leader FROM (
  SELECT s.id, s.rank + 1 AS rank, s.leaders,
         coalesce((SELECT min(a.earlier) FROM alike a WHERE a.id = s.id AND a.later = s.rank + 1
                   AND list_contains(s.leaders, a.earlier)), s.rank + 1) AS leader
  FROM led s JOIN items i ON i.id = s.id AND i.rank = s.rank + 1)""",
    }


def _tfidf() -> dict[str, str]:
    stop = _list(w for w in T.ENGLISH_STOP_WORDS if len(w) > 1)
    return {
        "toks": f"""
SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY p) AS p FROM (
  SELECT id, unnest(l) AS w, generate_subscripts(l, 1) AS p FROM (
    SELECT issue_key AS id, string_split(trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')), ' ') AS l
    FROM issues)) WHERE length(w) > 1 AND w NOT IN ({stop})""",
        "tf": """
SELECT id, term, count(*) AS tf FROM (
  SELECT id, w AS term FROM toks UNION ALL
  SELECT a.id, concat(a.w, ' ', b.w) FROM toks a JOIN toks b ON b.id = a.id AND b.p = a.p + 1)
GROUP BY id, term""",
        "weighted": """
SELECT t.id, t.term, t.tf * (ln((1.0::DOUBLE + k.n) / (d.df + 1)) + 1) AS w
FROM tf t JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) d ON d.term = t.term
CROSS JOIN (SELECT count(*) AS n FROM issues) k WHERE d.df <= 0.9 * k.n""",
        "norms": "SELECT id, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY id",
    }


def _nearest() -> dict[str, str]:
    """Cosines of all pairs, the weights fitted on the issues."""
    stop = _list(w for w in T.ENGLISH_STOP_WORDS if len(w) > 1)

    def tf(name: str, rows: str) -> dict[str, str]:
        return {
            f"{name}_toks": f"""
SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY p) AS p FROM (
  SELECT id, unnest(l) AS w, generate_subscripts(l, 1) AS p FROM (
    SELECT id, string_split(trim(regexp_replace(lower(txt), '[^a-z0-9]+', ' ', 'g')), ' ') AS l FROM ({rows})))
WHERE length(w) > 1 AND w NOT IN ({stop})""",
            f"{name}_tf": f"""
SELECT id, term, count(*) AS tf FROM (
  SELECT id, w AS term FROM {name}_toks UNION ALL
  SELECT a.id, concat(a.w, ' ', b.w) FROM {name}_toks a JOIN {name}_toks b ON b.id = a.id AND b.p = a.p + 1)
GROUP BY id, term""",
            f"{name}_w": f"""
SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS u FROM (
  SELECT t.id, t.term, t.tf * i.idf AS w FROM {name}_tf t JOIN idf i ON i.term = t.term)""",
        }

    return {
        **tf("issue", "SELECT issue_key AS id, concat_ws(' ', summary, description) AS txt FROM issues"),
        **tf("asked", "SELECT log_file AS id, signature AS txt FROM analysis"),
        "idf": """
SELECT term, ln((1.0::DOUBLE + k.n) / (df + 1)) + 1 AS idf
FROM (SELECT term, count(*) AS df FROM issue_tf GROUP BY term)
CROSS JOIN (SELECT count(*) AS n FROM issues) k WHERE df <= 0.9 * k.n""",
        "cosines": """
SELECT q.id AS log_file, d.id AS issue_key, round(least(1.0::DOUBLE, sum(q.u * d.u)), 9) AS cosine
FROM asked_w q JOIN issue_w d ON d.term = q.term GROUP BY 1, 2""",
    }


def _alike(rows: str) -> dict[str, str]:
    """Links of all pairs of rows(id, txt), and the smallest id that each row can reach."""
    return {
        "alike_rows": rows,
        "alike_words": _words("SELECT DISTINCT txt AS id, txt FROM alike_rows WHERE txt IS NOT NULL", 10),
        "classes": "SELECT list_sort(w.words) AS words, min(r.id) AS id, count(*) AS n FROM alike_rows r "
                   "JOIN alike_words w ON w.id = r.txt WHERE len(w.words) > 0 GROUP BY 1",
        "linked": f"""
SELECT a.id AS u, b.id AS v, b.n FROM classes a JOIN classes b ON a.id <> b.id
AND ({_jaccard('a.words', 'b.words')}) * {S.COMPARE_KEYWORD_WEIGHT}::DOUBLE >= {Q.GROUP_THRESHOLD} - 1e-9""",
        "reach": "SELECT id, id AS r FROM classes UNION SELECT p.id, l.v FROM reach p JOIN linked l ON l.u = p.r",
        "class_groups": """
SELECT c.words, g.group_id, c.n - 1 + coalesce(m.more, 0) AS n_links
FROM classes c JOIN (SELECT id, min(r) AS group_id FROM reach GROUP BY id) g ON g.id = c.id
LEFT JOIN (SELECT u, sum(n) AS more FROM linked GROUP BY u) m ON m.u = c.id""",
        "alike_groups": """
SELECT r.id, r.txt, coalesce(g.group_id, r.id) AS group_id, CAST(coalesce(g.n_links, 0) AS BIGINT) AS n_links
FROM alike_rows r LEFT JOIN alike_words w ON w.id = r.txt LEFT JOIN class_groups g ON g.words = list_sort(w.words)""",
    }


def _similar_failures() -> dict[str, str]:
    return {
        "errors": _test_errors("failed"),
        "sig_words": _words("SELECT DISTINCT sig AS id, sig AS txt FROM errors", None),
        "families": "SELECT id, list_sort(words) AS words FROM sig_words",
        "seen": "SELECT f.words, min(e.sig) AS sig, count(*) AS n_failures, min(e.end_time) AS first_seen, "
                "max(e.end_time) AS last_seen, bool_or(e.end_time IS NULL) AS open "
                "FROM errors e JOIN families f ON f.id = e.sig WHERE len(f.words) > 0 GROUP BY f.words",
    }


def _as_text(name: str, body: str) -> str:
    """Integers that may be missing compare as text."""
    cols = Q.NULLABLE_INTEGERS.get(name)
    if not cols:
        return body
    texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({texts}) FROM ({body})"


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}

    def add(name, body, extra=None):
        out[name] = _sql(_as_text(name, body), extra)

    # warehouse
    add("status_map", "SELECT DISTINCT status AS name, status AS id FROM tor")
    add("run_dims", "SELECT regression_run_id, project_name, regression_name FROM runs")
    add("failed_tests", f"SELECT {_TEST} FROM tor WHERE status = 'failed'")
    add("test_details", f"SELECT {_TEST}, sim_time FROM details")
    add("log_paths", "SELECT test_object_run_id, log_file FROM paths")
    add("run_header", f"SELECT {_RUN}, username, client, log_directory FROM runs")
    add("status_counts", "SELECT regression_run_id, status, count(*) AS n_tests FROM tor GROUP BY 1, 2")
    add("regression_summary", f"""
SELECT r.*, CAST(coalesce(s.total, 0) AS BIGINT) AS total_tests, CAST(coalesce(s.passed, 0) AS BIGINT) AS passed,
       CAST(coalesce(s.failed, 0) AS BIGINT) AS failed, s.by_status,
       CASE WHEN s.total > 0 THEN s.passed::DOUBLE / s.total * 100 ELSE 0.0 END AS pass_rate,
       printf('%.1f%%', CASE WHEN s.total > 0 THEN s.passed::DOUBLE / s.total * 100 ELSE 0.0 END) AS pass_rate_text
FROM (SELECT {_RUN}, username, client, log_directory FROM runs) r LEFT JOIN (
  SELECT regression_run_id AS id, CAST(sum(n) AS BIGINT) AS total,
         CAST(sum(CASE WHEN status = 'passed' THEN n ELSE 0 END) AS BIGINT) AS passed,
         CAST(sum(CASE WHEN status = 'failed' THEN n ELSE 0 END) AS BIGINT) AS failed,
         string_agg(concat(status, '=', n), ' ' ORDER BY status) AS by_status
  FROM (SELECT regression_run_id, status, count(*) AS n FROM tor GROUP BY 1, 2) GROUP BY 1) s
ON s.id = r.regression_run_id""")
    brief = "test_object_run_id, test_name, block_name, status, start_time, end_time, num_error, failed_job_run_ref, regression_run_id"
    add("search_tests_run", f"""
SELECT {brief}, CAST(row_number() OVER (PARTITION BY regression_run_id {_NEWEST}) AS INTEGER) AS rank
FROM tor WHERE test_name ILIKE '%{Q.NAME_KEYWORD}%' QUALIFY rank <= {Q.SEARCH_LIMIT}""")
    add("search_tests_recent", f"""
SELECT {brief} FROM tor WHERE test_name ILIKE '%{Q.NAME_KEYWORD}%' AND regression_run_id IN (
  SELECT regression_run_id FROM runs ORDER BY start_time DESC NULLS FIRST, regression_run_id LIMIT 5)
{_NEWEST} LIMIT {Q.SEARCH_LIMIT}""")
    add("search_tests_all", f"""
SELECT {brief}, CAST(row_number() OVER (PARTITION BY regression_run_id {_NEWEST}) AS INTEGER) AS rank
FROM tor WHERE test_name ILIKE '%{Q.NAME_KEYWORD}%'""")
    add("latest_run_with_test_all", """
SELECT t.test_name, t.regression_run_id FROM tor t JOIN runs r ON r.regression_run_id = t.regression_run_id
QUALIFY row_number() OVER (PARTITION BY t.test_name ORDER BY r.start_time DESC NULLS FIRST, t.regression_run_id) = 1""")
    add("job_details", """
SELECT j.*, c.job_cmd_id AS command_cmd_id, c.cmd AS command_cmd, c.log_file AS command_log_file,
       c.exit_code AS command_exit_code, c.start_time AS command_start_time, c.end_time AS command_end_time,
       c.host AS command_host
FROM job_run j LEFT JOIN (SELECT * FROM job_cmd QUALIFY row_number() OVER (
  PARTITION BY regression_run_ref, job_run_ref ORDER BY job_cmd_id DESC) = 1) c
  ON c.job_run_ref = j.job_run_id AND c.regression_run_ref = j.regression_run_id""")
    add("runs_by_regression", f"SELECT regression_ref, {_RUN} FROM runs")
    add("list_runs", f"SELECT {_RUN} FROM runs")
    add("latest_runs", """
SELECT project_name, regression_name, regression_run_id FROM runs QUALIFY row_number() OVER (
  PARTITION BY project_name, regression_name ORDER BY start_time DESC NULLS FIRST, regression_run_id) = 1""")
    add("latest_run_with_test", """
SELECT t.test_name, t.regression_run_id FROM tor t JOIN (
  SELECT regression_run_id, start_time AS started FROM runs
  ORDER BY start_time DESC NULLS FIRST, regression_run_id LIMIT 100) r ON r.regression_run_id = t.regression_run_id
QUALIFY row_number() OVER (PARTITION BY t.test_name ORDER BY r.started DESC NULLS FIRST, t.regression_run_id) = 1""")
    add("failed_tests_with_errors", f"""
SELECT {_TEST}, log_file, signature, array_to_string(words, ' ') AS keywords, error_level, tool
FROM ({_analysed('failed')})""")
    cols = _TEST.replace(", random_seed", "").replace(", mem_usage, lsf_req_mb", "")
    add("test_details_with_errors", f"""
SELECT {cols}, sim_time, log_file, CASE WHEN log_file IS NOT NULL THEN block_name END AS suite,
       CASE WHEN log_file IS NOT NULL THEN test_name END AS test, signature, tool, line_number, error_level,
       error_line, pattern_pos, num_lines_scanned, array_to_string(words, ' ') AS error_keywords
FROM ({_analysed('details')})""")

    # logs
    add("log_lines", "SELECT * FROM log_lines")
    add("lines_of_text", "SELECT concat('doc/', doc_id) AS log_file, CAST(p AS INTEGER) AS line_no, txt AS line FROM doc_lines")
    add("ignored_lines", "SELECT log_file, line_no, line FROM classified WHERE ign")
    add("classified_lines", "SELECT log_file, line_no, line, level, pos FROM classified WHERE level IS NOT NULL")
    add("custom_rules", "SELECT log_file, line_no, line, level, pos FROM custom WHERE level IS NOT NULL")
    odd = "CAST(split_part(log_file, '/', 2) AS BIGINT) % 2"
    add("rules_by_project", f"""
SELECT log_file, line_no, line, level, pos FROM classified WHERE level IS NOT NULL AND {odd} = 0 UNION ALL
SELECT log_file, line_no, line, level, pos FROM custom WHERE level IS NOT NULL AND {odd} = 1""")
    add("warnings_as_errors", """
SELECT log_file, line_no, line, 3 AS level, 'builtin:warning' AS pos FROM (
  SELECT *, min(CASE WHEN marks THEN line_no END) OVER (PARTITION BY log_file) AS marker FROM classified)
WHERE warns AND level IS NULL AND NOT marks AND line_no > marker""")
    part = lambda i, n: f"regexp_extract(line, {_q(R.ACTION_PATTERN)}, {i}) AS {n}"
    add("log_fileentity", f"""
SELECT log_file, line_no, {part(1, 'suite')}, {part(2, 'test')}, {part(3, 'tool')} FROM classified WHERE acts
QUALIFY row_number() OVER (PARTITION BY log_file ORDER BY line_no) = 1""")
    add("tool_events", "SELECT log_file, line_no, tool FROM classified WHERE tool IS NOT NULL")
    add("first_error", "SELECT log_file, first_line AS line_no, first_text AS line FROM analysis WHERE first_line IS NOT NULL")
    add("analyze_failure", _record("analysis", "words_analysis"))
    add("analyze_failure_capped", _record("analysis_capped", "words_capped"))
    add("head_tail_lines", f"""
SELECT log_file, line_no, CAST(byte_start AS BIGINT) AS byte_start, CAST(file_size AS BIGINT) AS file_size, line FROM (
  SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY log_file ORDER BY line_no) - strlen(line) - 1 AS byte_start,
         sum(strlen(line) + 1) OVER (PARTITION BY log_file) AS file_size FROM log_lines)
WHERE byte_start <= {Q.END_BYTES} OR byte_start >= file_size - {Q.END_BYTES}""")
    add("all_errors", _all_errors())
    add("log_tail", "SELECT log_file, log_tail FROM tails")
    add("error_context", f"""
SELECT l.log_file, a.line_number AS error_line, l.line_no,
       concat(CASE WHEN l.line_no = a.line_number THEN '>>> ' ELSE '    ' END, printf('%5d: ', l.line_no),
              rtrim(l.line, {_WS})) AS context
FROM analysis a JOIN log_lines l ON l.log_file = a.log_file AND l.line_no BETWEEN a.line_number - 5 AND a.line_number + 5
WHERE a.line_number > 0""")
    add("has_error", "SELECT log_file, bool_or(level IS NOT NULL) AS has_error FROM classified GROUP BY log_file")
    add("test_log_report", f"""
SELECT t.regression_run_id, t.test_object_run_id, t.test_name, t.path AS log_file,
       CASE WHEN t.path IS NULL THEN 'Log file path not found in database'
            WHEN t.log_file IS NULL THEN 'Log file not accessible' END AS error,
       CASE WHEN t.path IS NOT NULL AND t.log_file IS NULL
            THEN array_to_string({_name_words('t.test_name')}, ' ') END AS keywords,
       t.signature, t.tool, t.line_number, t.error_level, t.pattern_pos, t.num_lines_scanned,
       array_to_string(t.words, ' ') AS error_keywords, x.log_tail
FROM ({_analysed('details')}) t LEFT JOIN tails x ON x.log_file = t.log_file""")

    # text
    docs = "SELECT doc_id AS id, text AS txt FROM documents"
    add("keywords", """
SELECT d.doc_id, coalesce(array_to_string(w.words[1:10], ' '), '') AS words,
       CAST(coalesce(len(w.words), 0) AS INTEGER) AS all_words
FROM documents d LEFT JOIN doc_words w ON w.id = d.doc_id""", {"doc_words": _words(docs, None)})
    name = "concat('test_', replace(p_name, ' ', '_'), '_', lower(p_type))"
    add("test_name_keywords", f"""
SELECT p_partkey AS test_id, {name} AS test_name, array_to_string({_name_words(name)}, ' ') AS words FROM part""")
    add("clean_text", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM documents")
    add("truncate_text", "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE concat(left(text, 97), '...') END AS short FROM documents")
    add("format_duration", f"""
SELECT test_object_run_id, {_duration('cpu_time')} AS cpu, {_duration('sim_time')} AS sim,
       {_duration('(sim_time / 10)')} AS short FROM tor""")
    add("token_estimate", "SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS tokens FROM documents")
    add("highlight_keywords", _highlight(), {"doc_words": _words(docs, 5)})
    add("issue_link", f"SELECT issue_key, concat({_q(TRACKER.rstrip('/'))}, '/browse/', issue_key) AS link FROM issues")

    # similarity
    add("keyword_jaccard", f"""
SELECT src_key, dst_key, {_jaccard('a', 'b')} AS score,
       array_to_string(CASE WHEN len(a) = 0 OR len(b) = 0 THEN {_EMPTY} ELSE list_sort(list_intersect(a, b)) END, ' ') AS matching,
       CAST(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(a) + len(b) - len(list_intersect(a, b)) END AS INTEGER) AS total
FROM {_PAIR}""", _pair_words("description", None))
    add("simple_similarity", f"SELECT src_key, dst_key, {_jaccard('a', 'b')} AS score FROM {_PAIR}",
        _pair_words("description", 20))
    add("compare_errors", f"""
SELECT src_key, dst_key, least(1.0::DOUBLE, ({_jaccard('a', 'b')}) * {S.COMPARE_KEYWORD_WEIGHT}::DOUBLE) AS score
FROM {_PAIR}""", _pair_words("summary", 10))
    edit_pairs = _edit(f"SELECT src_summary AS a, dst_summary AS b FROM {_LINKED}")
    add("edit_similarity", f"""
SELECT p.src_key, p.dst_key, coalesce(edit.ratio, 0.0::DOUBLE) AS ratio
FROM {_LINKED} p LEFT JOIN edit ON {_ratio('p.src_summary', 'p.dst_summary')}""", edit_pairs)
    add("tfidf_cosine", """
SELECT l.src_key AS left_id, l.dst_key AS right_id,
       round(least(1.0, greatest(0.0, coalesce(any_value(x.dot) / (any_value(a.norm) * any_value(b.norm)), 0.0))), 9) AS cosine
FROM links l LEFT JOIN (
  SELECT l.src_key, l.dst_key, sum(p.w * q.w) AS dot FROM links l JOIN weighted p ON p.id = l.src_key
  JOIN weighted q ON q.id = l.dst_key AND q.term = p.term GROUP BY 1, 2) x
  ON x.src_key = l.src_key AND x.dst_key = l.dst_key
LEFT JOIN norms a ON a.id = l.src_key LEFT JOIN norms b ON b.id = l.dst_key
GROUP BY 1, 2""", _tfidf())
    add("issue_text", "SELECT id AS issue_key, txt AS text FROM texts")
    add("match_scores", f"""
SELECT src_key, dst_key, kw AS keyword_score, ed AS edit_score, {_score('kw', 'ed', 'dst_status')} AS similarity_score,
       array_to_string(CASE WHEN len(a) = 0 OR len(b) = 0 THEN {_EMPTY} ELSE list_sort(list_intersect(a, b)) END, ' ') AS matching_keywords,
       {_reason('kw', 'len(list_intersect(a, b))', 'len(a) + len(b) - len(list_intersect(a, b))', 'ed', 'dst_status')} AS relevance_reason
FROM (SELECT p.src_key, p.dst_key, p.dst_status, coalesce(s.words, {_EMPTY}) AS a, coalesce(d.words, {_EMPTY}) AS b,
        coalesce(edit.ratio, 0.0::DOUBLE) AS ed,
        {_jaccard(f'coalesce(s.words, {_EMPTY})', f'coalesce(d.words, {_EMPTY})')} AS kw
      FROM {_LINKED} p LEFT JOIN edit ON {_ratio('p.src_summary', 'p.dst_summary')}
      LEFT JOIN pair_words s ON s.id = p.src_key LEFT JOIN issue_words_plain d ON d.id = p.dst_key)""",
        {**edit_pairs, **_pair_words("summary", 10)})
    log_matches = _match("log_errors", "issue_words", "match_solution", 10, search=False)
    add("match_issues", "SELECT query AS id, * EXCLUDE (query) FROM matches", log_matches)
    add("resolved_matches", f"""
SELECT query AS id, rank, issue_key, status, resolution FROM matches
WHERE {_SETTLED.format('status')} OR coalesce(resolution, '') <> ''""", log_matches)
    low_matches = _match("log_errors", "issue_words", "match_solution", 10, search=False, min_score=Q.LOW_SCORE)
    add("match_issues_low", "SELECT query AS id, * EXCLUDE (query, description, solution_summary) FROM matches",
        low_matches)
    add("match_issues_delta", "SELECT query AS id, rank, issue_key, similarity_score, matching_keywords FROM matches",
        log_matches)
    add("nearest_issues", f"""
SELECT log_file, CAST(row_number() OVER (PARTITION BY log_file ORDER BY cosine DESC, issue_key) AS INTEGER) AS rank,
       issue_key, cosine FROM cosines WHERE cosine > 0 QUALIFY rank <= {Q.COSINE_RESULTS}""", _nearest())
    failed_texts = {"errors": _test_errors("failed"),
                    **_alike("SELECT test_object_run_id AS id, sig AS txt FROM errors")}
    add("error_groups", "SELECT id, group_id, n_links FROM alike_groups", failed_texts)
    add("error_group_report", """
SELECT group_id, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_texts, arg_min(txt, (-n, txt)) AS text, max(n) AS n_text
FROM (SELECT group_id, txt, count(*) AS n FROM alike_groups GROUP BY 1, 2) GROUP BY 1""", failed_texts)
    add("issue_groups", "SELECT id, group_id, n_links FROM alike_groups",
        _alike("SELECT issue_key AS id, summary AS txt FROM issues"))
    issue_words = {"every_word": """
SELECT DISTINCT issue_key, unnest(regexp_extract_all(lower(concat_ws(' ', summary, description,
       array_to_string(labels, ' '))), '[\\p{L}\\p{N}_]+')) AS w FROM issues"""}
    add("candidates_by_error", f"""
SELECT query AS log_file, id AS issue_key,
       CAST(len(list_intersect(list_distinct(e.words[1:{M.SEARCH_KEYWORDS}]), f.words)) AS INTEGER) AS n_words
FROM log_errors e JOIN full_words f ON list_has_any(e.words[1:{M.SEARCH_KEYWORDS}], f.words)""")
    add("issues_with_all_keywords", """
SELECT a.id AS query, i.issue_key, CAST(count(*) AS INTEGER) AS n_words
FROM (SELECT id, unnest(words) AS w, len(words) AS n FROM sum_words) a JOIN every_word i ON i.w = a.w
GROUP BY a.id, i.issue_key HAVING count(*) = any_value(a.n)""", {
        **issue_words, "sum_words": _words("SELECT issue_key AS id, summary AS txt FROM issues", Q.ALL_KEYWORDS)})
    add("match_groups", """
SELECT l.id, l.rank, i.issue_key, l.leader AS leader_rank FROM led l JOIN items i ON i.id = l.id AND i.rank = l.rank""",
        _groups())
    add("suggest_keywords", _suggest())
    add("candidate_issues", f"""
SELECT i.issue_key, i.project, i.status FROM issues i JOIN full_words f ON f.id = i.issue_key
WHERE {_SETTLED.format('i.status')} AND list_has_any(f.words, [{_list(Q.SEARCH_WORDS)}])""")
    add("solution_sentence_match", "SELECT issue_key, match_solution AS solution FROM solved")
    add("solution_sentence_issue", "SELECT issue_key, issue_solution AS solution FROM solved")
    add("find_solutions", """
SELECT e.test_object_run_id, e.regression_run_id, e.test_name, e.status, e.block_name, e.num_error, e.num_warning,
       e.sig AS signature, array_to_string(e.kws, ' ') AS error_keywords, m.rank, m.issue_key, m.summary,
       m.description, m.status AS issue_status, m.resolution, m.similarity_score, m.matching_keywords,
       m.relevance_reason, m.solution_summary, m.link, coalesce(t.relevant_matches, 0) AS relevant_matches,
       coalesce(t.top_match_score, 0.0::DOUBLE) AS top_match_score
FROM errors e LEFT JOIN matches m ON m.query = e.query LEFT JOIN totals t ON t.query = e.query""",
        _solutions("details", 10))
    batch = _batch_cte()
    add("batch_solutions", "SELECT * FROM batch", batch)
    add("batch_summary", """
SELECT regression_run_id, count(*) AS total_failed_tests, count(*) FILTER (has_solution) AS tests_with_solutions,
       count(*) FILTER (NOT has_solution) AS tests_without_solutions
FROM batch WHERE coalesce(rank, 1) = 1 GROUP BY regression_run_id""", batch)
    add("issue_stats_by_day", f"""
SELECT status, count(*) AS n_issues, count(s) AS n_settled, sum(s)::DOUBLE / nullif(count(s), 0) AS avg_seconds,
       CAST(min(s) AS VARCHAR) AS min_seconds, CAST(max(s) AS VARCHAR) AS max_seconds, true AS median_within_error
FROM (SELECT status, CASE WHEN {_SETTLED.format('status')} THEN updated_s - created_s END AS s FROM issues) GROUP BY 1""")
    add("frequent_issues", """
SELECT m.issue_key, count(DISTINCT e.test_object_run_id) AS n_tests FROM errors e JOIN matches m ON m.query = e.query
GROUP BY m.issue_key""", _solutions("failed", 2**31))

    # issues
    add("search_issues", f"SELECT {_BRIEF} FROM issues WHERE status = 'Resolved' AND list_contains(labels, 'en') {_TOP.format(50)}")
    add("search_text", f"""
SELECT {_BRIEF} FROM issues i JOIN full_words f ON f.id = i.issue_key
WHERE list_has_all(f.words, [{_list(Q.SEARCH_TEXT.split())}]) AND {_SETTLED.format('status')} {_TOP.format(20)}""")
    add("search_text_short", f"""
SELECT {_BRIEF} FROM issues WHERE list_has_all(regexp_extract_all(
  lower(concat_ws(' ', summary, description, array_to_string(labels, ' '))), '[\\p{{L}}\\p{{N}}_]+'), ['to', 'is'])""")
    add("issue_comments", """
SELECT issue_key, seq, author, body, CAST(row_number() OVER (PARTITION BY issue_key ORDER BY seq) AS INTEGER) AS position
FROM comments""")
    add("issue_details", f"""
SELECT {_BRIEF}, description, array_to_string(labels, ' ') AS labels,
       coalesce(n_comments, 0) AS n_comments, issue_solution AS solution_summary FROM solved""")
    add("labels_any", f"SELECT {_BRIEF} FROM issues WHERE list_has_any(labels, [{_list(Q.LABELS)}]) {_TOP.format(20)}")
    add("labels_all", f"SELECT {_BRIEF} FROM issues WHERE list_has_all(labels, [{_list(Q.LABELS)}]) {_TOP.format(20)}")
    add("related_issues", f"""
SELECT l.src_key AS issue_key, l.dst_key AS key, coalesce(i.summary, '') AS summary,
       coalesce(i.status, 'Unknown') AS status, coalesce(l.relation, 'relates to') AS relation,
       concat({_q(TRACKER.rstrip('/'))}, '/browse/', l.dst_key) AS link
FROM links l LEFT JOIN issues i ON i.issue_key = l.dst_key""")
    add("project_info", f"""
SELECT n.n_name AS key, concat(upper(n.n_name[1]), lower(n.n_name[2:])) AS name, r.r_name AS description, s.lead,
       concat({_q(TRACKER.rstrip('/'))}, '/browse/', n.n_name) AS url
FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN (SELECT s_nationkey, min(s_name) AS lead FROM supplier GROUP BY 1) s ON s.s_nationkey = n.n_nationkey""")

    # analytics
    score = f"({_jaccard('a.words', 'b.words')}) * {S.COMPARE_KEYWORD_WEIGHT}::DOUBLE"
    add("earlier_failures", f"""
SELECT a.test_object_run_id AS id, b.test_object_run_id AS earlier_id, b.end_time AS earlier_time, l.score,
       CAST(row_number() OVER (PARTITION BY a.test_object_run_id
            ORDER BY b.end_time DESC, b.test_object_run_id DESC) AS INTEGER) AS rank
FROM failure_rows a JOIN likes l ON l.a = a.words JOIN failure_rows b ON b.words = l.b
WHERE b.end_time IS NOT NULL AND b.test_object_run_id <> a.test_object_run_id AND (a.end_time IS NULL
  OR b.end_time < a.end_time OR (b.end_time = a.end_time AND b.test_object_run_id < a.test_object_run_id))
QUALIFY rank <= {Q.HISTORY}""", {
        **_similar_failures(),
        "failure_rows": "SELECT e.test_object_run_id, e.end_time, f.words FROM errors e "
                        "JOIN families f ON f.id = e.sig WHERE len(f.words) > 0",
        "likes": f"""
SELECT a, b, score FROM (
  SELECT x.words AS a, y.words AS b,
         least(1.0::DOUBLE, ({_jaccard('x.words', 'y.words')}) * {S.COMPARE_KEYWORD_WEIGHT}::DOUBLE) AS score
  FROM seen x JOIN seen y ON list_has_any(x.words, y.words))
WHERE score >= 0.3"""})
    add("similar_failures", f"""
SELECT signature, CAST(rank AS INTEGER) AS rank, earlier_signature, score, n_failures, first_seen, last_seen FROM (
  SELECT *, row_number() OVER (PARTITION BY words ORDER BY score DESC, first_seen DESC, earlier_signature) AS rank
  FROM (SELECT a.words, a.sig AS signature, b.sig AS earlier_signature, {score} AS score, b.n_failures, b.first_seen,
               b.last_seen
        FROM seen a JOIN seen b ON b.first_seen < a.last_seen OR (a.open AND b.first_seen IS NOT NULL)) WHERE score >= 0.3)
WHERE rank <= 5""", _similar_failures())
    words = "|".join(S.ISSUE_SOLUTION_WORDS)
    add("solution_sentences_all", f"""
SELECT issue_key, seq, CAST(p - 1 AS INTEGER) AS pos, trim(s, {_WS}) AS sentence FROM (
  SELECT issue_key, seq, unnest(l) AS s, generate_subscripts(l, 1) AS p FROM (
    SELECT issue_key, -1 AS seq, string_split(description, '.') AS l FROM issues
    UNION ALL SELECT issue_key, seq, string_split(body, '.') FROM comments))
WHERE regexp_matches(lower(s), '{words}')""")
    add("issue_stats", """
SELECT status, resolution, count(*) AS n_issues
FROM (SELECT status, coalesce(resolution, 'Unresolved') AS resolution FROM issues) GROUP BY ROLLUP (status, resolution)""")
    add("resolution_time", f"""
SELECT status, count(*) AS n_issues, avg(s) AS avg_seconds, min(s) AS min_seconds, max(s) AS max_seconds,
       quantile_cont(s, 0.5) AS median_seconds
FROM (SELECT status, updated_s - created_s AS s FROM issues WHERE {_SETTLED.format('status')}) GROUP BY status""")
    return out
