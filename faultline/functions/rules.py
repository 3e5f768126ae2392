"""Ordered error rules, ignore rules and the special lines of a test log.

A rule list becomes one CASE expression. Plain-text rules use ``contains`` or
``startswith`` instead of a regex, and every rule names a piece of text its matches must
hold (``stem``), so that a handful of substring tests drops nearly all lines first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .text import _col, strip

# Java flags that make a pattern read text as Python does: only \n ends a line, and
# \s, \d and \b know Unicode.
_FLAGS = "(?dU)"
_FLAGS_NOCASE = "(?diuU)"
_SPECIAL = set(".^$*+?{}[]\\|()")


@dataclass(frozen=True)
class Rule:
    """One error rule: the first rule whose regex is found decides level and pos.

    ``stem`` is text that every match contains exactly as written; leave it out if there
    is none, and the regex itself decides whether a line needs a closer look.
    ``stem_lower`` is the same for the lower-cased line.
    """

    regex: str
    level: int
    pos: str
    stem: str | None = None
    stem_lower: str | None = None
    ignore_case: bool = False

    def __post_init__(self):
        re.compile(self.regex)

    def _literal(self) -> tuple[bool, str] | None:
        """(anchored, text) when the regex is plain text, perhaps after a ``^``."""
        anchored = self.regex.startswith("^")
        body = self.regex[1:] if anchored else self.regex
        text = re.sub(r"\\([^A-Za-z0-9])", lambda m: "" if m[1] in _SPECIAL else m[1], body)
        plain = re.sub(r"\\([^A-Za-z0-9])", r"\1", body)
        if self.ignore_case or not body or any(ch in _SPECIAL for ch in text):
            return None
        return anchored, plain

    def java_regex(self) -> str:
        """The regex with the flags under which Spark reads it as it is meant."""
        return (_FLAGS_NOCASE if self.ignore_case else _FLAGS) + self.regex

    def found_in(self, line) -> Column:
        literal = self._literal()
        if literal:
            anchored, text = literal
            return line.startswith(text) if anchored else line.contains(text)
        found = line.rlike(self.java_regex())
        return line.contains(self.stem) & found if self.stem else found

    def needed_text(self) -> str | None:
        literal = self._literal()
        return self.stem or (literal[1] if literal else None)


# Error rules in matching order (regex, level, name of the position).
ERROR_RULES = (
    # level 10: system failures
    Rule(r"SEGMENTATION_FAULT", 10, "builtin:segfault"),
    Rule(r"Segmentation fault", 10, "builtin:segfault"),
    Rule(r"core dumped", 10, "builtin:core_dump"),
    Rule(r"Cannot allocate memory", 10, "builtin:oom"),
    # level 9: verification library errors
    Rule(r"UVM_ERROR", 9, "builtin:uvm_error"),
    Rule(r"UVM_FATAL", 9, "builtin:uvm_fatal"),
    # level 8: assertions
    Rule(r"ASSERTION FAILED(?!.*GcLog\.Assert)", 8, "builtin:assertion", stem="FAIL"),
    Rule(r"Assertion \`.*\' failed\.", 8, "builtin:assertion", stem="fail"),
    Rule(r"^sim_vcs: .* Assertion", 8, "builtin:assertion", stem=" Assertion"),
    Rule(r"TCORE ASSERT", 8, "builtin:tcore_assert"),
    # level 7: system errors
    Rule(r"symbol lookup error:", 7, "builtin:symbol_lookup"),
    Rule(r"Error: null object access", 7, "builtin:null_access"),
    Rule(r"error: .* No such file or directory", 7, "builtin:no_file", stem="No such file"),
    Rule(r"diff: .* No such file or directory", 7, "builtin:no_file", stem="No such file"),
    Rule(r"VCS runtime internal error", 7, "builtin:vcs_internal"),
    # level 6: compilation errors
    Rule(r"make.*\*\*\* .* Stop", 6, "builtin:make_stop", stem=" Stop"),
    Rule(r"Compilation failed in require", 6, "builtin:compile_fail"),
    Rule(r" undeclared \(first use this function\)$", 6, "builtin:undeclared",
         stem=" undeclared (first use"),
    Rule(r"^syntax error at ", 6, "builtin:syntax_error"),
    # level 5: general errors
    Rule(r"[^_|]ERROR[^_]", 5, "builtin:error_bounded", stem="ERROR"),
    Rule(r"ERROR(?!_)", 5, "builtin:error", stem="ERROR"),
    Rule(r"^ERROR", 5, "builtin:error_start"),
    Rule(r"Error-", 5, "builtin:error_dash"),
    Rule(r"Error:", 5, "builtin:error_colon"),
    Rule(r"\serror(?!s_are_warnings)(?!type)(?!_)(?!log)(?!To reproduce the error using the)",
         5, "builtin:error_word", stem="rror"),
    Rule(r"FAIL EXIT", 5, "builtin:fail_exit"),
    Rule(r"failed: exit status", 5, "builtin:failed_exit"),
    Rule(r"failed: caught signal", 5, "builtin:failed_signal"),
    Rule(r"TEST INCOMPLETE", 5, "builtin:incomplete"),
    Rule(r"surfexp failed to examine", 5, "builtin:surfexp"),
    Rule(r"surfexp failed to expand", 5, "builtin:surfexp"),
    Rule(r"Stack trace follows:", 5, "builtin:stack_trace"),
    Rule(r"\*E[^A-Za-z]", 5, "builtin:star_e", stem="*E"),
    Rule(r"\*F[^A-Za-z]", 5, "builtin:star_f", stem="*F"),
    Rule(r"\*\*\* SCV_ERROR: (.*) at time \d+", 5, "builtin:scv_error", stem="ERROR"),
    Rule(r"SCV_ERROR: CONSTRAINT_ERROR", 5, "builtin:scv_constraint"),
    Rule(r"^OVL_ERROR :", 5, "builtin:ovl_error"),
    Rule(r"^Files .* differ", 5, "builtin:files_differ", stem=" differ"),
    Rule(r"Mismatch!!!", 5, "builtin:mismatch"),
    Rule(r"cmd runtime exceeded timeout", 5, "builtin:timeout"),
    Rule(r"^Maximum evaluation count", 5, "builtin:max_eval"),
    Rule(r"still asserted at finish", 5, "builtin:still_asserted"),
    Rule(r"\d+ : fail", 5, "builtin:numbered_fail", stem="fail"),
    Rule(r"Error: TC BFM", 5, "builtin:tc_bfm"),
    Rule(r"^TCoreCail:", 5, "builtin:tcorecail"),
    # level 4 and 5: tool-specific errors
    Rule(r"run FAILED", 4, "builtin:run_failed"),
    Rule(r"Lint FAILED with Warnings\.Errors", 4, "builtin:lint_failed",
         stem_lower="warn", ignore_case=True),
    Rule(r"100%:\s*\w+\s*fail:", 4, "builtin:100pct_fail", stem="fail"),
    Rule(r"^emulate: ", 5, "builtin:emulate"),
    Rule(r"^db_emulate: ", 5, "builtin:db_emulate"),
    Rule(r"^bia error:", 5, "builtin:bia_error"),
    Rule(r"^cbgen error", 5, "builtin:cbgen_error"),
    Rule(r"^cb_emulate", 5, "builtin:cb_emulate"),
    Rule(r"mem_diff_dir\.pl FAILED", 5, "builtin:mem_diff_failed"),
    Rule(r"vec_check_dir\.pl FAILED", 5, "builtin:vec_check_failed"),
    # hardware-specific errors
    Rule(r"CP_VGT_START pulse was received", 5, "builtin:cp_vgt_start"),
    Rule(r"Request for more SQ GPRs than supported", 5, "builtin:sq_gprs"),
    Rule(r"Request for more SQ Threads than supported", 5, "builtin:sq_threads"),
    Rule(r"illegal_read_address: started", 5, "builtin:illegal_read"),
    Rule(r"mem_framebuf_r not found!", 5, "builtin:mem_framebuf"),
    Rule(r"tar:.*framebuf.*Not found in archive", 5, "builtin:framebuf_archive",
         stem="Not found in archive"),
    # tool-flow errors
    Rule(r"dv: can\'t move to ", 5, "builtin:dv_cant_move"),
    Rule(r"does not match bootstrap parameter", 5, "builtin:bootstrap_mismatch"),
    Rule(r"inferior process received signal", 5, "builtin:inferior_signal"),
    Rule(r"more than .* pct missed overlaps", 5, "builtin:missed_overlaps",
         stem=" pct missed overlaps"),
    Rule(r"both exist -- please delete one", 5, "builtin:duplicate_exists"),
    Rule(r"Error: out of memory while attempting", 5, "builtin:oom_attempt"),
    Rule(r"The tool has just run out of memory", 5, "builtin:tool_oom"),
    Rule(r"not found -- typo", 5, "builtin:not_found_typo"),
    Rule(r"^\s*sim_warnings\.pl:\s*!*Error:", 5, "builtin:sim_warnings", stem="rror"),
    Rule(r"^db_mem_htile_check\.pl: [1-9]+[0-9]* errors found in checking", 5,
         "builtin:htile_check", stem="rror"),
)

# The rule for warnings, used after the "warnings as errors" marker only.
WARNING_RULES = (
    Rule(r"warning", 3, "builtin:warning", stem_lower="warn", ignore_case=True),
)

# A line holding any of these (case-insensitive) is never an error. The
# second text is lower-case text that every match contains.
IGNORE_PATTERNS = (
    (r"UVM_ERROR\s*:\s*0", "uvm_error"),
    (r"UVM_ERROR reports\s+:\s+0", "uvm_error reports"),
    (r"UVM_FATAL\s*:\s*0", "uvm_fatal"),
    (r"UVM_FATAL reports\s+:\s+0", "uvm_fatal reports"),
    (r"grep UVM_ERROR", "grep uvm_error"),
    (r"grep UVM_FATAL", "grep uvm_fatal"),
    (r"-fail_on_regex.*UVM_(FATAL|ERROR)", "-fail_on_regex"),
    (r"^ERROR Param: unable to open file:", "error param: unable to open file:"),
    (r"Dumping state in current store \(Lookup error", "dumping state in current store"),
    (r"possible error on line", "possible error on line"),
    (r"^perl .*\/check_results\.pl .* -type errors", "check_results.pl"),
    (r"^ERROR: File .* is non-zero", " is non-zero"),
    (r"Runtime log has errors in Simulator", "runtime log has errors"),
    (r"Green Light: no errorflag", "green light: no errorflag"),
    (r"grep ERROR .*\.log", "grep error "),
    (r"To reproduce the error using the extracted testcase", "to reproduce the error"),
    (r"To reproduce the error using the original design", "to reproduce the error"),
    (r'grep -v "To reproduce the error"', "to reproduce the error"),
    (r"Your project demotes this error to a warning", "your project demotes"),
    (r"Number of demoted UVM_FATAL reports", "number of demoted"),
    (r"Model will not work properly because atleast one pin is not connected",
     "model will not work properly"),
    (r"grep.*ERROR.*mail.*FAIL", "grep"),
    (r"perl .*\/tb_log_grep\.pl.*ERROR", "tb_log_grep.pl"),
    (r"FlexNet\s+Licensing\s+(checkout|error)", "flexnet"),
    (r"error in a future release\s*$", "error in a future release"),
    (r": no version information available", ": no version information"),
)

# A line naming this program is ignored unless it reports a caught signal.
IGNORE_PROGRAM = "simctrl"
CAUGHT_SIGNAL = r"failed:\s+caught\s+signal\s+\d+"

# Lines that carry state instead of errors.
ACTION_HEAD = "# action: gc("
ACTION_PATTERN = (
    r"^# action: gc\(.*\)::([\p{L}\p{N}_]+)\/([\p{L}\p{N}_]+)\.(\S+)"
)
TOOL_HEAD = "dv: "
TOOL_PATTERNS = (r"dv: \.\.\. running tool (\S+)", r"dv: tool (\S+) failed!")
WARNINGS_MARKER = "cc1plus: warnings being treated as errors"


def _any(conditions) -> Column:
    result = F.lit(False)
    for c in conditions:
        result = result | c
    return result


def _shortest(texts) -> list[str]:
    """Texts without those that contain another one of them."""
    texts = sorted(set(texts), key=lambda t: (len(t), t))
    kept: list[str] = []
    for t in texts:
        if not any(k in t for k in kept):
            kept.append(t)
    return kept


def may_match(line, rules=ERROR_RULES) -> Column:
    """Cheap test that holds for every line any of the rules matches."""
    line = _col(line)
    inside, at_start, lower, rest = [], [], [], []
    for r in rules:
        literal = r._literal()
        if literal and literal[0] and not r.stem:
            at_start.append(literal[1])
        elif r.needed_text():
            inside.append(r.needed_text())
        elif r.stem_lower:
            lower.append(r.stem_lower)
        else:
            rest.append(r)
    inside = _shortest(inside)
    at_start = [t for t in at_start if not any(k in t for k in inside)]
    return _any(
        [line.startswith(t) for t in at_start]
        + [line.contains(t) for t in inside]
        + [F.lower(line).contains(t) for t in _shortest(lower)]
        + [r.found_in(line) for r in rest]
    )


def folded(line) -> Column:
    """Lower-case line in which the letters that fold to s, k and i are plain."""
    return F.lower(F.translate(_col(line), "\u017f\u212a\u0131\u0130", "skii"))


def ignored(line, low=None) -> Column:
    """True for lines that no analysis looks at. ``low`` is the folded line, if at hand."""
    line = _col(line)
    low = folded(line) if low is None else low
    program = line.contains(IGNORE_PROGRAM) & ~line.rlike(_FLAGS + CAUGHT_SIGNAL)
    listed = [low.contains(stem) & line.rlike(_FLAGS_NOCASE + p) for p, stem in IGNORE_PATTERNS]
    return program | _any(listed)


def classify(line, rules=ERROR_RULES) -> Column:
    """Number of the first matching rule, null when none matches or the line is blank."""
    line = _col(line)
    number = F.when(strip(line) == "", F.lit(None).cast("int"))
    for i, rule in enumerate(rules, 1):
        number = number.when(rule.found_in(line), F.lit(i))
    return number


def rule_level(number, rules=ERROR_RULES) -> Column:
    return F.get(F.array(*[F.lit(r.level) for r in rules]), _col(number) - 1)


def rule_pos(number, rules=ERROR_RULES) -> Column:
    return F.get(F.array(*[F.lit(r.pos) for r in rules]), _col(number) - 1)


def is_warning(line) -> Column:
    """The warning rules; the marker decides whether they count."""
    line = _col(line)
    return may_match(line, WARNING_RULES) & _any(r.found_in(line) for r in WARNING_RULES)


def is_marker(line) -> Column:
    return _col(line).contains(WARNINGS_MARKER)


def _group(line, pattern, n) -> Column:
    return F.nullif(F.regexp_extract(line, _FLAGS + pattern, n), F.lit(""))


def tool_name(line) -> Column:
    """Tool named by a tool line, else null."""
    line = _col(line)
    named = F.coalesce(*[_group(line, p, 1) for p in TOOL_PATTERNS])
    return F.when(line.contains(TOOL_HEAD), named)


def action(line) -> Column:
    """struct(suite, test, tool) of an action line, else null."""
    line = _col(line)
    parts = F.struct(
        *[_group(line, ACTION_PATTERN, i).alias(n) for i, n in enumerate(("suite", "test", "tool"), 1)]
    )
    matches = line.startswith(ACTION_HEAD) & line.rlike(_FLAGS + ACTION_PATTERN)
    return F.when(matches, parts)
