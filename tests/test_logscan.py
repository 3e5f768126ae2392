"""Log analysis against a line-by-line loop, with blocks small enough to be crossed."""

import random
import re

import pytest

from faultline.functions import rules as R
from faultline.functions.text import NOISE_WORDS
from faultline.operators import logscan as L

GOLDEN = [
    ("UVM_ERROR @ 5: x", False, 9, "builtin:uvm_error"),
    ("UVM_ERROR : 0", True, None, None),
    ("UVM_ERROR : 01", True, None, None),
    ("Segmentation fault simctrl", True, None, None),
    ("simctrl failed: caught signal 11", False, 5, "builtin:failed_signal"),
    ("FlexNet Licensing error", True, None, None),
    ("ASSERTION FAILED x", False, 8, "builtin:assertion"),
    ("ASSERTION FAILED at GcLog.Assert", False, None, None),
    ("symbol lookup error: z", False, 7, "builtin:symbol_lookup"),
    ("error: foo No such file or directory", False, 7, "builtin:no_file"),
    (" x undeclared (first use this function)", False, 6, "builtin:undeclared"),
    ("ERROR", False, 5, "builtin:error"),
    ("x ERROR y", False, 5, "builtin:error_bounded"),
    ("a|ERROR|b", False, 5, "builtin:error"),
    ("ERROR_X", False, 5, "builtin:error_start"),
    ("_ERROR_", False, None, None),
    ("my errors_are_warnings", False, None, None),
    ("OVL_ERROR : x", False, 5, "builtin:error"),
    ("Error: TC BFM x", False, 5, "builtin:error_colon"),
    ("bia error: z", False, 5, "builtin:error_word"),
    ("3 : fail", False, 5, "builtin:numbered_fail"),
    ("run FAILED", False, 4, "builtin:run_failed"),
    ("warning: x", False, None, None),
    ("LINT failed with wArnings.Errors", False, 4, "builtin:lint_failed"),
    ("dv: can't move to x", False, 5, "builtin:dv_cant_move"),
    ("Assertion `x' failed.", False, 8, "builtin:assertion"),
    ("make: *** [a] Stop", False, 6, "builtin:make_stop"),
    ("to reproduce the ERROR using the original design", True, None, None),
    ("UVM_FATAL reportſ : 0", True, None, None),
    ("   ", False, None, None),
]


def frame(spark, logs):
    rows = [(f, i, line) for f, lines in logs.items() for i, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "log_file STRING, line_no INT, line STRING")


def test_golden_lines(spark):
    lines = frame(spark, {"g": [g[0] for g in GOLDEN]})
    found = {r.line_no: (r.level, r.pos) for r in L.classified_lines(lines).collect()}
    ignored = {r.line_no for r in L.ignored_lines(lines).collect()}
    for i, (_, skip, level, pos) in enumerate(GOLDEN, 1):
        assert (i in ignored) == skip, GOLDEN[i - 1]
        assert found.get(i, (None, None)) == (level, pos), GOLDEN[i - 1]


def test_cheap_test_never_hides_a_match(spark):
    """Each rule on a line made from its own pattern, shortcut against bare regex."""
    samples = ["ASSERTION FAILED x", "sim_vcs: a Assertion", "diff: x No such file or directory",
               "xERROR y", "ERROR", " error x", "*E,", "*F,", "*** SCV_ERROR: x at time 5",
               "Files a differ", "12 : fail", "lint FAILED with warnings.errors", "100%: ab fail:",
               "tar: framebuf Not found in archive", "more than 3 pct missed overlaps",
               " sim_warnings.pl: !Error:", "db_mem_htile_check.pl: 12 errors found in checking"]
    for r in R.ERROR_RULES:
        if r._literal():
            samples.append(r._literal()[1])
    lines = frame(spark, {"s": samples})
    got = {r.line_no for r in L.classified_lines(lines).collect()}
    want = {i for i, s in enumerate(samples, 1)
            if any(re.search(r.regex, s, re.I if r.ignore_case else 0) for r in R.ERROR_RULES)}
    skipped = {r.line_no for r in L.ignored_lines(lines).collect()}
    assert got == want - skipped


# ------------------------------------------------------------- a loop over the lines


def plain_ignored(line):
    if "simctrl" in line and not re.search(R.CAUGHT_SIGNAL, line):
        return True
    return any(re.search(p, line, re.I) for p, _ in R.IGNORE_PATTERNS)


def plain_rule(line, warnings):
    if not line.strip():
        return None
    for r in R.ERROR_RULES:
        if re.search(r.regex, line, re.I if r.ignore_case else 0):
            return r.level, r.pos
    if warnings and re.search("warning", line, re.I):
        return 3, "builtin:warning"
    return None


def plain_words(text):
    words = dict.fromkeys(w for w in re.findall(r"\b[a-z0-9_]+\b", text.lower())
                          if len(w) > 2 and w not in NOISE_WORDS)
    return list(words)[:10]


def plain_analysis(lines, detect, tool=None, max_lines=None):
    suite = test = None
    best = first = None
    now, warnings, scanned = tool, False, 0
    nothing = "unknown"
    for no, line in enumerate(lines, 1):
        scanned += 1
        if max_lines and scanned > max_lines:
            nothing = f"unknown, did not find error in first {max_lines} lines"
            break
        if plain_ignored(line):
            continue
        if detect and suite is None:
            m = re.search(R.ACTION_PATTERN.replace(r"[\p{L}\p{N}_]", r"\w"), line)
            if m:
                suite, test = m[1], m[2]
                if not tool:
                    now = m[3]
                continue
        named = [m for p in R.TOOL_PATTERNS if (m := re.search(p, line))]
        if named:
            now = named[0][1]
            continue
        if R.WARNINGS_MARKER in line:
            warnings = True
            continue
        hit = plain_rule(line, warnings)
        if hit:
            first = first or (no, line.strip())
            if best is None or hit[0] > best[0]:
                best = (hit[0], hit[1], no, line, now)
    signature = best[3].strip() if best else nothing
    return {
        "suite": suite or "unknown", "test": test or "unknown", "signature": signature,
        "tool": (best and best[4]) or now or "unknown", "line_number": best[2] if best else 0,
        "error_level": best[0] if best else 1, "error_line": best[3] if best else nothing,
        "pattern_pos": best[1] if best else "unknown", "num_lines_scanned": scanned,
        "error_keywords": plain_words(signature),
        "first_error_line": first[0] if first else None,
    }


PIECES = [
    "info fine", "info fine", "info fine", "", "ERROR: bad thing", "UVM_ERROR @ 1: boom", "UVM_ERROR : 0",
    "warning: odd value", "Warning other", "cc1plus: warnings being treated as errors",
    "dv: ... running tool vcs", "dv: tool sim failed!", "# action: gc(x)::alpha/one.build",
    "# action: gc(x)::beta/two.run ERROR: strange", "  run FAILED  ", "x error_count 7",
    "dv: ... running tool cc1plus: warnings being treated as errors ERROR",
    "# action: gc(y)::gamma/three.t cc1plus: warnings being treated as errors",
    "# action: gc(y)::delta/four.t dv: ... running tool late",
]


def random_logs(n=120, seed=1):
    rnd = random.Random(seed)
    return {f"log{i}": [rnd.choice(PIECES) for _ in range(rnd.randrange(1, 30))] for i in range(n)}


@pytest.mark.parametrize("detect, tool, max_lines, block", [
    (True, None, None, 4), (False, None, None, 3), (True, "given", None, 5), (True, None, 7, 4),
    (True, None, None, 65_536),
])
def test_analysis(spark, detect, tool, max_lines, block):
    logs = random_logs(seed=block)
    got = L.analyze_logs(frame(spark, logs), detect=detect, tool=tool, max_lines=max_lines,
                         block_lines=block)
    got = {r.log_file: r.asDict() for r in got.collect()}
    assert got.keys() == logs.keys()
    for name, lines in logs.items():
        want = plain_analysis(lines, detect, tool, max_lines)
        assert {k: got[name][k] for k in want} == want, (name, lines)


@pytest.mark.parametrize("block", [3, 65_536])
def test_all_errors(spark, block):
    logs = random_logs(seed=11)
    got = L.all_errors(frame(spark, logs), max_errors=4, block_lines=block).collect()
    want = set()
    for name, lines in logs.items():
        warnings, n = False, 0
        for no, line in enumerate(lines, 1):
            if plain_ignored(line):
                continue
            if R.WARNINGS_MARKER in line:
                warnings = True
                continue
            hit = plain_rule(line, warnings)
            if hit and n < 4:
                n += 1
                want.add((name, no, line.strip(), hit[0]))
    assert {tuple(r) for r in got} == want


def test_tail_context_and_ends(spark):
    logs = {f"l{n}": [f"line {i} é" for i in range(1, n + 1)] for n in (1, 5, 9, 20)}
    lines = frame(spark, logs)
    for block in (4, 65_536):
        tail = L.log_tail(lines, 6, block_lines=block).collect()
        assert {(r.log_file, r.line_no) for r in tail} == {
            (f, i) for f, ls in logs.items() for i in range(max(1, len(ls) - 5), len(ls) + 1)}
        ends = {(r.log_file, r.line_no) for r in L.head_tail_lines(lines, 25, block).collect()}
        want = set()
        for f, ls in logs.items():
            sizes = [len(x.encode()) + 1 for x in ls]
            for i in range(len(ls)):
                start = sum(sizes[:i])
                if start <= 25 or start >= sum(sizes) - 25:
                    want.add((f, i + 1))
        assert ends == want
    hits = spark.createDataFrame([("l9", 2), ("l1", 1)], "log_file STRING, error_line INT")
    context = {(r.log_file, r.line_no): r.context for r in L.error_context(lines, hits, 2).collect()}
    assert sorted(context) == [("l1", 1), ("l9", 1), ("l9", 2), ("l9", 3), ("l9", 4)]
    assert context["l9", 2] == ">>>     2: line 2 é" and context["l9", 3] == "        3: line 3 é"


def test_custom_rules_without_stem(spark):
    mine = (R.Rule(r"^info\s+f", 2, "mine:info"),) + R.ERROR_RULES
    lines = frame(spark, {"a": ["info fine", "ERROR x", "nothing"]})
    got = {(r.line_no, r.level, r.pos) for r in L.classified_lines(lines, mine).collect()}
    assert got == {(1, 2, "mine:info"), (2, 5, "builtin:error")}
