"""Severity of lines (P-01 to P-04) and the line predicates (P-07 to P-11, P-16, P-17)."""

from __future__ import annotations

from lineflow.functions import patterns as P
from lineflow.functions.dialect import Dialect


def outside_paths(d: Dialect, pattern: str, x: str) -> str:
    """The pattern matches, and still does once path-like tokens are blanked (P-03); the cheap test stands first."""
    return f"({d.match(x, pattern)} and {d.match(d.sub(x, P.PATH_TOKEN, ' '), pattern)})"


#: Lower-case texts of which a line holds one wherever the pattern matches; they leave out s, whose other form ſ isn't lowered.
NEEDS = {
    P.ERROR_WORD: ("error",),
    P.PYTHON_EXCEPTION: ("error:", "exception:", "warning:", "fault:"),
    P.FAIL_WORD: ("fail",),
    P.COMPILE_ERROR: ("cannot", "undefined", "not found", "yntax error"),
    P.RUST_NOTE: ("note:", "help:"),
    P.VERBOSE: ("debug", "trace", "verbo"),
} | dict(zip(P.CRITICAL_TRIMMED, (("panic:",), ("fatal:",), ("fatal",), ("goroutine ",), ("traceback (mo",), ("egmentation fault", "egv", "egfault")))) | dict(
    zip((*P.ERROR_PLAIN, *P.PARSE_ERROR, *P.WARNING_WORDS), (("ertion failed",), (" got",), ("exit ",), ("json", "jſon", "yaml", "toml"), ("unexpected ",), ("yaml:",), ("warn",), ("deprecated",), ("todo", "fixme", "hack"), ("kip",)))
)


def holds(d: Dialect, pattern: str, x: str, low: str, test: str = "") -> str:
    """The pattern matches x, whose lower-case form is `low`: a plain text search spares most lines the pattern.  The oracle
    does without the search, so that it shows that none is lost."""
    if d.name == "duckdb":
        return test or d.match(x, pattern)
    return f"(({' or '.join(d.contains(low, d.lit(n)) for n in NEEDS[pattern])}) and {test or d.match(x, pattern)})"


def holds_any(d: Dialect, patterns: tuple[str, ...], x: str, low: str) -> str:
    return "(" + " or ".join(holds(d, p, x, low) for p in patterns) + ")"


def source_prefix() -> str:
    return r"^[^\s:]+\.(?:" + "|".join(P.SOURCE_EXTENSIONS) + r"):\d+(?::\d+)?:\s*"


def source_level(d: Dialect, x: str) -> str:
    """Stricter levels for the content of a match in source code (P-02); x is trimmed content."""
    return f"""case when {x} = '' then {P.NOISE}
        when {d.any_of(P.CRITICAL_TRIMMED, x)} then {P.CRITICAL}
        when {d.match(x, P.STRICT_ERROR)} then {P.ERROR} when {d.match(x, P.STRICT_WARNING)} then {P.WARNING}
        when {d.match(x, P.STRICT_COMPILER)} or {d.any_of(P.PARSE_ERROR, x)} then {P.ERROR} else {P.INFO} end"""


def level(d: Dialect, line: str, t: str, low: str = "") -> str:
    """Level 0 to 5 of a raw line and its trimmed form (P-01): the first rule that holds.  `low` is t in lower case."""
    low = low or d.lower(t)
    outside = lambda p: holds(d, p, t, low, outside_paths(d, p, t))
    bare = d.trim(d.sub(t, P.ANSI_CSI, ""))
    after = d.trim(d.sub(t, P.TIMESTAMP_ONLY, ""))
    content = d.trim(d.sub(t, source_prefix(), ""))
    return f"""case when {t} = '' or {d.match(t, P.PURE_ANSI)} or {d.match(t, P.DECORATIVE)} then {P.NOISE}
        when {d.contains(t, d.lit(chr(27) + '['))} and {bare} = '' then {P.NOISE}
        when {d.contains(t, d.lit(':'))} and {d.match(t, source_prefix())} then {source_level(d, content)}
        when {holds_any(d, P.CRITICAL_TRIMMED, t, low)} or ({line} <> {t} and {d.any_of(P.CRITICAL_RAW, line)}) then {P.CRITICAL}
        when {outside(P.ERROR_WORD)} and not {d.match(t, P.ZERO_ERRORS)} then {P.ERROR}
        when {holds(d, P.PYTHON_EXCEPTION, t, low)} or {outside(P.FAIL_WORD)} or {holds_any(d, P.ERROR_PLAIN, t, low)} or {outside(P.COMPILE_ERROR)} then {P.ERROR}
        when {holds(d, P.RUST_NOTE, t, low)} then {P.WARNING}
        when {holds_any(d, P.PARSE_ERROR, t, low)} then {P.ERROR}
        when {' or '.join(map(outside, P.WARNING_WORDS))} then {P.WARNING}
        when {holds(d, P.VERBOSE, t, low)} or {d.match(t, P.PROGRESS)} then {P.DEBUG}
        when {d.match(t, P.TIMESTAMP_ONLY)} and {d.octets(after)} < 3 then {P.DEBUG}
        else {P.INFO} end"""


def classified(d: Dialect, src: str, keep: str = "") -> str:
    """(doc, pos, line, t, level) of a line relation (P-04), and the columns `keep` of it."""
    keep = f", {keep}" if keep else ""
    trimmed = f"(select doc, pos, line, t, {d.lower('t')} as low{keep} from (select doc, pos, line, {d.trim('line')} as t{keep} from {src}) c0)"
    return f"(select doc, pos, line, t, cast({level(d, 'line', 't', 'low')} as int) as level{keep} from {trimmed} c1)"


#: The same of failure anchors; those in either case are looked for in lower case and leave out i, whose other form isn't lowered.
ANCHOR_NEEDS = (
    "FAIL", "FAIL:", "FAILED", "●", "failed", "led", "Error:", ("Error:", "Exception:"),
    "panic:", "fatal:", "Traceback (most", "error", "error[E", "BUILD FAILED", "error:", "##[error]",
)


def failure_anchor(d: Dialect, x: str) -> str:
    if d.name == "duckdb":
        return d.any_of(P.FAILURE_ANCHORS, x)
    tests = []
    for p, needs in zip(P.FAILURE_ANCHORS, ANCHOR_NEEDS):
        low = d.lower(x) if p.startswith("(?i)") else x
        tests.append(f"({' or '.join(d.contains(low, d.lit(n)) for n in ([needs] if isinstance(needs, str) else needs))}) and {d.match(x, p)}")
    return "(" + " or ".join(tests) + ")"


def summary_anchor(d: Dialect, x: str) -> str:
    return d.any_of([p for p, _ in P.RUNNER_ANCHORS], x)


def runner_verdict(d: Dialect, x: str) -> str:
    """PASS, FAIL or null of a line: the first runner anchor that yields a verdict (P-08)."""
    failed = f"coalesce({d.extract(x, P.FAILED_COUNT, 1)}, '')"
    read = {
        "count": f"case when {failed} not in ('', '0') then 'FAIL' else 'PASS' end",
        "pytest": f"case when {d.match(x, P.FAILED_COUNT)} then 'FAIL' when {d.contains(x, d.lit('passed'))} then 'PASS' end",
        "cargo": f"case when {d.match(x, P.CARGO_FULL)} then case when {d.extract(x, P.CARGO_FULL, 1)} = 'ok' and {d.extract(x, P.CARGO_FULL, 2)} = '0' then 'PASS' else 'FAIL' end when {d.contains(x, d.lit('test result: ok'))} then 'PASS' else 'FAIL' end",
        "FAIL": "'FAIL'",
        "PASS": "'PASS'",
    }
    return "coalesce(" + ", ".join(f"case when {d.match(x, p)} then {read[k]} end" for p, k in P.RUNNER_ANCHORS if k != "none") + ")"


def by_extension(d: Dialect, table: dict[str, tuple[str, ...]], ext: str, x: str) -> str:
    """Whether a line matches one of its language's patterns; languages without patterns match nothing (P-16, P-17)."""
    return f"case {d.lower(ext)} " + " ".join(f"when {d.lit(k)} then {d.any_of(v, x)}" for k, v in table.items()) + " else false end"
