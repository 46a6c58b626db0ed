"""Run summaries, verdicts and truncation (A-02 to A-04, T-01 to T-04, P-09, P-10)."""

from __future__ import annotations

from lineflow.functions import patterns as P
from lineflow.functions.dialect import Dialect
from lineflow.functions.text import thousands
from lineflow.operators import classify
from lineflow.operators.generic import LAST, PREVIOUS


def context_levels(d: Dialect, src: str) -> str:
    """Levels with console trailers, lone frames and bare console headers lowered to Info (P-09, P-10)."""
    frame, header = d.match("line", P.STACK_FRAME), d.match("line", P.CONSOLE_HEADER)
    banner = d.match("line", P.ERROR_BANNER)
    back = lambda x, n: f"max(case when {x} then pos end) over ({PREVIOUS} rows between {n} preceding and 1 preceding)"
    one = f"(select *, {frame} as frame, {header} as header, {banner} as banner from {classify.classified(d, src)} s0)"
    two = f"""(select *, coalesce(lag(frame) over ({PREVIOUS}), false) or coalesce(lead(frame) over ({PREVIOUS}), false) as beside,
        {back('header', 6)} as h6, {back('banner', 6)} as b6, {back('banner', 3)} as b3 from {one} s1)"""
    trailer = "(not beside and h6 is not null and (b6 is null or b6 < h6))"
    return f"(select doc, pos, line, t, case when header then {P.INFO} when level >= {P.ERROR} and frame and ({trailer} or (not beside and b3 is null)) then {P.INFO} else level end as level from {two} s2)"


def runner_result(d: Dialect, src: str) -> str:
    """(doc, verdict): FAIL if any runner total says so, else PASS if any does (A-04)."""
    return f"(select doc, case when {d.bool_or("v = 'FAIL'")} then 'FAIL' when {d.bool_or("v = 'PASS'")} then 'PASS' end as verdict from (select doc, {classify.runner_verdict(d, 'line')} as v from {src}) r0 group by doc)"


def resolved(d: Dialect, stdout: str, stderr: str, exit_code: str, fails: str, passes: str) -> str:
    """PASS, FAIL or unknown from the strongest signal: the runner's totals on stdout, those on stderr, the exit code, and
    where that is unknown (-1) what lines say (A-03)."""
    return f"case when {stdout} is not null then {stdout} when {stderr} is not null then {stderr} when {exit_code} = 0 then 'PASS' when {exit_code} > 0 then 'FAIL' when {fails} then 'FAIL' when {passes} then 'PASS' else 'unknown' end"


def _runner(d: Dialect) -> str:
    return f"case when {d.bool_or("v = 'FAIL'")} then 'FAIL' when {d.bool_or("v = 'PASS'")} then 'PASS' end"


def summary(d: Dialect, src: str, exit_code: str = "-1", threshold: int = 100, stderr: str = "") -> str:
    """One row per document of `threshold` lines or more: counts, first lines and verdict (A-02, A-03), in one aggregation.

    `stderr`, lines (doc, pos, line) of the other stream, only helps with the verdict.
    """
    exit_ = f"({exit_code})"
    one = f"(select *, {d.match('t', P.RESULT_FAIL)} as fails, {d.match('t', P.RESULT_PASS)} as passes, {classify.runner_verdict(d, 'line')} as v, case when level >= {P.ERROR} then 2 when level = {P.WARNING} then 1 else 0 end as class from {context_levels(d, src)} m0)"
    two = f"(select *, row_number() over (partition by doc, class order by pos) as nth from {one} m1)"
    first = lambda c, k: f"coalesce(max(case when class = {c} and nth = {k} then substr(t, 1, 120) end), '')"
    files = f"(select doc as fdoc, cast(count(distinct f) as bigint) as n_files from {d.explode('(select doc, ' + d.all('line', P.SUMMARY_PATH, 1) + ' as fs from ' + src + ') ' + ('e0' if d.name == 'duckdb' else ''), 'doc', 'fs', 'i', 'f')} e1 group by doc)"
    agg = f"""(select doc, cast(count(*) as bigint) as n_lines, {d.int_sum(d.octets('line') + ' + 1')} as n_bytes, {d.int_sum('case when class = 2 then 1 else 0 end')} as n_errors,
        {d.int_sum('case when class = 1 then 1 else 0 end')} as n_warnings, {first(2, 1)} as error_1, {first(2, 2)} as error_2, {first(2, 3)} as error_3, {first(1, 1)} as warning_1, {first(1, 2)} as warning_2,
        {_runner(d)} as stdout_says, {d.bool_or('fails')} as fails, {d.bool_or('passes')} as passes
        from {two} m2 group by doc having count(*) >= {threshold})"""
    other = f"(select doc as rdoc, {_runner(d)} as stderr_says from (select doc, {classify.runner_verdict(d, 'line')} as v from {stderr}) r0 group by doc)" if stderr else "(select cast(null as bigint) as rdoc, cast(null as varchar(9)) as stderr_says)"
    verdict = resolved(d, "stdout_says", "stderr_says", exit_, "fails", "passes")
    return f"(select a.doc, n_lines, n_bytes, n_errors, n_warnings, error_1, error_2, error_3, warning_1, warning_2, coalesce(n_files, 0) as n_files, {verdict} as verdict from {agg} a left join {files} f on a.doc = f.fdoc left join {other} r on a.doc = r.rdoc)"


def summary_header(d: Dialect, src: str, exit_code: str = "-1", name: str = "lineflow") -> str:
    """(doc, header): the block that goes before a summarised text, between lines that `name` it and with a blank line."""
    lf = d.lit("\n")
    line = lambda label, x: f"'  {label}', {x}, {lf}"
    quoted = lambda x: f"case when {x} <> '' then concat('   → ', {x}, {lf}) else '' end"
    errors = f"case when verdict = 'PASS' and n_errors > 0 then concat('  error-like lines: ', {thousands(d, 'n_errors')}, ' (run passed)', {lf}) else concat('  errors: ', {thousands(d, 'n_errors')}, {lf}) end"
    total = f"'  total: ', {thousands(d, 'n_lines')}, ' lines (', {thousands(d, 'n_bytes')}, ' bytes)', {lf}"
    files = f"case when n_files > 0 then concat('  files: ', {thousands(d, 'n_files')}, ' unique paths mentioned', {lf}) else '' end"
    return f"(select doc, concat({d.lit(f'[{name} summary]' + chr(10))}, {total}, {errors}, {quoted('error_1')}, {quoted('error_2')}, {quoted('error_3')}, {line('warnings: ', thousands(d, 'n_warnings'))}, {quoted('warning_1')}, {quoted('warning_2')}, {files}, {line('result: ', 'verdict')}, {d.lit(f'[/{name} summary]' + chr(10) * 2)}) as header from {summary(d, src, exit_code)} h)"


def _head(most: int) -> int:
    """Lines of the head: seven tenths, cut as a binary fraction is."""
    return int(most * 0.7)


#: What a failure does to a text that is too long: nothing, a hint at its end, its surroundings, all of it.
ESCALATIONS = ("off", "hint", "window", "conservative")


def _cut(d: Dialect, src: str, most: int, on_failure: str, window: int, cap: int, always: bool = False) -> str:
    """Every way of cutting long texts in one pass over windows of one partitioning.

    A text of more than `most` lines keeps its head and tail, its runner totals behind one marker.  Where it has a failure
    anchor (or `always`), `on_failure` says what else; its surroundings are `window` lines around every anchor, or around
    the first and the last one if there are more than two and more than `cap` times `most` lines would stay.
    """
    head = _head(most)
    whole = "over (partition by doc)"
    near = f"max(case when anchor then 1 else 0 end) over ({PREVIOUS} rows between {window} preceding and {window} following)"
    one = f"(select *, {near} as near, row_number() over ({PREVIOUS}) - 1 as i, count(*) {whole} as n, max(case when anchor then 1 else 0 end) {whole} as failed from (select doc, pos, line, {classify.failure_anchor(d, 'line')} as anchor, {classify.summary_anchor(d, 'line')} as pin from {src}) v0)"
    ends = f"(i < {head} or i >= n - {most - head})"
    two = f"(select *, sum(case when {ends} or near = 1 then 1 else 0 end) {whole} as kept, sum(case when anchor then 1 else 0 end) {whole} as anchors, min(case when anchor then i end) {whole} as a, max(case when anchor then i end) {whole} as b from {one} v1)"
    surroundings = f"(pin or {ends} or case when kept > {cap * most} and anchors > 2 then (i between a - {window} and a + {window}) or (i between b - {window} and b + {window}) else near = 1 end)"
    rule = "true" if always else "failed = 1"
    plain = f"(n <= {most} or {ends})"
    keep = {"off": plain, "hint": plain, "conservative": f"({plain} or {rule})", "window": f"case when {rule} then {'' if always else f'n <= {most} or '}{surroundings} else {plain} end"}[on_failure]
    in_place = rule if on_failure == "window" else "false"
    three = f"(select doc, pos, line, pin, n, failed, keep, {in_place} as in_place, sum(case when keep then 1 else 0 end) over ({PREVIOUS} rows between unbounded preceding and current row) as g, row_number() over (partition by doc order by pos desc) as back from (select *, {keep} as keep from {two} v2) v3)"
    gap = "partition by doc, g, keep"
    four = f"(select *, row_number() over ({gap} order by pos) as nth, count(*) over ({gap}) as gone, min(pos) over ({gap}) as first_pos, max(case when pin then 1 else 0 end) over ({gap}) as pins from {three} v4)"
    pinned = d.lit(" lines omitted; summary pinned below ...]")
    marker = f"concat({d.lit(chr(10) + '[... ')}, cast(gone as varchar(20)), case when pins = 1 and not in_place then {pinned} else {d.lit(' lines omitted ...]' + chr(10))} end)"
    hint = "failed = 1" if on_failure == "hint" else "false"
    texts = [f"case when keep then line when nth = 1 then {marker} end", "case when not keep and pin and not in_place then line end", f"case when {hint} and n > {most} and back = 1 then '[failures detected: rerun with a higher line limit for full context]' end"]
    place = f"case when k = 1 then at0 + 2 when k = 2 then {LAST} when first_row then 0 else 1 end"
    # Most lines stay alone, so most arrays have one text.
    several = f"not keep and pin or {hint} and back = 1"
    rows = d.explode(f"(select doc, pos as at0, first_pos, keep or in_place as first_row, case when {several} then {d.array(*texts)} else {d.array(texts[0])} end as texts from {four} v5)" + (" v6" if d.name == "duckdb" else ""), "doc, at0, first_pos, first_row", "texts", "k")
    return f"(select doc, case when k = 1 then first_pos else at0 end as pos, cast({place} as bigint) as sub, line from {rows} v7 where line is not null)"


def truncate(d: Dialect, src: str, most: int) -> str:
    """Head, one marker, pinned runner totals, tail (T-01); documents of up to `most` lines, and any if most <= 0, stay."""
    return _cut(d, src, most, "off", 0, 1) if most > 0 else f"(select doc, pos, cast(0 as bigint) as sub, line from {src})"


def window_truncate(d: Dialect, src: str, most: int, window: int = 10, cap: int = 2) -> str:
    """Head, tail and `window` lines around every failure anchor; with more than two anchors and too much kept, only the
    first and the last anchor's; runner totals always; a marker for each gap (T-03, J-06)."""
    return _cut(d, src, most, "window", window, cap, always=True)


def escalate(d: Dialect, src: str, most: int, mode: str = "window", window: int = 10) -> str:
    """Truncation that reacts to failures (T-02): off, hint, window or conservative; other names mean window."""
    mode = {"none": "off", "disabled": "off", "full": "conservative"}.get(mode.lower(), mode.lower())
    return _cut(d, src, most, mode if mode in ESCALATIONS else "window", window, 2) if most > 0 else truncate(d, src, most)
