"""Printed tables and their JSON forms over the report relations (K-06): (nth, line) or one (json).

A table is one pass over its relation: every row carries the texts that it stands for, the first and the last row also what
comes before and after, and `measure.printed` lays them out.  Relations have a row per item, step or mode, never per line.
"""

from __future__ import annotations

from collections.abc import Sequence

from lineflow.functions import text as T
from lineflow.functions.dialect import Dialect
from lineflow.operators.measure import printed


def _framed(d: Dialect, src: str, order: str, head: Sequence[str], body: Sequence[str], foot: Sequence[str], columns: str = "") -> str:
    """Head texts before the first row of src in `order`, body texts of every row, foot texts after the last; texts may be
    null, and may use window sums, which `columns` adds."""
    extra = f", {columns}" if columns else ""
    rows = f"(select *, row_number() over (order by {order}) as i, count(*) over () as rows_{extra} from {src})"
    texts = d.array(*[f"case when i = 1 then {x} end" for x in head], *body, *[f"case when i = rows_ then {x} end" for x in foot])
    return printed(d, f"(select i, {texts} as texts from {rows} f0) f1", "i", "i * 1000 + spot")


def _json(d: Dialect, src: str, order: str, head: Sequence[tuple[str, str]], name: str, row: Sequence[tuple[str, str]], columns: str = "") -> str:
    """(json): an object of `head` fields, which may use window sums, and an array of an object per row under `name`."""
    pair = lambda k, x, pad: f"concat({d.lit(' ' * pad + chr(34) + k + chr(34) + ': ')}, {x})"
    lines = lambda pairs, pad: d.join(d.array(*[pair(k, x, pad) for k, x in pairs]), ",\n")
    extra = f", {columns}" if columns else ""
    rows = f"(select *, row_number() over (order by {order}) as i{extra} from {src})"
    each = f"(select i, concat({d.lit('    {' + chr(10))}, {lines(row, 6)}, {d.lit(chr(10) + '    }')}) as item, {lines(head, 2)} as head from {rows} h0)"
    return f"(select concat({d.lit('{' + chr(10))}, max(head), {d.lit(',' + chr(10) + '  ' + chr(34) + name + chr(34) + ': [' + chr(10))}, {d.agg_join('item', 'i', ',' + chr(10))}, {d.lit(chr(10) + '  ]' + chr(10) + '}' + chr(10))}) as json from {each} h1 having count(*) > 0)"


def string(d: Dialect, x: str) -> str:
    return f"concat({d.lit(chr(34))}, {d.replace(d.replace(x, chr(92), chr(92) * 2), chr(34), chr(92) + chr(34))}, {d.lit(chr(34))})"


def whole(d: Dialect, x: str) -> str:
    return f"cast({x} as varchar(20))"


def hundredth(d: Dialect, x: str) -> str:
    return d.printf("%.2f", d.double(x))


def truth(x: str) -> str:
    return f"case when {x} then 'true' else 'false' end"


def spent(d: Dialect, us: str) -> str:
    """A duration in microseconds, or in milliseconds from 1000 on, with one decimal."""
    return f"case when {us} < 1000 then {d.printf('%.1fus', d.double(us))} else {d.printf('%.1fms', d.double(us) + ' / 1000')} end"


#: Averages, and the drift that lies farthest from 0, over all rows of measure.parity().
_PARITY = """avg(case when not missing_in_base then base_reduction end) over () as base_avg, avg(case when not missing_in_candidate then candidate_reduction end) over () as candidate_avg,
    max(drift) over () as most, min(drift) over () as least, max(case when over_limit then 1 else 0 end) over () as over_any"""
_DRIFT, _MOST = "(coalesce(candidate_avg, 0) - coalesce(base_avg, 0))", "case when -least > most then least else most end"
_PARITY_ORDER = "abs(drift) desc, name"


def parity_table(d: Dialect, src: str, base: str = "baseline", candidate: str = "candidate", per_item: float = 5, average: float = 5) -> str:
    """measure.parity() as a table, the largest drifts first."""
    good = f"over_any = 0 and abs({_DRIFT}) <= {average}"
    head = [
        d.lit(f"Bench parity: {base} vs {candidate}"), d.lit(f"  thresholds: per-fixture {per_item:.1f}pp, total-avg {average:.1f}pp"),
        d.printf(f"  {base} avg: %.2f%%   {candidate} avg: %.2f%%   drift: %+.2fpp", d.double("coalesce(base_avg, 0)"), d.double("coalesce(candidate_avg, 0)"), d.double(_DRIFT)),
        d.printf("  max per-fixture drift: %+.2fpp", d.double(_MOST)), f"case when {good} then '  status: PASS' else '  status: FAIL' end", "''", d.printf("%-28s %10s %10s %10s", *map(d.lit, ("Fixture", base, candidate, "Drift"))),
    ]
    mark = "case when over_limit then '! ' else '  ' end"
    a, b = d.double("base_reduction"), d.double("candidate_reduction")
    row = f"""case when missing_in_base then {d.printf('%s%-26s %10s %10.2f %10s', mark, 'name', "'-'", b, "'missing'")} when missing_in_candidate then {d.printf('%s%-26s %10.2f %10s %10s', mark, 'name', a, "'-'", "'missing'")}
        else {d.printf('%s%-26s %10.2f %10.2f %+10.2f', mark, 'name', a, b, d.double('drift'))} end"""
    return _framed(d, src, _PARITY_ORDER, head, [row], [], _PARITY)


def parity_json(d: Dialect, src: str, base: str = "baseline", candidate: str = "candidate", per_item: float = 5, average: float = 5) -> str:
    good = f"over_any = 0 and abs({_DRIFT}) <= {average}"
    numbers = (("baseline_avg", "coalesce(base_avg, 0)"), ("candidate_avg", "coalesce(candidate_avg, 0)"), ("avg_drift", _DRIFT), ("max_drift", _MOST))
    head = [("baseline_label", d.lit(f'"{base}"')), ("candidate_label", d.lit(f'"{candidate}"')), *[(k, hundredth(d, x)) for k, x in numbers], ("per_fixture_limit", d.lit(f"{per_item:.2f}")), ("avg_limit", d.lit(f"{average:.2f}")), ("pass", truth(good))]
    row = [("name", string(d, "name")), ("baseline_reduction", hundredth(d, "base_reduction")), ("candidate_reduction", hundredth(d, "candidate_reduction")), ("drift", hundredth(d, "drift")), ("over_threshold", truth("over_limit")), ("missing_in_baseline", truth("missing_in_base")), ("missing_in_candidate", truth("missing_in_candidate"))]
    return _json(d, src, _PARITY_ORDER, head, "results", row, _PARITY)


_QUALITY = "sum(important) over () as all_important, sum(preserved) over () as all_preserved, min(score) over () as worst"
_OVERALL = "case when all_important = 0 then 100.0 else all_preserved * 100.0 / all_important end"


def quality_table(d: Dialect, src: str) -> str:
    """(name, important, preserved, score) as a table with its total."""
    head = ["'Quality Score Report'", d.lit("=" * 20), "''", d.printf("%-24s %10s %10s %10s", *map(d.lit, ("Fixture", "Important", "Preserved", "Score")))]
    row = d.printf("%-24s %10d %10d %9.1f%%%s", "name", "important", "preserved", d.double("score"), "case when score < 100 then ' <!>' else '' end")
    total = d.printf("%-24s %10d %10d %9.1f%%", "'Total'", "cast(all_important as bigint)", "cast(all_preserved as bigint)", d.double(_OVERALL))
    return _framed(d, src, "name", head, [row], ["''", total], _QUALITY)


def quality_json(d: Dialect, src: str) -> str:
    head = [("total_important", whole(d, "cast(all_important as bigint)")), ("total_preserved", whole(d, "cast(all_preserved as bigint)")), ("overall_score", hundredth(d, _OVERALL)), ("all_perfect", truth("worst >= 100"))]
    row = [("name", string(d, "name")), ("important_lines", whole(d, "important")), ("preserved_lines", whole(d, "preserved")), ("score", hundredth(d, "score"))]
    return _json(d, src, "name", head, "results", row, _QUALITY)


def _reduction(d: Dialect) -> str:
    return f"case when bytes_before > 0 then {d.double('bytes_before - bytes_after')} / {d.double('bytes_before')} * 100 else {d.double('0')} end"


def steps_table(d: Dialect, src: str, name: str) -> str:
    """(nth, step, bytes_before, bytes_after, us) as a table of what each step takes away."""
    head = [d.lit(f"Per-Filter Contribution ({name} input)"), d.lit("=" * (50 + len(name))), "''", d.printf("%-24s %10s %10s %10s %10s", *map(d.lit, ("Filter", "Before", "After", "Reduction", "Time")))]
    return _framed(d, src, "nth", head, [d.printf("%-24s %10s %10s %9.1f%% %10s", "step", T.thousands(d, "bytes_before"), T.thousands(d, "bytes_after"), f"-({_reduction(d)})", spent(d, "us"))], [])


def steps_json(d: Dialect, src: str, name: str) -> str:
    row = [("name", string(d, "step")), ("bytes_before", whole(d, "bytes_before")), ("bytes_after", whole(d, "bytes_after")), ("reduction", hundredth(d, _reduction(d))), ("duration_us", whole(d, "us"))]
    return _json(d, src, "nth", [("fixture", d.lit(f'"{name}"'))], "filters", row)


_LATENCY = ("min_us", "max_us", "mean_us", "p50_us", "p95_us", "p99_us")


def latency_table(d: Dialect, src: str) -> str:
    """One row (iterations, bytes, min_us, max_us, mean_us, p50_us, p95_us, p99_us) as a table."""
    body = ["'Latency Report'", d.lit("=" * 14), "''", f"concat('  Iterations: ', {whole(d, 'iterations')})", f"concat('  Input size: ', {T.thousands(d, 'bytes')}, ' bytes')"]
    body += [d.printf("  %-11s %s", d.lit(f"{c.removesuffix('_us').capitalize()}:"), spent(d, c)) for c in _LATENCY]
    return _framed(d, src, "iterations", [], body, [])


def latency_json(d: Dialect, src: str) -> str:
    fields = [("iterations", whole(d, "iterations")), ("input_bytes", whole(d, "bytes")), *[(c, whole(d, c)) for c in _LATENCY]]
    body = d.join(d.array(*[f"concat({d.lit('  ' + chr(34) + k + chr(34) + ': ')}, {x})" for k, x in fields]), ",\n")
    return f"(select concat({d.lit('{' + chr(10))}, {body}, {d.lit(chr(10) + '}' + chr(10))}) as json from {src})"


def modes_table(d: Dialect, src: str, name: str = "Lineflow") -> str:
    """(mode, raw_tokens, clean_tokens, reduction, quality), by mode, as the summary of a comparison."""
    head = [d.lit(f"{name} A/B Test — Mode Comparison"), d.lit("=" * 78), "''", d.printf("  %-16s %10s %10s %10s %7s %7s", *map(d.lit, ("MODE", "RAW TOK", "CLEAN TOK", "SAVED", "REDUC", "QUAL"))), d.lit("  " + "-" * 64)]
    row = d.printf("  %-16s %10d %10d %10d %6.1f%% %6.1f%%", "mode", "raw_tokens", "clean_tokens", "raw_tokens - clean_tokens", d.double("reduction"), d.double("quality"))
    return _framed(d, src, "mode", head, [row], [])


def modes_json(d: Dialect, src: str) -> str:
    row = [("mode", string(d, "mode")), ("total_raw_tokens", whole(d, "raw_tokens")), ("total_clean_tokens", whole(d, "clean_tokens")), ("total_saved", whole(d, "raw_tokens - clean_tokens")), ("avg_reduction", hundredth(d, "reduction")), ("avg_quality", hundredth(d, "quality"))]
    return _json(d, src, "mode", [("modes", whole(d, "cast(count(*) over () as bigint)"))], "summary", row)


def suggestions_table(d: Dialect, candidates: str, stats: str, name: str = "lineflow") -> str:
    """learn.analyse() and learn.statistics() as printed suggestions with the lines to put into the settings."""
    rows = f"(select s.n as total, s.sessions, c.norm, c.pattern, c.n as hits, c.frequency, c.noise_score, c.commands, row_number() over (order by c.n desc, c.norm) as k from {stats} s left join {candidates} c on true)"
    quoted = lambda x: f"concat({d.lit(chr(34))}, {d.replace(d.replace(x, chr(92), chr(92) * 2), chr(34), chr(92) + chr(34))}, {d.lit(chr(34))})"
    short = f"case when {d.chars('norm')} > 60 then concat(substr(norm, 1, 60), '...') else norm end"
    head = [f"concat('{name} learn: analyzed ', {whole(d, 'total')}, ' lines from ', {whole(d, 'sessions')}, ' sessions')", "''", "case when norm is null then 'No noise patterns detected. Your output is already clean!' else 'Suggested patterns for always_remove:' end", "case when norm is not null then '' end"]
    some = lambda x: f"case when norm is not null then {x} end"
    frequency = d.printf("     Frequency: %.0f%% (%d lines), Noise confidence: %.0f%%", d.double("frequency * 100"), "hits", d.double("noise_score * 100"))
    body = [some(f"concat('  ', {whole(d, 'i')}, '. ', {short})"), some("concat('     Pattern:   ', pattern)"), some(frequency), some(f"concat('     Commands:  ', {d.replace('commands', ',', ', ')})"), some("''")]
    add = d.agg_join("line", "k", "\n")
    patterns = f"(select k, concat('  ', {quoted('pattern')}, ',') as line from {rows} g0 where norm is not null)"
    listed = f"(select cast(1000000000 as bigint) as nth, concat('Add to .{name}.toml:', {d.lit(chr(10) * 2)}, '[rules]', {d.lit(chr(10))}, 'always_remove = [', {d.lit(chr(10))}, {add}, {d.lit(chr(10) + ']')}) as line from {patterns} g1 having count(*) > 0)"
    return f"(select nth, line from {_framed(d, rows + ' g2', 'k', head, body, [])} g3 union all select nth, line from {listed} g4)"


def status_table(d: Dialect, stats: str, size: str = "0", name: str = "lineflow") -> str:
    """learn.statistics() as printed; `size` is the store's in bytes."""
    line = lambda label, x: f"case when n > 0 then concat({d.lit(f'  {label:<14}')}, {x}) end"
    when = lambda label, x: f"case when n > 0 and {x} is not null then concat({d.lit(f'  {label:<14}')}, cast({x} as varchar(40))) end"
    body = [f"case when n = 0 then '{name} learn: no observations collected yet.' else '{name} learn status:' end", f"case when n = 0 then {d.lit(f'Run {chr(39)}{name} learn run <command>{chr(39)} to start observing.')} end"]
    body += [line("Observations:", whole(d, "n")), line("Sessions:", whole(d, "sessions")), line("Commands:", whole(d, "commands")), line("Store size:", f"concat({whole(d, size)}, ' bytes')"), when("First entry:", "oldest"), when("Last entry:", "newest")]
    return printed(d, f"(select {d.array(*body)} as texts, 0 as i from {stats}) st1", "i", "spot")
