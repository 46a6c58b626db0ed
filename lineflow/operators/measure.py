"""Measurement analytics (A-05 to A-07, A-11 to A-17, J-02, J-03, T-05, T-06, T-11, DT-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineflow.functions import patterns as P
from lineflow.functions import text as T
from lineflow.functions.dialect import Dialect, Spark
from lineflow.operators import classify, contain
from lineflow.operators.generic import LAST
from lineflow.session import query_over

HOUR = 3_600_000_000


def in_period(d: Dialect, us: str, period: str, now_us: int) -> str:
    """Entries of today, the last 7 or 30 days, or all, against a given `now` in microseconds, UTC (DT-01)."""
    start = {"today": now_us - now_us % (24 * HOUR), "7d": now_us - 7 * 24 * HOUR, "30d": now_us - 30 * 24 * HOUR}.get(period)
    return f"{us} >= {start}" if start is not None else "true"


def report(d: Dialect, src: str) -> str:
    """(level, name, ...): totals, by command type and by session in one aggregation; a blank key is `unknown` (A-05)."""
    rows = f"(select *, case when cmd_type = '' then 'unknown' else cmd_type end as ct, case when session = '' then 'unknown' else session end as sid from {src})"
    return f"""(select case when grouping(ct) = 0 then 'type' when grouping(sid) = 0 then 'session' else 'total' end as level, coalesce(ct, sid, '') as name, cast(count(*) as bigint) as invocations,
        {d.int_sum('raw_tokens')} as raw_tokens, {d.int_sum('clean_tokens')} as clean_tokens, {d.int_sum('raw_tokens - clean_tokens')} as saved, {d.int_sum('case when rerequest then 1 else 0 end')} as rerequests,
        round({d.double(d.int_sum('raw_tokens - clean_tokens'))} / {d.double(d.int_sum('raw_tokens'))} * 100, 6) as reduction, round({d.double(d.int_sum('case when rerequest then 1 else 0 end'))} / {d.double('count(*)')} * 100, 6) as rerequest_rate,
        round(avg(quality), 6) as quality from {rows} m group by grouping sets ((), (ct), (sid)))"""


def _cells(d: Dialect, src: str) -> str:
    """Rows of the report that a table prints: the total, every type, and all sessions as one; with the rule that fits.

    One pass over the source: whatever is printed comes from these rows.
    """
    whole = lambda x: f"cast(cast(round({x}, 0) as bigint) as varchar(20))"
    count = lambda x: f"cast({x} as varchar(20))"
    again, deep = "level = 'type' and invocations >= 3 and rerequest_rate > 10", "level = 'type' and reduction > 90 and rerequests > 0 and invocations >= 3"
    often, well = "level = 'total' and invocations >= 10 and rerequest_rate > 15", "level = 'total' and invocations >= 10 and rerequests = 0 and reduction > 50"
    one = ", ".join(f"max({c}) as {c}" for c in ("invocations", "raw_tokens", "clean_tokens", "saved", "rerequests", "reduction", "rerequest_rate", "quality"))
    rows = f"(select level, case when level = 'session' then '' else name end as name, cast(count(*) as bigint) as members, {one} from {report(d, src)} k0 group by level, case when level = 'session' then '' else name end)"
    return f"""(select *, case when {again} or {often} then 'warning' when {deep} or {well} then 'info' end as tip,
        case when {again} then concat(name, ' has ', {whole('rerequest_rate')}, '% re-request rate (', {count('rerequests')}, '/', {count('invocations')}, ') — consider increasing truncation limit: [truncation] ', name, ' = <higher value>')
            when {deep} then concat(name, ' has ', {whole('reduction')}, '% reduction with ', {count('rerequests')}, ' re-request(s) — aggressive filtering may be removing useful content')
            when {often} then concat('Overall re-request rate is ', {whole('rerequest_rate')}, '% — consider switching to a less aggressive profile or mode')
            when {well} then concat('No re-requests detected with ', {whole('reduction')}, '% avg reduction — filtering quality is excellent') end as message from {rows} k1)"""


def insights(d: Dialect, src: str) -> str:
    """Rules over the report (A-06, J-12): frequent re-requests, high reduction with re-requests, overall rate, all well."""
    return f"(select tip as level, name as command, message from {_cells(d, src)} i0 where tip is not null)"


def clock(d: Dialect, us: str) -> str:
    """HH:MM of an instant in microseconds, UTC (DT-02)."""
    minute = d.div(us, "60000000")
    return f"concat(lpad(cast({d.div(minute, '60')} % 24 as varchar(20)), 2, '0'), ':', lpad(cast({minute} % 60 as varchar(20)), 2, '0'))"


def printed(d: Dialect, src: str, columns: str, nth: str) -> str:
    """(nth, line): the texts of the column `texts` of src, those that are null left out; `nth` may use `columns` and the
    place of a text, `spot`."""
    return f"(select cast({nth} as bigint) as nth, line from {d.explode(src, columns, 'texts', 'spot')} p0 where line is not null)"


def report_lines(d: Dialect, src: str, period: str, name: str = "Lineflow") -> str:
    """(nth, line): the report as a printed table, types in order of name (K-06)."""
    number = lambda label, x: d.printf("%-19s %d", d.lit(label), x)
    percent = lambda label, x: d.printf("%-19s %.1f%%", d.lit(label), d.double(f"coalesce({x}, 0)"))
    again = d.printf("%-19s %d (%.1f%% of invocations)", d.lit("Re-requests:"), "rerequests", d.double("coalesce(rerequest_rate, 0)"))
    head = [d.lit(f"{name} Measurement Report — {period}"), d.lit("=" * 50), "''", number("Total invocations:", "invocations"), number("Total raw tokens:", "coalesce(raw_tokens, 0)"), number("Total clean tokens:", "coalesce(clean_tokens, 0)"), number("Total tokens saved:", "coalesce(saved, 0)"), percent("Avg reduction:", "reduction"), percent("Avg quality score:", "quality"), f"case when rerequests > 0 then {again} end"]
    head += ["''", d.lit("By command type:"), d.printf("  %-12s %6s %10s %10s %8s %6s", *map(d.lit, ("TYPE", "COUNT", "RAW TOK", "SAVED", "REDUC", "RE-REQ"))), d.lit("  " + "-" * 58)]
    dash = "case when rerequests > 0 then cast(rerequests as varchar(20)) else '-' end"
    line = d.printf("  %-12s %6d %10d %10d %7.1f%% %6s", "name", "invocations", "coalesce(raw_tokens, 0)", "coalesce(saved, 0)", d.double("coalesce(reduction, 0)"), dash)
    tip = "concat(case when tip = 'info' then '  [i] ' else '  [!] ' end, message)"
    body = f"case level when 'total' then {d.array(*head)} when 'type' then {d.array(line)} else {d.array(chr(39) * 2, 'concat(' + d.lit('Sessions: ') + ', cast(members as varchar(20)))')} end"
    tips = f"case when tip is not null then {d.array('case when j = 1 then ' + chr(39) * 2 + ' end', 'case when j = 1 then ' + d.lit('Quality Insights:') + ' end', tip)} end"
    cells = f"(select *, row_number() over (partition by level order by name) as i, row_number() over (order by case when tip is null then 1 else 0 end, tip desc, message) as j from {_cells(d, src)} c0)"
    parts = f"(select level, i, j, 0 as part, {body} as texts from {cells} c1 union all select level, i, j, 1 as part, {tips} as texts from {cells} c2 where tip is not null)"
    return printed(d, f"{parts} c3", "level, i, j, part", f"case when part = 1 then {LAST} + 7 + 3 * j + spot when level = 'total' then spot when level = 'type' then 100 + i else {LAST} + spot end")


def last_lines(d: Dialect, src: str, n: int, name: str = "Lineflow") -> str:
    """(nth, line): the last n entries of (id, us, command, raw_tokens, clean_tokens, quality, rerequest) as a printed table
    with their totals (K-06, T-05)."""
    newest = f"(select *, raw_tokens - clean_tokens as saved, case when rerequest then ' [RE]' else '' end as tag, row_number() over (order by us, id) as i from (select * from {src} order by us desc, id desc limit {n}) z0)"
    sums = [f"sum({x}) over ()" for x in ("raw_tokens", "clean_tokens", "saved")]
    entries = f"(select *, cast(count(*) over () as bigint) as n, cast({sums[0]} as bigint) as raw, cast({sums[1]} as bigint) as clean, cast({sums[2]} as bigint) as gain from {newest} z1)"
    rate = lambda raw, saved: f"case when {raw} > 0 then {d.double(saved)} / {d.double(raw)} * 100 else {d.double('0')} end"
    room = "(28 - length(tag))"
    command = f"concat(case when length(command) > {room} then concat(substr(command, 1, cast({room} - 3 as int)), '...') else command end, tag)"
    form = "  %-4s %-5s  %-28s %7d %7d %7d %5.1f%%"
    line = d.printf(form + " %6.1f%%", "cast(i as varchar(20))", clock(d, "us"), command, "raw_tokens", "clean_tokens", "saved", rate("raw_tokens", "saved"), d.double("quality"))
    total = d.printf(form, "''", "''", "'TOTAL'", "raw", "clean", "gain", rate("raw", "gain"))
    head = [f"concat({d.lit(f'{name} — Last ')}, cast(n as varchar(20)), ' invocations')", d.lit("=" * 78), "''", d.printf("  %-4s %-5s  %-28s %7s %7s %7s %6s %7s", *map(d.lit, ("#", "TIME", "COMMAND", "RAW", "CLEAN", "SAVED", "REDUC", "QUAL"))), d.lit("  " + "-" * 74)]
    texts = [f"case when i = 1 then {x} end" for x in head] + [f"case when i is null then 'No measurement entries found.' else {line} end", f"case when i = n then {d.lit('  ' + '-' * 74)} end", f"case when i = n then {total} end"]
    rows = f"(select i, {d.array(*texts)} as texts from (select 0 as one) z2 left join {entries} z3 on one = 0)"
    return printed(d, f"{rows} z4", "i", "coalesce(i, 0) * 10 + spot")


def session_summary(d: Dialect, src: str) -> str:
    """Per session: commands, bytes, whole percent saved, span of time (A-07)."""
    return f"(select session, cast(count(*) as bigint) as commands, {d.int_sum('raw_bytes')} as raw_bytes, {d.int_sum('raw_bytes - clean_bytes')} as saved_bytes, cast({d.div('sum(raw_bytes - clean_bytes) * 100', 'sum(raw_bytes)')} as bigint) as pct, cast(max(us) - min(us) as bigint) as span_us from {src} where session <> '' group by session)"


def last_entries(d: Dialect, src: str, n: int) -> str:
    """The newest n entries, oldest first from 1, and their totals as entry 0 (T-05)."""
    newest = f"(select * from {src} order by us desc, id desc limit {n})"
    saved = d.double("sum(raw_tokens - clean_tokens)")
    rate = lambda a, b: f"round(case when {b} > 0 then {a} / {d.double(b)} * 100 else {d.double('0')} end, 6)"
    return f"""(select cast(row_number() over (order by us, id) as bigint) as nth, cast(id as bigint) as id, session, cmd_type, cast(raw_tokens as bigint) as raw_tokens, cast(clean_tokens as bigint) as clean_tokens, {rate(d.double('(raw_tokens - clean_tokens)'), 'raw_tokens')} as reduction from {newest} z0
        union all select cast(0 as bigint), cast(null as bigint), '', 'TOTAL', {d.int_sum('raw_tokens')}, {d.int_sum('clean_tokens')}, {rate(saved, 'sum(raw_tokens)')} from {newest} z1 having count(*) > 0)"""


def newest_half(d: Dialect, src: str, step: int = HOUR) -> str:
    """What a log keeps when it rotates: the newer half by count (K-02, K-03, T-11).

    Counts by `step` microseconds, few however long the log, say which step holds the cut; only that step is ranked.
    """
    counts = f"(select {d.div('us', str(step))} as h, cast(count(*) as bigint) as c from {src} group by {d.div('us', str(step))})"
    ranks = f"(select h, c, sum(c) over (order by h) as upto, sum(c) over () as n from {counts} q0)"
    cut = f"(select h as cut_h, {d.div('n', '2')} - (upto - c) as gone from {ranks} q1 where upto > {d.div('n', '2')} and upto - c <= {d.div('n', '2')})"
    inside = f"(select s.id, s.us, row_number() over (partition by {d.div('s.us', str(step))} order by s.us, s.id) as i, gone from {src.rsplit(' ', 1)[0]} s join {cut} k on {d.div('s.us', str(step))} = k.cut_h)"
    return f"""(select s.id, s.us from {src.rsplit(' ', 1)[0]} s join {cut} k on {d.div('s.us', str(step))} > k.cut_h union all
        select id, us from {inside} q2 where i > gone)"""


def limits(d: Dialect, src: str, overrides: dict[str, int], default: int) -> str:
    """Per-command line limit, else the default (J-02)."""
    table = " union all ".join(f"select {d.lit(k)} as cmd, cast({v} as bigint) as most" for k, v in overrides.items())
    return f"(select s.*, coalesce(o.most, {default}) as max_lines from {src} s left join ({table}) o on s.cmd_type = o.cmd)"


def marker_credit(d: Dialect, x: str) -> str:
    """Lines that count markers in a clean text stand for (A-12)."""
    one = lambda p: d.int_sum("1") and f"{_sum(d, d.transform(d.all(x, p, 1), 'n', 'cast(n as bigint)'))}"
    return "(" + " + ".join(one(p) for p in P.QUALITY_CREDIT) + ")"


def _sum(d: Dialect, array: str) -> str:
    return f"aggregate({array}, cast(0 as bigint), (a, b) -> a + b)" if d.name == "spark" else f"coalesce(list_sum({array}), 0)::bigint"


def quality_lines(d: Dialect, raw: str) -> str:
    """(doc, whole, core, safe) of the Warning+ lines of raw (doc, pos, line)."""
    return f"(select doc, t as whole, {T.core(d, 't')} as core, {d.match('t', P.DROP_SAFE)} as safe from {classify.classified(d, raw)} l where level >= {P.WARNING})"


def bench_lines(d: Dialect, raw: str) -> str:
    """The same of lines without escape codes."""
    lines = f"(select doc, {d.trim(T.strip_ansi(d, 't'))} as n, level from {classify.classified(d, raw)} b0)"
    return f"(select doc, n as whole, {T.core(d, 'n')} as core, {d.match('n', P.DROP_SAFE)} as safe from {lines} b1 where level >= {P.WARNING})"


def still_there(d: Dialect, lines: str, clean: str) -> str:
    """(doc, kept): whether the clean text (doc, text) has a line whole or its core, or needn't have it."""
    return f"(select l.doc, {d.contains('c.text', 'whole')} or (core <> '' and {d.contains('c.text', 'core')}) or safe as kept from {lines} l join {clean} c on l.doc = c.doc)"


def _credited(d: Dialect, kept: str, clean: str, text: str) -> str:
    counts = f"(select doc, cast(count(*) as bigint) as important, {d.int_sum('case when kept then 1 else 0 end')} as kept from {kept} q0 group by doc)"
    return f"(select c.doc, coalesce(important, 0) as important, coalesce(kept, 0) as kept, {marker_credit(d, text)} as credit from {clean} c left join {counts} n on c.doc = n.doc)"


def quality(d: Dialect, raw: str, clean: str, kept: str = "") -> str:
    """(doc, important, preserved, score): share of Warning+ lines of raw (doc, pos, line) that clean (doc, text) still has,
    whole or as core content, with credit for droppable noise and for count markers (A-11, J-08).

    `kept` is still_there() from elsewhere, such as `contained`, which is linear in a document.
    """
    credit = _credited(d, kept or still_there(d, quality_lines(d, raw), clean), clean, "c.text")
    return f"(select doc, important, least(kept + credit, important) as preserved, case when important = 0 then 100.0 else round({d.double('least(kept + credit, important)')} / {d.double('important')} * 100, 6) end as score from {credit} q1)"


def bare_text(d: Dialect, clean: str) -> str:
    return f"(select doc, {T.strip_ansi(d, 'text')} as text from {clean})"


def bench_quality(d: Dialect, raw: str, clean: str, kept: str = "") -> str:
    """Like quality(), on lines without escape codes: contained in an output line, or their core in the whole (A-13)."""
    credit = _credited(d, kept or still_there(d, bench_lines(d, raw), bare_text(d, clean)), clean, "c.text")
    return f"(select doc, important, least(kept + credit, important) as preserved from {credit} b3)"


def contained(lines: DataFrame, clean: DataFrame) -> DataFrame:
    """still_there() over frames, in time linear in every document."""
    asked = lines.select("doc", "core", "safe", F.array("whole", F.when(F.col("core") != "", F.col("core"))).alias("needles"))
    return contain.held(asked, clean).select("doc", (F.col("held")[0] | F.coalesce(F.col("held")[1], F.lit(False)) | F.col("safe")).alias("kept"))


def quality_of(raw: DataFrame, clean: DataFrame, bench: bool = False) -> DataFrame:
    """quality(), or bench_quality(), of frames (doc, pos, line) and (doc, text)."""
    d = Spark()
    lines = query_over(lambda view: f"select * from {(bench_lines if bench else quality_lines)(d, view)} q", raw)
    text = query_over(lambda view: f"select * from {bare_text(d, view)} q", clean) if bench else clean
    return query_over(lambda view, kept: f"select * from {(bench_quality if bench else quality)(d, '', view, kept)} q", clean, contained(lines, text))


def parity(d: Dialect, base: str, candidate: str, per_item: float = 5, average: float = 5) -> str:
    """Two reports (name, reduction) side by side: drift, what is missing, what is over the limit (J-03)."""
    return f"""(select coalesce(b.name, c.name) as name, coalesce(b.reduction, 0.0) as base_reduction, coalesce(c.reduction, 0.0) as candidate_reduction,
        case when b.name is null or c.name is null then 0.0 else round(c.reduction - b.reduction, 6) end as drift, b.name is null as missing_in_base, c.name is null as missing_in_candidate,
        b.name is null or c.name is null or abs(c.reduction - b.reduction) > {per_item} as over_limit from {base} b full outer join {candidate} c on b.name = c.name)"""


def percentiles(d: Dialect, src: str, key: str, value: str, ps: tuple[int, ...] = (50, 95, 99)) -> str:
    """Nearest-rank percentiles: the sorted value at p * n / 100, cut, within range (A-17).

    Ranks come from running counts of distinct values, so that the rows themselves are neither sorted nor ranked.
    """
    counts = f"(select {key}, {value} as v, cast(count(*) as bigint) as c from {src} group by {key}, {value})"
    ranks = f"(select {key}, v, sum(c) over (partition by {key} order by v) as upto, sum(c) over (partition by {key}) as n from {counts} z0)"
    at = lambda p: f"min(case when upto > least({d.div(f'n * {p}', '100')}, n - 1) then v end)"
    return f"(select {key}, cast(max(n) as bigint) as n, min(v) as least_v, max(v) as most_v, {', '.join(f'{at(p)} as p{p}' for p in ps)} from {ranks} z group by {key})"
