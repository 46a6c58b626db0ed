"""Command-specific operators (C-01 to C-19).

Most drop runs of noise and put counts in their place.  `counter_flush` does that for all of them: lines get a class
(KEEP, DROP, FLUSH: ends a run without a line of its own, or the number of a counter); a counter's lines between two kept
lines become marker lines before the later one.  Input (doc, pos, line), output (doc, pos, sub, line).
"""

from __future__ import annotations

from collections.abc import Sequence

from lineflow.functions.dialect import Dialect
from lineflow.operators import segmented
from lineflow.operators.generic import LAST, PREVIOUS, UPTO

KEEP, DROP, FLUSH = 0, -1, -2
BLANK = "t = ''"


def _n(d: Dialect, before: str, after: str, less: int = 0) -> str:
    return f"concat({d.lit(before)}, cast(n - {less} as varchar(20)), {d.lit(after)})"


def trimmed(d: Dialect, src: str, extra: str = "") -> str:
    return f"(select doc, pos, line, {d.trim('line')} as t{extra} from {src})"


def counter_flush(d: Dialect, src: str, classes: Sequence[tuple[str, int]], markers: dict[int, list[tuple[str, str]]], keep: str = "line", size: int = 0, blanks: bool = False) -> str:
    """`classes` in order of test, first match wins, KEEP otherwise; `markers` maps a counter to (condition, text) pairs
    over n (lines) and first_line; counters flush in their numeric order.

    `size` cuts long documents into pieces of so many positions; `blanks` keeps blank lines that are dropped otherwise where
    they stand, inside the run.  A run's lines meet in one aggregation, markers come after its blanks and before what ended it.
    """
    which = " ".join(f"when {c} then {k}" for c, k in classes)
    base = f"(select *, case {which} else {KEEP} end as k from {trimmed(d, src)} c0)"
    ends = f"case when k in ({KEEP}, {FLUSH}) then 1 else 0 end"
    base = segmented.running(d, f"{base} c1", ends, "g", size) if size else f"(select *, sum({ends}) over ({UPTO}) as g from {base} c1)"
    # Only a kept line, a counter's run and, if wanted, a blank line make rows; a kept line has its g for itself.
    alone = f"case when k = {DROP} then pos else 0 end" if blanks else "cast(0 as bigint)"
    wanted = f"(k >= {KEEP} or (k = {DROP} and t = ''))" if blanks else f"k >= {KEEP}"
    one = f"(select doc, g, k, {alone} as spot, cast(count(*) as bigint) as n, {d.first_by('line', 'pos')} as first_line, {d.first_by('t', 'pos')} as t from {base} c2 where {wanted} group by doc, g, k, {alone})"
    parts = [(code, j, cond, text) for code, texts in markers.items() for j, (cond, text) in enumerate(texts)]
    counted = " ".join(f"when k = {code} and j = {j} and {cond} then {text}" for code, j, cond, text in parts)
    most = max((j for _, j, _, _ in parts), default=0)
    text = f"case when k <= {KEEP} and j = 0 then {keep.replace('line', 'first_line')} {counted} end"
    # Places: blanks by position, then counters, then the line that ended the run.
    place = f"case when k = {KEEP} then {LAST} when k = {DROP} then spot - {LAST} else k * 10 + j end"
    rows = f"(select doc, case when k = {KEEP} then g - 1 else g end as pos, {place} as sub, {text} as line from {d.explode(f'(select *, {d.upto(most)} as js from {one} c3)' + (' c4' if d.name == 'duckdb' else ''), 'doc, g, k, spot, n, first_line, t', 'js', 'jp', 'j')} c5)"
    return f"(select doc, cast(pos as bigint) as pos, cast(sub as bigint) as sub, line from {rows} c6 where line is not null)"


def grep(d: Dialect, src: str) -> str:
    """Matches grouped under `>> path` headers (C-01)."""
    at = d.instr("line", ":")
    path = f"substr(line, 1, cast({at} - 1 as int))"
    good = f"({at} > 1 and not {d.contains(path, d.lit(' '))} and ({d.contains(path, d.lit('.'))} or {d.contains(path, d.lit('/'))}))"
    rows = f"(select doc, pos, line, case when {good} then {path} else '' end as path, case when {good} then substr(line, cast({at} + 1 as int)) end as rest from {trimmed(d, src)} g0 where t <> '')"
    prev = f"(select *, coalesce(lag(path) over ({PREVIOUS}), '') as before from {rows} g1)"
    return f"""(select doc, pos, cast(k as bigint) as sub, case when k = 0 then '' when k = 1 then concat('>> ', path) when path = '' then line else concat('  ', rest) end as line
        from {prev} g2 cross join (select 0 as k union all select 1 as k union all select 2 as k) three
        where k = 2 or (path <> '' and path <> before and (k = 1 or before <> '')))"""


def find(d: Dialect, src: str) -> str:
    """Paths under their longest common directory, grouped by first segment in order of appearance (C-02)."""
    rows = f"(select doc, pos, t, {d.split('t', '/')} as seg from {trimmed(d, src)} f0 where t <> '')"
    folder = f"(select *, {d.slice('seg', 1, d.size('seg') + ' - 1')} as dir from {rows} f1)"
    # The common prefix of all directories is that of the least and the greatest.
    ends = f"(select doc, cast(count(*) as bigint) as n, min(dir) as a, max(dir) as b from {folder} f2 group by doc)"
    shared = d.filter(d.upto(f"least({d.size('a')}, {d.size('b')})"), "i", f"{d.join(d.slice('a', 1, 'i'), '/')} = {d.join(d.slice('b', 1, 'i'), '/')}")
    base = f"(select doc, n, lv, {d.join(d.slice('a', 1, 'lv'), '/')} as p from (select doc, n, a, {d.size(shared)} - 1 as lv from {ends} f3) f5)"
    joined = f"(select r.doc, r.pos, r.t, case when b.n >= 2 and {d.octets('b.p')} >= 3 then b.p else '' end as p, r.seg, b.lv as lv from {rows} r join {base} b on r.doc = b.doc)"
    rest = f"(select doc, pos, p, case when p = '' then t else {d.join(d.slice('seg', 'lv + 1', d.size('seg')), '/')} end as rest, case when p = '' then '' else {d.item('seg', 'cast(lv as int) + 1')} end as head from {joined} f6)"
    seen = f"(select *, min(pos) over (partition by doc, head) as first_seen, min(pos) over (partition by doc) as top from {rest} f7)"
    return f"""(select doc, case when p = '' then pos else first_seen end as pos, case when p = '' then cast(0 as bigint) else pos + 1 end as sub, rest as line from {seen} f8
        union all select doc, cast(-1 as bigint) as pos, cast(0 as bigint) as sub, concat('[base: ', p, '/]') as line from {seen} f9 where p <> '' and pos = top
        union all select doc, cast({LAST} as bigint) as pos, cast(0 as bigint) as sub, '' as line from {rows} fa group by doc having count(*) >= 2)"""


def git(d: Dialect, src: str) -> str:
    """Diffs without hash ranges, modes and similarity (C-03)."""
    drop = f"({d.starts('t', 'index ')} and {d.contains('t', d.lit('..'))}) or {d.starts('t', 'old mode')} or {d.starts('t', 'new mode')} or {d.starts('t', 'similarity index')}"
    return f"(select doc, pos, cast(0 as bigint) as sub, line from {trimmed(d, src)} c where not ({drop}))"


def go(d: Dialect, src: str) -> str:
    """Runs of passing packages as one line (C-04)."""
    fields = d.all("t", r"[^ \t\n\f\r]+")
    base = f"(select *, sum(case when ok then 0 else 1 end) over ({UPTO}) as g from (select *, {d.starts('t', 'ok')} as ok, {d.item(fields, 2)} as pkg from {trimmed(d, src)} c0) c1)"
    return f"""(select doc, cast(g - 1 as bigint) as pos, cast({LAST} as bigint) as sub, line from {base} b where not ok union all
        select doc, cast(g as bigint) as pos, cast(0 as bigint) as sub, concat('ok ', cast(count(*) as varchar(20)), ' packages: ', {d.agg_join('pkg', 'pos', ', ')}) as line from {base} b where ok and pkg is not null group by doc, g)"""


def ls(d: Dialect, src: str) -> str:
    """Long listings as permissions, size and name (C-05)."""
    f = d.all("t", r"[^ \t\n\f\r]+")
    long = f"{d.size('f')} >= 9 and {d.chars(d.item('f', 1))} >= 10 and {d.match(d.item('f', 1), '^[-dlcb]')}"
    short = f"concat({d.item('f', 1)}, ' ', {d.item('f', 5)}, ' ', {d.join(d.slice('f', 9, d.size('f')), ' ')})"
    rows = f"(select doc, pos, line, t, {f} as f from {trimmed(d, src)} c0 where not {d.starts('t', 'total ')})"
    return f"(select doc, pos, cast(0 as bigint) as sub, case when {long} then {short} else line end as line from {rows} c)"


def docker(d: Dialect, src: str) -> str:
    """Build steps as their commands, pulls with their layer count (C-06)."""
    step = r"^Step \d+/\d+ :"
    layer = r"^[0-9a-f]{12}: (Waiting|Pulling fs layer|Downloading|Extracting|Verifying Checksum|Download complete|Pull complete)"
    drop = d.any_of((r"^---> Running in [0-9a-f]+", r"^---> [0-9a-f]{12}$", r"^Removing intermediate container [0-9a-f]+"), "t")
    bare = f"{d.trim(d.sub('t', chr(92) + 'x1b' + chr(92) + '[[0-9;]*[mGKHJ]', ''))} = ''"
    kind = f"case when t = '' or {drop} then 'drop' when {d.match('t', step)} then 'step' when {d.starts('t', 'Pulling ')} then 'pull' when {d.match('t', layer)} then 'layer' when {bare} then 'flush' else 'keep' end"
    base = f"(select *, sum(case when k in ('keep', 'flush') then 1 else 0 end) over ({UPTO}) as g, sum(case when k = 'pull' then 1 else 0 end) over ({UPTO}) as p from (select *, {kind} as k from {trimmed(d, src)} c0) c1)"
    cmd = d.sub("t", r"^[^:]*: ", "")
    command = f"case when {d.contains('t', d.lit(': '))} then case when upper(substr({cmd}, 1, 5)) = 'FROM ' then concat('--- ', {cmd}, ' ---') else {cmd} end else t end"
    # A step neither ends a pull nor waits for it: it stands where it was, before a pull still open there.
    pulls = f"(select doc, g, p, max(case when k = 'pull' then t end) as t, cast(sum(case when k = 'layer' then 1 else 0 end) as bigint) as n, max(pos) as pos, max(p) over (partition by doc, g) as last_p from {base} b where k in ('pull', 'layer') group by doc, g, p)"
    return f"""(select doc, cast(g as bigint) as pos, pos as sub, {command} as line from {base} b where k = 'step' union all
        select doc, cast(g as bigint) as pos, cast(-1 as bigint) as sub, line from {base} b where k = 'keep' union all
        select doc, cast(g as bigint) as pos, cast({LAST} as bigint) as sub, case when n > 0 then concat(t, ' (', cast(n as varchar(20)), ' layers)') else t end as line from {pulls} q where t is not null and p = last_p)"""


def npm(d: Dialect, src: str) -> str:
    """Installs without progress; runs of warnings as the first and a count; low-severity audit details after ten as one marker (C-07)."""
    started = f"max(case when {d.contains('t', d.lit('vulnerabilities'))} or {d.contains('t', d.lit('found 0'))} then 1 else 0 end) over ({UPTO}) = 1"
    audit = d.match("line", r"^\s+(Severity|Vulnerable|Patched|Dependency|Path|More info):")
    high, low = d.match("line", r"^\s+Severity:\s*(critical|high)"), d.match("line", r"^\s+Severity:\s*(low|moderate|info)")
    quiet = f"t = '' or {d.match('t', '^npm (http|timing)')} or {d.match('t', '^npm warn')}"
    one = f"(select *, {started} as started from {trimmed(d, src)} n0)"
    two = f"(select *, not started and not ({quiet}) and {audit} as audit from {one} n1)"
    three = f"(select *, coalesce({d.last_value(f'case when audit and {high} then 1 when audit and {low} then 0 end', UPTO)}, 0) as severe from {two} n2)"
    four = f"(select doc, pos, line, audit and severe = 0 as minor, sum(case when audit and severe = 0 then 1 else 0 end) over ({UPTO}) as nth from {three} n3)"
    five = f"(select doc, pos, case when minor and nth = 11 then '  ... additional low/moderate vulnerability details omitted' when minor and nth > 11 then {d.lit(chr(1))} else line end as line from {four} n4)"
    yarn = d.match("t", r"^\[[\d/]+\] (Resolving packages|Fetching packages|Linking dependencies)")
    classes = [(BLANK, DROP), (d.match("t", "^npm http"), DROP), (d.match("t", "^npm timing"), DROP), (d.match("t", "^npm warn"), 1), (f"line = {d.lit(chr(1))}", FLUSH), (yarn, FLUSH)]
    return counter_flush(d, five + " n5", classes, {1: [("n > 0", "first_line"), ("n > 1", _n(d, "... and ", " more npm warnings", 1))]})


def node(d: Dialect, src: str, size: int = 0) -> str:
    """Runtime warnings, build progress, assets and internal frames as counts (C-08)."""
    classes = [
        (BLANK, KEEP), (d.match("t", r"^\(node:\d+\) ExperimentalWarning:"), 1), (d.match("t", r"^\(node:\d+\) \[DEP\d+\] DeprecationWarning:"), 2),
        (d.match("t", r"^\s*\d+%\s+(building|sealing|emitting|optimizing)"), 3), (d.match("t", r"^\s*(asset|chunk|modules by path|orphan modules|runtime modules|cacheable modules)"), 4),
        (d.match("t", r"^(Optimized dependencies|Pre-bundling|✓ \d+ modules)"), DROP), (d.match("t", r"^(Need to install|Ok to proceed|npm warn exec)"), DROP), (d.match("line", r"^\s+at .+\(node:"), 5),
    ]
    return counter_flush(d, src, classes, {
        1: [("n > 0", _n(d, "(", " experimental warnings)"))], 2: [("n > 0", "first_line"), ("n > 1", _n(d, "... and ", " more deprecation warnings", 1))],
        3: [("n > 0", _n(d, "(", " build progress updates)"))], 4: [("n > 0", _n(d, "(", " module/asset details)"))], 5: [("n > 0", _n(d, "    [... ", " node internal frames]"))],
    }, size=size)


def cargo(d: Dialect, src: str) -> str:
    """Compile and download runs as counts (C-09)."""
    classes = [(BLANK, DROP), (d.match("t", r"^\s*Compiling\s+\S+\s+v"), 1), (d.match("t", r"^\s*Download(ing|ed)\s+"), 2)]
    return counter_flush(d, src, classes, {1: [("n > 0", _n(d, "   Compiled ", " crates"))], 2: [("n > 0", _n(d, "   Downloaded ", " crates"))]})


def make(d: Dialect, src: str) -> str:
    """Directory changes dropped, compiler calls as compiler, source and output (C-10)."""
    comp = r"^\s*(gcc|g\+\+|cc|c\+\+|clang|clang\+\+)\s+"
    source, out = d.extract("t", r"\s(\S+\.(c|cc|cpp|cxx|m|mm|s|S))\b", 1), d.extract("t", r"-o\s+(\S+)", 1)
    name = d.extract("t", comp, 1)
    short = f"case when {source} <> '' then concat({name}, ' ', {source}, case when {out} <> '' then concat(' -o ', {out}) else '' end) when {out} <> '' then concat({name}, ' ... -o ', {out}) else t end"
    drop = f"t = '' or {d.match('t', '^make' + chr(92) + '[' + chr(92) + 'd+' + chr(92) + ']: (Entering directory|Leaving directory|Nothing to be done for)')}"
    return f"(select doc, pos, cast(0 as bigint) as sub, case when {d.match('t', comp)} then {short} else line end as line from {trimmed(d, src)} c where not ({drop}))"


#: Response headers that stay.
RESPONSE_HEADERS = r"(?i)^< (content-type|location|www-authenticate|x-error|retry-after|status)"


def curl(d: Dialect, src: str) -> str:
    """Progress and connection notes dropped; header blocks shortened, which flush at a blank line, at a bare sign or at the
    end, never before ordinary lines (C-11)."""
    head, data = d.match("t", r"^\s*%\s+Total\s+%\s+Received"), d.match("t", r"^\s*\d+\s+\d+.*\d+[kMG]?\s+\d+")
    table = d.last_value(f"case when t = '' or ({data} and not {head}) then null when {head} then 1 else 0 end", UPTO)
    bars, info = d.any_of((r"^\.{5,}", r"\d+%\[=*>?\s*\]"), "t"), d.match("t", r"^\*\s+")
    kind = f"""case when t = '' then 'blank' when {head} then 'drop' when {data} and coalesce(in_table, 0) = 1 then 'drop' when {bars} then 'drop'
        when {info} then case when {d.match('t', '(?i)(error|fail|refused|timeout)')} then 'keep' else 'drop' end
        when t = '>' then 'end_send' when t = '<' then 'end_recv' when {d.match('t', '^>' + chr(92) + 's+' + chr(92) + 'S')} then 'send' when {d.match('t', '^<' + chr(92) + 's+' + chr(92) + 'S')} then 'recv' else 'keep' end"""
    base = f"(select doc, pos, line, t, {kind} as k from (select *, {table} as in_table from {trimmed(d, src)} u0) u1)"
    after = lambda x: f"min(case when k in ('blank', '{x}') then pos end) over (partition by doc order by pos rows between current row and unbounded following)"
    rows = f"(select *, coalesce(case when k = 'send' then {after('end_send')} else {after('end_recv')} end, {LAST}) as due from {base} u2)"
    kept = d.match("t", RESPONSE_HEADERS)
    count = lambda k, cond, sub, label, end: f"select doc, cast(due as bigint) as pos, cast({sub} as bigint) as sub, concat('{label} (', cast(count(*) as varchar(20)), ' {end})') as line from {rows} u4 where k = '{k}' and {cond} group by doc, due"
    return f"""(select doc, pos, cast({LAST} as bigint) as sub, line from {rows} u3 where k in ('blank', 'keep') union all
        select doc, cast(due as bigint) as pos, pos - {LAST} as sub, t as line from {rows} u3 where k = 'recv' and {kept} union all
        {count('recv', f'not {kept}', 0, '<', 'other headers')} union all {count('send', 'true', 1, '>', 'request headers')})"""


def python(d: Dialect, src: str) -> str:
    """Package installs as counts, progress bars dropped, deprecations as the first and a count (C-12, install part)."""
    classes = [
        (BLANK, KEEP), (d.match("t", r"^Requirement already satisfied:"), 1), (d.match("t", r"^\s*(Downloading|Installing|Collecting|Using cached)\s+"), 2),
        (d.match("t", r"\s+\|[█▓▒░#=\-\s]+\|\s+[\d.]+\s*[kMG]?B"), DROP), (d.match("t", r"^\S+:\d+:\s*(DeprecationWarning|PendingDeprecationWarning|FutureWarning):"), 3),
    ]
    return counter_flush(d, src, classes, {1: [("n > 0", _n(d, "Already satisfied: ", " packages"))], 2: [("n > 0", _n(d, "pip: ", " packages downloaded/installed"))], 3: [("n > 0", "first_line"), ("n > 1", _n(d, "... and ", " more deprecation warnings", 1))]})


def terraform(d: Dialect, src: str) -> str:
    """Refresh, read and wait lines as counts (C-14)."""
    classes = [(BLANK, KEEP), (d.match("t", r"^(\S+\.\S+): Refreshing state\.\.\."), 1), (d.match("t", r"^(\S+\.\S+): (Reading\.\.\.|Read complete after)"), 2), (d.match("t", r"^(\S+\.\S+): Still (creating|modifying|destroying)\.\.\."), 3)]
    return counter_flush(d, src, classes, {1: [("n > 0", _n(d, "Refreshed ", " resources"))], 2: [("n > 0", _n(d, "Read ", " data sources"))], 3: [("n > 0", _n(d, "(", " progress updates)"))]})


def kubectl(d: Dialect, src: str) -> str:
    """Managed fields and applied-configuration blocks as `(omitted)`, client debug lines dropped (C-15)."""
    w = f"cast({d.chars(d.replace(d.extract('line', '^[ ' + chr(92) + 't]*'), chr(9), '    '))} as bigint)"
    fields, note = d.match("line", r"^\s+managedFields:"), d.match("line", r"^\s+kubectl\.kubernetes\.io/(last-applied-configuration|rollout-status):")
    one = f"(select *, {w} as w, {fields} as fields, {note} as note from {trimmed(d, src)} k0 where not {d.match('line', '^(client|server)' + chr(92) + '.go:' + chr(92) + 'd+:')})"
    start = f"{d.last_value('case when fields or note then pos end', UPTO)}"
    width, isnote = d.last_value("case when fields or note then w end", UPTO), d.last_value("case when fields or note then case when note then 1 else 0 end end", UPTO)
    two = f"(select *, {start} as s, {width} as sw, {isnote} as sn from {one} k1)"
    ended = "max(case when fields or note then 0 when t = '' then sn when w <= sw then 1 else 0 end) over (partition by doc, s order by pos rows between unbounded preceding and current row)"
    three = f"(select *, {ended} as ended from {two} k2)"
    mark = f"concat({d.sub('line', ':.*$', ':')}, ' (omitted)')"
    return f"(select doc, pos, cast(0 as bigint) as sub, case when fields or note then {mark} else line end as line from {three} k3 where s is null or fields or note or ended = 1)"


def tar(d: Dialect, src: str) -> str:
    """Listings of over 30 lines: verbose rows as names, long runs as head, count and tail; extractions as a count (C-17)."""
    verbose = d.match("line", r"^[drwxlstST-]{10}\s+\S+/\S+\s+\d+\s+\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}\s+")
    drop = f"{d.match('line', '^' + chr(92) + 's*-{5,}')} or {d.match('line', ':' + chr(92) + 's+[' + chr(92) + 'd.]+%' + chr(92) + 's+--' + chr(92) + 's+(created|replaced)')}"
    kind = f"case when n <= 30 then 'keep' when {drop} then 'drop' when {verbose} then 'row' when {d.match('line', '^x' + chr(92) + 's+' + chr(92) + 'S')} then 'x' else 'keep' end"
    base = f"(select *, sum(case when k = 'keep' then 1 else 0 end) over ({UPTO}) as g from (select *, {kind} as k from (select *, count(*) over (partition by doc) as n from {src}) t0) t1)"
    rows = f"(select doc, g, pos, {d.extract('line', chr(92) + 'S+' + chr(92) + 's*$')} as name, row_number() over (partition by doc, g order by pos) as i, count(*) over (partition by doc, g) as m from {base} b where k = 'row')"
    head = f"case when n > 30 and {d.match('line', '^' + chr(92) + 's*Length' + chr(92) + 's+Date' + chr(92) + 's+Time' + chr(92) + 's+Name')} then 'Archive contents:' else line end"
    return f"""(select doc, cast(g - 1 as bigint) as pos, cast({LAST} as bigint) as sub, {head} as line from {base} b where k = 'keep' union all
        select doc, cast(g as bigint) as pos, cast(i as bigint) as sub, case when m > 20 and i = 11 then concat('... ', cast(m - 15 as varchar(20)), ' more files ...') else name end as line from {rows} r where m <= 20 or i <= 11 or i > m - 5 union all
        select doc, cast(g as bigint) as pos, cast({LAST} - 1 as bigint) as sub, concat('Extracted ', cast(count(*) as varchar(20)), ' files') as line from {base} b where k = 'x' group by doc, g)"""


def ssh(d: Dialect, src: str, size: int = 0) -> str:
    """Banners, host keys and message-of-the-day frames dropped, transfers as counts (C-19).

    A blank line stays and ends no run.
    """
    drop = d.any_of((r"^(Warning: Permanently added|Pseudo-terminal|Connection to .+ closed|Authenticated to)", r"^(ECDSA|RSA|ED25519) key fingerprint is", r"^debug\d+:", r"^(#{3,}|\*{3,}|={3,})", r"^#.+#\s*$"), "t")
    classes = [(BLANK, DROP), (drop, DROP), (d.match("t", r"\d+%\s+[\d.]+[kKMG]?B\s+[\d.]+[kKMG]?B/s"), 1), (d.match("t", r"^\s*[\d,]+\s+\d+%\s+[\d.]+[kKMG]?B/s"), 2)]
    return counter_flush(d, src, classes, {1: [("n > 0", _n(d, "scp: ", " files transferred"))], 2: [("n > 0", _n(d, "(", " progress updates)"))]}, size=size, blanks=True)


OPERATORS = {"grep": grep, "find": find, "git": git, "go": go, "ls": ls, "docker": docker, "npm": npm, "node": node, "cargo": cargo, "make": make, "curl": curl, "python": python, "terraform": terraform, "kubectl": kubectl, "tar": tar, "ssh": ssh}
