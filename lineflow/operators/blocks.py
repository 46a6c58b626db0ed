"""Operators over blocks of lines: element lists, folder chains, console blocks and stack traces (C-12, C-13, C-16, C-18,
F-10 to F-13).

What looks sequential is islands here: a block begins where a window over earlier lines says so and ends at the first line
that a running test rejects.  Every window is partitioned by doc (or by doc and an island) and ordered by pos, so a document
is exchanged once.  Input (doc, pos, line), output (doc, pos, sub, line).
"""

from __future__ import annotations

from lineflow.functions import text as T
from lineflow.functions.dialect import Dialect
from lineflow.operators import classify
from lineflow.operators.generic import PREVIOUS, UPTO, renumber

# How the tools print what the operators look for.
CONSOLE = r"^\s*console\.(log|warn|error|info|debug)\s*$"
TRAILER = r"^\s+at (?:[^\s()]+:\d+:\d+|[^\s()]+ \([^()]+:\d+:\d+\))\s*$"
FRAME = r"^\s+at\s"
TRACEBACK = "Traceback (most recent call last):"
CHAINED = ("During handling of the above exception, another exception occurred:", "The above exception was the direct cause of the following exception:")
PYTHON_CALL, PYTHON_CODE = r'^\s*File "(.+)", line (\d+), in (.+)', r"^\s{4}\S"
IMPORT_ERROR = r"^(ImportError|ModuleNotFoundError|ModuleNotFound):"
NODE_ERROR = r"^(?:[A-Z].*)?(?:Error|Exception)$"
NODE_INTERNAL = r"\(node:|node:(?:internal/|events|net|async_hooks|stream|fs|_)"
NODE_MODULES = r"node_modules[/\\]"
GO_RUNTIME = r"^(?:runtime\.goexit|runtime\.main\()"
TREE_SUMMARY = r"^\d+ director(y|ies), \d+ files?"

#: Order of a running window inside an island.
INSIDE = "order by pos rows between unbounded preceding and current row"
LINE, TEXT, SIZE, EMPTY = "line", "text", "size", "''"
BEFORE = "partition by doc order by pos rows between unbounded preceding and 1 preceding"


def _flag(test: str) -> str:
    return f"case when {test} then 1 else 0 end"


def _int(x: str) -> str:
    return f"cast({x} as varchar(20))"


def _exploded(d: Dialect, src: str, texts: str, where: str = "true") -> str:
    """(doc, pos, sub, line): the texts of each row that aren't null, a line each."""
    rows = d.explode(f"(select doc, pos, {texts} as texts from {src} where {where})" + (" x0" if d.name == "duckdb" else ""), "doc, pos", "texts", "spot")
    return f"(select doc, pos, spot as sub, line from {rows} x1 where line is not null)"


def jq(d: Dialect, src: str, most: int = 10, small: int = 50) -> str:
    """Array objects after the tenth dropped, until a closing bracket, which a marker at the depth of the first of them
    precedes (C-16).  Bracket lines always stay and start the count anew; a nested opening one doesn't end what is dropped."""
    opens, closes, item = "substr(t, length(t), 1) = '['", "t in (']', '],')", "substr(t, 1, 1) = '{'"
    one = f"(select *, {_flag(opens)} as o, {_flag(closes)} as c, {_flag(f'{item} and not ({opens})')} as item from (select doc, pos, line, {d.trim('line')} as t, count(*) over (partition by doc) as n from {src}) j0)"
    two = f"(select *, sum(o - c) over ({UPTO}) as depth, sum(o + c) over ({UPTO}) as part, sum(c) over ({UPTO}) - c as until from {one} j1)"
    three = f"(select *, sum(item) over (partition by doc, part {INSIDE}) as nth from {two} j2)"
    four = f"(select *, {_flag(f'item = 1 and depth > 0 and nth > {most}')} as spare from {three} j3)"
    until = f"partition by doc, until {INSIDE}"
    five = f"(select *, sum(spare) over ({until}) as gone, {d.first_value(f'case when spare = 1 then {d.chars(T.leading_text(d, LINE))} end', until)} as pad from {four} j4)"
    marker = f"case when n > {small} and c = 1 and gone > 0 then concat(repeat(' ', cast(pad as int)), '  ... ', {_int('gone')}, ' more elements') end"
    kept = f"case when n <= {small} or o + c > 0 or depth <= 0 or gone = 0 then line end"
    return _exploded(d, f"{five} j5", d.array(marker, kept))


def tree(d: Dialect, src: str, small: int = 20) -> str:
    """Chains of folders whose next line is a deeper folder, joined with the entry after them (C-13).

    A folder and its entry alone stay on two lines; both forms lose their depth.
    """
    lead = lambda x: f"lead({x}) over ({PREVIOUS})"
    one = f"(select *, name <> '' and (not {d.contains('name', d.lit('.'))} or name like '%/') as folder, t = '' or {d.match('t', TREE_SUMMARY)} as apart from (select doc, pos, line, count(*) over (partition by doc) as n, {d.trim('line')} as t, {T.tree_name(d, d.trim('line'))} as name, {T.tree_depth(d, 'line')} as depth from {src}) b0)"
    two = f"(select *, n > {small} and not apart and folder and coalesce({lead('folder')} and {lead('depth')} > depth, false) as opens from {one} b1)"
    three = f"(select *, coalesce(lag(opens) over ({PREVIOUS}), false) as opened from {two} b2)"
    four = f"(select *, opens or (opened and not apart) as inside, sum({_flag('opens and not opened')}) over ({UPTO}) as chain from {three} b3)"
    # A chain is one row, and so is every other line.
    key = "case when inside then -chain else pos + 1 end"
    five = f"(select doc, min(pos) as pos, cast(count(*) as bigint) as size, max({_flag('inside')}) as chained, {d.agg_join('name', 'pos', '/')} as path, {d.agg_join('name', 'pos', chr(10))} as names, {d.first_by('line', 'pos')} as plain from {four} b4 group by doc, {key})"
    branch = lambda x: f"concat('├── ', {x})"
    texts = f"case when chained = 0 then {d.array('plain')} when size > 2 then {d.array(branch('path'))} else {d.transform(d.split('names', chr(10)), 'x', branch('x'))} end"
    return _exploded(d, f"{five} b5", texts)


def console(d: Dialect, src: str, drop: str = "false", name: str = "lineflow") -> str:
    """Console blocks of a test runner as their message alone, equal neighbours counted; where `drop` holds, an expression
    over the document's rows such as `passed`, all as one marker (C-18).

    A block is a header, up to nine indented lines and a lone frame; an empty line after it goes too.  Blocks that overlap
    end at the same frame, and the first of them counts.
    """
    frame = d.match("line", FRAME)
    verdict = f"case when v = 'PASS' then 1 when v = 'FAIL' then -1 end"
    one = f"(select *, row_number() over ({PREVIOUS}) as i, coalesce(lead(frame) over ({PREVIOUS}), false) as followed, min({verdict}) over (partition by doc) as worst from (select doc, pos, line, {d.match('line', CONSOLE)} as header, {d.match('line', TRAILER)} as trailer, {frame} as frame, {d.match('line', chr(94) + chr(92) + 's')} as indented, {classify.runner_verdict(d, 'line')} as v from {src}) k0)"
    near = "partition by doc order by pos rows between 1 following and 10 following"
    two = f"(select *, coalesce(worst = 1, false) as passed, min(case when trailer then 2 * i + {_flag('followed')} end) over ({near}) as stop, min(case when not indented then i end) over ({near}) as bare from {one} k1)"
    three = f"(select *, case when header and stop % 2 = 0 and (bare is null or bare > {d.div('stop', '2')}) then {d.div('stop', '2')} end as e from {two} k2)"
    four = f"(select *, case when e is not null and coalesce({d.last_value('e', BEFORE)}, -1) <> e then i end as begins from {three} k3)"
    five = f"(select *, {d.last_value('begins', UPTO)} as b, {d.last_value('case when begins is not null then e end', UPTO)} as z from {four} k4)"
    six = f"(select *, coalesce(i <= z or (i = z + 1 and line = ''), false) as inside from {five} k5)"
    # A block is one row, and so is every other line.
    key = "case when inside then -b else pos + 1 end"
    shown = "case when not inside or (i > b and i < z) then line end"
    seven = f"(select doc, min(pos) as pos, max({_flag('inside')}) as block, max({_flag(f'inside and {drop}')}) as dropped, coalesce({d.agg_join(shown, 'pos', chr(10))}, '') as message, {d.first_by('line', 'pos')} as plain from {six} k6 group by doc, {key})"
    eight = f"(select *, {_flag(f'block = 1 and coalesce(lag(block) over ({PREVIOUS}) = 1 and message = lag(message) over ({PREVIOUS}), false)')} as same, sum(block) over ({UPTO}) as nth, sum(block) over (partition by doc) as blocks from {seven} k7)"
    nine = f"(select *, sum(1 - same) over ({UPTO}) as run from {eight} k8)"
    ten = f"(select *, count(*) over (partition by doc, run) - 1 as others from {nine} k9)"
    again = f"case when others > 0 and message <> '' then concat({T.leading_text(d, 'message')}, '... and ', {_int('others')}, ' identical console blocks') end"
    marker = f"concat('  [{name}: ', {_int('blocks')}, ' console.* log block', case when blocks > 1 then 's' else '' end, ' dropped — run passed]')"
    texts = f"case when block = 0 then {d.array('plain')} when dropped = 1 then {d.array(f'case when nth = 1 then {marker} end')} when message = '' then {d.array('cast(null as varchar(9))')} else {d.append(d.split('message', chr(10)), again)} end"
    return _exploded(d, f"{ten} k10", texts, "same = 0 or dropped = 1")


def go_traces(d: Dialect, src: str) -> str:
    """Equal neighbouring goroutine dumps kept once with a count, runtime frames dropped where others remain (F-10).

    Without equal neighbours nothing changes; with some, lines between the dumps that belong to none go.
    """
    head = f"{d.starts('line', 'goroutine ')} and {d.contains('line', d.lit(' ['))} and t like '%:'"
    one = f"(select *, sum({_flag('head')}) over ({UPTO}) as g from (select doc, pos, line, t, {head} as head from (select doc, pos, line, {d.trim('line')} as t from {src}) g0) g1)"
    inside = "partition by doc, g order by pos rows between unbounded preceding and current row"
    # A dump ends at its first blank line, which it takes along.
    two = f"(select *, sum({_flag('t = ' + chr(39) * 2)}) over ({inside}) as blanks from {one} g2)"
    three = f"(select *, g > 0 and (blanks = 0 or (blanks = 1 and t = '')) as own from {two} g3)"
    four = f"(select *, own and not head as body, own and not head and t <> '' and not {d.starts('line', chr(9))} as call from {three} g4)"
    order = "partition by doc, g order by pos"
    five = f"(select *, body and {d.starts('line', chr(9))} and coalesce(lag(call) over ({order}), false) as place, call and {d.match('t', GO_RUNTIME)} as runtime from {four} g5)"
    six = f"(select *, runtime or (place and coalesce(lag(runtime) over ({order}), false)) as quiet, sum({_flag('call')}) over (partition by doc, g) as frames, sum({_flag('call and not runtime')}) over (partition by doc, g) as others from {five} g6)"
    # A dump is one row, and so is every other line.  Folded, it loses runtime frames where others remain, and its lines
    # that belong to no frame come last.
    key, shown, cut = "case when own then -g else pos + 1 end", "body and t <> ''", "frames > 1 and others > 0"
    seven = f"(select *, {_flag(f'{cut} and body and not call and not place')} as late from {six} g7)"
    eight = f"""(select doc, min(pos) as pos, max(g) as g, max({_flag('own')}) as dump, coalesce({d.agg_join(f'case when {shown} then line end', 'pos', chr(10))}, '') as text, cast(sum({_flag(shown)}) as bigint) as size,
        {d.agg_join('line', 'pos', chr(10))} as whole, {d.agg_join(f'case when not (body and {cut} and quiet) then line end', 'late, pos', chr(10))} as folded from {seven} g8 group by doc, {key})"""
    last = lambda x: d.last_value(f"case when dump = 1 then {x} end", BEFORE)
    nine = f"(select *, {_flag(f'dump = 1 and coalesce(text = {last(TEXT)} and size = {last(SIZE)}, false)')} as same, sum(dump) over (partition by doc) as dumps from {eight} g9)"
    ten = f"(select *, sum(dump - same) over ({UPTO}) as run, sum(same) over (partition by doc) as repeats from {nine} g10)"
    eleven = f"(select *, sum(dump) over (partition by doc, run) - 1 as more from {ten} g11)"
    note = f"case when more > 0 then concat('[... ', {_int('more')}, ' more goroutine', case when more > 1 then 's' else '' end, ' with identical stack]') end"
    lines = d.split("folded", chr(10))
    texts = f"case when repeats = 0 then {d.split('whole', chr(10))} when dump = 1 then {d.append(d.append(lines, note), f'case when more > 0 then {EMPTY} end')} else {d.array('whole')} end"
    return _exploded(d, f"{eleven} g12", texts, "repeats = 0 or (dump = 1 and same = 0) or (dump = 0 and (g = 0 or g = dumps))")


def _folded(d: Dialect, src: str, folds: str, marker: str) -> str:
    """src (doc, pos, line, framed, f, frames, opens) with the frames of every trace that `folds` as first, marker, last."""
    note = f"case when framed and {folds} and f = 2 and opens then concat({marker}) end"
    kept = f"case when framed and {folds} and f > 1 and f < frames then null else line end"
    return _exploded(d, src, d.array(note, kept))


def python_traces(d: Dialect, src: str, most: int = 5) -> str:
    """Tracebacks of more than five frames as their first and last (F-11).

    What follows the frames, up to a blank line or a chain, belongs to the exception, another header too.
    """
    breaks = f"t = '' or t in ({', '.join(map(d.lit, CHAINED))})"
    one = f"(select *, sum({_flag(breaks)}) over ({UPTO}) as part, {_flag('t = ' + d.lit(TRACEBACK))} as head, {d.starts('t', 'File ')} as opens from (select doc, pos, line, {d.trim('line')} as t from {src}) p0)"
    part = f"partition by doc, part {INSIDE}"
    two = f"(select *, sum(head) over ({part}) as heads, sum(head) over ({part}) - head as before, opens or (coalesce(lag(opens) over (partition by doc, part order by pos), false) and head = 0 and t <> '' and not {d.match('t', '^[A-Z]')}) as fits from {one} p1)"
    three = f"(select *, before > 0 and max({_flag('before > 0 and not fits')}) over ({part}) = 0 as framed from {two} p2)"
    four = f"(select *, sum({_flag('framed and opens')}) over ({part}) as f from {three} p3)"
    five = f"(select *, max(case when framed then f end) over (partition by doc, part) as frames from {four} p4)"
    return _folded(d, f"{five} p5", f"frames > {most}", f"'  [... ', {_int('frames - 2')}, ' more frames]'")


def script_traces(d: Dialect, src: str) -> str:
    """Tracebacks of more than two frames as first and last, unless an import failed (C-12).

    The line after the frames is the error, whatever it looks like; of headers in a row every second one is an error.
    """
    one = f"(select *, {d.match('line', PYTHON_CALL)} as call, {d.match('line', PYTHON_CODE)} as code, {d.starts('t', TRACEBACK)} as header, {d.match('t', IMPORT_ERROR)} as failed from (select doc, pos, line, {d.trim('line')} as t from {src}) s0)"
    # A call may look like the code of the call before it: every second of such a row is code.
    two = f"(select *, code and coalesce(lag(call) over ({PREVIOUS}), false) as follows from {one} s1)"
    three = f"(select *, sum({_flag('not follows')}) over ({UPTO}) as row_ from {two} s2)"
    four = f"(select *, follows and row_number() over (partition by doc, row_ order by pos) % 2 = 0 as its_code from {three} s3)"
    five = f"(select *, call and not its_code as opens, not its_code and not call as other from {four} s4)"
    six = f"(select *, sum({_flag('other')}) over ({UPTO}) as part, sum({_flag('other and not header')}) over ({UPTO}) as plain, {d.last_value('case when other then failed end', 'partition by doc order by pos desc rows between unbounded preceding and 1 preceding')} as fails from {five} s5)"
    seven = f"(select *, sum({_flag('other and header')}) over (partition by doc, plain {INSIDE}) as nth from {six} s6)"
    whole = "partition by doc, part"
    eight = f"(select *, max({_flag('other and header and nth % 2 = 1')}) over ({whole}) = 1 and not other as framed, sum({_flag('opens')}) over ({whole} {INSIDE}) as f, sum({_flag('opens')}) over ({whole}) as frames from {seven} s7)"
    nine = f"(select *, max({_flag('coalesce(fails, false)')}) over ({whole} order by pos rows between current row and unbounded following) as failed_import from {eight} s8)"
    return _folded(d, f"{nine} s9", "frames > 2 and failed_import = 0", f"'  ... ', {_int('frames - 2')}, ' more frames ...'")


def node_traces(d: Dialect, src: str, most: int = 2) -> str:
    """Stacks under an error line as their first two application frames and counts of the others (F-12)."""
    named = f"{d.instr('t', ': ')} > 0 and {d.match(f'substr(t, 1, cast({d.instr(chr(116), chr(58) + chr(32))} - 1 as int))', NODE_ERROR)}"
    one = f"(select *, sum({_flag('not frame')}) over ({UPTO}) as stack, not frame and {named} as head from (select *, {d.starts('t', 'at ')} as frame from (select doc, pos, line, {d.trim('line')} as t from {src}) n0) n1)"
    kind = f"case when not frame then '' when {d.match('line', NODE_INTERNAL)} then 'internal' when {d.match('line', NODE_MODULES)} then 'module' else 'app' end"
    two = f"(select *, {kind} as kind, max({_flag('head')}) over (partition by doc, stack) as headed from {one} n2)"
    count = lambda k: f"cast(sum({_flag(f'kind = {chr(39)}{k}{chr(39)}')}) over (partition by doc, stack) as bigint)"
    three = f"(select *, sum({_flag('kind = ' + d.lit('app'))}) over (partition by doc, stack {INSIDE}) as nth, {count('module')} as modules, {count('internal')} as internals, {count('app')} as apps, max(pos) over (partition by doc, stack) as last_pos from {two} n3)"
    part = lambda test, n, what: f"case when {test} then concat({_int(n)}, ' {what}') end"
    parts = f"concat_ws(', ', {part('modules > 0', 'modules', 'node_modules frames')}, {part('internals > 0', 'internals', 'node internals')}, {part(f'apps > {most}', f'apps - {most}', 'more app frames')})"
    kept = f"case when not frame or headed = 0 or (kind = 'app' and nth <= {most}) then line end"
    note = f"case when frame and headed = 1 and pos = last_pos and (modules > 0 or internals > 0 or apps > {most}) then concat('    [... ', {parts}, ']') end"
    return _exploded(d, f"{three} n4", d.array(kept, note))


def traces(d: Dialect, src: str) -> str:
    """The three stack operators in order (F-13)."""
    lines = renumber(d, f"{go_traces(d, src)} z0")
    lines = renumber(d, f"{python_traces(d, lines + ' z1')} z2")
    return node_traces(d, f"{lines} z3")
