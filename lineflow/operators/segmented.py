"""Line operators over documents of any length (F-05, K-01, T-01, W-01, W-02): a segmented scan.

A document is cut into pieces of `size` positions.  Pieces are partitions of their own, so one document spreads over as
many tasks as it has pieces.  Each piece is reduced to a row (first line, last line, length of its first run, counts); the
rows of a document, one for `size` lines, are combined by windows, and what they say is applied to the pieces.  Results
are those of the plain operators.
"""

from __future__ import annotations

from lineflow.functions.dialect import Dialect
from lineflow.operators import classify

#: Positions of a piece.
SIZE = 1 << 17
INSIDE = "partition by doc, piece order by pos"
INSIDE_UPTO = f"{INSIDE} rows between unbounded preceding and current row"
BEFORE = "partition by doc order by piece rows between unbounded preceding and 1 preceding"


def cut(d: Dialect, src: str, size: int = SIZE) -> str:
    return f"(select *, {d.div('pos', str(size))} as piece from {src})"


def running(d: Dialect, src: str, value: str, name: str, size: int = SIZE) -> str:
    """src with `name`, the running sum of `value` over the document, and `piece`."""
    local = f"(select *, sum({value}) over ({INSIDE_UPTO}) as local_ from {cut(d, src, size)} u0)"
    before = f"(select doc as doc_, piece as piece_, coalesce(sum(total_) over ({BEFORE}), 0) as before_ from (select doc, piece, sum({value}) as total_ from {cut(d, src, size)} u1 group by doc, piece) u2)"
    return f"(select *, cast(local_ + before_ as bigint) as {name} from {local} u3 join {before} u4 on doc = doc_ and piece = piece_)"


def dedup(d: Dialect, src: str, size: int = SIZE) -> str:
    """generic.dedup(): a run that crosses pieces is counted where it begins."""
    same = f"(select *, coalesce(line = lag(line) over ({INSIDE}), false) as same from {cut(d, src, size)} r0)"
    runs = f"""(select doc, piece, run, min(pos) as pos, {d.first_by('line', 'pos')} as line, cast(count(*) as bigint) as n
        from (select doc, piece, pos, line, sum(case when same then 0 else 1 end) over ({INSIDE_UPTO}) as run from {same} r1) r2 group by doc, piece, run)"""
    ends = f"(select doc, piece, max(run) as last_run, {d.first_by('line', 'run')} as first_line, {d.last_by('line', 'run')} as last_line, {d.first_by('n', 'run')} as first_n from {runs} r3 group by doc, piece)"
    # A piece continues the run before it; if it is that run alone, the next one may continue it too.
    joined = f"(select *, coalesce(first_line = lag(last_line) over (partition by doc order by piece), false) as goes_on from {ends} r4)"
    origin = f"(select *, {d.last_value('case when not (goes_on and last_run = 1) then piece end', BEFORE)} as origin from {joined} r5)"
    more = f"(select doc as mdoc, origin as mpiece, cast(sum(first_n) as bigint) as more from {origin} r6 where goes_on group by doc, origin)"
    state = f"(select doc as sdoc, piece as spiece, last_run, goes_on, coalesce(more, 0) as more from {origin} r7 left join {more} r8 on doc = mdoc and piece = mpiece)"
    whole = f"(select doc, pos, line, n + case when run = last_run then more else 0 end as n from {runs} r9 join {state} s on doc = sdoc and piece = spiece where not (goes_on and run = 1))"
    return f"""(select doc, pos, cast(k as bigint) as sub, case when k = 0 then line else concat('  ... (', cast(n - 1 as varchar(20)), case when n = 2 then ' duplicate line)' else ' duplicate lines)' end) end as line
        from {whole} w cross join (select 0 as k union all select 1 as k) two where k = 0 or n > 1)"""


def truncate(d: Dialect, src: str, most: int, size: int = SIZE) -> str:
    """summary.truncate(): head, one marker, pinned runner totals, tail."""
    if most <= 0:
        return f"(select doc, pos, cast(0 as bigint) as sub, line from {src})"
    head = int(most * 0.7)
    placed = running(d, f"(select doc, pos, line, {classify.summary_anchor(d, 'line')} as pin from {src}) t0", "1", "i", size)
    length = f"(select doc as ldoc, cast(count(*) as bigint) as n from {src} group by doc)"
    rows = f"(select doc, pos, line, pin, n, n <= {most} or i <= {head} or i > n - {most - head} as keep from {placed} t1 join {length} t2 on doc = ldoc)"
    gap = f"(select doc as gdoc, cast(count(*) as bigint) as gone, min(pos) as first_pos, max(case when pin then 1 else 0 end) as pins from {rows} t3 where not keep group by doc)"
    pinned, plain = d.lit(" lines omitted; summary pinned below ...]"), d.lit(" lines omitted ...]\n")
    return f"""(select doc, pos, cast(0 as bigint) as sub, line from {rows} t4 where keep union all
        select gdoc as doc, first_pos as pos, cast(1 as bigint) as sub, concat({d.lit(chr(10) + '[... ')}, cast(gone as varchar(20)), case when pins = 1 then {pinned} else {plain} end) as line from {gap} t5 union all
        select doc, first_pos as pos, cast(pos + 2 as bigint) as sub, line from {rows} t6 join {gap} t7 on doc = gdoc where pin and not keep)"""


def assemble(d: Dialect, src: str, size: int = SIZE, sub: bool = True) -> str:
    """generic.assemble(), a piece at a time: what a task holds beside the text is a row for `size` lines."""
    parts = f"(select doc, piece, {d.agg_join('line', 'pos, sub' if sub else 'pos', chr(10))} as line from {cut(d, src, size)} a0 group by doc, piece)"
    return f"(select doc, {d.agg_join('line', 'piece', chr(10))} as text from {parts} a1 group by doc)"


def renumber(d: Dialect, src: str, size: int = SIZE) -> str:
    """generic.renumber() where positions and their sub-places may lie over many pieces."""
    local = f"(select *, row_number() over (partition by doc, piece order by pos, sub) as local_ from {cut(d, src, size)} n0)"
    before = f"(select doc as doc_, piece as piece_, coalesce(sum(n) over ({BEFORE}), 0) as before_ from (select doc, piece, count(*) as n from {cut(d, src, size)} n1 group by doc, piece) n2)"
    return f"(select doc, cast(local_ + before_ - 1 as bigint) as pos, line from {local} n3 join {before} n4 on doc = doc_ and piece = piece_)"

