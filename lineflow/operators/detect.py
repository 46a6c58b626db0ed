"""Type detection (P-05, P-06, A-01)."""

from __future__ import annotations

from lineflow.functions import patterns as P
from lineflow.functions.dialect import Dialect


def registry(d: Dialect) -> str:
    """(binary, cmd_type): the small dimension that commands are looked up in."""
    return "(" + " union all ".join(f"select {d.lit(b)} as binary_name, {d.lit(t)} as cmd_type" for t, bs in P.REGISTRY.items() for b in bs) + ")"


def identify(d: Dialect, src: str) -> str:
    """(doc, command, cmd_type) from (doc, command): base name without .exe, looked up, else generic (J-01)."""
    base = d.sub(d.sub("command", r"^.*[/\\]", ""), r"\.exe$", "")
    return f"(select c.doc, c.command, coalesce(r.cmd_type, 'generic') as cmd_type from (select doc, command, {base} as base from {src}) c left join {registry(d)} r on c.base = r.binary_name)"


def auto_detect(d: Dialect, src: str, sample: int = 50) -> str:
    """(doc, cmd_type) of a line relation from its first `sample` non-blank lines.

    The first line of a distinctive group decides; else the greatest weighted count among types on at least two lines and
    40 % of the sample; else the only type on at least two lines and 20 %.  Ties fall to the type's name.
    """
    first = "case " + " ".join(f"when {d.match('line', p)} then {d.lit(t)}" for t, p in P.DETECT_FIRST) + " end"
    counted = "case " + " ".join(f"when {d.match('line', p)} then {d.lit(t)}" for t, p, _ in P.DETECT_COUNTED) + " end"
    kinds = sorted((t, w) for t, _, w in P.DETECT_COUNTED)
    lines = f"(select * from (select doc, pos, line, row_number() over (partition by doc order by pos) as i from {src} where {d.trim('line')} <> '') a0 where i <= {sample})"
    marked = f"(select doc, pos, {first} as first_kind, {counted} as kind from {lines} a1)"
    # One aggregation by document: the deciding line and a count for each type.
    each = ", ".join(f"{d.int_sum(f'case when kind = {d.lit(t)} then 1 else 0 end')} as n_{t}" for t, _ in kinds)
    decided = d.first_by("case when first_kind is not null then first_kind end", "case when first_kind is not null then pos end")
    counts = f"(select doc, cast(count(*) as bigint) as n, {decided} as decided, {each} from {marked} a2 group by doc)"
    bounds = f"(select *, greatest({d.div('n * 40', '100')}, 2) as high, greatest({d.div('n * 20', '100')}, 2) as low from {counts} a3)"
    # Weighted count and rank of the name in one number, so that the greatest is the winner with ties to the first name.
    coded = "greatest(" + ", ".join(f"case when n_{t} >= high then n_{t} * {w * 100} + {99 - r} else 0 end" for r, (t, w) in enumerate(kinds)) + ")"
    name = "case 99 - best % 100 " + " ".join(f"when {r} then {d.lit(t)}" for r, (t, _) in enumerate(kinds)) + " end"
    some = " + ".join(f"case when n_{t} >= low then 1 else 0 end" for t, _ in kinds)
    only = "case " + " ".join(f"when n_{t} >= low then {d.lit(t)}" for t, _ in kinds) + " end"
    return f"(select doc, coalesce(decided, case when best > 0 then {name} when {some} = 1 then {only} end, 'generic') as cmd_type from (select *, {coded} as best from {bounds} a4) a5)"


def resolve(d: Dialect, commands: str, lines: str, mapping: dict[str, str]) -> str:
    """(doc, cmd_type, source): user mapping, then registry, then detection, then none (P-06)."""
    mapped = "case command " + " ".join(f"when {d.lit(k)} then {d.lit(v)}" for k, v in mapping.items()) + " end" if mapping else "cast(null as varchar(20))"
    known = f"(select doc, command, {mapped} as mapped, nullif(cmd_type, 'generic') as known from {identify(d, commands)} i0)"
    return f"""(select k.doc, coalesce(mapped, known, nullif(a.cmd_type, 'generic'), 'generic') as cmd_type,
        case when mapped is not null then 'mapping' when known is not null then 'registry' when coalesce(a.cmd_type, 'generic') <> 'generic' then 'auto' else 'none' end as source
        from {known} k left join {auto_detect(d, lines)} a on k.doc = a.doc)"""
