"""Scalar functions over text and lines, as SQL expressions of either engine."""

from __future__ import annotations

from lineflow.functions import patterns as P
from lineflow.functions.dialect import Dialect


def words(d: Dialect, x: str) -> str:
    return d.size(d.all(x, r"[^ \t\n\f\r\v]+"))


def tokens(d: Dialect, x: str) -> str:
    """Token estimate: the larger of words * 1.3 and bytes / 4, both cut; 0 for empty text (X-01)."""
    return f"greatest(cast(floor({d.double(words(d, x))} * {d.double('1.3')}) as bigint), {d.div(d.octets(x), '4')})"


def line_count(d: Dialect, x: str) -> str:
    """Lines of a text, a closing LF not counted twice (X-02)."""
    lf = f"({d.chars(x)} - {d.chars(d.replace(x, chr(10), ''))})"
    return f"case when {x} = '' then 0 when {d.match(x, chr(92) + 'n' + chr(92) + 'z') if d.name == 'duckdb' else x + ' like ' + d.lit('%' + chr(10))} then {lf} else {lf} + 1 end"


def core(d: Dialect, x: str) -> str:
    """Content after `file:line:`, trimmed, else empty (X-03)."""
    return d.trim(d.extract(x, r"^[^:]*:[^:]*:((?s:.*))$", 1)) if d.name == "duckdb" else d.trim(f"regexp_extract({x}, {d.lit('(?s)^[^:]*:[^:]*:(.*)')}, 1)")


def normalise(d: Dialect, x: str) -> str:
    """Variable parts replaced by placeholders, most specific first (X-04)."""
    out = d.trim(x)
    for name, pattern in P.NORMAL:
        out = d.sub(out, pattern, f"<{name}>")
    return out


#: What a placeholder matches in a learned pattern.
PLACEHOLDERS = {
    "UUID": r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    "HASH": r"[0-9a-f]+",
    "TIMESTAMP": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\S*",
    "DATE": r"\d{4}[-/]\d{2}[-/]\d{2}",
    "TIME": r"\d{2}:\d{2}:\d{2}\S*",
    "SIZE": r"\d+(\.\d+)?\s*(B|KB|MB|GB|TB|KiB|MiB|GiB|TiB|bytes)",
    "DURATION": r"\d+(\.\d+)?\s*(ms|µs|ns|us|s|m|h)",
    "IP": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?",
    "VERSION": r"v?\d+\.\d+\.\d+[-\w.]*",
    "N": r"\d+(\.\d+)?",
}


def to_regex(d: Dialect, x: str) -> str:
    """A normalised line as a pattern: literals escaped, placeholders opened (X-05)."""
    out = d.sub(x, r"([.*+?()\[\]{}|^$\\])", r"\\\1") if d.name == "duckdb" else f"regexp_replace({x}, {d.lit('([.*+?()' + chr(92) + '[' + chr(92) + ']{}|^$' + chr(92) * 2 + '])')}, {d.lit(chr(92) * 2 + '$1')})"
    for name, pattern in PLACEHOLDERS.items():
        out = d.replace(out, f"<{name}>", pattern)
    return f"concat({d.lit(chr(94) + chr(92) + 's*')}, {out})"


def thousands(d: Dialect, x: str) -> str:
    """A whole number with thousands separators (X-06)."""
    return f"format_number({x}, 0)" if d.name == "spark" else f"format('{{:,}}', ({x})::bigint)"


def duration(d: Dialect, us: str) -> str:
    """Microseconds, or milliseconds with one decimal from 1000 on (X-07)."""
    tenth = f"cast(floor({d.double(us)} / 100.0 + 0.5) as bigint)"
    return f"case when {us} < 1000 then concat(cast({us} as varchar(20)), 'µs') else concat(cast({d.div(tenth, '10')} as varchar(20)), '.', cast({tenth} % 10 as varchar(20)), 'ms') end"


def ellipsis(d: Dialect, x: str, most: int) -> str:
    """Cut to `most` characters, the last three of them dots (X-08)."""
    return f"case when {d.chars(x)} > {most} then concat(substr({x}, 1, {most - 3}), '...') else {x} end"


def strip_ansi(d: Dialect, x: str) -> str:
    return d.sub(x, P.ANSI, "")


def plural(d: Dialect, n: str, one: str, many: str) -> str:
    return f"case when {n} = 1 then {d.lit(one)} else {d.lit(many)} end"


def leading(d: Dialect, x: str, tab: int = 4) -> str:
    """Width of the leading white space, a tab counting `tab` (X-13)."""
    return d.chars(d.replace(d.extract(x, r"^[ \t]*"), "\t", " " * tab))


def leading_text(d: Dialect, x: str) -> str:
    """The leading spaces and tabs themselves (X-13)."""
    return d.extract(x, r"^[ \t]*")


def stats_line(d: Dialect, raw: str, clean: str, important: str, name: str = "lineflow") -> str:
    """Lines and bytes before and after, whole percent saved, and important lines that are left, if any (X-15)."""
    n = lambda x: f"cast({x} as varchar(20))"
    percent = f"case when {d.octets(raw)} > 0 then {d.div(f'({d.octets(raw)} - {d.octets(clean)}) * 100', d.octets(raw))} else 0 end"
    tail = f"case when {important} > 0 then concat(', ', {n(important)}, ' errors/warnings preserved]') else ']' end"
    return f"concat({d.lit(f'[{name}: ')}, {n(line_count(d, raw))}, ' → ', {n(line_count(d, clean))}, ' lines, ', {n(d.octets(raw))}, ' → ', {n(d.octets(clean))}, ' bytes (-', {n(percent)}, '%)', {tail})"


def percent_saved(d: Dialect, raw: str, clean: str) -> str:
    return f"case when {raw} > 0 then {d.double(f'({raw} - {clean})')} / {d.double(raw)} * 100 else {d.double('0')} end"


def version_key(d: Dialect, x: str) -> list[str]:
    """What versions are ordered by: three numbers, a release after its pre-releases, those by their text (X-17)."""
    part = lambda k: f"cast(coalesce(nullif({d.extract(x, r'^v?([0-9]+)(?:[.]([0-9]+))?(?:[.]([0-9]+))?', k)}, ''), '0') as bigint)"
    pre = d.extract(x, r"^[^-+]*[-+](.*)$", 1)
    return [part(1), part(2), part(3), f"case when coalesce({pre}, '') = '' then 1 else 0 end", f"coalesce({pre}, '')"]


def tree_name(d: Dialect, x: str) -> str:
    """Entry name of a tree line, without branches (X-14)."""
    return d.trim(d.sub(x, r"^[│├└─┬┤┼╠╚═╔╗╝╬║ \t|+\\`-]+", ""))


def tree_depth(d: Dialect, x: str) -> str:
    """Width of the branches before an entry (X-14)."""
    return d.chars(d.extract(x, r"^[ │|\t]*"))


def age(d: Dialect, seconds: str) -> str:
    """Age text of a snapshot (X-18)."""
    ago = lambda by, unit: f"concat(cast({d.div(seconds, str(by))} as varchar(20)), '{unit} ago')"
    return f"case when {seconds} < 60 then 'just now' when {seconds} < 3600 then {ago(60, 'm')} when {seconds} < 86400 then {ago(3600, 'h')} else {ago(86400, 'd')} end"
