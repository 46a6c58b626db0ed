"""Search modes, walking and globbing (S-04 to S-08, H-01 to H-09, W-11, A-18, A-19, T-08 to T-10)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from lineflow.functions import patterns as P
from lineflow.functions import text as T
from lineflow.functions.dialect import Dialect
from lineflow.operators import classify
from lineflow.operators.generic import LAST, PREVIOUS

ORDER = "partition by path order by pos"


def base_name(d: Dialect, x: str) -> str:
    return d.sub(x, r"^.*/", "")


def extension(d: Dialect, x: str) -> str:
    return d.extract(base_name(d, x), r"\.([^.]+)$", 1)


def _folders(d: Dialect, x: str) -> str:
    return d.split(d.sub(x, r"/?[^/]*$", ""), "/")


def walkable(d: Dialect, x: str, extensions: tuple[str, ...] = ()) -> str:
    """Paths that a search opens: no excluded folder, lock file or binary; optionally of given extensions (S-04).

    `x` is relative to the root, or begins with its name; extensions are compared in lower case.
    """
    folders = d.exists(_folders(d, x), "s", f"s in ({', '.join(map(d.lit, P.SKIP_DIRS))})")
    kind = d.lower(extension(d, x))
    only = f" and {kind} in ({', '.join(map(d.lit, extensions))})" if extensions else ""
    return f"(not {folders} and {base_name(d, x)} not in ({', '.join(map(d.lit, P.SKIP_FILES))}) and {kind} not in ({', '.join(map(d.lit, P.BINARY))}){only})"


def watchable(d: Dialect, x: str, extensions: tuple[str, ...] = ()) -> str:
    """Paths that the watcher looks at: outside hidden and a few other folders, of given extensions as written (S-14)."""
    hidden = "(substr(s, 1, 1) = '.' and s <> '.')"
    folders = d.exists(_folders(d, x), "s", f"{hidden} or s in ({', '.join(map(d.lit, P.WATCH_SKIP_DIRS))})")
    only = f" and {extension(d, x)} in ({', '.join(map(d.lit, extensions))})" if extensions else ""
    return f"(not {folders}{only})"


def glob_regex(pattern: str) -> tuple[str, bool]:
    """(regex, whole path): `*`, `?` and classes never cross a slash; a leading `**/` is dropped (S-06)."""
    pattern = pattern.removeprefix("**/")
    out = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, c if c in "[]-" else re.escape(c)) for c in pattern)
    return f"^{out}$", "/" in pattern


def glob(d: Dialect, src: str, pattern: str, most: int = 500) -> str:
    """The first `most` matching paths in walk order, which compares names folder by folder."""
    rx, whole = glob_regex(pattern)
    x = "path" if whole else base_name(d, "path")
    return f"(select path from {src} where {d.match(x, rx)} order by {d.split('path', '/')} limit {most})"


def glob_clusters(d: Dialect, src: str, least: int = 30) -> str:
    """Results by folder with their names, once there are `least` of them (A-19)."""
    dirs = f"(select path, {d.sub('path', '[^/]*$', '')} as dir, {base_name(d, 'path')} as name, row_number() over (partition by {d.sub('path', '[^/]*$', '')} order by path) as i from {src})"
    return f"(select dir, cast(count(*) as bigint) as n, concat(dir, ' (', cast(count(*) as varchar(20)), '): ', {d.agg_join('name', 'i', ' ')}) as line from {dirs} g where (select count(*) from {src.rsplit(' ', 1)[0]} g2) >= {least} group by dir)"


def matches(d: Dialect, src: str, pattern: str, fold: bool = False) -> str:
    """Matching lines of (path, pos, line); an empty pattern matches nothing (H-03, S-08)."""
    return f"(select path, pos, line from {src} where {d.match('line', ('(?i)' if fold else '') + pattern) if pattern else 'false'})"


def listing(d: Dialect, src: str, pattern: str, recursive: bool = False, ignore_case: bool = False, number: bool = False) -> str:
    """(path, pos, line): matches as the grep tool lists them (S-08).

    Without any option the listing is recursive with line numbers; a recursive one puts the path before every match, one
    with numbers the place of the line.
    """
    if not (recursive or ignore_case or number):
        recursive = number = True
    head = [x for x, on in (("path", recursive), ("cast(pos + 1 as varchar(20))", number)) if on]
    line = f"concat({', '.join(y for x in head for y in (x, d.lit(':')))}, line)" if head else "line"
    return f"(select path, pos, {line} as line from {matches(d, src, pattern, fold=ignore_case)} g0)"


def no_match(d: Dialect, found: str) -> str:
    """(line): the notice of a search without matches, or no row (S-08)."""
    return f"(select '[no matches found]' as line from {found} n0 having count(*) = 0)"


#: Where the lines of a file's listing stand: a blank line before it, its header, its lines, a blank line after it.
BEFORE, HEADER, AFTER = -2, -1, LAST


def _number(pos: str) -> str:
    return f"cast({pos} + 1 as varchar(20))"


def _between(d: Dialect, files: str) -> str:
    """Blank lines before every file but the first in walk order."""
    order = d.split("path", "/")
    return f"select path, cast({BEFORE} as bigint) as pos, cast(0 as bigint) as sub, '' as line from {files} b0 where path <> (select {d.first_by('path', order)} from {files} b1)"


def _listed(d: Dialect, rows: str, texts: Sequence[str], pos: str, sub: str) -> str:
    """(path, pos, sub, line): the texts of every row that aren't null; `pos` and `sub` may use their place `spot`."""
    listed = d.explode(f"(select path, pos as at0, {d.array(*texts)} as texts from {rows})" + (" y0" if d.name == "duckdb" else ""), "path, at0", "texts", "spot")
    return f"(select path, cast({pos} as bigint) as pos, cast({sub} as bigint) as sub, line from {listed} y1 where line is not null)"


def _later(d: Dialect, files: str) -> str:
    """Whether a file isn't the first with matches in walk order."""
    return f"path <> (select {d.first_by('path', d.split('path', '/'))} from {files} b1)"


def scan(d: Dialect, src: str, pattern: str, width: int = 120) -> str:
    """`Nx path` and its matches, each line cut to `width` (H-04, T-10): (path, pos, sub, line)."""
    m = f"{matches(d, src, pattern)} m"
    text = T.ellipsis(d, f"concat('  ', {_number('pos')}, ': ', {d.trim('line')})", width)
    one = f"(select *, row_number() over ({ORDER}) as i, count(*) over (partition by path) as n from {m})"
    texts = [f"case when i = 1 and {_later(d, matches(d, src, pattern))} then '' end", "case when i = 1 then concat(cast(n as varchar(20)), 'x ', path) end", text]
    return _listed(d, f"{one} s0", texts, f"case spot when 0 then {BEFORE} when 1 then {HEADER} else at0 end", "0")


def detail(d: Dialect, src: str, pattern: str, context: int = 3) -> str:
    """Matches with `context` lines around them under `--- path:line ---`; windows that touch are one, those of one file are
    parted by `  ...` (H-05, J-07): (path, pos, sub, line)."""
    context = context if context > 0 else 3
    hit = d.match("line", pattern) if pattern else "false"
    one = f"(select *, max(case when hit then 1 else 0 end) over ({ORDER} rows between {context} preceding and {context} following) as near from (select path, pos, line, {hit} as hit from {src}) d0)"
    two = f"(select *, pos - lag(pos) over ({ORDER}) as gap from {one} d1 where near = 1)"
    texts = [
        f"case when gap is null and {_later(d, matches(d, src, pattern))} then '' end", "case when gap > 1 then '  ...' end", f"case when coalesce(gap, 2) > 1 then concat('--- ', path, ':', {_number('pos')}, ' ---') end",
        f"concat(case when hit then '> ' else '  ' end, {_number('pos')}, ': ', line)",
    ]
    return _listed(d, f"{two} d2", texts, f"case when spot = 0 then {BEFORE} else at0 end", "greatest(spot - 1, 0)")


def definitions(d: Dialect, src: str, pattern: str, width: int = 120) -> str:
    """Matches that define something, by the file's language, under its path; files without any give all their matches
    (H-06): (path, pos, sub, line)."""
    m = f"(select path, pos, line, {classify.by_extension(d, P.DEFINITIONS, extension(d, 'path'), d.trim('line'))} as def from {matches(d, src, pattern)} m0)"
    files = f"(select distinct path from {matches(d, src, pattern)} m3)"
    heads = " union all ".join(f"select path, cast({k} as bigint) as pos, cast(0 as bigint) as sub, {x} as line from {files} f{j}" for j, (k, x) in enumerate(((HEADER, "path"), (AFTER, "''"))))
    return f"""({heads} union all select path, pos, cast(0 as bigint) as sub, concat('  ', {_number('pos')}, ': ', {T.ellipsis(d, d.trim('line'), width - 8)}) as line
        from (select *, max(case when def then 1 else 0 end) over (partition by path) as any_def from {m} m1) m2 where def or any_def = 0)"""


def skeleton(d: Dialect, src: str, pattern: str, width: int = 120) -> str:
    """Structural lines of every file with a match under `== path ==` (H-07, P-17): (path, pos, sub, line)."""
    files = f"(select distinct path from {matches(d, src, pattern)} k0)"
    trimmed = f"(select path, pos, {d.trim('line')} as line from {src})"
    lines = f"(select s.path, s.pos, s.line from {trimmed} s join {files} f on s.path = f.path where {classify.by_extension(d, P.SKELETON, extension(d, 's.path'), 's.line')})"
    return f"""({_between(d, files)} union all select path, cast({HEADER} as bigint) as pos, cast(0 as bigint) as sub, concat('== ', path, ' ==') as line from {files} f1
        union all select path, pos, cast(0 as bigint) as sub, concat('  ', {_number('pos')}, ': ', {T.ellipsis(d, 'line', width - 8)}) as line from {lines} k1
        union all select f2.path, cast(0 as bigint) as pos, cast(0 as bigint) as sub, '  (no structure detected)' as line from {files} f2 left join (select distinct path as found from {lines} k2) k3 on f2.path = found where found is null)"""


def by_folder(d: Dialect, src: str, pattern: str) -> str:
    """Files and matches by folder (H-08, A-18); a path without a slash lies in `.`."""
    folder = f"case when {d.contains('path', d.lit('/'))} then {d.sub('path', '/[^/]*$', '')} else '.' end"
    return f"(select dir, cast(count(distinct path) as bigint) as files, cast(count(*) as bigint) as n from (select path, {folder} as dir from {matches(d, src, pattern)} b0) b1 group by dir)"


def folder_table(d: Dialect, src: str, pattern: str) -> str:
    """by_folder() as a table, most matches first, ties by name: (path, pos, sub, line) with an empty path."""
    rows = by_folder(d, src, pattern)
    name = f"case when {d.chars('dir')} <= 40 then dir else concat('...', substr(dir, cast({d.chars('dir')} - 36 as int))) end"
    head = [f"concat('Pattern: ', {d.lit(pattern)})", "concat('Total: ', cast(sum(n) as varchar(20)), ' matches in ', cast(sum(files) as varchar(20)), ' files')", "''", d.printf("%-40s %6s %8s", "'Directory'", "'Files'", "'Matches'"), d.lit("-" * 56)]
    heads = " union all ".join(f"select '' as path, cast({k - len(head)} as bigint) as pos, cast(0 as bigint) as sub, {x} as line from {rows} t{k} having count(*) > 0" for k, x in enumerate(head))
    return f"({heads} union all select '' as path, cast(row_number() over (order by n desc, dir) - 1 as bigint) as pos, cast(0 as bigint) as sub, {d.printf('%-40s %6d %8d', name, 'files', 'n')} as line from {rows} t9)"


@dataclass(frozen=True)
class Options:
    """A search (H-02); the mode is scan, detail, def, tree or summary."""

    pattern: str = ""
    folder: str = "."
    mode: str = "scan"
    context: int = 3
    types: tuple[str, ...] = ()
    glob: str = ""
    max_results: int = 0
    width: int = 120


def parse_flags(args: Sequence[str]) -> Options:
    """Options from arguments: -d [n], --def, --tree, --summary, -t ext, -g glob, -m n, -p folder, pattern, folder (H-02)."""
    out, free, i = Options(), [], 0
    named = {"-t": "types", "--type": "types", "-g": "glob", "--glob": "glob", "-m": "max_results", "--max": "max_results", "-p": "folder", "--path": "folder"}
    while i < len(args):
        a = args[i]
        if a in ("-d", "--detail"):
            out = replace(out, mode="detail")
            if i + 1 < len(args) and re.fullmatch(r"[+-]?[0-9]+", args[i + 1]):
                out, i = replace(out, context=int(args[i + 1])), i + 1
        elif a in ("--def", "--tree", "--summary"):
            out = replace(out, mode=a[2:])
        elif field := named.get(a):
            if i + 1 >= len(args):
                raise ValueError(f"flag {a} requires an argument")
            i += 1
            value = args[i]
            if field == "max_results" and not re.fullmatch(r"[+-]?[0-9]+", value):
                raise ValueError(f"invalid max results: {value}")
            out = replace(out, **{field: (*out.types, value.removeprefix(".")) if field == "types" else int(value) if field == "max_results" else value})
        elif a.startswith("-"):
            raise ValueError(f"unknown flag: {a}")
        else:
            free.append(a)
        i += 1
    return replace(out, pattern=free[0] if free else out.pattern, folder=free[1] if len(free) > 1 else out.folder)


def run(d: Dialect, src: str, options: Options) -> str:
    """A whole search over (path, pos, line): walk rules, glob, first files, and the listing of the mode (H-01, H-09)."""
    if not options.pattern and options.mode != "tree":
        raise ValueError("missing search pattern")
    keep = [walkable(d, "path", options.types)]
    if options.glob:
        rx, whole = glob_regex(options.glob)
        keep.append(d.match("path" if whole else base_name(d, "path"), rx))
    rows = f"(select path, pos, line from {src} where {' and '.join(keep)})"
    if options.max_results > 0:
        first = f"(select path as hit from (select distinct path from {matches(d, rows + ' r0', options.pattern)} r1) r2 order by {d.split('path', '/')} limit {options.max_results})"
        rows = f"(select path, pos, line from {rows} r3 join {first} r4 on path = hit)"
    rows += " r5"
    if options.mode == "detail":
        return detail(d, rows, options.pattern, options.context)
    if options.mode == "summary":
        return folder_table(d, rows, options.pattern)
    return {"scan": scan, "def": definitions, "tree": skeleton}[options.mode](d, rows, options.pattern, options.width)


def capped(d: Dialect, src: str, most: int = 10) -> str:
    """Grouped matches (doc, pos, line), `>> path` headers with indented lines under them, with at most `most` of a file and
    one marker for the rest, which stands before the next header, blank or other line (W-11, T-09); most <= 0 keeps all."""
    if most <= 0:
        return f"(select doc, pos, cast(0 as bigint) as sub, line from {src})"
    match = f"({d.starts('line', '  ')} and {d.trim('line')} <> '')"
    # Every line that is no match ends the count before it, and the marker takes the place right before that line.
    one = f"(select *, sum(case when is_match then 0 else 1 end) over ({PREVIOUS} rows between unbounded preceding and current row) as block from (select doc, pos, line, {match} as is_match from {src}) c0)"
    two = f"(select *, row_number() over (partition by doc, block, is_match order by pos) as i, count(*) over (partition by doc, block, is_match) as n from {one} c1)"
    return f"(select doc, pos, cast(0 as bigint) as sub, case when is_match and i = {most} + 1 then concat('  … ', cast(n - {most} as varchar(20)), ' more in this file') else line end as line from {two} c2 where not is_match or i <= {most} + 1)"
