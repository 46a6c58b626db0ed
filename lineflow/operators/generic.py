"""Generic operators, in chain order (F-00 to F-16).

Line operators take a relation (doc, pos, line) and give (doc, pos, sub, line), ordered by pos then sub; text operators
are expressions.  Every window is partitioned by doc and ordered by pos, so a chain of them costs one exchange.
"""

from __future__ import annotations

from lineflow.functions import patterns as P
from lineflow.functions.dialect import Dialect
from lineflow.functions.text import strip_ansi

#: Behind every position of a document.
LAST = 1 << 60
PREVIOUS = "partition by doc order by pos"
UPTO = "partition by doc order by pos rows between unbounded preceding and current row"


def crlf(d: Dialect, x: str) -> str:
    return d.replace(x, "\r\n", "\n")


def remove_by_rules(d: Dialect, src: str, rules: list[str]) -> str:
    """Lines that match no rule (F-01); without rules the relation as it is."""
    keep = f"not {d.any_of(rules, 'line')}" if rules else "true"
    return f"(select doc, pos, cast(0 as bigint) as sub, line from {src} where {keep})"


def strip_ansi_lines(d: Dialect, src: str) -> str:
    return f"(select doc, pos, cast(0 as bigint) as sub, {strip_ansi(d, 'line')} as line from {src})"


def strip_timestamps(d: Dialect, src: str) -> str:
    """One leading timestamp off each line of documents that have three or more of them (F-03); a line never goes blank."""
    hit = d.match("line", P.TIMESTAMP)
    new = d.sub("line", P.TIMESTAMP, r"\1")
    return f"""(select doc, pos, cast(0 as bigint) as sub, case when n >= 3 and hit and {d.trim(new)} <> '' then {new} else line end as line
        from (select *, sum(case when hit then 1 else 0 end) over (partition by doc) as n from (select doc, pos, line, {hit} as hit from {src}) s0) s1)"""


def normalise_whitespace(d: Dialect, x: str) -> str:
    """Closing blanks off lines, three or more LFs made two, the whole trimmed with one LF at the end (F-04)."""
    body = d.trim(d.sub(d.sub(x, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))
    return f"case when {body} = '' then '' else concat({body}, {d.lit(chr(10))}) end"


def dedup(d: Dialect, src: str) -> str:
    """Runs of equal lines become the first and a marker (F-05)."""
    runs = f"""(select doc, min(pos) as at0, min(line) as first, cast(count(*) as bigint) as n from (select *, sum(case when same then 0 else 1 end) over ({UPTO}) as run
            from (select doc, pos, line, coalesce(line = lag(line) over ({PREVIOUS}), false) as same from {src}) r0) r1 group by doc, run)"""
    marker = "concat('  ... (', cast(n - 1 as varchar(20)), case when n = 2 then ' duplicate line)' else ' duplicate lines)' end)"
    texts = f"case when n > 1 then {d.array('first', marker)} else {d.array('first')} end"
    rows = d.explode(f"(select doc, at0, {texts} as texts from {runs} r2)" + (" r3" if d.name == "duckdb" else ""), "doc, at0", "texts", "spot")
    return f"(select doc, at0 as pos, spot as sub, line from {rows} r4)"


def dedup_text(d: Dialect, src: str, keep: str = "") -> str:
    """dedup() of (doc, text) as (doc, text): rows stay where they are, for texts of which one fits in memory (F-05)."""
    keep = f", {keep}" if keep else ""
    lines = f"(select doc, {d.split('text', chr(10))} as a{keep} from {src})"
    heads = d.filter(d.upto(d.size("a")), "i", f"i > 0 and (i = 1 or {d.item('a', 'cast(i as int)')} <> {d.item('a', 'cast(i as int) - 1')})")
    runs = f"(select doc, a, {heads} as h{keep} from {lines} t0)"
    at, after = "cast(i as int)", f"coalesce({d.item('h', d.nth('k') + ' + 1')}, {d.size('a')} + 1)"
    marker = f"concat({d.lit(chr(10) + '  ... (')}, cast({after} - i - 1 as varchar(20)), case when {after} - i = 2 then ' duplicate line)' else ' duplicate lines)' end)"
    item = f"case when {after} - i > 1 then concat({d.item('a', at)}, {marker}) else {d.item('a', at)} end"
    return f"(select doc, {d.join(d.transform_at('h', 'i', 'k', item), chr(10))} as text{keep} from {runs} t1)"


def collapse_node_warnings(d: Dialect, src: str) -> str:
    """Blocks of the same warning from several workers become the first and a marker (F-06).

    A block is a header with its continuation lines, one row with its text.  Blocks are equal if their texts without
    process ids are, and a block equal to the one right before it joins its run.
    """
    head, more = d.match("line", P.NODE_WARNING), d.match("line", r"^[( \t]")
    one = f"(select *, sum(case when head or not more then 1 else 0 end) over ({UPTO}) as unit from (select doc, pos, line, {head} as head, {more} as more from {src}) w0)"
    two = f"(select doc, unit, min(pos) as pos, cast(count(*) as bigint) as size, max(case when head then 1 else 0 end) as is_block, {d.agg_join('line', 'pos', chr(10))} as text from {one} w1 group by doc, unit)"
    three = f"(select *, case when is_block = 1 then {d.sub('text', P.NODE_PID, '(node)')} end as body from {two} w2)"
    by = "partition by doc order by unit"
    four = f"(select *, case when coalesce(body = lag(body) over ({by}), false) then 0 else 1 end as starts from {three} w3)"
    five = f"(select *, sum(starts) over ({by} rows between unbounded preceding and current row) as run from {four} w4)"
    six = f"(select *, cast(count(*) over (partition by doc, run) - 1 as bigint) as others, max(unit) over (partition by doc, run) as last_unit from {five} w5)"
    # One row per unit carries what is left of it: its lines if it begins a run, the marker if it ends one.
    marker = "concat('... and ', cast(others as varchar(20)), case when others = 1 then ' identical warning' else ' identical warnings' end, ' from other workers')"
    ends = "others > 0 and unit = last_unit"
    texts = f"case when starts = 1 then {d.split('text', chr(10))} else {d.array(f'case when {ends} then {marker} end')} end"
    # A run of several begins and ends in different units.
    lines = d.explode(f"(select doc, pos as at0, size, starts, {texts} as texts from {six} w6 where starts = 1 or {ends})" + (" w7" if d.name == "duckdb" else ""), "doc, at0, size, starts", "texts", "spot")
    return f"(select doc, case when starts = 1 then at0 + spot else at0 + size - 1 end as pos, cast(1 - starts as bigint) as sub, line from {lines} w8)"


#: Secrets, in order of application: pattern and replacement.
SECRETS = (
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED]"),
    (r"\b(?:sk|pk)-[A-Za-z0-9_-]{16,}", "[REDACTED]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{16,}", "[REDACTED]"),
    (r"\bglpat-[A-Za-z0-9_-]{16,}", "[REDACTED]"),
    (r"\bxox[bpars]-[A-Za-z0-9-]{10,}", "[REDACTED]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED]"),
    (r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}(?:\.[A-Za-z0-9_-]+)?", "[REDACTED]"),
    (r"(?i)(bearer +)[A-Za-z0-9._~+/-]{8,}=*", r"\1[REDACTED]"),
    (r"([a-zA-Z][a-zA-Z0-9+.-]*://[^\s:/@]+:)[^\s@/]+@", r"\1[REDACTED]@"),
    (r"(?i)\b([A-Z0-9_]*(?:KEY|SECRET|TOKEN|PASSWORD|APIKEY)[A-Z0-9_]* *[=:] *[\"']?)[^\s\"'\[]{4,}", r"\1[REDACTED]"),
)


#: Texts of which one is held wherever the pattern of the same place matches; those of patterns in either case are in lower
#: case and without i, k and s at places where other letters fold to them without being lowered.
NEEDS = (
    ("PRIVATE KEY-----",), ("sk-", "pk-"), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("glpat-",), ("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"), ("AKIA",), ("eyJ",),
    ("bearer ",), ("://",), ("key", "ecret", "token", "word"),
)


def redact(d: Dialect, x: str) -> str:
    """Secrets replaced, whole private-key blocks first (F-07)."""
    if d.name == "spark":
        return redact_held(d, x)
    for pattern, new in SECRETS:
        x = d.sub(x, pattern, new)
    return x


def redact_held(d: Dialect, x: str) -> str:
    """redact() with a search for plain texts before each pattern, which spares most texts the pattern."""
    for (pattern, new), needs in zip(SECRETS, NEEDS):
        done = f"regexp_replace(x, {d.lit(pattern)}, {d.lit(new)})" if pattern.startswith("(?s)") else d.sub("x", pattern, new)
        low = d.lower("x") if pattern.startswith("(?i)") else "x"
        held = d.exists(d.array(low), "l", " or ".join(d.contains("l", d.lit(n)) for n in needs))
        # A lambda's name keeps the expression so far from being written, and run, several times.
        x = d.item(d.transform(d.array(x), "x", f"case when {held} then {done} else x end"), "1")
    return x


def compress_paths(d: Dialect, x: str, cwd: str, home: str) -> str:
    """Working and home directory shortened, literally and in this order (F-08)."""
    for old, new in ((cwd + "/", "./"), (cwd, "."), (home + "/", "~/"), (home, "~")):
        x = d.replace(x, old, new)
    return x


def decorative(d: Dialect, x: str) -> str:
    t = d.trim(x)
    return f"({d.octets(t)} >= 10 and {d.match(t, '^(?:-[- ]*|=[= ]*|_[_ ]*|~[~ ]*)$')})"


def drop_decorative(d: Dialect, src: str) -> str:
    """Lines without rules of one repeated sign (F-09)."""
    return f"(select doc, pos, cast(0 as bigint) as sub, line from {src} where not {decorative(d, 'line')})"


def keep_by_rules(d: Dialect, original: str, clean: str, rules: list[str]) -> str:
    """Original lines that match a rule and that the clean text (doc, text) no longer contains (F-14, J-09)."""
    return f"(select o.doc, o.pos, o.line from {original} o join {clean} c on o.doc = c.doc where {d.any_of(rules, 'o.line')} and not {d.contains('c.text', 'o.line')})"


def assemble(d: Dialect, src: str, sub: bool = True) -> str:
    """(doc, text): lines joined in order (K-01)."""
    return f"(select doc, {d.agg_join('line', 'pos, sub' if sub else 'pos', chr(10))} as text from {src} group by doc)"


def renumber(d: Dialect, src: str) -> str:
    """(doc, pos, line) with positions from 0, after an operator that inserted or dropped lines."""
    return f"(select doc, cast(row_number() over (partition by doc order by pos, sub) - 1 as bigint) as pos, line from {src})"


def split_lines(d: Dialect, src: str, keep: str = "") -> str:
    """(doc, pos, line) of a relation (doc, text) (S-01, S-05), and the columns `keep` of it."""
    keep = f", {keep}" if keep else ""
    return d.explode(f"(select doc, {d.split('text', chr(10))} as lines{keep} from {src})" + (" x0" if d.name == "duckdb" else ""), f"doc{keep}", "lines")


def chain(d: Dialect, src: str, cwd: str = "/home/u/app", home: str = "/home/u", remove: list[str] | None = None) -> str:
    """The generic chain over (doc, text), up to redaction: (doc, text)."""
    lines = split_lines(d, f"(select doc, {crlf(d, 'text')} as text from {src})" + (" t0" if d.name == "duckdb" else ""))
    lines = remove_by_rules(d, f"{lines} l1", remove or [])
    lines = strip_ansi_lines(d, f"{lines} l2")
    lines = strip_timestamps(d, f"{lines} l3")
    text = f"(select doc, {normalise_whitespace(d, 'text')} as text from {assemble(d, lines + ' l4')} t1)"
    lines = dedup(d, f"{split_lines(d, text + (' t2' if d.name == 'duckdb' else ''))} l5")
    lines = collapse_node_warnings(d, f"{renumber(d, lines + ' l6')} l7")
    text = assemble(d, f"{drop_decorative(d, renumber(d, lines + ' l8') + ' l9')} l10")
    return f"(select doc, {redact(d, compress_paths(d, 'text', cwd, home))} as text from {text} t3)"


def stderr_chain(d: Dialect, src: str) -> str:
    """What is done to stderr (doc, text): escape codes, secrets, then warnings of several workers (F-15): (doc, text)."""
    lines = strip_ansi_lines(d, f"{split_lines(d, src)} e1")
    text = f"(select doc, {redact(d, 'text')} as text from {assemble(d, lines + ' e2')} e3)"
    lines = collapse_node_warnings(d, f"{split_lines(d, text + (' e4' if d.name == 'duckdb' else ''))} e5")
    return assemble(d, f"{lines} e6")
