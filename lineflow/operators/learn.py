"""Noise learning (A-08 to A-10, X-04, X-05) and request tracking (J-05, P-12 to P-14, P-18, A-20, X-11)."""

from __future__ import annotations

from lineflow.functions import patterns as P
from lineflow.functions import text as T
from lineflow.functions.dialect import Dialect
from lineflow.operators import classify


def observe(d: Dialect, src: str) -> str:
    """(ts, session, cmd, norm, level) of non-blank lines of (doc, pos, line, ts, session, cmd) (A-09)."""
    lines = f"(select *, {d.lower('t')} as low from (select *, {d.trim('line')} as t from {src}) o0 where t <> '')"
    return f"(select ts, session, cmd, {T.normalise(d, 'line')} as norm, cast({classify.level(d, 'line', 't', 'low')} as int) as level from {lines} o1)"


def analyse(d: Dialect, src: str, sessions: int = 3, least: float = 0.05, most: float = 0.30, noise: float = 0.80, top: int = 20, members: str | None = None) -> str:
    """Candidates for removal (A-08, T-07): normalised lines of middling frequency, nearly all noise, none a warning.

    `members` has the same columns and at least the lines that are frequent enough; without it they are looked for in `src`.
    """
    total = f"(select cast(count(*) as bigint) as total, count(distinct session) as sessions from {src})"
    groups = f"(select norm, cast(count(*) as bigint) as n, {d.int_sum(f'case when level <= {P.DEBUG} then 1 else 0 end')} as noisy, max(level) as top_level, {d.join(d.sorted_set('cmd'), ',')} as commands from {members or src} group by norm)"
    freq, share = f"{d.double('n')} / {d.double('total')}", f"{d.double('noisy')} / {d.double('n')}"
    return f"""(select norm, {T.to_regex(d, 'norm')} as pattern, n, round({freq}, 6) as frequency, round({share}, 6) as noise_score, commands from {groups} g cross join {total} t
        where sessions >= {sessions} and {freq} >= {least} and {freq} <= {most} and {share} >= {noise} and top_level < {P.WARNING} order by n desc, norm limit {top})"""


#: Items that the engine's sketch can track at most.
MOST_TRACKED = 1_000_000


def frequent(src: str, least: float) -> str:
    """Rows of `src` (Spark) whose norm may make up `least` of all; no norm that does is lost.

    A frequent-items sketch over hashes of the lines finds them, two longs for each of 16 / least items a task.  With so
    many items its error is under least / 6 of all rows, so that every frequent line is in it, and under 2 / least lines
    have an estimate as high as any of them: these are broadcast.  Lines of one hash are counted as one, which can only
    let more through.  Only what comes through is classified, grouped and shuffled.
    """
    kept, tracked = -int(-2 // least), -int(-16 // least)
    if tracked > MOST_TRACKED:
        return src
    heavy = f"(select explode(k) as item from (select approx_top_k(xxhash64(norm), {kept}, {tracked}) as k from {src}))"
    return f"(select /*+ broadcast(h) */ o.* from (select * from {src}) o left semi join {heavy} h on xxhash64(o.norm) = h.item.item) m"


def analyse_frequent(d: Dialect, src: str, least: float = 0.05, **options) -> str:
    """`analyse` in Spark with a shuffle that doesn't grow with the number of different lines."""
    return analyse(d, src, least=least, members=frequent(src, least), **options)


def statistics(d: Dialect, src: str) -> str:
    """Size and span of the learn store (A-10); `src` has a column ts."""
    return f"(select cast(count(*) as bigint) as n, cast(count(distinct session) as bigint) as sessions, cast(count(distinct cmd) as bigint) as commands, min(ts) as oldest, max(ts) as newest from {src})"


def rerequests(d: Dialect, src: str, window_us: int = 120_000_000) -> str:
    """(id, type): the newest earlier request of the same tool and key within the window makes a request an escalation, an
    exact or a similar repeat (J-05); `lag` finds it, no range join."""
    by = "over (partition by tool, key order by us, id)"
    prev = f"(select *, lag(us) {by} as p_us, lag(raw_key) {by} as p_raw, lag(max_lines) {by} as p_max, lag(no_trunc) {by} as p_no from {src})"
    more = "((no_trunc and not p_no) or (p_max > 0 and max_lines > p_max))"
    return f"(select id, case when {more} then 'escalation' when p_raw = raw_key then 'exact' else 'similar' end as type, us - p_us as since_us from {prev} r0 where p_us is not null and us - p_us <= {window_us})"


def cache_totals(d: Dialect, src: str) -> str:
    """Hits and misses of an unbounded cache by key (A-20)."""
    return f"(select key, cast(count(*) - 1 as bigint) as hits, cast(1 as bigint) as misses from {src} group by key)"


def _in(d: Dialect, x: str, words: tuple[str, ...]) -> str:
    return f"{x} in ({', '.join(map(d.lit, words))})"


def fields(d: Dialect, x: str) -> str:
    return d.all(x, r"[^ \t\n\f\r\v]+")


def _base(d: Dialect, x: str) -> str:
    """Last element of a path; a path of slashes alone is one slash."""
    return f"case when {d.match(x, '^/+$')} then '/' else {d.sub(d.sub(x, '/+$', ''), '^.*/', '')} end"


def first_word(d: Dialect, x: str) -> str:
    """The command's name: the first word that sets no variable, without its folder; empty if there is none."""
    plain = d.filter(fields(d, x), "w", f"not {d.contains('w', d.lit('='))} or {d.contains('w', d.lit('/'))}")
    return f"coalesce({_base(d, d.item(plain, '1'))}, '')"


def skipped(d: Dialect, x: str, name: str = "lineflow") -> str:
    """Nothing to run, trivial, interactive, the filter itself, or already piped into it (P-12)."""
    w = first_word(d, x)
    piped = " or ".join(d.contains(x, d.lit(bar + name)) for bar in ("| ", "|"))
    return f"({w} in ('', {d.lit(name)}) or {_in(d, w, P.TRIVIAL)} or {_in(d, w, P.INTERACTIVE)} or {piped})"


def wrapped(d: Dialect, x: str, name: str = "lineflow") -> str:
    """The command piped into the filter, or as it is: already piped, the filter itself, trivial, or only settings (P-12)."""
    plain = d.filter(fields(d, x), "w", f"not {d.contains('w', d.lit('='))} or {d.starts('w', '-')} or {d.contains('w', d.lit('/'))}")
    w = f"coalesce({_base(d, d.item(plain, '1'))}, {_base(d, d.item(fields(d, x), '1'))}, '')"
    t = d.trim(x)
    piped = " or ".join(d.contains(x, d.lit(bar + name)) for bar in ("| ", "|"))
    settings = f"({d.contains(w, d.lit('='))} and not {d.contains(w, d.lit('/'))})"
    return f"case when {piped} or {t} = {d.lit(name)} or {d.starts(t, name + ' ')} or {_in(d, w, P.TRIVIAL)} or {settings} then {x} else concat('set -o pipefail; (', {x}, {d.lit(') | ' + name)}) end"


def command_name(d: Dialect, words: str) -> str:
    """Lower-case name of the command in an array of words, past settings and prefixes such as sudo; else of the first."""
    plain = d.filter(words, "w", f"not {d.contains('w', d.lit('='))} and not {_in(d, d.lower('(' + _base(d, 'w') + ')'), P.PREFIXES)}")
    return f"coalesce({d.lower('(' + _base(d, d.item(plain, '1')) + ')')}, {d.lower('(' + _base(d, d.item(words, '1')) + ')')}, '')"


def denied(d: Dialect, x: str) -> str:
    """Denied name, download piped into a shell, fork bomb, write to a disk, or a name with denied arguments (P-13)."""
    words = fields(d, x)
    name, rest = command_name(d, words), d.slice(words, 2, d.size(words))
    tests = [_in(d, name, P.DENIED), d.starts(name, "mkfs.")]
    tests += [d.contains(d.lower(x), d.lit(p)) for p in P.DENIED_PIPES] + [d.contains(x, d.lit(p)) for p in P.DENIED_TEXTS]
    for cmd, texts, alone in P.DENIED_ARGUMENTS:
        each = [f"{name} = {d.lit(cmd)}", *(d.contains(d.join(rest, " "), d.lit(t)) for t in texts)]
        tests.append("(" + " and ".join(each + ([d.exists(rest, "w", f"w = {d.lit(alone)}")] if alone else [])) + ")")
    return "(" + " or ".join(tests) + ")"


def sandboxed(d: Dialect, x: str) -> str:
    """No redirection, and every stage of the pipe that isn't blank is a read-only command (P-14)."""
    bad = d.exists(d.split(x, "|"), "s", f"{d.trim('s')} <> '' and not {_in(d, command_name(d, fields(d, 's')), P.READ_ONLY)}")
    return f"(not {d.contains(x, d.lit('>'))} and not {bad})"


def request_key(d: Dialect, tool: str, text: str, path: str = "''") -> str:
    """Normalised key of a request (X-11): exec by its first word as it stands, read by path, grep by pattern and path,
    anything else by the first 8 bytes of the text's SHA-256."""
    word = f"coalesce({d.item(fields(d, text), '1')}, '')"
    return f"case {tool} when 'exec' then concat('exec:', {word}) when 'read' then concat('read:', {path}) when 'grep' then concat('grep:', {text}, ':', {path}) else concat('filter:', substr({d.sha256(text)}, 1, 16)) end"


def config_fingerprint(d: Dialect, filters: str, rules: str, mode: str, redact: str) -> str:
    """128 bits of the settings that change a result (X-10)."""
    return f"substr({d.sha256(f'concat({filters}, {d.lit(chr(124))}, {rules}, {d.lit(chr(124))}, {mode}, {d.lit(chr(124))}, {redact})')}, 1, 32)"


def cache_key(d: Dialect, fingerprint: str, kind: str, most: str, text: str) -> str:
    """Key of a cached result: fingerprint, NUL, number of the command type, line limit, raw text (X-10)."""
    return d.sha256(f"concat({fingerprint}, {d.nul()}, cast({kind} as varchar(20)), ':', cast({most} as varchar(20)), ':', {text})")
