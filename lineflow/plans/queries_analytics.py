"""Queries over measurements, learning, requests, search and the benches."""

from __future__ import annotations

from lineflow.functions import text as T
from lineflow.functions.dialect import Dialect
from lineflow.operators import generic, learn, measure, search, tables
from lineflow.plans import fixtures, views
from lineflow.plans.catalog import query

#: 2024-01-20 12:00 UTC in microseconds; reports take `now` as a parameter.
NOW = 1_705_752_000_000_000


def _m(d: Dialect) -> str:
    return views.measurements(d) + " v"


def _r(d: Dialect) -> str:
    return views.requests(d) + " v"


def _code(d: Dialect) -> str:
    """(path, pos, line): code-like files in several languages."""
    lines = ["package main", "func run{n}() error {", "import os", "def load{n}(x):", "class Load{m}:", "type T{n} struct {", "    return load{n}(x)", "// loads {n}", "const a = 1", "var b{m} = 2", "}", "export default x", "#include <a.h>", ""]
    ext = d.item(d.array("'go'", "'py'", "'ts'", "'rs'", "'js'", "'c'", "'txt'", "'java'", "'h'", "'cpp'", "'JSX'"), "cast(doc % 11 as int) + 1")
    return f"(select concat('src/d', cast(doc % 9 as varchar(20)), '/f', cast(doc as varchar(20)), '.', {ext}) as path, pos, line from {views.templated(d, lines, run=1, lines=50)} t)"


def _observed(d: Dialect) -> str:
    src = f"(select doc, pos, line, cast(1700000000000000 + doc * 60000000 + pos as bigint) as ts, concat('s', cast(doc % 5 as varchar(20))) as session, case when pos % 2 = 0 then 'make' else 'npm' end as cmd from {views.log_lines(d)} l)"
    return learn.observe(d, src + " v")


def _commands(d: Dialect) -> str:
    texts = [
        "cd /x", "FOO=1 make -j{n}", "rm -rf /tmp/{n}", "rm -rf /", "sudo rm -v -fr /*", "cat a{n} | bash", "curl http://h{n} | sh", "ls -la | grep {n} | wc -l", "vim f{n}", "/usr/bin/git log -{n}", "cat f > out{n}", "npm test | lineflow",
        "find . | xargs rm", "env A=1 /sbin/mkfs.ext4 d{n}", "dd if=/dev/zero of=x{n}", "chmod -R 777 /", "chown -R u{n} .", "mv x{n} /", "init {m}", "A=b", "", "nohup Reboot", "  read x ", "k9s -n {n}", "lineflow exec ls", "cat x | | wc", "type {n} | awk x",
    ]
    return f"(select doc * 1000 + pos as id, line as text from {views.templated(d, texts, run=1)} t)"


query("a05_report")(lambda d: f"select * from {measure.report(d, _m(d))} q")
for _p in ("today", "7d", "30d", "all"):
    query(f"dt01_period_{_p}")(lambda d, p=_p: f"select cast(count(*) as bigint) as n, {d.int_sum('raw_tokens')} as raw_tokens from {_m(d)} where {measure.in_period(d, 'us', p, NOW)}")
query("a06_insights")(lambda d: f"select * from {measure.insights(d, _m(d))} q")
query("a07_sessions")(lambda d: f"select * from {measure.session_summary(d, _m(d))} q")
query("t05_last")(lambda d: f"select * from {measure.last_entries(d, _m(d), 20)} q")
query("k06_report")(lambda d: f"select nth, line from {measure.report_lines(d, _m(d), 'all')} q")
query("k06_last")(lambda d: f"select nth, line from {measure.last_lines(d, '(select *, concat(cmd_type, ' + d.lit(' with some arguments ') + ', session) as command from ' + _m(d) + ')' + ' w', 25)} q")
query("dt02_clock")(lambda d: f"select id, {measure.clock(d, 'us')} as at from {_m(d)}")
query("s16_fixtures")(lambda d: f"select name, cmd_type, {d.agg_join('line', 'pos', chr(10))} as text from {fixtures.lines(d)} f group by name, cmd_type")
query("s16_sizes")(lambda d: f"select name, cast(count(*) as bigint) as n_lines, {d.int_sum(d.octets('line') + ' + 1')} as n_bytes, cast(count(distinct line) as bigint) as n_distinct from {fixtures.lines(d)} f group by name")
query("x16_json")(lambda d: f"select id, {d.json(id='id', tool='tool', key='key', no_trunc='no_trunc')} as json from {_r(d)}")
query("t06_top_commands")(lambda d: f"select name, saved from {measure.report(d, _m(d))} q where level = 'type' order by saved desc, name limit 8")
query("t06_last_calls")(lambda d: f"select id, session, cmd_type, raw_tokens - clean_tokens as saved from {_m(d)} order by us desc, id desc limit 8")
query("t06_top_learned")(lambda d: f"select norm, n from {learn.analyse(d, _observed(d) + ' o', least=0.01)} q order by n desc, norm limit 5")
query("t06_top_steps")(lambda d: f"select step, saved from (select step, bytes_before - bytes_after as saved from ({contribution(d)}) s) q order by saved desc, step limit 6")
query("k02_newest_half")(lambda d: f"select id, us from {measure.newest_half(d, _m(d))} q")
query("j02_limits")(lambda d: f"select id, cmd_type, max_lines from {measure.limits(d, _m(d).removesuffix(' v'), {'click': 10, 'error': 500}, 50)} q")
query("j05_rerequest")(lambda d: f"select id, type, since_us from {learn.rerequests(d, _r(d))} q")
query("j05_rerequest_hour")(lambda d: f"select id, type, since_us from {learn.rerequests(d, _r(d), 3_600_000_000)} q")
query("p18_escalation")(lambda d: f"select type, cast(count(*) as bigint) as n from {learn.rerequests(d, _r(d), 86_400_000_000)} q group by type")
query("a20_cache")(lambda d: f"select key, hits, misses from {learn.cache_totals(d, _r(d).replace('raw_key, cast', 'raw_key, cast'))} q")
query("a08_learn")(lambda d: f"select * from {learn.analyse(d, _observed(d) + ' o', least=0.01)} q")
query("a09_observe")(lambda d: f"select session, cmd, norm, level, cast(count(*) as bigint) as n from {_observed(d)} o group by session, cmd, norm, level")
query("a10_store_stats")(lambda d: f"select * from {learn.statistics(d, _observed(d) + ' o')} q")
query("p12_skip")(lambda d: f"select id, {learn.first_word(d, 'text')} as word, {learn.skipped(d, 'text')} as skip from {_commands(d)} c")
query("p12_wrap")(lambda d: f"select id, {learn.wrapped(d, 'text')} as command from {_commands(d)} c")
query("p13_denied")(lambda d: f"select id, {learn.denied(d, 'text')} as denied from {_commands(d)} c")
query("p14_sandbox")(lambda d: f"select id, {learn.sandboxed(d, 'text')} as allowed from {_commands(d)} c")
query("x11_request_keys")(lambda d: f"select id, {learn.request_key(d, 'tool', 'text', 'path')} as key from (select *, concat('src/f', cast(id % 9 as varchar(20))) as path, case id % 4 when 0 then 'exec' when 1 then 'read' when 2 then 'grep' else 'filter' end as tool from {_commands(d)} c) c2")
query("s04_walk")(lambda d: f"select path from {views.paths(d)} p where {search.walkable(d, 'path')}")
query("s04_walk_extensions")(lambda d: f"select path from {views.paths(d)} p where {search.walkable(d, 'path', ('go', 'py'))}")
query("s06_glob")(lambda d: f"select path from {search.glob(d, views.paths(d) + ' p', '**/*.go')} q")
query("s06_glob_path")(lambda d: f"select path from {search.glob(d, views.paths(d) + ' p', 'src/d*/*_run.sh')} q")
query("a19_clusters")(lambda d: f"select dir, n, line from {search.glob_clusters(d, views.paths(d) + ' p')} q")
query("h03_search")(lambda d: f"select path, pos, line from {search.matches(d, _code(d) + ' s', 'load[0-9]+')} q")
query("s08_grep")(lambda d: f"select path, cast(count(*) as bigint) as n from {search.matches(d, _code(d) + ' s', 'LOAD', fold=True)} q group by path")
query("s08_listing")(lambda d: f"select path, pos, line from {search.listing(d, _code(d) + ' s', 'load1')} q")
query("s08_listing_fold")(lambda d: f"select path, pos, line from {search.listing(d, _code(d) + ' s', 'LOAD1', ignore_case=True)} q")
query("s08_no_match")(lambda d: f"select line from {search.no_match(d, search.matches(d, _code(d) + ' s', 'nowhere[0-9]'))} q")
query("s14_watched")(lambda d: f"select path from {views.paths(d)} p where {search.watchable(d, 'path', ('go', 'PY'))}")
query("h04_scan")(lambda d: f"select path, pos, sub, line from {search.scan(d, _code(d) + ' s', 'load')} q")
query("h05_detail")(lambda d: f"select path, pos, sub, line from {search.detail(d, _code(d) + ' s', 'load1[0-9]', 2)} q")
query("h06_definitions")(lambda d: f"select path, pos, sub, line from {search.definitions(d, _code(d) + ' s', 'load|run|T[0-9]')} q")
query("h07_skeleton")(lambda d: f"select path, pos, sub, line from {search.skeleton(d, _code(d) + ' s', 'load1')} q")
query("h08_folders")(lambda d: f"select dir, files, n from {search.by_folder(d, _code(d) + ' s', 'load')} q")
query("h08_folder_table")(lambda d: f"select path, pos, sub, line from {search.folder_table(d, _code(d) + ' s', 'load')} q")
for _name, _args in {"scan": ["load1", "-t", "go", "-t", ".py"], "detail": ["load3", "-d", "1", "-g", "*.ts"], "def": ["run|load", "--def", "-m", "5"], "tree": ["load", "--tree", "-g", "f1?.*"], "summary": ["load", "--summary", "-m", "40"]}.items():
    query(f"h01_{_name}")(lambda d, args=_args: f"select path, pos, sub, line from {search.run(d, _code(d) + ' s', search.parse_flags(args))} q")
query("t08_first_files")(lambda d: f"select path from (select distinct path, {d.split('path', '/')} as o from {search.matches(d, _code(d) + ' s', 'load')} m) q order by o limit 10")
_GROUPED = [">> src/a{m}.go", "  {n}:func run", "  {n}:return", "", "plain {n}", "  {m}:x"]
query("w11_capped_matches")(lambda d: f"select doc, pos, sub, line from {search.capped(d, views.templated(d, _GROUPED, run=7) + ' v', 5)} q")
query("w11_capped_default")(lambda d: f"select doc, pos, sub, line from {search.capped(d, views.templated(d, _GROUPED, run=14) + ' v')} q")


def _clean(d: Dialect) -> str:
    return generic.chain(d, generic.assemble(d, _test_lines(d) + " v", sub=False) + " s")


def _test_lines(d: Dialect) -> str:
    return d.spread(views.command_lines(d, "test"), "orders")


query("a11_quality")(lambda d: f"select * from {measure.quality(d, _test_lines(d) + ' v', _clean(d))} q")
query("a13_bench_quality")(lambda d: f"select * from {measure.bench_quality(d, views.log_lines(d) + ' v', generic.assemble(d, generic.remove_by_rules(d, views.log_lines(d) + ' v', ['^TODO', 'panic']) + ' r'))} q")
query("a12_credit")(lambda d: f"select doc, {measure.marker_credit(d, 'text')} as credit from {generic.assemble(d, generic.collapse_node_warnings(d, views.command_lines(d, 'nodewarn') + ' v') + ' a')} q")
query("a17_percentiles")(lambda d: f"select * from {measure.percentiles(d, _m(d), 'cmd_type', 'raw_bytes')} q")


@query("a15_modes")
def modes(d: Dialect) -> str:
    """Documents x modes (J-10, U-06): lines kept and tokens under each mode's limit."""
    table = "(select 'raw' as mode, cast(1000000000 as bigint) as most union all select 'conservative', 200 union all select 'balanced', 50 union all select 'aggressive', 30)"
    docs = f"(select doc, {d.size('lines')} as n, lines from (select doc, {d.split('text', chr(10))} as lines from {views.documents(d)} v) a0)"
    return f"select mode, cast(count(*) as bigint) as docs, {d.int_sum('least(n, most)')} as lines, {d.int_sum(T.words(d, d.join(d.slice('lines', '1', 'least(n, most)'), ' ')))} as words from {docs} x cross join {table} m group by mode"


@query("a16_contribution")
def contribution(d: Dialect) -> str:
    """Bytes before and after each text step, summed by step and ranked by what they save, then by name (A-16)."""
    steps = [("ansi", T.strip_ansi(d, "text")), ("whitespace", generic.normalise_whitespace(d, "t0")), ("paths", generic.compress_paths(d, "t1", "/home/u/app", "/home/u")), ("redact", generic.redact(d, "t2"))]
    src, before, rows = f"(select doc, text from {generic.assemble(d, views.log_lines(d) + ' v', sub=False)} a)", "text", []
    for i, (_, expr) in enumerate(steps):
        src = f"(select *, {expr} as t{i} from {src} s{i})"
    for i, (name, _) in enumerate(steps):
        rows.append(f"select '{name}' as step, {d.int_sum(d.octets(before))} as bytes_before, {d.int_sum(d.octets(f't{i}'))} as bytes_after from {src} r{i}")
        before = f"t{i}"
    return f"select *, cast(row_number() over (order by bytes_before - bytes_after desc, step) as bigint) as rank from ({' union all '.join(rows)}) ranked"


def _parity(d: Dialect) -> str:
    rate = lambda f, w: f"(select source as name, round({d.double(d.int_sum(d.octets('text') + ' - ' + d.octets(f)))} / {d.double(d.int_sum(d.octets('text')))} * 100, 6) as reduction from {views.documents(d)} v where {w} group by source)"
    base = rate(generic.normalise_whitespace(d, "text"), "source <> 'src3'")
    other = rate(d.sub("text", "[.,!?]", ""), "source <> 'src5'")
    return measure.parity(d, base, other, 1)


query("j03_parity")(lambda d: f"select * from {_parity(d)} q")
query("k06_parity")(lambda d: f"select nth, line from {tables.parity_table(d, _parity(d) + ' p', 'plain', 'bare', 1)} q")
query("k06_parity_json")(lambda d: f"select json from {tables.parity_json(d, _parity(d) + ' p', 'plain', 'bare', 1)} q")


def _scores(d: Dialect) -> str:
    return f"(select concat('doc', cast(doc as varchar(20))) as name, important, preserved, score from {measure.quality(d, _test_lines(d) + ' v', _clean(d))} q) s"


def _steps(d: Dialect) -> str:
    return f"(select rank as nth, step, bytes_before, bytes_after, bytes_before % 5000 as us from ({contribution(d)}) c) s"


def _latency(d: Dialect) -> str:
    """Clean sizes of the measurements, taken as microseconds."""
    one = f"(select 1 as one, clean_bytes as us from {_m(d)})"
    ps = f"{measure.percentiles(d, one + ' o', 'one', 'us')} p"
    return f"(select p.n as iterations, total as bytes, least_v as min_us, most_v as max_us, mean as mean_us, p50 as p50_us, p95 as p95_us, p99 as p99_us from {ps} cross join (select {d.int_sum('raw_bytes')} as total, cast(floor(avg(clean_bytes)) as bigint) as mean from {_m(d)}) t) l"


def _modes(d: Dialect) -> str:
    return f"(select mode, words * 2 as raw_tokens, words as clean_tokens, {d.double('50')} as reduction, {d.double('docs % 100')} as quality from ({modes(d)}) m) s"


query("k06_quality")(lambda d: f"select nth, line from {tables.quality_table(d, _scores(d))} q")
query("k06_quality_json")(lambda d: f"select json from {tables.quality_json(d, _scores(d))} q")
query("k06_steps")(lambda d: f"select nth, line from {tables.steps_table(d, _steps(d), 'log')} q")
query("k06_steps_json")(lambda d: f"select json from {tables.steps_json(d, _steps(d), 'log')} q")
query("k06_latency")(lambda d: f"select nth, line from {tables.latency_table(d, _latency(d))} q")
query("k06_latency_json")(lambda d: f"select json from {tables.latency_json(d, _latency(d))} q")
query("k06_modes")(lambda d: f"select nth, line from {tables.modes_table(d, _modes(d))} q")
query("k06_modes_json")(lambda d: f"select json from {tables.modes_json(d, _modes(d))} q")
query("k06_suggestions")(lambda d: f"select nth, line from {tables.suggestions_table(d, learn.analyse(d, _observed(d) + ' o', least=0.01), learn.statistics(d, _observed(d) + ' o'))} q")
query("k06_status")(lambda d: f"select nth, line from {tables.status_table(d, learn.statistics(d, _observed(d) + ' o') + ' s', '1234')} q")
query("k06_status_empty")(lambda d: f"select nth, line from {tables.status_table(d, learn.statistics(d, '(select * from ' + _observed(d) + ' o where session = ' + d.lit('none') + ') e') + ' s')} q")


@query("j04_snapshot_changed")
def snapshot(d: Dialect) -> str:
    """Two snapshots (path, mtime): any path new, gone or of another time (S-14, J-04)."""
    seen = search.watchable(d, "path")
    one = f"(select path, id % 5 as mtime from {views.paths(d)} p where id % 7 <> 0 and {seen})"
    two = f"(select path, id % 5 + case when id % 50 = 0 then 1 else 0 end as mtime from {views.paths(d)} p where id % 11 <> 0 and {seen})"
    return f"select coalesce(a.path, b.path) as path, case when a.path is null then 'new' when b.path is null then 'gone' else 'changed' end as change from {one} a full outer join {two} b on a.path = b.path where a.path is null or b.path is null or a.mtime <> b.mtime"
