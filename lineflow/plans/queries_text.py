"""Queries over the generic operators, the classification and the scalar functions."""

from __future__ import annotations

from lineflow.functions import patterns as P
from lineflow.functions import text as T
from lineflow.functions.dialect import Dialect
from lineflow.operators import classify, commands, generic, learn, segmented, summary
from lineflow.plans import views
from lineflow.plans.catalog import query, spark_form


def _log(d: Dialect) -> str:
    return views.log_lines(d) + " v"


def _log_text(d: Dialect) -> str:
    return generic.assemble(d, _log(d), sub=False)


def _docs(d: Dialect) -> str:
    return views.documents(d) + " v"


def _rows(relation: str) -> str:
    return f"select doc, pos, sub, line from {relation} q"


query("f00_crlf")(lambda d: f"select doc, {generic.crlf(d, 'text')} as text from (select doc, {d.replace('text', chr(10), chr(13) + chr(10))} as text from {_docs(d)}) c")
query("f01_remove_rules")(lambda d: _rows(generic.remove_by_rules(d, _log(d), [r"^ERROR", r"step \d+", r"\b0 errors\b"])))
query("f02_strip_ansi")(lambda d: _rows(generic.strip_ansi_lines(d, _log(d))))
query("f03_strip_timestamps")(lambda d: _rows(generic.strip_timestamps(d, _log(d))))
query("f04_whitespace")(lambda d: f"select doc, {generic.normalise_whitespace(d, 'text')} as text from {_log_text(d)} t")
query("f04_whitespace_documents")(lambda d: f"select doc, {generic.normalise_whitespace(d, 'text')} as text from {_docs(d)}")
query("f05_dedup")(lambda d: _rows(generic.dedup(d, _log(d))))
query("f05_dedup_documents")(lambda d: _rows(generic.dedup(d, generic.split_lines(d, _docs(d)) + " l")))
query("f06_node_warnings")(lambda d: _rows(generic.collapse_node_warnings(d, views.command_lines(d, "nodewarn") + " v")))
query("f07_redact")(lambda d: f"select doc, {generic.redact(d, 'text')} as text from {_log_text(d)} t")
query("f08_paths")(lambda d: f"select doc, pos, {generic.compress_paths(d, 'line', '/home/u/app', '/home/u')} as line from {_log(d)}")
query("f09_decorative")(lambda d: _rows(generic.drop_decorative(d, _log(d))))
query("f14_keep_rules")(lambda d: f"select doc, pos, line from {generic.keep_by_rules(d, _log(d).removesuffix(' v'), generic.assemble(d, generic.remove_by_rules(d, _log(d), ['^ERROR', 'panic']) + ' r'), ['ERROR', 'panic', 'TODO'])} k")
query("f15_stderr_chain")(lambda d: f"select doc, text from {generic.stderr_chain(d, _log_text(d) + ' s')} q")
query("w01_dedup_pieces")(lambda d: _rows(generic.dedup(d, generic.split_lines(d, _docs(d)) + " l")))
spark_form("w01_dedup_pieces")(lambda d: _rows(segmented.dedup(d, generic.split_lines(d, _docs(d)) + " l", 3)))
query("w02_node_pieces")(lambda d: _rows(commands.node(d, views.command_lines(d, "node") + " v")))
spark_form("w02_node_pieces")(lambda d: _rows(commands.node(d, views.command_lines(d, "node") + " v", 32)))
query("c19_ssh_pieces")(lambda d: _rows(commands.ssh(d, views.command_lines(d, "ssh") + " v")))
spark_form("c19_ssh_pieces")(lambda d: _rows(commands.ssh(d, views.command_lines(d, "ssh") + " v", 17)))
query("t01_truncate_pieces")(lambda d: _rows(summary.truncate(d, generic.split_lines(d, _docs(d)) + " l", 20)))
spark_form("t01_truncate_pieces")(lambda d: _rows(segmented.truncate(d, generic.split_lines(d, _docs(d)) + " l", 20, 8)))
query("k01_assemble_pieces")(lambda d: f"select doc, text from {generic.assemble(d, generic.split_lines(d, _docs(d)) + ' l', sub=False)} t")
spark_form("k01_assemble_pieces")(lambda d: f"select doc, text from {segmented.assemble(d, generic.split_lines(d, _docs(d)) + ' l', 16, sub=False)} t")
query("f_chain_log")(lambda d: f"select doc, text from {generic.chain(d, _log_text(d) + ' s', remove=['^step'])} q")
query("f_chain_documents")(lambda d: f"select doc, text from {generic.chain(d, _docs(d))} q")
query("k01_assemble")(lambda d: f"select doc, text from {_log_text(d)} t")
query("s01_lines")(lambda d: f"select doc, pos, line from {generic.split_lines(d, _docs(d))} l")
query("s05_numbered_lines")(lambda d: f"select doc, pos + 1 as line_num, {d.sub('line', chr(92) + 'r+$', '')} as line from (select *, max(pos) over (partition by doc) as z from {generic.split_lines(d, _docs(d))} l) m where not (pos = z and line = '')")
query("s07_read_window")(lambda d: f"select doc, {d.join(d.slice(d.split('text', chr(10)), 2, 6), chr(10))} as text from {_docs(d)}")
query("p01_levels")(lambda d: f"select doc, pos, level from {classify.classified(d, _log(d))} q")
query("p01_level_histogram")(lambda d: f"select source, level, cast(count(*) as bigint) as n from {classify.classified(d, generic.split_lines(d, _docs(d), 'source') + ' l', 'source')} c group by source, level")
query("f05_dedup_text")(lambda d: f"select doc, text from {generic.dedup_text(d, _log_text(d) + ' v')} q")
query("p02_source_levels")(lambda d: f"select doc, pos, line, cast({classify.source_level(d, 't')} as int) as level from (select doc, pos, line, {d.trim(d.sub('line', classify.source_prefix(), ''))} as t from {_log(d)}) s where {d.match('line', classify.source_prefix())}")
query("p03_outside_paths")(lambda d: f"select doc, pos, {classify.outside_paths(d, P.ERROR_WORD, 'line')} as hit from {_log(d)}")
query("p07_failure_anchors")(lambda d: f"select doc, pos, line from {views.command_lines(d, 'test')} v where {classify.failure_anchor(d, 'line')}")
query("p08_runner_verdict")(lambda d: f"select doc, pos, line, {classify.runner_verdict(d, 'line')} as verdict from {views.command_lines(d, 'test')} v where {classify.summary_anchor(d, 'line')}")
query("p11_drop_safe")(lambda d: f"select doc, pos, {d.match('line', P.DROP_SAFE)} as safe from {views.command_lines(d, 'ssh')} v")
query("x01_tokens")(lambda d: f"select doc, {T.tokens(d, 'text')} as tokens from {_docs(d)}")
query("x02_line_count")(lambda d: f"select doc, cast({T.line_count(d, 'text')} as bigint) as n from {_docs(d)}")
query("x03_core")(lambda d: f"select doc, pos, {T.core(d, 'line')} as core from {_log(d)}")
query("x04_normalise")(lambda d: f"select doc, pos, {T.normalise(d, 'line')} as norm from {_log(d)}")
query("x04_normalise_documents")(lambda d: f"select doc, {T.normalise(d, 'text')} as norm from {_docs(d)}")
query("x05_to_regex")(lambda d: f"select distinct {T.to_regex(d, 'norm')} as pattern from (select {T.normalise(d, 'line')} as norm from {_log(d)}) n")
query("x06_thousands")(lambda d: f"select o_orderkey, {T.thousands(d, 'o_orderkey * 7919')} as text from {d.table('orders')}")
query("x07_duration")(lambda d: f"select o_orderkey, {T.duration(d, 'o_orderkey * 37')} as text from {d.table('orders')}")
query("x08_ellipsis")(lambda d: f"select doc, pos, {T.ellipsis(d, 'line', 20)} as text from {_log(d)}")
query("x09_clean_line")(lambda d: f"select doc, pos, {d.trim(T.strip_ansi(d, 'line'))} as line from {_log(d)}")
query("x10_cache_key")(lambda d: f"select doc, {learn.cache_key(d, learn.config_fingerprint(d, d.lit('{true false}'), d.lit('[]|[]'), d.lit('balanced'), d.lit('true')), 'doc % 18', '50', 'text')} as key from {_docs(d)}")
query("x13_indent")(lambda d: f"select doc, pos, {T.leading(d, 'line')} as width, {T.leading_text(d, 'line')} as text from {_log(d)}")
query("x14_tree")(lambda d: f"select doc, pos, {T.tree_name(d, 'line')} as name, {T.tree_depth(d, 'line')} as depth from {views.templated(d, ['├── a{m}', '│   ├── b{n}', '│   │   └── c.go', '.', 'x', '| +- y{n}'])} v")
query("x18_age")(lambda d: f"select o_orderkey, {T.age(d, 'o_orderkey * 61')} as age from {d.table('orders')}")


@query("x15_stats_line")
def stats_lines(d: Dialect) -> str:
    """One line of figures for every text and its cleaned form."""
    pair = f"(select doc, text, {generic.normalise_whitespace(d, 'text')} as clean from {_log_text(d)} t)"
    lines = generic.split_lines(d, f"(select doc, clean as text from {pair} p0)" + (" x1" if d.name == "duckdb" else ""))
    counts = f"(select doc as cdoc, {d.int_sum(f'case when level >= {P.WARNING} then 1 else 0 end')} as important from {classify.classified(d, lines + ' l')} c group by doc)"
    return f"select doc, {T.stats_line(d, 'text', 'clean', 'important')} as stats from {pair} p1 join {counts} n on doc = cdoc"


query("x17_version_order")(lambda d: f"select v, row_number() over (order by {', '.join(T.version_key(d, 'v'))}, v) as n from (select distinct concat('v', cast(p_size % 4 as varchar(9)), '.', cast(p_partkey % 12 as varchar(9)), case when p_partkey % 3 = 0 then '-rc1' else '' end) as v from {d.table('part')}) p")


@query("a14_saved_by_source")
def saved_by_source(d: Dialect) -> str:
    """Lines, bytes and tokens saved by collapsing duplicate lines, by source."""
    lines = generic.dedup(d, generic.split_lines(d, _docs(d)) + " l")
    return f"""select source, cast(count(*) as bigint) as docs, {d.int_sum(d.octets('raw'))} as raw_bytes, {d.int_sum(d.octets('clean'))} as clean_bytes,
        {d.int_sum(T.tokens(d, 'raw'))} as raw_tokens, {d.int_sum(T.tokens(d, 'clean'))} as clean_tokens,
        round({d.double(d.int_sum(T.tokens(d, 'raw')) + ' - ' + d.int_sum(T.tokens(d, 'clean')))} / {d.double(d.int_sum(T.tokens(d, 'raw')))} * 100, 6) as saved_pct
        from (select r.source, r.text as raw, c.text as clean from {views.documents(d)} r join {generic.assemble(d, lines + ' m')} c on r.doc = c.doc) j group by source"""


@spark_form("a14_saved_by_source")
def saved_by_source_in_place(d: Dialect) -> str:
    """The same figures without a shuffle of lines: each text is collapsed where it lies."""
    raw = f"(select doc, source, text, {d.octets('text')} as raw_bytes, {T.tokens(d, 'text')} as raw_tokens from {_docs(d)})"
    clean = f"(select source, raw_bytes, raw_tokens, {d.octets('text')} as clean_bytes, {T.tokens(d, 'text')} as clean_tokens from {generic.dedup_text(d, raw + ' r', 'source, raw_bytes, raw_tokens')} c)"
    return f"""select source, cast(count(*) as bigint) as docs, {d.int_sum('raw_bytes')} as raw_bytes, {d.int_sum('clean_bytes')} as clean_bytes, {d.int_sum('raw_tokens')} as raw_tokens, {d.int_sum('clean_tokens')} as clean_tokens,
        round({d.double(d.int_sum('raw_tokens') + ' - ' + d.int_sum('clean_tokens'))} / {d.double(d.int_sum('raw_tokens'))} * 100, 6) as saved_pct from {clean} s group by source"""
