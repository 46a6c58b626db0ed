"""Queries over the command-specific operators, detection, summaries, verdicts and truncation."""

from __future__ import annotations

from lineflow.functions.dialect import Dialect
from lineflow.operators import blocks, classify, commands, detect, generic, summary
from lineflow.plans import views
from lineflow.plans.catalog import BUILDERS

_IDS = {"grep": "c01", "find": "c02", "git": "c03", "go": "c04", "ls": "c05", "docker": "c06", "npm": "c07", "node": "c08", "cargo": "c09", "make": "c10", "curl": "c11", "python": "c12", "terraform": "c14", "kubectl": "c15", "tar": "c17", "ssh": "c19"}


#: Operators that look at one line at a time, for which nothing is dealt.
_BY_LINE = ("git", "ls", "make")


def _command(kind: str):
    def build(d: Dialect) -> str:
        src = f"(select {d.div('id', '40')} as doc, id % 40 as pos, concat('src/app/', path) as line from {views.paths(d)} p)" if kind == "find" else views.command_lines(d, kind)
        src = src if kind in _BY_LINE else d.spread(src, "part" if kind == "find" else "orders")
        return f"select doc, pos, sub, line from {commands.OPERATORS[kind](d, src + ' v')} q"

    return build


for _kind, _id in _IDS.items():
    BUILDERS[f"{_id}_{_kind}"] = _command(_kind)

_TRACES = ["goroutine {n} [running]:", "main.f()", "\t/a/b.go:{m}", "", "Traceback (most recent call last):", '  File "a.py", line {n}, in f', "    g()", '  File "b.py", line {m}, in g', "ValueError: x", "TypeError: bad {n}", "    at a (src/x.js:{n}:1)", "    at b (node:internal/y:{m})", "done {n}"]
_JSON = ["[", "{", '  "a": {n}', "},", "]", "x {m}"]
_TREE = [".", "├── a{m}", "│   ├── b{n}", "│   │   ├── c", "│   │   │   ├── f{n}.go", "├── z.txt"]
_CONSOLE = ["  console.log", "    hello {m}", "      at log (src/a.js:{n}:2)", "", "PASS a{n}", "plain"]
#: Block operators with lines of their kind, and how many lines of one template stand together.
_BLOCKS = {
    "f10_go_traces": (blocks.go_traces, _TRACES, 1), "f11_python_traces": (blocks.python_traces, _TRACES, 1), "f12_node_traces": (blocks.node_traces, _TRACES, 1), "f13_traces": (blocks.traces, _TRACES, 1),
    "c12_script_traces": (blocks.script_traces, _TRACES, 1), "c13_tree": (blocks.tree, _TREE, 1), "c16_jq": (blocks.jq, _JSON, 2), "c18_console": (blocks.console, _CONSOLE, 1),
}


def _assembled(operator, lines):
    return lambda d: f"select doc, text from {generic.assemble(d, operator(d, lines(d) + ' v') + ' o')} t"


def _document_lines(d: Dialect) -> str:
    return d.spread(_split_documents(d), "documents")


def _split_documents(d: Dialect) -> str:
    return generic.split_lines(d, views.documents(d) + " v")


def _turns(d: Dialect) -> str:
    """The texts of the conversations, a turn of a user or assistant being a document."""
    return f"(select conv_id * 1000 + turn as doc, coalesce(text, '') as text from {d.table('conversations')})"


for _name, (_operator, _lines, _run) in _BLOCKS.items():
    BUILDERS[_name] = _assembled(_operator, lambda d, lines=_lines, run=_run: d.spread(views.templated(d, lines, run=run), "orders"))
    BUILDERS[f"{_name}_documents"] = _assembled(_operator, _document_lines)
# The operators of a command on texts that weren't made for them: documents and turns of conversations.
for _kind, _id in _IDS.items():
    BUILDERS[f"{_id}_{_kind}_documents"] = lambda d, kind=_kind: f"select doc, pos, sub, line from {commands.OPERATORS[kind](d, (_split_documents if kind in _BY_LINE else _document_lines)(d) + ' v')} q"
BUILDERS["a01_auto_detect_conversations"] = lambda d: f"select doc, cmd_type from {detect.auto_detect(d, generic.split_lines(d, _turns(d) + ' c') + ' v')} q"
BUILDERS["f_chain_conversations"] = lambda d: f"select doc, text from {generic.chain(d, _turns(d) + ' c')} q"


def _mixed(d: Dialect) -> str:
    """Documents of several kinds, a few lines of each kind at a time."""
    kinds = ["grep", "go", "ls", "npm", "cargo", "make", "git", "docker", "terraform", "test"]
    parts = [f"select doc * {len(kinds)} + {k} as doc, pos, line from {views.command_lines(d, kind, 60)} k{k}" for k, kind in enumerate(kinds)]
    return d.spread("(" + " union all ".join(parts) + ")", "orders", len(kinds))


def _tests(d: Dialect) -> str:
    return d.spread(views.command_lines(d, "test"), "orders")


def _invocations(d: Dialect) -> str:
    names = ["/usr/bin/grep", "git", "C:\\tools\\npm.exe", "unknown", "pytest", "cargo", "kubectl", "x/y/zip"]
    return f"(select o_orderkey as doc, {d.item(d.array(*map(d.lit, names)), 'cast(o_orderkey % 8 as int) + 1')} as command from {d.table('orders')})"


BUILDERS["a01_auto_detect"] = lambda d: f"select doc, cmd_type from {detect.auto_detect(d, _mixed(d) + ' v')} q"
BUILDERS["p05_identify"] = lambda d: f"select doc, command, cmd_type from {detect.identify(d, _invocations(d) + ' v')} q"
BUILDERS["p06_resolve"] = lambda d: f"select doc, cmd_type, source from {detect.resolve(d, _invocations(d) + ' v', _mixed(d) + ' w', {'pytest': 'python'})} q"
BUILDERS["p09_context_levels"] = lambda d: f"select doc, pos, cast(level as int) as level from {summary.context_levels(d, _tests(d) + ' v')} q"
BUILDERS["a02_summary"] = lambda d: f"select * from {summary.summary(d, _tests(d) + ' v')} q"
BUILDERS["a02_summary_log"] = lambda d: f"select * from {summary.summary(d, views.log_lines(d) + ' v', '1')} q"
BUILDERS["a02_summary_header"] = lambda d: f"select * from {summary.summary_header(d, _tests(d) + ' v')} q"
BUILDERS["a03_two_streams"] = lambda d: f"select doc, verdict from {summary.summary(d, views.log_lines(d) + ' v', 'doc % 3 - 1', 100, '(select doc, pos, line from ' + _tests(d) + ' t where doc % 2 = 0) e')} q"
BUILDERS["a04_runner_result"] = lambda d: f"select doc, verdict from {summary.runner_result(d, _mixed(d) + ' v')} q"
BUILDERS["t01_truncate"] = lambda d: f"select doc, pos, sub, line from {summary.truncate(d, _tests(d) + ' v', 50)} q"
BUILDERS["t01_truncate_30"] = lambda d: f"select doc, pos, sub, line from {summary.truncate(d, _mixed(d) + ' v', 30)} q"
for _mode in ("window", "hint", "conservative", "off"):
    BUILDERS[f"t02_escalate_{_mode}"] = lambda d, mode=_mode: f"select doc, pos, sub, line from {summary.escalate(d, _mixed(d) + ' v', 40, mode)} q"
BUILDERS["t03_window"] = lambda d: f"select doc, pos, sub, line from {summary.window_truncate(d, _tests(d) + ' v', 50, 3)} q"
BUILDERS["t03_window_capped"] = lambda d: f"select doc, pos, sub, line from {summary.window_truncate(d, _tests(d) + ' v', 20, 10)} q"
BUILDERS["t04_anchors"] = lambda d: f"select doc, {d.agg_join('cast(pos as varchar(20))', 'pos', ',')} as positions from {_tests(d)} v where {classify.failure_anchor(d, 'line')} group by doc"
