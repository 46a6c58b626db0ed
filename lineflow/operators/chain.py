"""Chains of named steps over (doc, text), built from settings and a command type (U-01, U-02, F-15, F-16).

A step is a line operator, a text expression or a Python function of a text.  Neighbouring line steps share one split and
one join of lines; Catalyst sees each of them as one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineflow.config import Config
from lineflow.functions import patterns as P
from lineflow.functions.dialect import Dialect, Spark
from lineflow.operators import blocks, commands, contain, generic, sequential, summary
from lineflow.session import query_over

LineOperator = Callable[[Dialect, str], str]


@dataclass(frozen=True)
class Step:
    """A named step: `lines` maps a line relation, `text` an expression, `native` a text, `frame` a DataFrame (doc, text)."""

    name: str
    lines: LineOperator | None = None
    text: Callable[[Dialect, str], str] | None = None
    native: Callable[[str], str] | None = None
    frame: Callable[[DataFrame], DataFrame] | None = None


def _by_lines(docs: DataFrame, steps: list[Step]) -> DataFrame:
    """Neighbouring line steps: one plan, each step analysed on its own so that its text doesn't hold those before it."""
    d = Spark()
    lines = query_over(lambda view: f"select doc, pos, line from {generic.split_lines(d, view)} q", docs)
    for k, step in enumerate(steps):
        if k:
            lines = query_over(lambda view: f"select doc, pos, line from {generic.renumber(d, f'{view} r')} q", lines)
        lines = query_over(lambda view, step=step: f"select doc, pos, sub, line from {step.lines(d, f'{view} l')} q", lines)
    return query_over(lambda view: f"select doc, text from {generic.assemble(d, f'{view} a')} t", lines)


@dataclass(frozen=True)
class Chain:
    """Steps in order; a chain is a value, so adding gives a new one."""

    steps: tuple[Step, ...] = ()

    def add(self, *steps: Step) -> Chain:
        return replace(self, steps=self.steps + steps)

    @property
    def names(self) -> list[str]:
        return [s.name or "(anonymous)" for s in self.steps]

    def __len__(self) -> int:
        return len(self.steps)

    def apply(self, docs: DataFrame) -> DataFrame:
        """(doc, text) of (doc, text), CRLF made LF first; null texts are empty; doc is unique."""
        start = docs.select("doc")
        docs = docs.select("doc", F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")).alias("text"))
        for by_lines, group in groupby(self.steps, key=lambda s: s.lines is not None):
            steps = list(group)
            if by_lines:
                docs = _by_lines(docs, steps)
                continue
            for step in steps:
                if step.text is not None:
                    docs = query_over(lambda view, step=step: f"select doc, {step.text(Spark(), 'text')} as text from {view}", docs)
                elif step.native is not None:
                    docs = sequential.per_document(docs, step.native)
                else:
                    docs = step.frame(docs)
        # A text that lost every line is empty, not gone.
        return start.join(docs, "doc", "left").select("doc", F.coalesce("text", F.lit("")).alias("text")) if any(s.lines for s in self.steps) else docs


def paths(cwd: str, home: str) -> Step:
    return Step("compress_paths", text=lambda d, x: generic.compress_paths(d, x, cwd, home))


#: Steps of a command type, by the settings; commands.OPERATORS gives the line operator where there is no more to do.
REGISTRY: dict[str, Callable[[Config, str, str], list[Step]]] = {}
#: Names of commands that the fixed table doesn't have.
BINARIES: dict[str, str] = {}


def register(kind: str, binaries: tuple[str, ...], steps: Callable[[Config, str, str], list[Step]]) -> None:
    """Add or replace a command type: its binaries and a function of (settings, working folder, home) to its steps (U-02)."""
    REGISTRY[kind] = steps
    BINARIES.update(dict.fromkeys(binaries, kind))


def identify(command: str, config: Config | None = None) -> str:
    """The type of one command: the settings' mapping, registered binaries, the fixed table, else generic (P-05, P-06)."""
    name = command.replace("\\", "/").rsplit("/", 1)[-1].removesuffix(".exe")
    known = {b: kind for kind, names in P.REGISTRY.items() for b in names} | BINARIES | dict(config.mapping if config else {})
    return known.get(name, "generic")


def _registered() -> None:
    line = lambda kind: Step(kind, lines=commands.OPERATORS[kind])
    for kind in commands.OPERATORS:
        register(kind, (), lambda c, cwd, home, kind=kind: [line(kind)])
    for kind in ("grep", "find", "go"):
        register(kind, (), lambda c, cwd, home, kind=kind: [paths(cwd, home), line(kind)])
    console = lambda c: Step("console", lines=lambda d, src, drop=c.drop_console_on_pass: blocks.console(d, src, "passed" if drop else "false"))
    register("npm", (), lambda c, cwd, home: [console(c), line("npm"), line("node")])
    register("node", (), lambda c, cwd, home: [console(c), line("node")])
    register("python", (), lambda c, cwd, home: [line("python"), Step("python", lines=blocks.script_traces)])
    register("tree", (), lambda c, cwd, home: [Step("tree", lines=blocks.tree)])
    register("jq", (), lambda c, cwd, home: [Step("jq", lines=blocks.jq)])
    register("generic", (), lambda c, cwd, home: [paths(cwd, home)])


_registered()


def _with_summary(docs: DataFrame, exit_code: int) -> DataFrame:
    """Long texts behind their summary block (A-02)."""
    d = Spark()
    # The empty piece after a closing LF is no line of the summary.
    body = lambda view: f"(select doc, {d.sub('text', chr(92) + 'n$', '')} as text from {view})"
    header = lambda view: summary.summary_header(d, generic.split_lines(d, body(view)) + " l", str(exit_code))
    return query_over(lambda view: f"select v.doc, concat(coalesce(h.header, ''), v.text) as text from {view} v left join {header(view)} h on v.doc = h.doc", docs)


def _kept(original: DataFrame, rules: tuple[str, ...], name: str) -> Callable[[DataFrame], DataFrame]:
    """Lines of the original that match a rule and are gone, at the end behind a notice (F-14)."""
    d = Spark()

    def run(docs: DataFrame) -> DataFrame:
        lines = original.selectExpr("doc", "coalesce(text, '') as text")
        clean = lines.select("doc").join(docs, "doc", "left").select("doc", F.coalesce("text", F.lit("")).alias("text"))
        wanted = query_over(lambda view: f"select doc, pos, line from {generic.split_lines(d, view)} l where {d.any_of(rules, 'line')}", lines)
        lost = query_over(lambda view: f"select doc, {d.agg_join('line', 'pos', chr(10))} as lost from {view} k group by doc", contain.kept_by_rules(wanted, clean))
        notice = F.concat(F.when((F.col("text") != "") & ~F.col("text").endswith("\n"), F.lit("\n")).otherwise(F.lit("")), F.lit(f"[{name}: preserved by always_keep rule]\n"), F.col("lost"))
        docs = docs.join(lost, "doc", "full").withColumn("text", F.coalesce("text", F.lit("")))
        return docs.select("doc", F.concat("text", F.coalesce(notice, F.lit(""))).alias("text"))

    return run


def build(config: Config, kind: str = "generic", cwd: str = "/home/u/app", home: str = "/home/u", exit_code: int = -1, original: DataFrame | None = None, max_lines: int | None = None) -> Chain:
    """The chain of a command type under the settings; with `original` (doc, text), lines that must stay come back."""
    if config.passthrough:
        return Chain()
    most = config.limit_for(kind) if max_lines is None else max_lines
    steps: list[Step] = []
    if config.always_remove:
        steps.append(Step("always_remove", lines=lambda d, src: generic.remove_by_rules(d, src, list(config.always_remove))))
    if config.strip_ansi:
        steps.append(Step("strip_ansi", lines=generic.strip_ansi_lines))
    if config.strip_timestamps:
        steps.append(Step("strip_timestamps", lines=generic.strip_timestamps))
    if config.normalize_whitespace:
        steps.append(Step("normalize_whitespace", text=generic.normalise_whitespace))
    if config.dedup:
        steps += [Step("dedup", lines=generic.dedup), Step("node_warnings", lines=generic.collapse_node_warnings)]
    steps += REGISTRY.get(kind, REGISTRY["generic"])(config, cwd, home)
    if config.trim_decorative:
        steps.append(Step("trim_decorative", lines=generic.drop_decorative))
    steps.append(Step("stack_traces", lines=blocks.traces))
    if config.redact_secrets:
        steps.append(Step("redact_secrets", text=generic.redact))
    steps.append(Step("summarize", frame=lambda docs: _with_summary(docs, exit_code)))
    if config.truncate:
        steps.append(Step("truncate", lines=lambda d, src: summary.escalate(d, src, most, config.escalate, config.escalate_window)))
    if original is not None and config.always_keep:
        steps.append(Step("always_keep", frame=_kept(original, config.always_keep, "lineflow")))
    return Chain(tuple(steps))


def declared(d: Dialect, src: str, steps: Sequence[Step]) -> str:
    """A chain of line and text steps over (doc, text) as one declaration (doc, text), for either engine (U-01)."""
    alias = lambda k: f" c{k}" if d.name == "duckdb" else ""
    text = f"(select doc, {generic.crlf(d, 'text')} as text from {src})"
    for k, (by_lines, group) in enumerate(groupby(steps, key=lambda s: s.lines is not None)):
        if not by_lines:
            for step in group:
                text = f"(select doc, {step.text(d, 'text')} as text from {text} t{k})"
            continue
        lines = generic.split_lines(d, text + alias(k))
        for j, step in enumerate(group):
            lines = step.lines(d, f"{generic.renumber(d, f'{lines} r{k}_{j}') if j else lines} l{k}_{j}")
        text = generic.assemble(d, f"{lines} a{k}")
    return text


def build_stderr(config: Config) -> Chain:
    """What is done to stderr: escape codes, secrets, warnings of several workers; nothing that changes its structure (F-15)."""
    steps = [Step("strip_ansi", lines=generic.strip_ansi_lines)] if config.strip_ansi else []
    steps += [Step("redact_secrets", text=generic.redact)] if config.redact_secrets else []
    return Chain((*steps, Step("node_warnings", lines=generic.collapse_node_warnings)))


def contributions(chain: Chain, docs: DataFrame) -> DataFrame:
    """(step, bytes_before, bytes_after) of every step over all texts, in order (A-16)."""
    rows, before = [], Chain().apply(docs)
    for nth, (name, step) in enumerate(zip(chain.names, chain.steps)):
        after = Chain((step,)).apply(before)
        sizes = before.agg(F.sum(F.octet_length("text")).alias("bytes_before")).crossJoin(after.agg(F.sum(F.octet_length("text")).alias("bytes_after")))
        rows.append(sizes.select(F.lit(nth).alias("nth"), F.lit(name).alias("step"), "bytes_before", "bytes_after"))
        before = after
    out = rows[0] if rows else docs.sparkSession.createDataFrame([], "nth int, step string, bytes_before long, bytes_after long")
    for r in rows[1:]:
        out = out.union(r)
    return out
