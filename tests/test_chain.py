"""Chains built from settings, hand-made texts through them, registered types, and the settings' own layers."""

from dataclasses import replace

from lineflow.config import Config, discover, layers, profile_of
from lineflow.functions.dialect import Spark
from lineflow.operators import chain, generic


def run(spark, text, config, kind="generic", keep=False, **more):
    docs = spark.createDataFrame([(1, text), (2, "")], "doc long, text string")
    got = {r["doc"]: r["text"] for r in chain.build(config, kind, original=docs if keep else None, **more).apply(docs).collect()}
    assert set(got) == {1, 2} and got[2] == ""
    return got[1]


def test_names_and_switches():
    everything = ["strip_ansi", "strip_timestamps", "normalize_whitespace", "dedup", "node_warnings", "compress_paths", "grep", "trim_decorative", "stack_traces", "redact_secrets", "summarize", "truncate"]
    assert chain.build(Config(), "grep").names == everything
    assert chain.build(Config(always_remove=("x",)), "grep").names == ["always_remove", *everything]
    few = Config(strip_ansi=False, strip_timestamps=False, normalize_whitespace=False, dedup=False, trim_decorative=False, redact_secrets=False, truncate=False)
    assert chain.build(few, "ls").names == ["ls", "stack_traces", "summarize"] and len(chain.build(replace(few, passthrough=True))) == 0
    assert chain.build(Config(mode="conservative").resolved(), "jq").names[-1] == "summarize"
    assert chain.Chain().add(chain.Step("")).names == ["(anonymous)"]
    assert chain.build_stderr(Config()).names == ["strip_ansi", "redact_secrets", "node_warnings"]


def test_generic_text(spark):
    text = "\x1b[31mred\x1b[0m\r\nsame\r\nsame\r\n\r\n\r\n\r\n==========\r\nopen /home/u/app/x and /home/u/y\r\nAPI_KEY=abcdefgh\r\ndrop me\r\n"
    want = "red\nsame\n  ... (1 duplicate line)\n\nopen ./x and ~/y\nAPI_KEY=[REDACTED]\n"
    assert run(spark, text, Config(always_remove=("^drop",))) == want
    assert run(spark, text, Config(always_remove=("^drop",), always_keep=("drop",)), keep=True) == want + "[lineflow: preserved by always_keep rule]\ndrop me\r"
    assert run(spark, text, Config(passthrough=True)) == text.replace("\r\n", "\n")
    assert run(spark, "drop a\ndrop b", Config(always_remove=("^drop",))) == ""


def test_command_types(spark):
    assert run(spark, "/home/u/app/a.go:1:x\n/home/u/app/a.go:2:y", Config(), "grep") == ">> ./a.go\n  1:x\n  2:y"
    npm = "  console.log\n    hi\n      at f (a.js:1:2)\n\nnpm warn a\nnpm warn b\n(node:1) ExperimentalWarning: x\nTests: 2 passed, 2 total"
    assert run(spark, npm, Config(), "npm").rstrip("\n") == "  [lineflow: 1 console.* log block dropped — run passed]\nnpm warn a\n... and 1 more npm warnings\n(1 experimental warnings)\nTests: 2 passed, 2 total"
    assert "    hi\n" in run(spark, npm, Config(drop_console_on_pass=False), "npm")


def test_long_text_is_summarised_and_cut(spark):
    text = "\n".join(f"line {i}" for i in range(200)) + "\n"
    got = run(spark, text, Config(max_lines=20), exit_code=0)
    assert got.startswith("[lineflow summary]\n  total: 200 lines (1,690 bytes)\n  errors: 0\n  warnings: 0\n  result: PASS\n[/lineflow summary]\n\nline 0\n")
    assert "lines omitted ...]" in got and got.endswith("line 199\n")


def test_registered_type(spark):
    chain.register("shout", ("shout", "yell"), lambda c, cwd, home: [chain.Step("shout", text=lambda d, x: f"upper({x})")])
    assert [chain.identify(x) for x in ("/usr/bin/yell", "C:\\bin\\grep.exe", "nope")] == ["shout", "grep", "generic"]
    assert chain.identify("mine", Config(mapping={"mine": "go"})) == "go"
    assert run(spark, "abc", Config(), "shout").strip() == "ABC"


def test_chain_equals_the_declared_one(spark):
    d = Spark("/root/testdata/sf0.001")
    from lineflow.plans import views

    docs = spark.sql(f"select doc, text from {generic.assemble(d, views.log_lines(d) + ' v', sub=False)} t")
    config = Config(truncate=False)
    steps = [s for s in chain.build(config).steps if s.name not in ("summarize", "stack_traces")]
    order = [s for s in steps if s.name != "compress_paths"]
    order.insert(-1, next(s for s in steps if s.name == "compress_paths"))
    got = {r["doc"]: r["text"] for r in chain.Chain(tuple(order)).apply(docs).collect()}
    docs.createOrReplaceTempView("declared_docs")
    want = {r["doc"]: r["text"] for r in spark.sql(f"select doc, text from {generic.chain(d, 'declared_docs')} q").collect()}
    assert got == want and len(got) > 3


def test_contributions(spark):
    docs = spark.createDataFrame([(1, "\x1b[0mab  \n\n\n\nc")], "doc long, text string")
    steps = chain.Chain(chain.build(Config()).steps[:3])
    got = [(r["step"], r["bytes_before"], r["bytes_after"]) for r in chain.contributions(steps, docs).orderBy("nth").collect()]
    assert got == [("strip_ansi", 13, 9), ("strip_timestamps", 9, 9), ("normalize_whitespace", 9, 6)]


def test_layers_and_clients(tmp_path):
    home, project = tmp_path / "home", tmp_path / "work" / "deep"
    (home / ".config/lineflow").mkdir(parents=True)
    project.mkdir(parents=True)
    (home / ".config/lineflow/config.toml").write_text('[general]\nmax_lines = 1\nmode = "aggressive"\n[truncation]\ngrep = 5')
    (tmp_path / "work/.lineflow.toml").write_text("[general]\nmax_lines = 2\n[filters]\njest_drop_console_on_pass = false")
    (project / "lineflow.toml").write_text('[general]\nmax_lines = 3\nauto_escalate = "hint"')
    c = discover(project, home, {})
    assert (c.max_lines, c.mode, c.limits, c.escalate, c.drop_console_on_pass, c.passthrough) == (3, "aggressive", {"grep": 5}, "hint", False, False)
    assert len(layers(project, home)) == 3 and layers(tmp_path, tmp_path) == []
    assert discover(tmp_path, tmp_path, {"LINEFLOW_PASSTHROUGH": "1"}) == Config(passthrough=True)
    assert [profile_of(x) for x in ("Claude-Desktop", "Cursor", "my gpt", "Google AI", "other", "", None)] == ["claude", "gpt", "gpt", "gemini", "", "", ""]
