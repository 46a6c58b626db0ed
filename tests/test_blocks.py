"""Block operators of both engines against outputs written by hand."""

from test_operators import on_both

from lineflow.operators import blocks


class Both:
    """The operators as functions of a text, which both engines must agree on."""

    def __init__(self, spark):
        of = lambda op: lambda text, **args: on_both(spark, (lambda d, src: op(d, src, **args)) if args else op, text)
        self.go, self.python, self.script, self.node = map(of, (blocks.go_traces, blocks.python_traces, blocks.script_traces, blocks.node_traces))
        self.jq, self.tree = map(of, (blocks.jq, blocks.tree))
        self.strip_console = lambda text, drop_all=False: of(blocks.console)(text, drop="true" if drop_all else "false")
        self.console = lambda text, drop=True: of(blocks.console)(text, drop="passed" if drop else "false")


def test_go_traces_collapse(spark):
    s = Both(spark)
    block = "goroutine {} [running]:\nmain.f()\n\t/a.go:1\nruntime.goexit()\n\t/r.s:2\n"
    got = s.go("head\n" + block.format(1) + "\n" + block.format(2) + "\ntail")
    assert got.split("\n") == ["head", "goroutine 1 [running]:", "main.f()", "\t/a.go:1", "", "[... 1 more goroutine with identical stack]", "", "tail"]
    assert s.go("plain") == "plain"
    one = "goroutine 1 [running]:\na()\n\nlost\ngoroutine 2 [x]:\nb()\ngoroutine 3 [y]:\nb()\ngoroutine 4 [y]:\nb()\nc()\n\td\n\te\nf()\n\tg"
    assert s.go(one).split("\n") == ["goroutine 1 [running]:", "a()", "", "goroutine 2 [x]:", "b()", "[... 1 more goroutine with identical stack]", "", "goroutine 4 [y]:", "b()", "c()", "\td", "f()", "\tg", "\te"]
    alone = "goroutine 1 [running]:\nruntime.goexit()\n\tx\n\ngoroutine 2 [running]:\nmain.f()"
    assert s.go(alone) == alone


def test_python_traces(spark):
    s = Both(spark)
    frames = "".join(f'  File "f{i}.py", line {i}, in g\n    c{i}\n' for i in range(7))
    got = s.python(f"Traceback (most recent call last):\n{frames}ValueError: x")
    assert "[... 5 more frames]" in got and "f0.py" in got and "f6.py" in got and "f3.py" not in got
    short = s.script(f"Traceback (most recent call last):\n{frames}ImportError: x")
    assert short.count("File") == 7
    assert "  ... 5 more frames ..." in s.script(f"Traceback (most recent call last):\n{frames}ValueError: x")


def test_python_exception_text_belongs_to_the_trace(spark):
    s = Both(spark)
    frames = "".join(f'  File "f{i}.py", line {i}, in g\n' + (f"    c{i}\n" if i % 2 else "") for i in range(6))
    text = f"Traceback (most recent call last):\n{frames}ValueError: x\nTraceback (most recent call last):\n\nend"
    got = s.python(text).split("\n")
    assert got == ["Traceback (most recent call last):", '  File "f0.py", line 0, in g', "  [... 4 more frames]", '  File "f5.py", line 5, in g', "    c5", "ValueError: x", "Traceback (most recent call last):", "", "end"]


def test_node_traces(spark):
    s = Both(spark)
    got = s.node("TypeError: x\n    at a (s.js:1)\n    at b (s.js:2)\n    at c (s.js:3)\n    at d (node_modules/x)\n    at e (node:i)\nend")
    assert got.split("\n") == ["TypeError: x", "    at a (s.js:1)", "    at b (s.js:2)", "    [... 1 node_modules frames, 1 node internals, 1 more app frames]", "end"]
    for head, folds in (("  Uncaught Error: x", True), ("Exception: x", True), ("error: x", False), ("Error:x", False), ("Oops: Error: x", False)):
        assert ("[... 1 node_modules frames]" in s.node(f"{head}\n  at d (node_modules/x)")) == folds, head


def test_jq_and_tree(spark):
    s = Both(spark)
    text = "\n".join(["["] + ["{", "}"] * 30 + ["]"])
    assert "  ... 20 more elements" in s.jq(text) and s.jq("[\n]") == "[\n]"
    tree = "\n".join([".", "├── a", "│   ├── b", "│   │   ├── c", "│   │   │   ├── f.go", "├── p", "│   ├── q.txt", "├── r", "│   ├── s", "│   ├── t.txt", "", "3 directories, 2 files"] + ["├── z.txt"] * 20)
    # The root's next line is no deeper, so it starts no chain; c has the file under it and ends one.
    assert s.tree(tree).split("\n")[:11] == [".", "├── a/b/c", "│   │   │   ├── f.go", "├── p", "│   ├── q.txt", "├── r", "├── s", "│   ├── t.txt", "", "3 directories, 2 files", "├── z.txt"]


def test_console_blocks(spark):
    s = Both(spark)
    block = "  console.log\n    hi\n      at f (a.js:1:2)\n\n"
    assert s.strip_console(block * 3 + "PASS x") == "    hi\n    ... and 2 identical console blocks\nPASS x"
    assert s.strip_console(block * 2 + "PASS x") == "    hi\n    ... and 1 identical console blocks\nPASS x"
    assert s.strip_console(block * 2 + "PASS x", drop_all=True) == "  [lineflow: 2 console.* log blocks dropped — run passed]\nPASS x"
    gap = "  console.log\n    hi\n\n      at f (a.js:1:2)\n"
    assert s.strip_console(gap) == gap
    inside = "  console.warn\n    a\n   \n    b\n      at f (a.js:1:2)\nx"
    assert s.strip_console(inside) == "    a\n   \n    b\nx"
    stack = "  console.error\n    Error: a\n      at f (a.js:1:2)\n      at g (a.js:1:2)\nx"
    assert s.strip_console(stack) == stack
    green, red = block + "Tests: 2 passed, 2 total", block + "Tests: 1 failed, 2 total"
    assert s.console(green) == "  [lineflow: 1 console.* log block dropped — run passed]\nTests: 2 passed, 2 total"
    assert s.console(red) == s.console(green, False).replace("2 passed", "1 failed") == "    hi\nTests: 1 failed, 2 total"
    assert s.console(block + "done") == "    hi\ndone"

def test_overlapping_and_nested_console_blocks(spark):
    s = Both(spark)
    frame = "      at f (a.js:1:2)"
    cases = [
        (f"console.log\n  console.warn\n  x\n{frame}\nend", "  console.warn\n  x\nend"),
        (f"console.log\n{frame}\nend", "end"),
        (f"console.log\n{frame}\n{frame}\nend", f"console.log\n{frame}\n{frame}\nend"),
        (f"console.log\n  a\n{frame}\nconsole.log\n  a\n{frame}\nconsole.log\n  b\n{frame}", "  a\n  ... and 1 identical console blocks\n  b"),
        (f"console.log\n  a\n{frame}\n\n\nconsole.log\n  a\n{frame}", "  a\n\n  a"),
        ("console.log\n" + "  x\n" * 9 + frame, "\n".join(["  x"] * 9)),
        ("console.log\n" + "  x\n" * 10 + frame, "console.log\n" + "  x\n" * 10 + frame),
        ("console.log\n" + "  x\n" * 5 + "console.info\n" + "  y\n" * 5 + frame, "console.log\n" + "  x\n" * 5 + "\n".join(["  y"] * 5)),
        (f"  console.log\n  x\n    console.error\n  y\n{frame}\n  console.log\n  z\n{frame}", "  x\n    console.error\n  y\n  z"),
        (f"console.log\nbare\n{frame}", f"console.log\nbare\n{frame}"),
    ]
    for text, want in cases:
        assert s.strip_console(text) == want, text


def test_headers_in_a_row_and_calls_that_look_like_code(spark):
    s = Both(spark)
    head, call = "Traceback (most recent call last):", '    File "a.py", line 1, in f'
    # The second header is the error of the first; the third opens a trace of three frames.
    text = "\n".join([head, head, head, *[call, "    x()"] * 3, "ValueError: y"])
    assert s.script(text).split("\n") == [head, head, head, call, "    x()", "  ... 1 more frames ...", call, "    x()", "ValueError: y"]
    # Calls indented like code are code of the call before them, so six of them are three frames.
    assert s.script("\n".join([head, *[call] * 6, "E: z"])).split("\n") == [head, call, call, "  ... 1 more frames ...", call, call, "E: z"]


def test_all_traces_in_order(spark):
    dump = "goroutine {} [running]:\nmain.f()\n\t/a.go:1\n\n"
    text = dump.format(1) + dump.format(2) + "TypeError: x\n    at a (s.js:1)\n    at b (node_modules/y)\nend"
    assert on_both(spark, blocks.traces, text).split("\n") == ["goroutine 1 [running]:", "main.f()", "\t/a.go:1", "", "[... 1 more goroutine with identical stack]", "", "TypeError: x", "    at a (s.js:1)", "    [... 1 node_modules frames]", "end"]
