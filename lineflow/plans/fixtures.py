"""Documents in the shape of the bench's fixed corpus (S-16): name, command type, template lines and how many of them.

Every document is written by `range` and arithmetic alone, the same in both engines.
"""

from __future__ import annotations

from lineflow.functions.dialect import Dialect
from lineflow.plans import views

_SEARCH = [">> src/a{m}.go", "  {n}: func run()", "  {n}: return nil", ""]
_TRACE = ["goroutine {n} [running]:", "main.f({m})", "\t/a/b.go:{n}", "", "Traceback (most recent call last):", '  File "a.py", line {n}, in f', "    g()", "ValueError: x{m}"]
_MIXED = ["ERROR: cannot open f{n}", "WARNING: slow {m}", "INFO ok {n}", "DEBUG x{m}", "export API_KEY=fake{n}value", "health check ok"]
_DIFF = ["diff --git a/f{m} b/f{m}", "index a1b2c3..d4e5f6 100644", "old mode 100644", "similarity index 9{m}%", "@@ -{n},2 +{n},2 @@", "-removed {n}", "+added {n}", " same {m}"]
_PATHS = ["./src/lib/f{n}.go", "./src/lib/deep/g{n}.go", "./docs/h{m}.md"]

#: name: (command type, template lines, number of lines).
FIXTURES: dict[str, tuple[str, list[str], int]] = {
    "grep large": ("grep", views.COMMANDS["grep"], 500),
    "git log verbose": ("git", views.COMMANDS["git"], 400),
    "git diff large": ("git", _DIFF, 240),
    "go test mixed": ("go", views.COMMANDS["go"], 60),
    "find deep tree": ("find", _PATHS, 300),
    "docker build": ("docker", views.COMMANDS["docker"], 120),
    "npm install": ("npm", views.COMMANDS["npm"], 120),
    "cargo build": ("cargo", views.COMMANDS["cargo"], 150),
    "make build": ("make", views.COMMANDS["make"], 150),
    "stack traces": ("generic", _TRACE, 80),
    "noisy log": ("generic", views.LOG, 500),
    "mixed errors": ("generic", _MIXED, 150),
    "ctx scan": ("generic", _SEARCH, 120),
    "ctx detail": ("generic", _SEARCH, 90),
    "curl verbose": ("curl", views.COMMANDS["curl"], 60),
    "python traceback": ("python", [*views.COMMANDS["python"], *_TRACE[4:]], 80),
    "terraform plan": ("terraform", views.COMMANDS["terraform"], 120),
    "kubectl describe": ("kubectl", views.COMMANDS["kubectl"], 90),
    "tar listing": ("tar", views.COMMANDS["tar"], 120),
    "ssh remote": ("ssh", views.COMMANDS["ssh"], 60),
    "node runtime": ("node", views.COMMANDS["node"], 120),
}


def lines(d: Dialect) -> str:
    """(name, cmd_type, pos, line) of all fixtures."""
    rows = []
    for k, (name, (kind, templates, count)) in enumerate(FIXTURES.items()):
        body = d.item(d.array(*map(d.lit, templates)), f"cast(({d.div('n', '2')}) % {len(templates)} as int) + 1")
        text = f"replace(replace(replace({body}, '{{n}}', cast(n % 97 as varchar(20))), '{{m}}', cast(n % 7 as varchar(20))), '{{t}}', concat('2024-01-0', cast(n % 9 + 1 as varchar(20)), 'T10:00:00Z'))"
        rows.append(f"select {d.lit(name)} as name, {d.lit(kind)} as cmd_type, n as pos, {text} as line from {d.numbers(0, count)} f{k}")
    return "(" + " union all ".join(rows) + ")"
