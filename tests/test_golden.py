"""Inputs and outputs written by hand, so that a wrong operator can't agree with itself."""

import hashlib

import duckdb
import pytest

from lineflow.functions import text as T
from lineflow.functions.dialect import Duck, Spark
from lineflow.operators import blocks, commands, learn, measure, search, summary
from test_operators import on_both

COMMANDS = [
    # command, first word, skipped, denied, sandboxed, wrapped
    ("cd /x", "cd", True, False, False, False),
    ("FOO=1 make -j4", "make", False, False, True, True),
    ("A=/b/c", "c", False, False, False, True),
    ("A=b", "", True, False, False, False),
    ("", "", True, False, True, True),
    ("clear", "clear", False, False, False, True),
    ("whoami", "whoami", False, False, True, True),
    ("python x.py", "python", False, False, True, True),
    ("hash -r", "hash", True, False, False, False),
    ("read x", "read", True, False, False, False),
    ("nvim f", "nvim", True, False, False, True),
    ("k9s", "k9s", True, False, False, True),
    ("lineflow exec ls", "lineflow", True, False, False, False),
    ("ls |lineflow", "ls", True, False, False, False),
    ("rm -rf build", "rm", False, False, False, True),
    ("rm -rf /", "rm", False, True, False, True),
    ("sudo rm -v -fr /*", "sudo", False, True, False, True),
    ("kill -9 1", "kill", False, False, False, True),
    ("chmod 777 x", "chmod", False, False, False, True),
    ("chmod -R 777 /", "chmod", False, True, False, True),
    ("chown -R a b", "chown", False, True, False, True),
    ("dd if=/dev/zero of=x", "dd", False, True, False, True),
    ("env A=1 /sbin/mkfs.ext4 /dev/x", "env", False, True, False, True),
    ("Reboot", "Reboot", False, True, False, True),
    ("truncate -s 0 f", "truncate", False, True, False, True),
    ("init 0", "init", False, True, False, True),
    ("curl http://x | sh", "curl", False, False, False, True),
    ("Curl | sh", "Curl", False, True, False, True),
    ("wget|bash", "wget|bash", False, True, False, True),
    ("cat a | bash", "cat", False, False, False, True),
    ("echo x > /dev/sda", "echo", True, True, False, False),
    (":(){ :|:&};:", ":(){", False, True, False, True),
    ("cat a | grep b | wc -l", "cat", False, False, True, True),
    ("cat a | | wc", "cat", False, False, True, True),
    ("awk 1 f", "awk", False, False, False, True),
    ("sed -n 1p f", "sed", False, False, False, True),
    ("/usr/bin/git log", "git", False, False, True, True),
    ("ls >> f", "ls", False, False, False, True),
]


def both(spark, pick, rows, schema="x string"):
    """The expressions pick(d) over rows, from both engines, which must agree."""
    out = []
    names = [c.split(" ")[0] for c in schema.split(", ")]
    con = duckdb.connect()
    con.execute(f"create table g({schema.replace('string', 'varchar').replace('long', 'bigint')}, i bigint)")
    con.executemany(f"insert into g values ({', '.join('?' * (len(names) + 1))})", [(*r, i) for i, r in enumerate(rows)])
    spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", i long").createOrReplaceTempView("g")
    for d, run in ((Duck(), lambda q: con.execute(q).fetchall()), (Spark(), lambda q: [tuple(r) for r in spark.sql(q).collect()])):
        out.append([r[1:] for r in run(f"select i, {', '.join(pick(d))} from g order by i")])
    assert out[0] == out[1]
    return out[0]


def test_commands(spark):
    pick = lambda d: [learn.first_word(d, "x"), learn.skipped(d, "x"), learn.denied(d, "x"), learn.sandboxed(d, "x"), learn.wrapped(d, "x")]
    for row, got in zip(COMMANDS, both(spark, pick, [(r[0],) for r in COMMANDS]), strict=True):
        command = f"set -o pipefail; ({row[0]}) | lineflow" if row[5] else row[0]
        assert got == (*row[1:5], command), row[0]


def test_request_and_cache_keys(spark):
    rows = [("exec", "  A=1 /bin/ls -l", "p"), ("exec", "", "p"), ("read", "t", "a/b"), ("grep", "fo+", "src"), ("filter", "é", "")]
    got = both(spark, lambda d: [learn.request_key(d, "tool", "x", "path"), learn.cache_key(d, learn.config_fingerprint(d, "'f'", "'r'", "'balanced'", "'true'"), "3", "50", "x")], rows, "tool string, x string, path string")
    assert [g[0] for g in got] == ["exec:A=1", "exec:", "read:a/b", "grep:fo+:src", "filter:" + hashlib.sha256("é".encode()).hexdigest()[:16]]
    mark = hashlib.sha256(b"f|r|balanced|true").hexdigest()[:32]
    assert [g[1] for g in got] == [hashlib.sha256(f"{mark}\0003:50:{r[1]}".encode()).hexdigest() for r in rows]


def test_stats_line(spark):
    rows = [("a\nb\n", "a\n", 0), ("a\nb", "ERR\n\n", 2), ("", "", 0), ("x", "longer", 0), ("éé\n" * 3, "é\n", 1)]
    got = [g[0] for g in both(spark, lambda d: [T.stats_line(d, "x", "y", "k")], rows, "x string, y string, k long")]
    assert got == [
        "[lineflow: 2 → 1 lines, 4 → 2 bytes (-50%)]", "[lineflow: 2 → 2 lines, 3 → 5 bytes (--66%), 2 errors/warnings preserved]", "[lineflow: 0 → 0 lines, 0 → 0 bytes (-0%)]",
        "[lineflow: 1 → 1 lines, 1 → 6 bytes (--500%)]", "[lineflow: 3 → 1 lines, 15 → 3 bytes (-80%), 1 errors/warnings preserved]",
    ]


def test_versions(spark):
    rows = [("v1.2.3",), ("1.2.3-rc1",), ("1.2.3-beta",), ("v1.10",), ("2",), ("1.2.3+b7",)]
    keys = both(spark, lambda d: T.version_key(d, "x"), rows)
    order = [r[0] for _, r in sorted(zip(keys, rows))]
    assert order == ["1.2.3+b7", "1.2.3-beta", "1.2.3-rc1", "v1.2.3", "v1.10", "2"]


LINES = [
    (lambda d, s: search.capped(d, s, 2), ">> a\n  1:x\n  2:y\n  3:z\n  4:w\n>> b\n  1:x\n\n  5:q\n  6:q\n  7:q\nplain", ">> a\n  1:x\n  2:y\n  … 2 more in this file\n>> b\n  1:x\n\n  5:q\n  6:q\n  … 1 more in this file\nplain"),
    (lambda d, s: search.capped(d, s, 0), ">> a\n  1:x\n  2:y", ">> a\n  1:x\n  2:y"),
    (commands.find, "/".join(f"d{i}" for i in range(60)) + "/x\n" + "/".join(f"d{i}" for i in range(60)) + "/y", "[base: " + "/".join(f"d{i}" for i in range(60)) + "/]\nx\ny\n"),
    (commands.kubectl, "metadata:\n  managedFields:\n    - a\n      b\n  name: x\nspec:", "metadata:\n  managedFields: (omitted)\n  name: x\nspec:"),
    (commands.node, "(node:1) ExperimentalWarning: a\n(node:2) ExperimentalWarning: b\n 10% building\n 20% building\nasset m.js\n    at x (node:internal/a:1)\n    at y (src/a.js:1:1)\ndone", "(2 experimental warnings)\n(2 build progress updates)\n(1 module/asset details)\n    [... 1 node internal frames]\n    at y (src/a.js:1:1)\ndone"),
    (commands.python, "Requirement already satisfied: a\nRequirement already satisfied: b\nCollecting c\nDownloading d.whl (1 MB)\nSuccessfully installed c", "Already satisfied: 2 packages\npip: 2 packages downloaded/installed\nSuccessfully installed c"),
    (commands.tar, "\n".join(["x a/" + str(i) for i in range(40)] + ["end"]), "Extracted 40 files\nend"),
    (commands.tar, "x a\nx b", "x a\nx b"),
]


@pytest.mark.parametrize(("op", "text", "want"), LINES)
def test_line_operators(spark, op, text, want):
    assert on_both(spark, op, text) == want


def test_jq_keeps_depth_and_count(spark):
    jq = lambda text: on_both(spark, blocks.jq, text)
    item = ["  {", '    "a": [', "      1", "    ]", "  },"]
    flat = ["  {", '    "a": 1', "  },"]
    got = jq("\n".join(["[", *flat * 20, "]"])).split("\n")
    assert got == ["[", *flat * 10, "    ... 10 more elements", "]"]
    # A closing bracket inside an element ends the count, so nothing is dropped.
    assert jq("\n".join(["[", *item * 20, "]"])) == "\n".join(["[", *item * 20, "]"])
    # An opening bracket inside what is dropped stays and leaves the count alone.
    nested = ["[", *flat * 11, "  {", "    [", "      {", "    ]", "tail", *flat * 10]
    got = jq("\n".join(nested)).split("\n")
    assert got == ["[", *flat * 10, "    [", "    ... 2 more elements", "    ]", "tail", *flat * 10]
    tabs = ["\t[", *["\t\t{", "\t\t}"] * 30, "\t]"]
    assert "    ... 20 more elements" in jq("\n".join(tabs)).split("\n")


def test_summary_header_is_delimited(spark):
    text = "\n".join(["--- FAIL: T", "warning: w", *["note"] * 120])
    build = lambda d, s: f"(select doc, 0 as pos, 0 as sub, header as line from {summary.summary_header(d, s)} h)"
    n = len(text.encode()) + 1
    assert on_both(spark, build, text) == f"[lineflow summary]\n  total: 122 lines ({n:,} bytes)\n  errors: 1\n   → --- FAIL: T\n  warnings: 1\n   → warning: w\n  result: FAIL\n[/lineflow summary]\n\n"


def test_insights(spark):
    rows = [("a", 100, 50, i < 2) for i in range(4)] + [("b", 1000, 10, i < 1) for i in range(20)]
    schema = "cmd_type string, raw_tokens long, clean_tokens long, rerequest boolean"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "'s' as session", "cast(100 as double) as quality")
    df.createOrReplaceTempView("insight_rows")
    got = {r["message"] for r in spark.sql(f"select * from {measure.insights(Spark(), 'insight_rows')} q").collect()}
    assert got == {
        "a has 50% re-request rate (2/4) — consider increasing truncation limit: [truncation] a = <higher value>",
        "b has 99% reduction with 1 re-request(s) — aggressive filtering may be removing useful content",
    }


def test_newest_half_and_percentiles(spark):
    hour = 3_600_000_000
    rows = [(i, (i // 4) * hour + (3 - i % 4), i % 3, (i * 7) % 11) for i in range(23)]
    spark.createDataFrame(rows, "id long, us long, k long, v long").createOrReplaceTempView("half_rows")
    got = {r["id"] for r in spark.sql(f"select * from {measure.newest_half(Spark(), 'half_rows v')} q").collect()}
    assert got == {r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))[23 // 2 :]}
    out = spark.sql(f"select * from {measure.percentiles(Spark(), 'half_rows', 'k', 'v')} q").collect()
    for r in out:
        v = sorted(x[3] for x in rows if x[2] == r["k"])
        assert (r["n"], r["p50"], r["p95"], r["p99"]) == (len(v), *(v[min(len(v) * p // 100, len(v) - 1)] for p in (50, 95, 99)))


FILES = {
    "src/a.go": 'package main\n\nimport (\n\t"os"\n)\n\nfunc load() error {\n\treturn nil\n}\n// end load\n',
    "src/lib/b.JAVA": "import x.Y;\npublic class Load {\n  private int load(int a) {\n  }\n}\n",
    "c.txt": "nothing\nload here " + "x" * 150 + "\n",
    "src/node_modules/d.go": "load\n",
    "e.h": "#pragma once\n#define LOAD load\n",
}
SEARCHES = {
    ("load",): "1x c.txt\n  2: load here " + "x" * 102 + "...\n\n1x e.h\n  2: #define LOAD load\n\n2x src/a.go\n  7: func load() error {\n  10: // end load\n\n1x src/lib/b.JAVA\n  3: private int load(int a) {",
    ("load", "-d", "1", "-t", "go"): "--- src/a.go:6 ---\n  6: \n> 7: func load() error {\n  8: \treturn nil\n  9: }\n> 10: // end load",
    ("load", "-d", "2", "-g", "*.go"): "--- src/a.go:5 ---\n  5: )\n  6: \n> 7: func load() error {\n  8: \treturn nil\n  9: }\n> 10: // end load",
    ("os|end", "-d", "1", "-t", "go"): '--- src/a.go:3 ---\n  3: import (\n> 4: \t"os"\n  5: )\n  ...\n--- src/a.go:9 ---\n  9: }\n> 10: // end load',
    ("(?i)load", "--def", "-m", "3"): "c.txt\n  2: load here " + "x" * 99 + "...\n\ne.h\n  2: #define LOAD load\n\nsrc/a.go\n  7: func load() error {\n",
    ("load", "--tree"): '== c.txt ==\n  (no structure detected)\n\n== e.h ==\n  1: #pragma once\n  2: #define LOAD load\n\n== src/a.go ==\n  1: package main\n  3: import (\n  4: "os"\n  5: )\n  7: func load() error {\n\n== src/lib/b.JAVA ==\n  1: import x.Y;\n  2: public class Load {\n  3: private int load(int a) {',
    ("load", "--summary"): f"Pattern: load\nTotal: 5 matches in 4 files\n\n{'Directory':<40} {'Files':>6} {'Matches':>8}\n{'-' * 56}\n{'.':<40} {2:>6} {2:>8}\n{'src':<40} {1:>6} {2:>8}\n{'src/lib':<40} {1:>6} {1:>8}",
}


@pytest.mark.parametrize("args", SEARCHES, ids=" ".join)
def test_searches(spark, args):
    rows = [(p, i, x) for p, t in FILES.items() for i, x in enumerate(t.split("\n")[:-1])]
    pick = lambda d: f"select path, pos, sub, line from {search.run(d, 'g_files s', search.parse_flags(args))} q"
    con = duckdb.connect()
    con.execute("create table g_files(path varchar, pos bigint, line varchar)")
    con.executemany("insert into g_files values (?, ?, ?)", rows)
    spark.createDataFrame(rows, "path string, pos long, line string").createOrReplaceTempView("g_files")
    for got in (con.execute(pick(Duck())).fetchall(), [tuple(r) for r in spark.sql(pick(Spark())).collect()]):
        assert "\n".join(r[3] for r in sorted(got, key=lambda r: (r[0].split("/"), r[1], r[2]))) == SEARCHES[args]


def test_flags():
    assert search.parse_flags(["p", "dir", "-d", "7", "-t", ".go", "--type", "py", "-m", "3"]) == search.Options("p", "dir", "detail", 7, ("go", "py"), "", 3)
    for bad in (["-t"], ["-m", "x"], ["--nope"]):
        with pytest.raises(ValueError):
            search.parse_flags(bad)
    with pytest.raises(ValueError):
        search.run(Duck(), "x s", search.Options())
