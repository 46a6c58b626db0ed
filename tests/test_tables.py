"""Printed tables and verdicts of both engines against texts written by hand."""

import duckdb

from lineflow.functions.dialect import Duck, Spark
from lineflow.operators import summary, tables


def printed(spark, build, values, columns):
    """The lines (or the JSON) of both engines, which must agree."""
    out = []
    con = duckdb.connect()
    for d, run in ((Duck(), lambda q: con.execute(q).fetchall()), (Spark(), lambda q: [tuple(r) for r in spark.sql(q).collect()])):
        rows = " union all ".join("select " + ", ".join(f"{v} as {c}" for v, c in zip(row, columns)) for row in values)
        got = run(f"select * from {build(d, f'({rows}) v')} q")
        out.append([r[-1] for r in sorted(got)])
    assert out[0] == out[1]
    return out[0]


PARITY = ("name", "base_reduction", "candidate_reduction", "drift", "missing_in_base", "missing_in_candidate", "over_limit")
ITEMS = [("'a'", "50.0", "51.5", "1.5", "false", "false", "false"), ("'b'", "40.0", "30.0", "-10.0", "false", "false", "true"), ("'c'", "20.0", "0.0", "0.0", "false", "true", "true")]


def test_parity(spark):
    assert printed(spark, lambda d, src: tables.parity_table(d, src, "linux", "win"), ITEMS, PARITY) == [
        "Bench parity: linux vs win", "  thresholds: per-fixture 5.0pp, total-avg 5.0pp", "  linux avg: 36.67%   win avg: 40.75%   drift: +4.08pp", "  max per-fixture drift: -10.00pp", "  status: FAIL", "",
        "Fixture                           linux        win      Drift", "! b                               40.00      30.00     -10.00", "  a                               50.00      51.50      +1.50", "! c                               20.00          -    missing",
    ]
    good = printed(spark, lambda d, src: tables.parity_json(d, src, "linux", "win"), ITEMS[:1], PARITY)[0]
    assert good == '{\n  "baseline_label": "linux",\n  "candidate_label": "win",\n  "baseline_avg": 50.00,\n  "candidate_avg": 51.50,\n  "avg_drift": 1.50,\n  "max_drift": 1.50,\n  "per_fixture_limit": 5.00,\n  "avg_limit": 5.00,\n  "pass": true,\n  "results": [\n    {\n      "name": "a",\n      "baseline_reduction": 50.00,\n      "candidate_reduction": 51.50,\n      "drift": 1.50,\n      "over_threshold": false,\n      "missing_in_baseline": false,\n      "missing_in_candidate": false\n    }\n  ]\n}\n'


def test_quality_and_steps(spark):
    rows = [("'b'", "10", "9", "90.0"), ("'a\"x'", "0", "0", "100.0")]
    columns = ("name", "important", "preserved", "score")
    assert printed(spark, tables.quality_table, rows, columns) == [
        "Quality Score Report", "====================", "", "Fixture                   Important  Preserved      Score", 'a"x                               0          0     100.0%', "b                                10          9      90.0% <!>", "",
        "Total                            10          9      90.0%",
    ]
    assert '"name": "a\\"x"' in printed(spark, tables.quality_json, rows, columns)[0]
    steps = [("1", "'ansi'", "12345", "6172", "999"), ("2", "'dedup'", "6172", "6172", "1500")]
    assert printed(spark, lambda d, src: tables.steps_table(d, src, "log"), steps, ("nth", "step", "bytes_before", "bytes_after", "us"))[3:] == [
        "Filter                       Before      After  Reduction       Time", "ansi                         12,345      6,172     -50.0%    999.0us", "dedup                         6,172      6,172      -0.0%      1.5ms",
    ]


def test_latency_and_status(spark):
    got = printed(spark, tables.latency_table, [("100", "2048", "10", "2500", "400", "300", "900", "2400")], ("iterations", "bytes", "min_us", "max_us", "mean_us", "p50_us", "p95_us", "p99_us"))
    assert got[3:7] == ["  Iterations: 100", "  Input size: 2,048 bytes", "  Min:        10.0us", "  Max:        2.5ms"] and got[-1] == "  P99:        2.4ms"
    columns = ("n", "sessions", "commands", "oldest", "newest")
    assert printed(spark, lambda d, src: tables.status_table(d, src, "7"), [("0", "0", "0", "null", "null")], columns) == ["lineflow learn: no observations collected yet.", "Run 'lineflow learn run <command>' to start observing."]
    assert printed(spark, lambda d, src: tables.status_table(d, src, "7"), [("3", "2", "1", "'x'", "'y'")], columns)[1:] == ["  Observations: 3", "  Sessions:     2", "  Commands:     1", "  Store size:   7 bytes", "  First entry:  x", "  Last entry:   y"]


def test_verdict_of_two_streams(spark):
    """The runner's word on stdout, then on stderr, then the exit code, then what lines say."""
    cases = [("'PASS'", "'FAIL'", "1", "true", "false", "PASS"), ("null", "'FAIL'", "0", "false", "true", "FAIL"), ("null", "null", "0", "true", "false", "PASS"), ("null", "null", "2", "false", "true", "FAIL"), ("null", "null", "-1", "true", "true", "FAIL"), ("null", "null", "-1", "false", "true", "PASS"), ("null", "null", "-1", "false", "false", "unknown")]
    for *given, want in cases:
        assert spark.sql(f"select {summary.resolved(Spark(), *given)} as v").first()["v"] == want == duckdb.sql(f"select {summary.resolved(Duck(), *given)}").fetchall()[0][0]
