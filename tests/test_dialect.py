"""Patterns mean the same in both engines, on lines chosen to tell them apart."""

import duckdb
import pytest

from lineflow.functions import patterns as P
from lineflow.functions.dialect import Duck, Spark, java

LINES = [
    "", " ", "error", "Error:", "éerror", "errors", "0 errors", "a\rb", "abc\n", "x\x0berror", "panic: x", "  File \"a.py\", line 3", "\tat Object.x", "FAIL a b", "12 failed", "[x]", "a]b", "Ünïcode ERROR ö",
    "src/a.go:1:2: error[E1]: x", "warning TS12: y", "--- FAIL: T", "● z", "[12:00:00] x", "2024-01-01T00:00:00Z y", "(node:1) w", "-_=~", "C:\\x\\y.txt", "json parse error", "= note: a", "\x1b[31m", "10.0.0.1:80", "3.5 MB", "5ms", "v1.2.3-rc", "deadbeef",
]


def every_pattern():
    found = [v for k, v in vars(P).items() if k.isupper() and isinstance(v, str)]
    found += [p for v in (P.CRITICAL_TRIMMED, P.CRITICAL_RAW, P.ERROR_PLAIN, P.PARSE_ERROR, P.WARNING_WORDS, P.FAILURE_ANCHORS, P.QUALITY_CREDIT) for p in v]
    return found + [p for p, _ in P.RUNNER_ANCHORS] + [p for _, p in P.DETECT_FIRST] + [p for _, p, _ in P.DETECT_COUNTED] + [p for _, p in P.NORMAL]


def test_patterns_agree(spark):
    s, d = Spark(), Duck()
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, x string")
    rows.createOrReplaceTempView("dialect_lines")
    con = duckdb.connect()
    con.execute("create table dialect_lines(i int, x varchar)")
    con.executemany("insert into dialect_lines values (?, ?)", list(enumerate(LINES)))
    patterns = every_pattern()
    pick = lambda q: f"select i, {', '.join(f'{q.match(chr(120), p)} as c{k}' for k, p in enumerate(patterns))} from dialect_lines order by i"
    got = [tuple(r) for r in spark.sql(pick(s)).collect()]
    want = con.execute(pick(d)).fetchall()
    assert got == want


@pytest.mark.parametrize(("re2", "expected"), [(r"a$", r"a\z"), (r"[\s]", r"[ \t\n\f\r]"), (r"\S", r"[^ \t\n\f\r]"), (r"(?i)x.", r"(?iu)x[^\n]")])
def test_translation(re2, expected):
    assert java(re2) == expected
