"""Learning through a sketch of frequent lines against the plain form."""

import random

import pytest

from lineflow.functions.dialect import Spark
from lineflow.operators import learn

SCHEMA = "ts long, session string, cmd string, norm string, level int"


def both(spark, rows, **options):
    spark.createDataFrame(rows, SCHEMA).repartition(7).createOrReplaceTempView("observed_rows")
    d = Spark()
    want = spark.sql(f"select * from {learn.analyse(d, 'observed_rows', **options)} q").collect()
    assert spark.sql(f"select * from {learn.analyse_frequent(d, 'observed_rows', **options)} q").collect() == want
    return want


def test_no_frequent_line_is_lost(spark):
    """Shares at, just under and over the bounds among thousands of lines that stand once."""
    r = random.Random(4)
    n = 20_000
    lines = [f"hot {k}" for k in range(12) for _ in range(n // 20 + k - 6)]
    lines += [f"cold {k}" for k in range(n - len(lines))]
    r.shuffle(lines)
    rows = [(k, f"s{k % 4}", f"c{k % 3}", x, 3 if x == "hot 9" and k % 2 else 0) for k, x in enumerate(lines)]
    got = both(spark, rows)
    assert [g["norm"] for g in got] == ["hot 11", "hot 10", "hot 8", "hot 7", "hot 6"] and got[0]["n"] == n // 20 + 5
    assert len(both(spark, rows, least=0.0001, most=1.0, noise=0.0, top=50)) == 11


@pytest.mark.parametrize("rows", [[], [(1, "a", "c", "x", 0)], [(k, None, None, "x", None) for k in range(5)], [(k, f"s{k}", "c", "", 0) for k in range(5)]])
def test_small_and_null(spark, rows):
    both(spark, rows, sessions=1, most=1.0)


def test_only_frequent_lines_are_shuffled(spark):
    """The group by line stands behind the broadcast of the sketch's lines."""
    spark.range(1000).selectExpr("id as ts", "'s' as session", "'c' as cmd", "concat('l', id) as norm", "0 as level").createOrReplaceTempView("observed_range")
    plan = spark.sql(f"select * from {learn.analyse_frequent(Spark(), 'observed_range')} q")._jdf.queryExecution().executedPlan().toString()
    # Printed from the result down to the sources.
    assert plan.index("hashpartitioning(norm") < plan.index("LeftSemi") and plan.count("hashpartitioning(norm") == 1 and "approx_top_k" in plan
