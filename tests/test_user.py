"""A user's chain and fold called from SQL."""

import pytest
from pyspark.sql.types import LongType, StringType

from lineflow.operators import user


def collapse():
    """Runs of equal lines as the line and a count; a local class, which workers get by value."""

    class Collapse:
        def __init__(self):
            self.last, self.n = None, 0

        def line(self, line):
            if line == self.last:
                self.n += 1
                return
            yield from self.end()
            self.last, self.n = line, 1

        def end(self):
            if self.n:
                yield self.last if self.n == 1 else f"{self.last} x{self.n}"

    return Collapse


ROWS = [(1, 3, "b", 0), (1, 1, "a", 0), (1, 2, "a", 0), (2, 1, None, 0), (2, 2, "", 0), (None, 1, "z", 0), (None, None, "y", 0), (3, 1, "skip", 0)]
SCHEMA = "doc long, pos int, line string, extra int"


def registered(spark, rows=ROWS, schema=SCHEMA):
    user.register_chain(spark, "my_chain", user.each(lambda x: [] if x == "skip" else [x]), collapse(), user.each(lambda x: x.split("|")))
    spark.createDataFrame(rows, schema).createOrReplaceTempView("user_lines")
    return "select * from my_chain(table(user_lines))"


def test_chain(spark):
    got = spark.sql(registered(spark) + " order by doc nulls first, pos").collect()
    assert [tuple(r) for r in got] == [(None, 0, "y"), (None, 1, "z"), (1, 0, "a x2"), (1, 1, "b"), (2, 0, " x2")]
    assert spark.sql(registered(spark, [])).collect() == []


@pytest.mark.parametrize("schema, says", [("doc long, pos int, text string, extra int", "one column line"), ("doc long, pos string, line string, extra int", "column pos"), ("doc double, pos int, line string, extra int", "column doc")])
def test_columns_are_checked_at_analysis(spark, schema, says):
    with pytest.raises(Exception, match=says):
        spark.sql(registered(spark, [], schema)).schema


def test_bad_registrations(spark):
    for bad in (lambda: user.register_chain(spark, "x y", collapse()), lambda: user.register_chain(spark, "empty")):
        with pytest.raises(Exception):
            bad()


@pytest.mark.parametrize("most", [1, 10_000])
def test_fold(spark, most):
    user.register_fold(spark, "longest", StringType(), LongType(), int, lambda n, x: max(n, len(x)), max, int, most)
    rows = [(1, "ab"), (2, "q"), (1, None), (1, "abc"), (4, None), (3, ""), (None, "abcd"), (2, "wxyz")]
    spark.createDataFrame(rows, "key int, value string").repartition(3).createOrReplaceTempView("user_values")
    sql = "select * from longest(table(select * from longest_parts(table(%s))))"
    assert sorted((tuple(r) for r in spark.sql(sql % "user_values").collect()), key=str) == [(1, 3), (2, 4), (3, 0), (4, 0), (None, 4)]
    assert spark.sql(sql % "select * from user_values where key > 9").collect() == []
    assert spark.sql("select * from longest_parts(table(user_values))").rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="column value"):
        spark.sql(sql % "select key, 1 as value from user_values").schema
