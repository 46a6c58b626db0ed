"""Mixing against its SQL, with buckets cut finer and finer."""

import duckdb
import pytest
from test_llm import prose

from lineflow.llm import mixing
from lineflow.llm.queries import OP3


@pytest.mark.parametrize("steps, edge", [(4096, 100_000), (3, 2), (2, 1)])
def test_equals_sql_at_every_depth(spark, monkeypatch, steps, edge):
    monkeypatch.setattr(mixing, "STEPS", steps)
    monkeypatch.setattr(mixing, "EDGE", edge)
    rows = [(i, None if i % 17 == 0 else prose(i % 40, 5 + i % 60), None if i % 11 == 0 else "abc"[i % 3 if i % 5 else 0]) for i in range(300)]
    spark_rows = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, taken string").repartition(4)
    got = sorted(tuple(r) for r in mixing.mix(spark_rows).select("doc_id", "size", "source_size", "target", "taken").collect())
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    want = sorted(con.execute(OP3).fetchall())
    assert [(a, b, c, round(d, 6), e) for a, b, c, d, e in got] == [(a, b, c, round(d, 6), e) for a, b, c, d, e in want] and sum(r[4] for r in want) > 0
