"""Segmented scans against the plain operators, runs that cross pieces, one document over many tasks, order in long documents."""

import random

import pytest
from test_operators import on_both

from lineflow.functions.dialect import Duck, Spark
from lineflow.operators import commands, generic, segmented, summary


def lines_of(text):
    return "\n".join(text)


@pytest.mark.parametrize("size", [1, 2, 5, 64])
def test_dedup_of_runs_over_pieces(spark, size):
    r = random.Random(size)
    text = [x for _ in range(40) for x in [r.choice("ab")] * r.choice([1, 1, 2, 3, 9, 17])]
    got = on_both(spark, lambda d, src: segmented.dedup(d, src, size), lines_of(text))
    assert got == on_both(spark, generic.dedup, lines_of(text))


@pytest.mark.parametrize("size", [1, 3, 7])
def test_counters_truncation_and_joins(spark, size):
    r = random.Random(size)
    log = [r.choice(["a.txt 100% 12KB 1.2MB/s", "1,2 45% 1.2MB/s 0:01", "", "done", "debug1: x", "sent 3 bytes"]) for _ in range(120)]
    assert on_both(spark, lambda d, src: commands.ssh(d, src, size), lines_of(log)) == on_both(spark, commands.ssh, lines_of(log))
    runs = [r.choice(["ok a", "Tests: 1 failed, 2 total", "b", "PASS x"]) for _ in range(60)]
    for most in (0, 10, 59, 60, 61):
        assert on_both(spark, lambda d, src, most=most: segmented.truncate(d, src, most, size), lines_of(runs)) == on_both(spark, lambda d, src, most=most: summary.truncate(d, src, most), lines_of(runs))


def test_order_in_long_documents(spark):
    """A copied file, a blank and the end, far behind 100,000 and 200,000 other lines."""
    for before in (3, 100_050, 300_050):
        src = f"(select 1L as doc, id as pos, concat('line ', id) as line from range({before}) union all select * from values (1L, {before}L, 'a.txt 100% 12KB 1.2MB/s'), (1L, {before + 1}L, ''), (1L, {before + 2}L, 'done')) v"
        got = spark.sql(f"select line from {commands.ssh(Spark(), src)} q where line not like 'line%' order by doc, pos, sub")
        assert [r["line"] for r in got.collect()] == ["", "scp: 1 files transferred", "done"]


def test_one_document_over_many_tasks(spark):
    """A million lines of one document: every task gets a part, and the result is known."""
    n, size = 1_000_000, 1 << 15
    src = f"(select 1L as doc, id as pos, cast(case when id between 300000 and 700000 then -1 else id div 3 end as string) as line from range(0, {n}, 1, 8)) v"
    placed = spark.sql(f"select spark_partition_id() as p, count(*) as n from (select /*+ repartition(8, doc, piece) */ * from {segmented.cut(Spark(), src, size)} c) q group by 1").collect()
    assert len(placed) >= 4 and max(r["n"] for r in placed) < n
    got = spark.sql(f"select * from {segmented.dedup(Spark(), src, size)} q").persist()
    assert [r["line"] for r in got.where("pos = 300000").orderBy("sub").collect()] == ["-1", "  ... (400000 duplicate lines)"]
    assert got.where("pos between 300001 and 700000").count() == 0
    assert got.where("sub = 0").count() == 100_000 + 1 + 100_001
    got.unpersist()


def test_identical_warnings(spark):
    text = ["(node:1) Warning: a", "  at x", "(node:22) Warning: a", "  at x", "(node:3) Warning: a", "  at y", "plain", "(node:4) Warning: b", "(node:5) Warning: b", "end"]
    got = on_both(spark, generic.collapse_node_warnings, lines_of(text))
    assert got.split("\n") == ["(node:1) Warning: a", "  at x", "... and 1 identical warning from other workers", "(node:3) Warning: a", "  at y", "plain", "(node:4) Warning: b", "... and 1 identical warning from other workers", "end"]


def test_stderr_chain_hides_secrets_before_it_compares(spark):
    """Two warnings that differ in their secret alone are one."""
    text = "(node:1) Warning: TOKEN=abcdefgh1\n(node:2) Warning: TOKEN=zyxwvuts2\nx"
    spark.createDataFrame([(1, text)], "doc long, text string").createOrReplaceTempView("stderr_texts")
    got = spark.sql(f"select text from {generic.stderr_chain(Spark(), 'stderr_texts')} q").first()["text"]
    assert got == "(node:1) Warning: TOKEN=[REDACTED]\n... and 1 identical warning from other workers\nx"
    assert "stderr_texts" in generic.stderr_chain(Duck(), "stderr_texts")
