"""Streams against their batch twins (R-04 to R-07)."""

from datetime import datetime, timedelta

from lineflow.functions.dialect import Spark
from lineflow.operators import learn
from lineflow.streaming import filter as streams

START = datetime(2024, 1, 1)


def drained(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.sql(f"select * from {name}").collect()


def fed(spark, rows, schema, path, parts):
    """A stream of `rows` in several files, one a micro-batch."""
    size = -(-len(rows) // parts)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").json(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


def test_requests_equal_the_batch_form(spark, tmp_path):
    rows = [(i, START + timedelta(seconds=19 * i + i % 5), i % 3, "ab"[i % 2], f"r{i % 4}", 50 * (i % 3), i % 7 == 0) for i in range(60)]
    schema = "id long, ts timestamp, tool long, key string, raw_key string, max_lines long, no_trunc boolean"
    got = drained(spark, streams.recent_requests(fed(spark, rows, schema, tmp_path / "in", 5)), "requests_out", tmp_path)
    spark.createDataFrame(rows, schema).selectExpr("*", "unix_micros(ts) us").createOrReplaceTempView("request_rows")
    want = spark.sql(f"select * from {learn.rerequests(Spark(), 'request_rows')} q").collect()
    assert sorted((r["id"], r["type"], r["since_us"]) for r in got) == sorted((r["id"], r["type"], r["since_us"]) for r in want) and {r["type"] for r in want} >= {"escalation", "similar"}


def test_bursts_of_files(spark, tmp_path):
    at = lambda ms: START + timedelta(milliseconds=ms)
    rows = [("w", "a", at(0)), ("w", "b", at(300)), ("w", "a", at(600)), ("v", "z", at(700)), ("w", "c", at(2000)), ("w", "late", at(60_000))]
    got = drained(spark, streams.changed_files(fed(spark, rows, "root string, path string, ts timestamp", tmp_path / "in", 3)), "bursts_out", tmp_path)
    assert sorted((r["root"], sorted(r["paths"]), r["events"]) for r in got) == [("v", ["z"], 1), ("w", ["a", "b"], 3), ("w", ["c"], 1)]


def test_running_totals(spark, tmp_path):
    rows = [("grep", 100, 10), ("go", 50, 50), ("grep", 10, 5)]
    got = drained(spark, streams.saved_by_command(fed(spark, rows, "cmd_type string, raw_tokens long, clean_tokens long", tmp_path / "in", 2)), "saved_out", tmp_path, "complete")
    assert {(r["cmd_type"], r["calls"], r["saved"]) for r in got} == {("grep", 2, 95), ("go", 1, 0)}


def test_volume_is_observed(spark):
    rows = spark.createDataFrame([(1, i, x, False) for i, x in enumerate(["ab", "ab", "é", ""])], "doc_id long, seq long, line string, is_stderr boolean")
    raw, _ = streams.with_volume(rows, rows.withColumnRenamed("line", "out"))
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation("bytes")
    rows.observe(seen, F.sum(F.octet_length("line") + 1).alias("bytes")).count()
    assert seen.get["bytes"] == 10 and raw.count() == 4


def test_static_form_carries_state_across_batches(spark):
    """Documents far longer than an Arrow batch keep their duplicates."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(d, i, "same" if i < 50 else f"l{i}", False) for d in (1, 2) for i in range(60)] + [(3, i, "x", False) for i in range(20)]
        got = streams.filter_stream(spark.createDataFrame(rows, "doc_id long, seq long, line string, is_stderr boolean")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum("(49 duplicate lines)" in r["out"] for r in got) == 2 and [r["out"] for r in got if r["doc_id"] == 3] == ["x", "  ... (19 duplicate lines)"]
