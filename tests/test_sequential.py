from lineflow.operators import sequential as s
from lineflow.streaming.filter import LineState, filter_stream, flush, process_line


def test_rate_limit_and_lru(spark):
    rows = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 2, "a"), (1, 2, 3, "b"), (1, 60_000_000, 4, "a"), (2, 0, 5, "a")], "tool long, us long, id long, key string")
    got = {r["id"]: r["allowed"] for r in s.rate_limit(rows, 1, 2).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True}
    assert {r["id"]: r["hit"] for r in s.lru_hits(rows, 1).collect()} == {1: False, 2: True, 3: False, 4: False, 5: False}


def test_stream_filter_lines():
    state = LineState()
    got = [process_line(state, x) for x in ["a", "a", "a", "b", "", "", "----------", "12:00:00 x", "12:00:01 y", "12:00:02 z"]]
    assert got == ["a", None, None, "  ... (2 duplicate lines)\nb", "", None, None, "12:00:00 x", "12:00:01 y", "z"]
    assert flush(state) is None
    process_line(state, "z")
    assert flush(state) == "  ... (1 duplicate line)"


def test_streams_agree_with_batch(spark, tmp_path):
    """The same lines in several micro-batches give what one batch gives, up to the closing flush."""
    schema = "doc_id long, seq long, line string, is_stderr boolean"
    rows = [(d, i, x, False) for d in (1, 2) for i, x in enumerate(["a", "a", "b", "b", "c"])]
    whole = {(r["doc_id"], r["out"]) for r in filter_stream(spark.createDataFrame(rows, schema)).collect()}
    src = tmp_path / "in"
    for k in range(0, 5, 2):
        spark.createDataFrame([r for r in rows if k <= r[1] < k + 2], schema).coalesce(1).write.mode("append").json(str(src))
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = filter_stream(lines, idle=60_000).writeStream.format("memory").queryName("filtered").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["doc_id"], r["out"]) for r in spark.sql("select * from filtered").collect()} == whole
