"""The live source over restarts and half-written lines; commits of a log that fail or race."""

import pytest

from lineflow.sources import live, sinks


def drained(spark, folder, out, marks, **options):
    spark.dataSource.register(live.LiveLines)
    lines = spark.readStream.format("lineflow_lines").options(path=str(folder), **options).load()
    lines.writeStream.format("parquet").option("checkpointLocation", str(marks)).trigger(availableNow=True).start(str(out)).awaitTermination()
    return sorted((r["file"], r["at"], r["is_stderr"], r["line"]) for r in spark.read.parquet(str(out)).collect())


def test_restart_repeats_and_loses_nothing(spark, tmp_path):
    src, out, marks = tmp_path / "in", tmp_path / "out", tmp_path / "marks"
    src.mkdir()
    (src / "a.out").write_bytes(b"one\r\ntwo\nhal")
    (src / "a.err").write_bytes(b"bad\n")
    first = drained(spark, src, out, marks)
    assert first == [("a.err", 0, True, "bad"), ("a.out", 0, False, "one"), ("a.out", 5, False, "two")]
    with (src / "a.out").open("ab") as f:
        f.write("f é\n\nlast".encode())
    (src / "b.out").write_bytes(b"new\n")
    second = drained(spark, src, out, marks)
    assert second == sorted([*first, ("a.out", 9, False, "half é"), ("a.out", 17, False, ""), ("b.out", 0, False, "new")])
    assert drained(spark, src, out, marks) == second


def test_long_lines_and_many_tasks(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    body = [f"line {k}" for k in range(500)]
    (src / "x.out").write_bytes("\n".join([*body, "y" * (live.LONGEST + 1), "z" * live.LONGEST, "end", ""]).encode())
    got = drained(spark, src, tmp_path / "out", tmp_path / "marks", perTask="700")
    assert [x[3] for x in sorted(got, key=lambda x: x[1])] == [*body, "z" * live.LONGEST, "end"]


def test_commits(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "ts string, n int"
    part = lambda *ns: spark.createDataFrame([(f"t{n:02}", n) for n in ns], schema)
    held = lambda: sorted(r["n"] for r in sinks.read_log(spark, path, schema).collect())
    assert held() == []
    assert sinks.commit_log(part(1, 2, 3), path, most=5) == 1 and held() == [1, 2, 3]
    with pytest.raises(Exception, match="boom"):
        sinks.commit_log(part(4, 5).selectExpr("ts", "if(n = 5, cast(raise_error('boom') as int), n) as n"), path, most=5)
    assert held() == [1, 2, 3]
    assert sinks.commit_log(part(9, 8, 7, 6), path, most=5) == 2 and held() == [6, 7, 8, 9]
    sinks.vacuum_log(spark, path)
    assert held() == [6, 7, 8, 9] and len(list((tmp_path / "log" / "data").glob("*"))) == 1


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "log"), "ts string, n int"
    rows = spark.createDataFrame([("a", 1)], schema)
    sinks.commit_log(rows, path)
    stale = sinks._latest(spark, path)
    sinks.commit_log(rows, path)
    monkeypatch.setattr(sinks, "_latest", lambda *_: stale)
    with pytest.raises(OSError, match="another writer"):
        sinks.commit_log(rows, path)
    monkeypatch.undo()
    assert sinks.read_log(spark, path, schema).count() == 2
