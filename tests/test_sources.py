from lineflow.sources import readers, sinks


def test_text_and_walk(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    for name, text in (("src/a.go", "x\r\ny\n"), ("src/b.png", "z"), ("src/yarn.lock", "l"), ("src/node_modules/c.js", "n")):
        (tmp_path / name).write_bytes(text.encode())
    docs = readers.documents(spark, str(tmp_path))
    assert len(docs.collect()) == 4
    got = [(r["pos"], r["line"]) for r in readers.lines(docs.where("path like '%a.go'")).orderBy("pos").collect()]
    assert got == [(1, "x"), (2, "y")]
    assert [r["path"].rsplit("/", 1)[1] for r in readers.walk(spark, str(tmp_path)).collect()] == ["a.go"]


def _tree(root, names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")


def test_walk_rules(spark, tmp_path):
    """Roots below excluded names, hidden folders and files, upper-case extensions, links."""
    root = tmp_path / "vendor" / "proj"
    _tree(root, ["a.go", "L.PNG", "A.LOCK", "U.GO", ".github/a.go", "_x/b.go", ".env", "vendor/v.go", "s/node_modules/n.js", "s/dist/d.js", "s/deep/er/f.py", "go.sum"])
    (root / "link.go").symlink_to(root / "a.go")
    names = lambda df: sorted(r["path"].removeprefix(str(root) + "/") for r in df.collect())
    assert names(readers.walk(spark, str(root))) == [".env", ".github/a.go", "U.GO", "_x/b.go", "a.go", "s/deep/er/f.py"]
    assert names(readers.walk(spark, str(root), ("go",))) == [".github/a.go", "U.GO", "_x/b.go", "a.go"]
    assert names(readers.walk(spark, str(root), glob="*.py")) == ["s/deep/er/f.py"]
    assert names(readers.walk(spark, str(tmp_path / "vendor"))) == []


def test_walk_beyond_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "FRONTIER", 2)
    monkeypatch.setattr(readers, "PER_TASK", 1)
    made = [f"d{i}/e{j}/f{k}.go" for i in range(4) for j in range(3) for k in range(2)] + ["d1/vendor/x.go", "top.go"]
    _tree(tmp_path, made)
    got = sorted(r["path"].removeprefix(str(tmp_path) + "/") for r in readers.walk(spark, str(tmp_path)).collect())
    assert got == sorted(x for x in made if "vendor" not in x)


def test_snapshot_rules(spark, tmp_path):
    _tree(tmp_path, ["a.go", "go.sum", "x.png", "dist/d.go", ".hid/h.go", "s/.svn/q.go", "vendor/v.go", "coverage/c.GO", ".dot.go"])
    names = lambda df: sorted(r["path"].removeprefix(str(tmp_path) + "/") for r in df.collect())
    assert names(readers.snapshot(spark, [str(tmp_path)])) == [".dot.go", "a.go", "coverage/c.GO", "dist/d.go", "go.sum", "x.png"]
    assert names(readers.snapshot(spark, [str(tmp_path), str(tmp_path / "dist")], ("go",))) == [".dot.go", "a.go", "dist/d.go"]


def test_capped(spark):
    df = spark.createDataFrame([("a" * 10,), ("éé",), (None,)], "text string")
    assert [r["text"] for r in readers.capped(df, most=3).collect()] == ["aaa" + readers.CAPTURE_NOTICE, "é" + readers.CAPTURE_NOTICE, None]


def test_logs(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"ts":"2024-01-01T00:00:00Z","raw_tokens":5,"new_key":1}\nnot json\n{"ts":"2024-01-02T00:00:00Z","rerequest":true}\n')
    rows = readers.measurements(spark, str(log))
    assert rows.count() == 2 and readers.measurements(spark, str(log), "2024-01-02").count() == 1
    assert {r["rerequest"] for r in rows.collect()} == {True, False}
    assert readers.observations(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_retention(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i:02}", i) for i in range(9)], "ts string, n int")
    sinks.append_log(rows, str(tmp_path / "log"))
    sinks.rotate(spark, rows, str(tmp_path / "log"))
    assert sorted(r["n"] for r in spark.read.schema(rows.schema).json(str(tmp_path / "log")).collect()) == [4, 5, 6, 7, 8]
    sinks.clear(rows, str(tmp_path / "log"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "log")).count() == 0
