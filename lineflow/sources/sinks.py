"""Sinks: clean texts, logs with retention, snapshots (K-01 to K-05)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_texts(docs: DataFrame, path: str, text: str = "text") -> None:
    """Clean texts as a text folder (K-01)."""
    docs.select(text).write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append to a JSON-lines log (K-02, K-03)."""
    rows.write.mode("append").json(path)


def newest_half(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """The newer half of a log by count (K-02, T-11), ties by the rows' text.

    Counts by hour, of which there are few however long the log, say which hour holds the cut; only that hour is ranked.
    """
    hour = F.substring(F.col(ts), 1, 13)
    counts = rows.groupBy(hour.alias("_h")).agg(F.count(F.lit(1)).alias("_c"))
    upto = counts.select("_h", "_c", F.sum("_c").over(Window.orderBy("_h")).alias("_upto"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    half, before = F.floor(F.col("_n") / 2), F.col("_upto") - F.col("_c")
    parts = upto.select("_h", F.greatest(F.least(half - before, F.col("_c")), F.lit(0)).alias("_gone"), F.col("_c"))
    marked = rows.withColumn("_h", hour).join(parts, "_h")
    whole = marked.where("_gone = 0").drop("_h", "_gone", "_c")
    place = F.row_number().over(Window.partitionBy("_h").orderBy(ts, F.to_json(F.struct(*[F.col(c) for c in rows.columns]))))
    cut = marked.where("_gone > 0 and _gone < _c").withColumn("_i", place).where("_i > _gone").drop("_h", "_gone", "_c", "_i")
    return whole.select(*rows.columns).union(cut.select(*rows.columns))


def rotate(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Replace a log by its newer half: written beside it, then the folders change names, so that a reader or a failed run
    finds the old log or the new one, never a part."""
    newest_half(rows).write.mode("overwrite").json(f"{path}.new")
    jvm = spark.sparkContext._jvm
    here, new, old = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".new", ".old"))
    store = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(old, True)
    if store.exists(here) and not store.rename(here, old) or not store.rename(new, here):
        raise OSError(f"could not replace {path}")
    store.delete(old, True)


def write_snapshot(rows: DataFrame, path: str) -> None:
    """Overwrite a snapshot (K-04)."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def clear(rows: DataFrame, path: str) -> None:
    """Empty a store, keeping its schema (K-05)."""
    rows.limit(0).write.mode("overwrite").json(path)


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    return at(".").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest commit of a log; 0 where there is none."""
    store, at = _store(spark, path)
    if not store.exists(at("commits")):
        return 0, {"parts": [], "rows": 0}
    n = max((int(f.getPath().getName()) for f in store.listStatus(at("commits")) if f.getPath().getName().isdigit()), default=0)
    return n, json.loads(spark.read.text(f"{path}/commits/{n:012}", wholetext=True).first()[0]) if n else {"parts": [], "rows": 0}


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the newest commit of a committed log, and nothing of an append that failed or is under way."""
    parts = _latest(spark, path)[1]["parts"]
    return spark.read.schema(schema).json([f"{path}/{p}" for p in parts]) if parts else spark.createDataFrame([], schema)


def commit_log(rows: DataFrame, path: str, most: int | None = None, ts: str = "ts") -> int:
    """Append to a log, and keep its newer half once it has over `most` rows, as one commit (K-02 to K-04).

    Rows are written under a name that no reader knows; a commit is a small file that lists what a log consists of, made
    by one rename to the next number.  A task or a driver that fails before that leaves the log as it was; of two writers
    at a time the second one fails and changes nothing.  Gives the number of the commit.
    """
    spark = rows.sparkSession
    n, before = _latest(spark, path)
    store, at = _store(spark, path)
    part = f"data/{uuid.uuid4().hex}"
    rows.write.json(f"{path}/{part}")
    added = spark.read.schema(rows.schema).json(f"{path}/{part}").count()
    parts, total = [*before["parts"], part], before["rows"] + added
    if most is not None and total > most:
        kept = f"data/{uuid.uuid4().hex}"
        newest_half(spark.read.schema(rows.schema).json([f"{path}/{p}" for p in parts]), ts).write.json(f"{path}/{kept}")
        parts, total = [kept], total - total // 2
    store.mkdirs(at("commits"))
    draft = at(f"commits/.{uuid.uuid4().hex}")
    out = store.create(draft)
    out.write(bytearray(json.dumps({"parts": parts, "rows": total}).encode()))
    out.close()
    if store.exists(at(f"commits/{n + 1:012}")) or not store.rename(draft, at(f"commits/{n + 1:012}")):
        store.delete(draft, False)
        raise OSError(f"another writer made commit {n + 1} of {path}")
    return n + 1


def vacuum_log(spark: SparkSession, path: str) -> None:
    """Delete what the newest commit of a log doesn't list; for when no reader is left with an older one."""
    n, now = _latest(spark, path)
    store, at = _store(spark, path)
    for f in list(store.listStatus(at("data"))) if n else []:
        if f"data/{f.getPath().getName()}" not in now["parts"]:
            store.delete(f.getPath(), True)
