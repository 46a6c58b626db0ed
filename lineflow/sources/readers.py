"""Sources: whole texts, lines, logs, reports and folders as DataFrames (S-01 to S-14)."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineflow.functions import patterns as P
from lineflow.functions.dialect import Spark
from lineflow.operators import search

MEASUREMENT = """ts STRING, session STRING, command STRING, cmd_type STRING, raw_bytes BIGINT, clean_bytes BIGINT, raw_tokens BIGINT,
    clean_tokens BIGINT, tokens_saved BIGINT, reduction_pct DOUBLE, lines_raw BIGINT, lines_clean BIGINT, important_lines BIGINT,
    quality_score DOUBLE, mode STRING, source STRING, cached BOOLEAN, duration_us BIGINT, rerequest BOOLEAN, rerequest_type STRING"""
OBSERVATION = "ts STRING, cmd STRING, norm STRING, level INT, session STRING"
BENCH_RESULT = "name STRING, raw_bytes BIGINT, clean_bytes BIGINT, reduction DOUBLE, duration_us BIGINT, lines_raw BIGINT, lines_clean BIGINT"
BENCH_REPORT = f"total_raw BIGINT, total_clean BIGINT, avg_reduction DOUBLE, total_duration_us BIGINT, results ARRAY<STRUCT<{', '.join(': '.join(c.split(' ')) for c in BENCH_RESULT.split(', ')) }>>"
SNAPSHOT = "generated_at STRING, filters ARRAY<STRUCT<filter: STRING, bytes_before: BIGINT, bytes_after: BIGINT, reduction_pct: DOUBLE, duration_us: BIGINT, invocations: BIGINT>>"
#: Bytes of a captured stream that are kept, and the notice that stands for the rest.
CAPTURE_CAP, CAPTURE_NOTICE = 10 << 20, "\n[output truncated: exceeded 10MB limit]"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file one document (S-01)."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def capped(docs: DataFrame, text: str = "text", most: int = CAPTURE_CAP) -> DataFrame:
    """Texts cut at `most` bytes with a notice (S-02); a character cut in two is dropped."""
    raw = F.col(text).cast("binary")
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(raw, 1, most).cast("string")), "\ufffd+$", "")
    return docs.withColumn(text, F.when(F.octet_length(text) > most, F.concat(cut, F.lit(CAPTURE_NOTICE))).otherwise(F.col(text)))


def lines(docs: DataFrame, key: str = "path", longest: int = 1 << 20) -> DataFrame:
    """(key, pos, line) from 1, CR and the empty last element gone; a file with a line over `longest` bytes is left out (S-05)."""
    parts = F.split("text", "\n")
    fit = docs.where(~F.exists(parts, lambda x: F.octet_length(x) > longest))
    rows = fit.select(key, F.posexplode(F.when(F.col("text").endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)).alias("pos", "line"))
    return rows.select(key, (F.col("pos") + 1).cast("long").alias("pos"), F.regexp_replace("line", "\r+$", "").alias("line"))


#: Folders that the driver lists before tasks walk on from them, and how many of them make a task.
FRONTIER, PER_TASK = 512, 8
_FILES = "path string, relative string, mtime timestamp, size long"


def _entries(fs: pafs.FileSystem, folder: str) -> Iterator[pafs.FileInfo]:
    """What a folder holds, links left out; a folder that can't be read holds nothing."""
    try:
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    except OSError:
        return
    yield from (x for x in found if not (fs.type_name == "local" and os.path.islink(x.path)))


def _walked(uri: str, root: str, skip: Callable[[str], bool], folders: Iterable[str]) -> Iterator[tuple]:
    fs = pafs.FileSystem.from_uri(uri)[0]
    left = list(folders)
    while left:
        for x in _entries(fs, left.pop()):
            if x.type == pafs.FileType.Directory:
                left += [] if skip(x.base_name) else [x.path]
            else:
                yield x.path, x.path.removeprefix(root).lstrip("/"), x.mtime, x.size


def _listed(spark: SparkSession, uri: str, skip: Callable[[str], bool]) -> DataFrame:
    """Every file under a folder, hidden ones too, without going into skipped folders (the root counts as one).

    The driver lists folder by folder until it has FRONTIER of them; the rest of the tree is walked by tasks.
    """
    fs, root = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")
    uri = uri if "://" in uri else f"file://{os.path.abspath(uri)}"
    name = root.rstrip("/").rsplit("/", 1)[-1]
    info = fs.get_file_info(root)
    frontier, files = deque([root] if info.type == pafs.FileType.Directory and not skip(name) else []), []
    while frontier and len(frontier) < FRONTIER:
        for x in _entries(fs, frontier.popleft()):
            if x.type == pafs.FileType.Directory:
                frontier.extend([] if skip(x.base_name) else [x.path])
            else:
                files.append((x.path, x.path.removeprefix(root).lstrip("/"), x.mtime, x.size))
    near = spark.createDataFrame(files, _FILES)
    if not frontier:
        return near
    folders = spark.createDataFrame([(x,) for x in frontier], "folder string").repartition(max(1, len(frontier) // PER_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _walked(uri, root, skip, b["folder"].to_pylist())
            while part := list(islice(rows, 10_000)):
                path, relative, mtime, size = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(relative), pa.array(mtime, pa.timestamp("us", "UTC")), pa.array(size, pa.int64())], names=["path", "relative", "mtime", "size"])

    return near.unionByName(folders.mapInArrow(run, _FILES))


def walk(spark: SparkSession, path: str, extensions: tuple[str, ...] = (), glob: str | None = None) -> DataFrame:
    """(path, mtime, size) of the files that a search opens (S-04); folders above the root don't matter, hidden files count."""
    files = _listed(spark, path, lambda name: name in P.SKIP_DIRS).where(search.walkable(Spark(), "relative", extensions))
    if glob:
        rx, whole = search.glob_regex(glob)
        files = files.where(Spark().match("relative" if whole else search.base_name(Spark(), "relative"), rx))
    return files.select("path", "mtime", "size")


def snapshot(spark: SparkSession, paths: list[str], extensions: tuple[str, ...] = ()) -> DataFrame:
    """(path, mtime) of the files that the watcher looks at (S-14)."""
    skip = lambda name: name in P.WATCH_SKIP_DIRS or (name.startswith(".") and name != ".")
    parts = [_listed(spark, p, skip).where(search.watchable(Spark(), "relative", extensions)).select("path", "mtime") for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct() if len(parts) > 1 else out


def _log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns of `schema`, `raw` (the whole entry as VARIANT, so keys without a column stay reachable) and `fine`.

    One scan of JSON lines: a line that is no JSON object has fine = false.  A missing file is an empty relation.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string")
    rows = lines.where("value <> ''").select("value", F.try_parse_json("value").alias("raw"))
    fine = F.coalesce(F.schema_of_variant("raw").startswith("OBJECT"), F.lit(False))
    return rows.select("raw", fine.alias("fine"), F.from_json(F.when(fine, F.col("value")), schema).alias("e")).select("e.*", "raw", "fine")


def log_health(spark: SparkSession, path: str) -> DataFrame:
    """(entries, malformed) of a log."""
    return _log(spark, path, "ts STRING").agg(F.count_if("fine").alias("entries"), F.count_if(~F.col("fine")).alias("malformed"))


def measurements(spark: SparkSession, path: str, since: str | None = None, raw: bool = False) -> DataFrame:
    """The measurement log, malformed lines skipped, optionally from a timestamp on, compared as text (S-09, S-10)."""
    rows = _log(spark, path, MEASUREMENT).where("fine").withColumn("rerequest", F.coalesce("rerequest", F.lit(False))).withColumn("rerequest_type", F.coalesce("rerequest_type", F.lit("")))
    rows = rows.where(F.col("ts") >= since) if since else rows
    return rows.drop("fine") if raw else rows.drop("fine", "raw")


def observations(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """The learn store (S-11)."""
    rows = _log(spark, path, OBSERVATION).where("fine")
    return rows.drop("fine") if raw else rows.drop("fine", "raw")


def bench_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of a bench report, one row each (S-12)."""
    return spark.read.schema(BENCH_REPORT).option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")


def step_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Per-step snapshot, one row a step (S-13)."""
    return spark.read.schema(SNAPSHOT).option("multiLine", True).json(path).select("generated_at", F.explode("filters").alias("f")).select("generated_at", "f.*")


def line_stream(spark: SparkSession, path: str, trigger_files: int = 100) -> DataFrame:
    """(path, line) of files that appear under a folder, as a stream (S-03)."""
    return spark.readStream.option("maxFilesPerTrigger", trigger_files).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
