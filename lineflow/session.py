"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers of this session import the package from where the driver imported it."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_counter(spark: SparkSession, sf_dir: str) -> Callable[[str], int]:
    """Counts the lines of a table: its rows, or for texts their bytes by 80 (about 12 MB a task)."""

    def lines(name: str) -> int:
        rows = table(spark, sf_dir, name)
        size = "sum(octet_length(text)) div 80" if name in ("documents", "conversations") else "count(1)"
        return rows.selectExpr(f"coalesce({size}, 0) as n").first()["n"]

    return lines


def query_over(build: Callable[..., str], *frames: DataFrame) -> DataFrame:
    """A query over frames as views, which are needed until the query is analysed only."""
    views = [f"lineflow_{uuid.uuid4().hex}" for _ in frames]
    for view, frame in zip(views, frames):
        frame.createOrReplaceTempView(view)
    try:
        return frames[0].sparkSession.sql(build(*views))
    finally:
        for view in views:
            frames[0].sparkSession.catalog.dropTempView(view)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir; a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lineflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/lineflow/{name}-{uuid.uuid4().hex}"
