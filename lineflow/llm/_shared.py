"""Shared-folder materialisation and connected components, used by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a temporary one where that is unset in local mode (tests)."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = "file://" + tempfile.mkdtemp(prefix="lineflow-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lineflow/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder as Parquet and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): smallest node reachable, for the nodes of an undirected edge table of longs.

    Every round hooks each node to its smallest neighbour, jumps once, and rewrites the edges to the new labels, so that
    at least half of the labels with edges go and dense groups shrink to a few edges at once.  Only aggregates by node:
    no neighbour list is collected.  The smallest node of a component keeps its own label throughout.  An empty edge
    table gives an empty result; self loops and repeated edges are harmless; edges with a null end are ignored.
    """
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null")
    both = materialise(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = both.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    left = both.where("u <> v")
    while not left.isEmpty():
        hook = materialise(left.groupBy(F.col("u").alias("label")).agg(F.least(F.col("label"), F.min("v")).alias("up")), "hooks")
        top = hook.select(F.col("label").alias("up"), F.col("up").alias("top"))
        parent = materialise(hook.join(top, "up").select("label", F.col("top").alias("parent")), "parents")
        of = lambda c: parent.select(F.col("label").alias(c), F.col("parent").alias(f"p{c}"))
        labels = labels.join(parent.withColumnRenamed("label", "component"), "component", "left")
        labels = materialise(labels.select("node", F.coalesce("parent", "component").alias("component")), "labels")
        left = materialise(left.join(of("u"), "u").join(of("v"), "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "edges")
    return labels
