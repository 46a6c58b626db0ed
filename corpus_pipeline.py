"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

quality      rejects documents under the classifier's threshold
near_dedup   keeps the smallest document of each near-duplicate group
decontam     drops documents that hold a benchmark item
pii          replaces personal data by pseudonyms
mix          draws the sources to their target weights; `copies` says how often a document is taken
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineflow.llm import decontaminate, minhash, mixing, pii, quality
from lineflow.llm._fit import remainder
from lineflow.llm._shared import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more; learns from labels whose crc32(doc_id) mod 5 is not 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.fit(docs, labels.where(remainder("doc_id", 5) != 0)), 0.3)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 over five-word shingles; rows without doc_id stay."""
    gone = minhash.near_duplicates(docs, percent=80, bands=36).where("not kept").select("doc_id")
    return docs.join(gone.distinct().hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item within a tenth of its characters edited."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _free(name: str, columns: list[str]) -> str:
    """`name`, with underscores behind it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced under the session's key; n_chars, where there is one, follows the text.

    No other column changes, whatever it is called.
    """
    done = pii.pseudonymise(docs, pii.session_key(spark), into=_free("pii", docs.columns))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with taken words and copies; repeated rows of one doc_id share the largest count.

    Documents without doc_id count each on their own: the mix knows them by source and size alone, so of those that share
    both, in order of text, the first get the largest counts.  Where a column is called `taken` or `copies` already, the
    new one has an underscore behind its name.
    """
    words, copies = _free("taken", docs.columns), _free("copies", docs.columns)
    counts = [F.col("mix.taken").alias(words), F.col("mix.copies").alias(copies)]
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    taken = mixing.mix(docs).where("taken > 0").select("doc_id", "source", "size", F.struct("taken", (F.col("taken") / F.col("size")).cast("int").alias("copies")).alias("mix"))
    plan = taken.where("doc_id is not null").groupBy("doc_id").agg(F.max("mix").alias("mix"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row).join(plan.hint("merge"), "doc_id").select("row.*", *counts)
    of = Window.partitionBy("source", "size")
    places = taken.where("doc_id is null").select(F.struct("source", "size", F.row_number().over(of.orderBy(F.desc("mix"))).alias("k")).alias("place"), "mix")
    nameless = docs.where("doc_id is null").select(row, "source", "text", mixing.size_of("text").alias("mix_size"))
    of = Window.partitionBy("source", "mix_size")
    nameless = nameless.select("row", F.struct("source", F.col("mix_size").alias("size"), F.row_number().over(of.orderBy("text")).alias("k")).alias("at"))
    nameless = nameless.join(places.hint("merge"), F.col("at").eqNullSafe(F.col("place"))).select("row.*", *counts)
    return named.unionByName(nameless)


#: Order is fixed: near-duplicates after the classifier, personal data after decontamination, mixing last.
STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontam", decontam_stage), ("pii", pii_stage), ("mix", mix_stage)]

#: SQL can't express the classifier and the alignment; tests compare near_dedup and decontam with brute force, mix with its
#: plan, and hold quality and pii against planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
