"""Operator 3: mixing sources to target weights by weighted fair queueing.

Every source is shuffled by a keyed digest; a document's virtual finish time is the cumulative size of its source up to
and including it, divided by the source's target.  Serving documents in global order of finish time until the total
budget is used gives each source its target.  A source above its own size goes round again (second epoch).

The global order is never sorted in one place: running totals are prefix sums over digest buckets and finish-time
buckets.  The one bucket that holds the end of the budget is cut into finer ones until it is small, and only that one is
ordered row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineflow.llm._shared import materialise

#: Words are counted as maximal runs outside space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
STEPS = 4096
#: Slots that are ordered row by row; buckets are cut until one holds no more, LEVELS times at the most (equal times stay
#: together).
EDGE, LEVELS = 100_000, 4


def size_of(text: str) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: Sequence[int], share: float, cap: int) -> DataFrame:
    """(sk, source_size, target) from (sk, source_size): weights cycle over sk order, water-filled under cap x size."""
    by_name = Window.orderBy("sk")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in cycle]), ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * cap)
    order = Window.orderBy(F.col("cap") / F.col("w"), "sk")
    everything = Window.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("k", F.row_number().over(order))
    s = s.withColumn("left", F.col("budget") - (F.sum("cap").over(order) - F.col("cap")))
    s = s.withColumn("w_left", F.sum("w").over(everything) - (F.sum("w").over(order) - F.col("w")))
    s = s.withColumn("level", F.col("left") / F.col("w_left"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("k", "level"))
    s = s.withColumn("level", F.min(fits).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double")))
    return s.select("sk", "source_size", target.alias("target"), "budget")


def mix(docs: DataFrame, cycle: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of `docs` (doc_id, text, source).

    Sources rank by code point with null last; targets share `share` times all words by the cycled weights and stop at
    `cap` times a source's size (cap is also the number of epochs).  Null and empty texts have size 0 and take 0.  Ties
    in finish time fall to source, digest, doc_id, then size, so reruns agree; repeated rows count each on their own;
    an empty table gives an empty result.
    """
    sk = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        size_of("text").alias("size"),
        sk.alias("sk"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("h"),
    )
    rows = materialise(rows, "sizes")
    sizes = rows.groupBy("sk").agg(F.sum("size").alias("source_size"))
    goal = materialise(targets(sizes, cycle, share, cap), "targets")

    bucket = F.substring("h", 1, 3)
    totals = rows.groupBy("sk", bucket.alias("b")).agg(F.sum("size").alias("total"))
    before = totals.withColumn("before", F.sum("total").over(Window.partitionBy("sk").orderBy("b")) - F.col("total")).select("sk", "b", "before")
    inside = Window.partitionBy("sk", "b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    timed = rows.withColumn("b", bucket).withColumn("cum", F.sum("size").over(inside)).join(before, ["sk", "b"]).join(goal, "sk")
    timed = timed.withColumn("cum", F.col("cum") + F.col("before"))
    for e in range(cap):
        finish = F.when(F.col("target") > 0, (F.col("source_size") * e + F.col("cum")) / F.col("target"))
        timed = timed.withColumn(f"f{e}", finish)
    timed = materialise(timed.select("doc_id", "source", "size", "source_size", "target", "budget", "sk", "h", *[f"f{e}" for e in range(cap)]), "timed")

    def slots(frame: DataFrame) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.col(f"f{e}").alias("f"), "sk", "h", "doc_id", "size", F.lit(e).alias("e")) for e in range(cap)]))
        return frame.where("f0 is not null and size > 0").select(each.alias("slot"), "budget")

    def buckets(f: Column, levels: int) -> list[Column]:
        """Bucket of a finish time among STEPS, then among STEPS inside that, and so on; their order is that of times."""
        out, x = [], f * STEPS
        for _ in range(levels):
            out.append(F.least(F.floor(x), F.lit(STEPS * 16)))
            x = (x - out[-1]) * STEPS
        return out

    last: list[int] = []
    before = 0
    while True:
        here = buckets(F.col("slot.f"), len(last) + 1)
        inside = slots(timed)
        for g, value in zip(here, last):
            inside = inside.where(g == value)
        totals = inside.groupBy(here[-1].alias("g")).agg(F.sum("slot.size").alias("total"), F.count(F.lit(1)).alias("n"), F.max("budget").alias("budget"))
        running = totals.withColumn("upto", F.sum("total").over(Window.orderBy("g")) + before)
        end = running.where("upto > budget").orderBy("g").select("g", (F.col("upto") - F.col("total")).alias("before"), "n", "budget").first()
        if end is None:
            return timed.withColumn("taken", F.when(F.col("target") > 0, F.col("size") * cap).otherwise(F.lit(0)).cast("long")).select("doc_id", "source", "size", "source_size", "target", "taken")
        last.append(end["g"])
        before = end["before"]
        if end["n"] <= EDGE or len(last) == LEVELS:
            break
    edge = slots(timed)
    for g, value in zip(buckets(F.col("slot.f"), len(last)), last):
        edge = edge.where(g == value)
    edge = edge.withColumn("run", F.sum("slot.size").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)))
    cut = edge.where(F.col("run") + F.lit(before) <= F.lit(float(end["budget"]))).agg(F.max("slot").alias("cut")).first()["cut"]
    taken = F.lit(0).cast("long")
    for e in range(cap):
        served, same = F.lit(False), F.lit(True)
        for g, value in zip(buckets(F.col(f"f{e}"), len(last)), last):
            served, same = served | (same & (g < value)), same & (g == value)
        if cut is not None:
            here = F.struct(F.col(f"f{e}").alias("f"), "sk", "h", "doc_id", "size", F.lit(e).alias("e"))
            upto = F.struct(F.lit(cut["f"]).alias("f"), F.lit(cut["sk"]).alias("sk"), F.lit(cut["h"]).alias("h"), F.lit(cut["doc_id"]).cast("long").alias("doc_id"), F.lit(cut["size"]).cast("long").alias("size"), F.lit(cut["e"]).alias("e"))
            served = served | (same & (here <= upto))
        taken = taken + F.when(F.coalesce(served, F.lit(False)), F.col("size")).otherwise(F.lit(0))
    return timed.withColumn("taken", taken.cast("long")).select("doc_id", "source", "size", "source_size", "target", "taken")
