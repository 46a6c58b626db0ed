"""Merkle manifest of a dataset: a tree of fan-out 8 per group of rows, a tree over the groups' roots, proofs of both.

A leaf is the sha256 of a row's fields, each with its length before it.  Leaves of a group stand in order; while several
nodes remain, every 8 consecutive ones, the last run fewer, even one, become the sha256 of their digests as text.  Nothing
is padded.

How it runs.  Leaves are range-partitioned by group and key, so that a group of any size lies over many partitions, and
every partition learns how many leaves stand before it.  A task then pushes its leaves on a mountain-range stack: a run of
8 with an aligned start carries one node up a level, what can't be completed inside the partition stays as peaks, 14 a
level at the most.  Peaks of neighbouring partitions are merged level by level with one aggregation each, keyed by run, in
which the short last runs are closed too.  A second pass gives each leaf its siblings: runs that lie inside the partition
are built again there, the few others come with the partition's header row.  Rows meet their header by partition number,
never by group, and nothing of the corpus goes through the driver.

Defined results: a null field counts as `-`; rows without key come first, equal keys stand in order of their leaves, equal
rows are leaves of their own; a group of one row is its own root; an empty table has no rows; columns that are not named
are ignored, whatever they are called; texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineflow.llm._shared import materialise

FANOUT = 8
#: Leaves a partition has at about the most; a partition of fewer than LEAST isn't made for the sake of more tasks.
PER_PART, LEAST = 1 << 17, 1 << 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PROOF = "array<struct<left:string,right:string>>"


def field(x: Column) -> Column:
    """A field with its length in bytes before it; `-` for null."""
    s = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def depth_of(n: int) -> int:
    """Levels above n leaves."""
    d = 0
    while n > 1:
        n, d = -(-n // FANOUT), d + 1
    return d


def _hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Range:
    """The mountain-range stack over consecutive leaves: open runs by level, completed ones carried up.

    `made` gets (level, index, digest, open): nodes above the leaves, and what stays open for the neighbours.
    """

    def __init__(self) -> None:
        self.runs: list[list[tuple[int, str]]] = []
        self.made: list[tuple[int, int, str, bool]] = []

    def push(self, level: int, at: int, digest: str) -> None:
        while level == len(self.runs):
            self.runs.append([])
        run = self.runs[level]
        run.append((at, digest))
        if at % FANOUT == FANOUT - 1:
            if len(run) == FANOUT:
                self.made += [(level, k, d, False) for k, d in run if level]
                self.runs[level] = []
                self.push(level + 1, at // FANOUT, _hash([d for _, d in run]))
            else:
                self._peak(level)

    def _peak(self, level: int) -> None:
        self.made += [(level, k, d, True) for k, d in self.runs[level]]
        self.runs[level] = []

    def close(self) -> None:
        for level in range(len(self.runs)):
            self._peak(level)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[pa.RecordBatch]]]:
    """(header, its leaf rows in batches); a header row has kind 0 and stands before its leaves."""
    rest: list[pa.RecordBatch] = []
    source = iter(batches)

    def rows() -> Iterator[pa.RecordBatch]:
        while True:
            b = rest.pop() if rest else next(source, None)
            if b is None:
                return
            heads = [k for k, v in enumerate(b["kind"].to_pylist()) if v == 0]
            if heads:
                rest.append(b.slice(heads[0]))
                if heads[0]:
                    yield b.slice(0, heads[0])
                return
            if b.num_rows:
                yield b

    for _ in rows():
        raise ValueError("leaves without a header")
    while rest:
        b = rest.pop()
        head = b.slice(0, 1).to_pylist()[0]
        rest.append(b.slice(1))
        yield head, rows()


def _stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for head, rows in _segments(batches):
        stack, at = Range(), head["start"]
        for b in rows:
            for digest in b["leaf"].to_pylist():
                stack.push(0, at, digest)
                at += 1
            if len(stack.made) >= 65536:
                yield _records(head, stack.made)
                stack.made = []
        stack.close()
        yield _records(head, stack.made)


def _records(head: dict, made: list) -> pa.RecordBatch:
    level, at, digest, open_ = zip(*made) if made else ((), (), (), ())
    n = len(made)
    return pa.RecordBatch.from_arrays(
        [pa.array([head["grp"]] * n, pa.string()), pa.array([depth_of(head["total"])] * n, pa.int32()), pa.array(level, pa.int32()), pa.array(at, pa.int64()), pa.array(digest, pa.string()), pa.array(open_, pa.bool_())],
        names=["grp", "depth", "level", "at", "digest", "open"],
    )


class Paths:
    """Siblings on the way up from the leaves of one partition."""

    def __init__(self, start: int, leaves: list[str], depth: int, edges: dict[tuple[int, int], list[str]]) -> None:
        self.levels, self.depth, self.edges = [(start, leaves)], depth, edges
        self.last: dict[int, tuple[int, list]] = {}
        self.cut: dict[int, tuple[int, list]] = {}
        while True:
            lo, nodes = self.levels[-1]
            first, upto = -(-lo // FANOUT), (lo + len(nodes)) // FANOUT
            if first >= upto:
                break
            self.levels.append((first, [_hash(nodes[FANOUT * r - lo : FANOUT * (r + 1) - lo]) for r in range(first, upto)]))

    def _run(self, level: int, run: int) -> list[tuple[str, str]]:
        """(left, right) of every node of a run."""
        if self.cut.get(level, (None,))[0] != run:
            kids = None
            if level < len(self.levels):
                lo, nodes = self.levels[level]
                if lo <= FANOUT * run and FANOUT * (run + 1) <= lo + len(nodes):
                    kids = nodes[FANOUT * run - lo : FANOUT * (run + 1) - lo]
            kids = kids or self.edges[level, run]
            self.cut[level] = run, [("".join(kids[:c]), "".join(kids[c + 1 :])) for c in range(len(kids))]
        return self.cut[level][1]

    def above(self, level: int, at: int) -> list[tuple[str, str]]:
        if level == self.depth:
            return []
        if self.last.get(level, (None,))[0] != at:
            self.last[level] = at, [self._run(level, at // FANOUT)[at % FANOUT], *self.above(level + 1, at // FANOUT)]
        return self.last[level][1]


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    for head, rows in _segments(batches):
        held = list(rows)
        edges = {(e["level"], e["run"]): e["kids"] for e in head["edges"] or ()}
        paths = Paths(head["start"], [d for b in held for d in b["leaf"].to_pylist()], depth_of(head["total"]), edges)
        above = [(s["left"], s["right"]) for s in head["above"] or ()]
        at = head["start"]
        for whole in held:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                proofs = [[*paths.above(0, at + k), *above] for k in range(b.num_rows)]
                at += b.num_rows
                flat = [s for p in proofs for s in p]
                values = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.string())], fields=list(pair.value_type))
                ends = [0]
                for p in proofs:
                    ends.append(ends[-1] + len(p))
                same = lambda v: pa.array([v] * b.num_rows, pa.string())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([b["key"], b["leaf"], b["other"], same(head["subroot"]), same(head["root"]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=pair)], names=["key", "leaf", "other", "subroot", "root", "proof"])


@dataclass
class Tree:
    """Indexed leaves of all groups, the partitions' pieces of them, node records, and the runs across partitions."""

    placed: DataFrame  # part, row, key, leaf, other
    pieces: DataFrame  # part, grp, first (its first row), start, n, total
    records: DataFrame  # grp, depth, level, at, digest, open
    runs: DataFrame  # grp, level, run, kids
    roots: DataFrame  # grp, digest
    parts: int

    def nodes(self) -> DataFrame:
        """Every node above the leaves: grp, level, at, digest."""
        own = self.records.where("level > 0 and not open").select("grp", "level", "at", "digest")
        return own.unionByName(self.runs.where("level > 0").select("grp", "level", F.posexplode("kids").alias("k", "digest"), "run").selectExpr("grp", "level", "8 * run + k as at", "digest")).unionByName(self.roots.select("grp", F.col("depth").alias("level"), F.lit(0).cast("long").alias("at"), "digest").where("level > 0"))


def _routed(tree_parts: int, placed: DataFrame, headers: DataFrame) -> DataFrame:
    """Leaves of a partition behind the headers of its pieces, in order."""
    both = placed.withColumn("kind", F.lit(1)).unionByName(headers.withColumn("kind", F.lit(0)).withColumnRenamed("first", "row"), allowMissingColumns=True)
    return both.repartitionById(tree_parts, F.col("part").cast("int")).sortWithinPartitions("row", "kind")


def tree(leaves: DataFrame) -> Tree:
    """The trees of `leaves` (grp, key, leaf, other): grp isn't null, leaves of a group stand by key, nulls first, then leaf."""
    spark = leaves.sparkSession
    leaves = materialise(leaves.select("grp", "key", "leaf", "other"), "leaves")
    n = leaves.count()
    parts = max(1, -(-n // PER_PART), min(spark.sparkContext.defaultParallelism, -(-n // LEAST)))
    # The last key splits rows that are equal in all others; they are interchangeable.
    order = [F.col("grp"), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    placed = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie")
    placed = materialise(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "index")
    own = placed.groupBy("part", "grp").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("grp").orderBy("part")
    pieces = materialise(own.select("*", (F.sum("n").over(before) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy("grp")).alias("total")), "pieces")
    top = pieces.agg(F.max("part"), F.max("total")).first()
    parts, levels = (top[0] or 0) + 1, depth_of(top[1] or 1)
    placed = placed.drop("grp")
    records = _routed(parts, placed.select("part", "row", "leaf"), pieces.select("part", "grp", "first", "start", "total"))
    records = materialise(records.mapInArrow(_stack, "grp string, depth int, level int, at long, digest string, open boolean"), "nodes")
    peaks = records.where("open").select("grp", "depth", "level", "at", "digest")
    carried, runs, roots = None, None, peaks.where("level = depth")
    for level in range(levels):
        here = peaks.where((F.col("level") == level) & (F.col("level") < F.col("depth")))
        here = here if carried is None else here.unionByName(carried)
        run = here.groupBy("grp", "depth", F.floor(F.col("at") / FANOUT).alias("run")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("kids"))
        run = materialise(run.select("grp", "depth", F.lit(level).alias("level"), "run", F.col("kids.digest").alias("kids")), "runs")
        up = run.select("grp", "depth", F.lit(level + 1).alias("level"), F.col("run").alias("at"), F.sha2(F.array_join("kids", ""), 256).alias("digest"))
        carried = up.where("level < depth")
        roots = roots.unionByName(up.where("level = depth"))
        runs = run if runs is None else runs.unionByName(run)
    if runs is None:
        runs = peaks.limit(0).select("grp", "depth", "level", F.col("at").alias("run"), F.array("digest").alias("kids"))
    return Tree(placed, pieces, records, runs.drop("depth"), roots.select("grp", "depth", "digest"), parts)


def prove(t: Tree, tops: DataFrame | None = None) -> DataFrame:
    """Per leaf: key, leaf, other, subroot, root and proof, the (left, right) siblings from the leaf's run up.

    `tops` (grp, root, above) carries the proofs on to the root of the groups; without it a group's root is the end.
    """
    depth = F.expr("aggregate(sequence(1, 22), named_struct('n', total, 'd', 0), (s, i) -> if(s.n > 1, named_struct('n', (s.n + 7) div 8, 'd', s.d + 1), s), s -> s.d)")
    asked = t.pieces.select("part", "grp", "start", "n", F.explode(F.expr("sequence(0, 21)")).alias("level"), depth.alias("depth")).where("level < depth")
    size = F.pow(F.lit(float(FANOUT)), F.col("level") + 1).cast("long")
    edges = asked.withColumn("size", size).select("part", "grp", "level", F.expr("explode(array_distinct(array(start div size, (start + n - 1) div size))) as run"))
    edges = edges.join(t.runs, ["grp", "level", "run"]).groupBy("part", "grp").agg(F.collect_list(F.struct("level", "run", "kids")).alias("edges"))
    ends = t.roots.select("grp", F.col("digest").alias("subroot"))
    ends = ends.join(tops, "grp") if tops is not None else ends.select("*", F.col("subroot").alias("root"), F.lit(None).cast(PROOF).alias("above"))
    headers = t.pieces.join(edges, ["part", "grp"], "left").join(ends, "grp").select("part", "first", "start", "total", "edges", "subroot", "root", "above")
    kind = {f.name: f.dataType.simpleString() for f in t.placed.schema}
    return _routed(t.parts, t.placed, headers).mapInArrow(_prove, f"key {kind['key']}, leaf string, other string, subroot string, root string, proof {PROOF}")


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, other: Column | None = None) -> DataFrame:
    """Per row: key, leaf, other, subroot (of its group), root (of the whole table), proof.

    `other` is any value that rides along, such as the leaf that a later state of the row has.
    """
    name = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = docs.select(name.alias("grp"), F.col(key).alias("key"), leaf_of(*[F.col(f) for f in fields]).alias("leaf"), (F.lit(None) if other is None else other).cast("string").alias("other"))
    rows = tree(leaves)
    above = tree(rows.roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("digest").alias("leaf"), F.lit(None).cast("string").alias("other")))
    return prove(rows, materialise(prove(above).select(F.col("key").alias("grp"), "root", F.col("proof").alias("above")), "tops"))


def lowered(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit(docs: DataFrame) -> DataFrame:
    """Every document's proof checked, after a third of them (crc32 of doc_id divisible by 3) were lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(hit, leaf_of(*[lowered(F.col(f)) if f == "text" else F.col(f) for f in FIELDS]))
    rows = manifest(docs, other=changed).withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("proof")))
    return rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
