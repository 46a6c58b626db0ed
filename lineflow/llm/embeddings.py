"""Operator 2: near-duplicate embeddings by an inverted multi-index.

Each half of the unit vectors has its own codebook; the product of the two is the grid of cells.  For a query, a
multi-sequence traversal takes the two halves' centroids in order of a lower bound on the distance to anything stored
with them and visits cells in order of the sum of the bounds, from a heap that holds the next candidates only.  It stops
at the bound at which a sample of queries has reached the target recall of its links among all vectors, or at which links
drawn at the threshold itself are reached, where links are hardest to reach, so that it depends neither on one large
group nor on the sample having such links.  What the visited cells hold is verified in double precision.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineflow.llm._fit import fit_once
from lineflow.llm._groups import sorted_groups
from lineflow.llm._shared import components, materialise

#: Vectors that the codebooks are fitted on, queries that the radius is measured on, rows of a block, target recall.
SAMPLE, PROBES, BLOCK, RECALL = 65_536, 256, 1024, 0.9995
#: Vectors of a cell, about; most centroids of a half, so that each has 16 vectors of the sample.
CELL, MOST = 16, SAMPLE // 16
#: Distances held at once, parts of a dense cell's rows.
HELD, SALTS = 1 << 21, 16
#: The measured radius (squared) is widened by this factor; it never needs to exceed the threshold's own distance.
MARGIN = 2.0
#: Links at the threshold in random directions that are drawn for each query of the sample.
DRAWS = 16
_BINS = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision, row by row."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _slices(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with HELD distances to `width` centroids or so."""
    step = max(1, HELD // width)
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def usable_vectors(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, dim, key, v): vectors as they are, key a digest of the unit vector in double precision; dim is 0 and key
    and v are null for unusable vectors."""
    element = table.schema[embedding].dataType.elementType.simpleString()
    element = element if element in ("float", "double") else "double"
    kind = pa.list_(pa.float32() if element == "float" else pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, key, dim = [], [], []
            for x in b["e"]:
                a = None
                if x.is_valid and len(x) and x.values.null_count == 0:
                    a = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(a).max()
                    a = a / top if np.isfinite(top) and top > 0 else None
                    a = None if a is None or not np.isfinite(a).all() else a / np.linalg.norm(a)
                good.append(a is not None)
                dim.append(0 if a is None else len(a))
                key.append(None if a is None else hashlib.blake2b((a + 0.0).tobytes(), digest_size=16).digest())
            v = pc.if_else(pa.array(good, pa.bool_()), b["e"].cast(kind), pa.scalar(None, kind))
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(dim, pa.int64()), pa.array(key, pa.binary()), v], names=["vec_id", "dim", "key", "v"])

    rows = table.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{element}>").alias("e"))
    return rows.mapInArrow(run, f"vec_id long, dim long, key binary, v array<{element}>")


def codebook(x: np.ndarray, k: int, seed: int = 3, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from distinct random rows."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        a = np.concatenate([((c**2).sum(axis=1) - 2 * x[k : k + HELD // len(c) + 1] @ c.T).argmin(axis=1) for k in range(0, len(x), HELD // len(c) + 1)])
        n = np.bincount(a, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


class Grid:
    """Two codebooks.  A vector is stored in the cell of its nearest centroids; `span` neighbouring cells of a row of the
    grid are stored together, so that a query is not copied to many cells of a few vectors."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], span: int = 1):
        self.books = books
        self.cut = books[0].shape[1]
        self.span = span

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(home, low): nearest centroid of each half and, for every centroid, the least squared distance that a vector
        stored with it can have to x: the distance to the plane between the two centroids."""
        home, low = [], []
        for part, c in zip((x[:, : self.cut], x[:, self.cut :]), self.books):
            d = np.maximum((part**2).sum(axis=1)[:, None] - 2 * part @ c.T + (c**2).sum(axis=1), 0)
            h = d.argmin(axis=1)
            apart = np.sqrt(np.maximum(((c[h][:, None] - c[None]) ** 2).sum(axis=2), 0)) if len(x) * len(c) < 1 << 16 else np.sqrt(np.maximum((c[h] ** 2).sum(axis=1)[:, None] - 2 * c[h] @ c.T + (c**2).sum(axis=1), 0))
            gap = np.maximum(d - d.min(axis=1)[:, None], 0) / (2 * np.maximum(apart, 1e-9))
            gap[np.arange(len(x)), h] = 0
            home.append(h)
            low.append(gap**2)
        return home, low

    def cells(self, home: list[np.ndarray]) -> np.ndarray:
        return home[0] * len(self.books[1]) + home[1] // self.span

    def sequences(self, low: list[np.ndarray]) -> list[np.ndarray]:
        """Bounds of what is stored together: of each centroid of the first half, of each span of the second."""
        return [low[0], np.minimum.reduceat(low[1], np.arange(0, low[1].shape[1], self.span), axis=1)]

    def traverse(self, first: np.ndarray, second: np.ndarray, radius: float) -> list[int]:
        """Stored cells of one query in order of the sum of their bounds, up to the radius (multi-sequence algorithm).

        A pair of places in the two sorted lists enters the heap once both pairs before it have left it.
        """
        lists = []
        for bound in (first, second):
            near = np.flatnonzero(bound <= radius)
            order = near[np.argsort(bound[near], kind="stable")]
            lists.append((order.tolist(), bound[order].tolist()))
        (a, x), (b, y) = lists
        if not a or not b:
            return []
        heap, upto, cells = [(x[0] + y[0], 0, 0)], [0] * len(a), []
        while heap:
            bound, i, j = heapq.heappop(heap)
            if bound > radius:
                break
            cells.append(a[i] * len(self.books[1]) + b[j])
            # upto[i]: places of the second list already visited with place i of the first.
            upto[i] = j + 1
            if i + 1 < len(a) and upto[i + 1] == j:
                heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
            if j + 1 < len(b) and (i == 0 or upto[i - 1] > j + 1):
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        return cells


def fit_grid(vectors: DataFrame, n: int) -> Grid:
    k = int(min(MOST, max(4, round((n / CELL) ** 0.5))))
    share = min(1.0, SAMPLE / max(1, n))
    sample = vectors.where((F.xxhash64("rep", F.lit("grid")).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))) < share)

    def learn(table: pa.Table) -> Grid:
        x = _matrix(table["v"].combine_chunks())
        cut = max(1, x.shape[1] // 2)
        right = x[:, cut:] if x.shape[1] > 1 else np.zeros((len(x), 1))
        return Grid((codebook(x[:, :cut], k), codebook(right, k)), min(k, -(-BLOCK * k * k // max(1, n))))

    grid = fit_once(sample.select(F.col("rep").alias("doc_id"), "v"), ["doc_id", "v"], learn)
    return grid or fit_once(vectors.orderBy("rep").limit(1).select(F.col("rep").alias("doc_id"), "v"), ["doc_id", "v"], learn)


def drawn_bounds(q: np.ndarray, grid: Grid, low: list[np.ndarray], threshold: float) -> np.ndarray:
    """Bounds, by query, of the cells of DRAWS vectors at exactly the threshold from it, in random directions."""
    rng = np.random.default_rng(5)
    rows, out = np.arange(len(q)), []
    for _ in range(DRAWS):
        z = rng.normal(size=q.shape)
        z -= (z * q).sum(axis=1)[:, None] * q
        z /= np.maximum(np.linalg.norm(z, axis=1), 1e-300)[:, None]
        home, _ = grid.bounds(threshold * q + max(0.0, 1 - threshold**2) ** 0.5 * z)
        out.append(low[0][rows, home[0]] + low[1][rows, home[1]])
    return np.array(out)


def measured_radius(vectors: DataFrame, grid: Grid, threshold: float, recall: float) -> float:
    """Squared radius of the traversal that finds, for each query of a sample, `recall` of its true links to other vectors
    of the whole table, and every drawn link at the threshold."""
    most = 2 - 2 * threshold
    probes = vectors.orderBy(F.xxhash64("rep", F.lit("probe"))).limit(PROBES).select("rep", "v").toArrow()
    if not probes.num_rows or most <= 0:
        return max(0.0, most) + 1e-9
    ids, q = probes["rep"].to_numpy(), _matrix(probes["v"].combine_chunks())
    _, low = grid.bounds(q)
    drawn = drawn_bounds(q, grid, low, threshold).max()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(q) * _BINS, dtype=np.int64)
        for b in (p for whole in batches for p in _slices(whole, max(len(q), *map(len, grid.books)))):
            x = _matrix(b["v"])
            home, _ = grid.bounds(x)
            i, j = np.nonzero((q @ x.T >= threshold) & (ids[:, None] != b["rep"].to_numpy()[None]))
            s = low[0][i, home[0][j]] + low[1][i, home[1][j]]
            np.add.at(seen, i * _BINS + np.minimum((s / most * _BINS).astype(np.int64), _BINS - 1), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at // _BINS), pa.array(at % _BINS), pa.array(seen[at])], names=["probe", "bin", "n"])

    of = Window.partitionBy("probe")
    got = vectors.select("rep", "v").mapInArrow(run, "probe long, bin long, n long").groupBy("probe", "bin").agg(F.sum("n").alias("n"))
    got = got.select("probe", "bin", F.sum("n").over(of.orderBy("bin")).alias("run"), F.sum("n").over(of).alias("total"))
    reach = got.where(F.col("run") >= F.lit(recall) * F.col("total")).groupBy("probe").agg(F.min("bin").alias("bin")).agg(F.max("bin")).first()[0]
    found = 0.0 if reach is None else (reach + 1) / _BINS * most * MARGIN
    return min(most, max(found, drawn, most / 50)) + 1e-9


def _block_links(blocks: DataFrame, threshold: float) -> DataFrame:
    """(u, v, links) of blocks: a query's weighted link count (v null), or an edge of a forest over the block (links 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["cell", "i", "j"]):
            stored = g["stored"].to_numpy(zero_copy_only=False)
            ids, x, w = g["rep"].to_numpy(), _matrix(g["v"]), g["w"].to_numpy()
            d, q = np.flatnonzero(stored), np.flatnonzero(~stored)
            if not len(d) or not len(q):
                continue
            near = (x[q] @ x[d].T >= threshold) & (ids[q][:, None] != ids[d][None])
            links = near @ w[d]
            some = np.flatnonzero(links)
            u, v, n = [ids[q][some]], [np.zeros(len(some), dtype=np.int64)], [links[some]]
            edges, left_q, left_d = [], near.any(axis=1), near.any(axis=0)
            for root in np.flatnonzero(left_q):
                if not left_q[root]:
                    continue
                left_q[root] = False
                stack = [root]
                while stack:
                    a = stack.pop()
                    for b in np.flatnonzero(near[a] & left_d):
                        left_d[b] = False
                        edges.append((ids[q[a]], ids[d[b]]))
                        more = np.flatnonzero(near[:, b] & left_q)
                        left_q[more] = False
                        edges += [(ids[q[c]], ids[d[b]]) for c in more]
                        stack += more.tolist()
            if edges:
                e = np.array(edges)
                u, v, n = [*u, e[:, 0]], [*v, e[:, 1]], [*n, np.zeros(len(e), dtype=np.int64)]
            u, v, n = map(np.concatenate, (u, v, n))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, mask=np.arange(len(v)) < len(some)), pa.array(n)], names=["u", "v", "links"])

    return blocks.mapInArrow(run, "u long, v long, links long")


def _split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rep, links), edges) of block links."""
    return found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links")), found.where("v is not null").select("u", "v")


def _linked(vectors: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Links among class representatives (rep, w, v) of one dimension."""
    n = vectors.count()
    grid = fit_grid(vectors, n)
    radius = measured_radius(vectors, grid, threshold, recall)
    kind = vectors.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in _slices(whole, max(map(len, grid.books)))):
            home, low = grid.bounds(_matrix(b["v"]))
            first, second = grid.sequences(low)
            visits = [grid.traverse(x, y, radius) for x, y in zip(first, second)]
            yield pa.RecordBatch.from_arrays([b["rep"], b["w"], b["v"], pa.array(grid.cells(home)), pa.array(visits, pa.list_(pa.int64()))], names=["rep", "w", "v", "cell", "visits"])

    placed = materialise(vectors.select("rep", "w", "v").mapInArrow(run, f"rep long, w long, v {kind}, cell long, visits array<long>"), "cells")
    chunks = lambda c: F.ceil(F.count(F.lit(1)) / BLOCK).alias(c)
    stored, queries = placed.select("rep", "cell"), placed.select("rep", F.explode("visits").alias("cell"))
    sizes = queries.groupBy("cell").agg(chunks("qn")).join(stored.groupBy("cell").agg(chunks("dn")), "cell")
    # Rows of a dense cell meet their cell's sizes in SALTS parts.
    sizes = sizes.select("cell", "qn", "dn", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    salted = lambda rows: rows.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit("salt")), F.lit(SALTS)).cast("int")).join(sizes, ["cell", "salt"])
    part = lambda n: F.pmod(F.xxhash64("rep", F.lit("part")), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    d = salted(stored).select("cell", part("dn").alias("i"), each("qn").alias("j"), "rep", F.lit(True).alias("stored"))
    q = salted(queries).select("cell", each("dn").alias("i"), part("qn").alias("j"), "rep", F.lit(False).alias("stored"))
    # Places are dealt without vectors, which join them once and then travel to their blocks.
    blocks = d.union(q).join(placed.select("rep", "w", "v").hint("merge"), "rep")
    blocks = blocks.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return materialise(_block_links(blocks, threshold), "links")


def _few(vectors: DataFrame, threshold: float) -> DataFrame:
    """Links among representatives (rep, w, v, dim) of dimensions that have a block or less: one cell a dimension."""
    zero = F.lit(0).cast("long")
    roles = F.explode(F.array(F.lit(True), F.lit(False))).alias("stored")
    blocks = vectors.select(F.col("dim").alias("cell"), zero.alias("i"), zero.alias("j"), "rep", "w", "v", roles)
    return materialise(_block_links(blocks.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j"), threshold), "links")


def near_duplicates(table: DataFrame, threshold: float = 0.95, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector of `table`.

    Null, empty and zero vectors and those with null or non-finite components link with nothing, and so do vectors of
    different length.  Equal vectors (up to length) form a weighted class that is compared once.  Rows without vec_id
    are dropped, repeated rows count each; other columns are ignored; an empty table gives an empty result.  Dimensions
    with more than a block of vectors have a grid each; of those a table should have few.
    """
    units = materialise(usable_vectors(table, vec_id, embedding), "vectors")
    classes = materialise(units.where("v is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v"), F.max("dim").alias("dim")), "classes")
    dims = materialise(classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")), "dims")
    parts = [_linked(classes.where(F.col("dim") == r["dim"]), threshold, recall) for r in dims.where(F.col("n") > BLOCK).orderBy("dim").collect()]
    if not (few := dims.where(F.col("n") <= BLOCK)).isEmpty():
        parts.append(_few(classes.join(few.select("dim"), "dim", "left_semi"), threshold))
    if not parts:
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links, edges = _split(reduce(DataFrame.union, parts))
    merged = components(edges).withColumnRenamed("node", "rep")
    of = classes.select("key", "rep", "w").join(links, "rep", "left").join(merged, "rep", "left")
    # A class may hold a third of all rows, so it is looked up in SALTS parts.
    of = of.select("key", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"), (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = units.select("vec_id", "key", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt")).join(of, ["key", "salt"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
