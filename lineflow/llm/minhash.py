"""Operator 7: near-duplicate documents by circulant MinHash.

One permutation (sigma) shuffles the shingle universe, a second one (pi) is applied to circular shifts of it, so that
two permutations give every signature coordinate: h_k(S) = min over s in S of pi(sigma(s) + k mod 2**32).  ROWS
coordinates form a band; documents that agree on one of BANDS bands share a bucket.  Every link is confirmed on the full
shingle sets, whose members are 64-bit hashes.

A bucket of any size is compared in blocks, first each block with itself and with a few pivots drawn from the whole
bucket, which joins a group of near copies in one pass over its texts; then, of the buckets that still hold several
components, what lies outside the largest one with the whole bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineflow.llm._bytes import BASE, MASK, TABLE_FOLDED, U64, mix, prefix_hash, row_of, span_hash, text_column, word_spans
from lineflow.llm._shared import components, materialise

#: 24 bands of 5: a pair at similarity 0.85 shares no bucket with probability (1 - 0.85**5)**24, under 1e-6.
BANDS, ROWS = 24, 5
SHINGLE = 5
#: Members of a block, shingles of a block (about), pivots of a bucket of several blocks (about), parts of a hot key.
BLOCK, SHINGLES, PIVOTS, SALTS = 256, 1 << 18, 16, 16


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts): the distinct shingles of each row as 64-bit hashes, row by row, and how many a row has.

    Words are maximal runs outside space and 0x09-0x0D, A-Z folded.  A row of fewer than `size` words has its whole word
    sequence as one shingle, a row without words has none.
    """
    starts, ends, n = word_spans(raw, offsets)
    if len(starts) == 0:
        return np.zeros(0, dtype=U64), np.zeros(len(n), dtype=np.int64)
    words = span_hash(prefix_hash(raw, TABLE_FOLDED), starts, ends)
    rows = row_of(n)
    first = np.concatenate([[0], np.cumsum(n)])
    short = (n > 0) & (n < size)
    whole = np.zeros(len(words) + 1, dtype=U64)
    place = (np.arange(len(words)) - first[rows]).astype(U64)
    # A short row: its own polynomial over word place, then its word count.
    np.cumsum(mix(words + place * U64(0x632BE59BD9B4E019)), out=whole[1:])
    at = np.flatnonzero(short)
    h, row = [mix((whole[first[at + 1]] - whole[first[at]]) ^ U64(0xA5A5A5A5A5A5A5A5))], [at]
    if len(words) >= size:
        m = len(words) - size + 1
        grams = words[:m] * U64(BASE)
        for k in range(1, size):
            grams += words[k : m + k] * U64(pow(BASE, k + 1, MASK + 1))
        inside = rows[:m] == rows[size - 1 :]
        h.append(mix(grams[inside]))
        row.append(rows[:m][inside])
    h, row = np.concatenate(h), np.concatenate(row)
    # Sort by row and the upper 48 bits; where two hashes differ below them alone, by all bits.
    key = (row.astype(U64) << U64(48)) | (h >> U64(16))
    order = np.argsort(key)
    if ((key[order][1:] == key[order][:-1]) & (h[order][1:] != h[order][:-1])).any():
        order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(n))


def _pi(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit integers; works in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(shingles: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Circulant MinHash coordinates (rows with shingles x length)."""
    full = counts[counts > 0]
    sigma = (mix(shingles) >> U64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(full)])
    out = np.empty((len(full), length), dtype=np.uint32)
    # Blocks of rows whose shingles stay in cache while all shifts are applied.
    lo = 0
    while lo < len(full):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + 65536, side="right")) - 1)
        part, at = sigma[starts[lo] : starts[hi]], starts[lo:hi] - starts[lo]
        for k in range(length):
            out[lo:hi, k] = np.minimum.reduceat(_pi(part + np.uint32(k)), at)
        lo = hi
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    got = np.empty((len(sig), bands), dtype=U64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, dtype=U64)
        for r in range(rows):
            h = mix(h * U64(BASE) + sig[:, b * rows + r].astype(U64))
        got[:, b] = h
    return got


_DIGEST = "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>"


def slices(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with up to 65,535 rows and about `limit` bytes of text."""
    size = batch.nbytes
    step = max(1, min(65535, batch.num_rows * limit // max(size, 1)))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def digests(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: set size, a 128-bit hash of the set, and one 64-bit key a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                raw, offsets = text_column(batch.column("text"))
                value, counts = shingle_sets(raw, offsets)
                full = counts > 0
                hi, lo = np.zeros((2, len(counts)), dtype=U64)
                at = np.concatenate([[0], np.cumsum(counts[full])])
                if len(value):
                    hi[full] = np.add.reduceat(mix(value + U64(0x1234567)), at[:-1])
                    lo[full] = np.add.reduceat(mix(value * U64(BASE) + U64(0x89ABCDEF)), at[:-1])
                got = band_keys(signatures(value, counts, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32), pa.array(got.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(counts.astype(np.int64)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), lists],
                    names=["doc_id", "n_shingles", "set_hi", "set_lo", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _DIGEST)


def _linked(value: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """Boolean matrix of the rows whose sets satisfy 100 * intersection >= percent * union."""
    n = len(counts)
    owner = row_of(counts)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, dtype=bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else new
    column, owner = column[shared], owner[shared]
    inter = np.zeros((n, n), dtype=np.float32)
    if len(column):
        fresh = np.concatenate([[True], column[1:] != column[:-1]])
        column = np.cumsum(fresh) - 1
        for lo in range(0, int(column[-1]) + 1, 4096):
            a, b = np.searchsorted(column, [lo, lo + 4096])
            hit = np.zeros((n, min(4096, int(column[-1]) + 1 - lo)), dtype=np.float32)
            hit[owner[a:b], column[a:b] - lo] = 1
            inter += hit @ hit.T
    inter = inter.astype(np.int64)
    return (inter > 0) & (100 * inter >= percent * (counts[:, None] + counts[None, :] - inter))


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph, breadth first."""
    left, edges = np.ones(len(linked), dtype=bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            for y in np.flatnonzero(linked[x] & left):
                left[y] = False
                queue.append(int(y))
                edges.append((x, int(y)))
    return edges


def block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that connect what is linked inside each cell of (bucket, i, j, doc_id, text), rows in that order.

    Rows of a cell come together and number 2 * BLOCK or so, whatever the size of its bucket.
    """

    def links(batch: pa.RecordBatch, groups: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        ids = batch["doc_id"].to_numpy()
        u, v = [], []
        for lo, hi in groups:
            for x, y in _forest(_linked(*shingle_sets(*text_column(batch["text"].slice(lo, hi - lo))), percent)):
                u.append(ids[lo + x])
                v.append(ids[lo + y])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for new in batches:
            held = pa.Table.from_batches([new]) if held is None else pa.concat_tables([held, pa.Table.from_batches([new])])
            key = np.stack([held[c].to_numpy() for c in ("bucket", "i", "j")])
            cut = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1])
            whole = held.combine_chunks().to_batches(max_chunksize=held.num_rows)
            if len(cut) > 1:
                yield from links(whole[0], list(zip(cut[:-1].tolist(), cut[1:].tolist())))
            held = held.slice(int(cut[-1]))
        if held is not None and held.num_rows:
            yield from links(held.combine_chunks().to_batches(max_chunksize=held.num_rows)[0], [(0, held.num_rows)])

    return blocks.select("bucket", "i", "j", "doc_id", "text").mapInArrow(run, "u long, v long")


def _compared(dealt: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The links inside the cells of `dealt` (bucket, i, j, doc_id), each with its `texts` (doc_id, text)."""
    cells = dealt.join(texts.hint("merge"), "doc_id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return materialise(block_links(cells, percent), "links")


def _blocks(k: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(k / BLOCK, shingles / SHINGLES, F.lit(1)))


def _each(n: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), n - 1)


def _outside(members: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Cells (bucket, i, j, doc_id) for what round one left in several components: blocks i of the members outside the
    largest component of a bucket, with each block j of the whole bucket.  None if there is nothing left."""
    found = members.where("n > 1").join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    found = materialise(found.select("bucket", "doc_id", "n", "own", "n_shingles", F.coalesce("component", "doc_id").alias("c")), "labelled")
    parts = found.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n_shingles").alias("s"))
    largest = parts.groupBy("bucket").agg(F.max(F.struct("k", "s", "c")).alias("top"), F.sum("k").alias("k"), F.sum("s").alias("s")).where("k > top.k")
    largest = materialise(largest.select("bucket", F.col("top.c").alias("top"), _blocks(F.col("k") - F.col("top.k"), F.col("s") - F.col("top.s")).alias("m")), "largest")
    if largest.isEmpty():
        return None
    left = found.join(largest, "bucket")
    block = F.pmod(F.xxhash64("doc_id", F.lit("outside")), F.col("m"))
    rest = left.where("c <> top").select("bucket", block.alias("i"), F.explode(_each(F.col("n"))).alias("j"), "doc_id")
    return rest.union(left.select("bucket", F.explode(_each(F.col("m"))).alias("i"), F.col("own").alias("j"), "doc_id"))


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document of `docs` (doc_id, text; other columns are ignored).

    Null or wordless texts have no shingles and link with nothing (component_id = doc_id, kept).  Documents with equal
    sets form a class and only its smallest document goes on, so copies are never paired.  Buckets with the same members
    count once.  Members of a bucket are compared exactly in cells of bounded size, each of which returns a spanning
    forest, so pairs are never emitted; two members of one bucket that are not in one component are always compared, so
    no link between components is lost.  A group of near copies costs its texts about once; only members of a bucket
    outside its largest component meet all of the bucket.  Rows without doc_id are dropped, repeated rows come back as
    often as they came (different texts of one doc_id: once with the component of any of them); texts are read whole; an
    empty table gives an empty result.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    d = materialise(digests(docs, bands, rows), "digests")
    key = ["set_hi", "set_lo", "n_shingles"]
    classes = materialise(d.where("n_shingles > 0").groupBy(*key).agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    rowset = classes.select(F.col("rep").alias("doc_id"), "n_shingles", F.explode("bands").alias("bucket"))
    members = [F.count(F.lit(1)).alias("k"), F.sum("n_shingles").alias("s"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit("second"))).alias("y")]
    kept = rowset.groupBy("bucket").agg(*members).where("k > 1").groupBy("k", "s", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "k", _blocks(F.col("k"), F.col("s")).alias("n"))
    own = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.col("n"))
    share = F.xxhash64("doc_id", "bucket").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    members = materialise(rowset.join(kept, "bucket").select("bucket", "doc_id", "n_shingles", "n", own.alias("own"), (share * F.col("k") < PIVOTS).alias("pivot")), "members")
    # Both rounds read the texts of bucket members only.
    texts = materialise(docs.join(members.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    cells = F.when(F.col("pivot"), _each(F.col("n"))).otherwise(F.array("own"))
    merged = components(_compared(members.select("bucket", F.explode(cells).alias("i"), F.lit(0).cast("long").alias("j"), "doc_id"), texts, percent))
    if (left := _outside(members, merged)) is not None:
        known = merged.select(F.col("node").alias("u"), F.col("component").alias("v"))
        merged = components(known.union(_compared(left, texts, percent)))

    # Only classes of several documents are looked up by their sets, in SALTS parts each, as one may be very large.
    classes = classes.select(*key, "rep", "copies").where("copies > 1").join(merged.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select(*key, F.coalesce("component", "rep").alias("c"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    out = d.select("doc_id", *key, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(classes, [*key, "salt"], "left")
    out = out.join(merged.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("c", "component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
