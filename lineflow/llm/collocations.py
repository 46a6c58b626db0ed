"""Phrase collocations per language: frequent phrases of two to five words, scored by their weakest cut.

Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?]` and line ends, and pieces into words at blanks.  f(phrase) counts
every contiguous occurrence inside a piece, overlaps included, n the words of a language.

1. Pieces.  Equal pieces of a language become one row with a multiplicity, so copies of documents are read once from here.
2. Counts.  A task turns its pieces into weighted n-grams and adds them up in DuckDB before the shuffle, a limited number
   of them at a time; the rows go to hash buckets of (language, phrase), each summed by DuckDB under a memory limit, on disk
   beyond it.  Phrases are compared as text, never by a hash alone.  Words are counted first, then pairs of frequent words,
   then longer phrases all of whose pairs are frequent: no phrase is more frequent than its parts, so nothing is lost.
   Tasks know the frequent ones from a bitmap of 2**26 bits, 8 MB whatever the corpus; where it is crowded, or two
   phrases share a bit, more is counted, and the result is the same.
3. Parts.  Candidates ask for the counts of their first and last words by shuffled requests, salted, because one word may
   be the part of a third of all candidates; replies meet at the candidate.
4. Ranks.  The order is a range partition with running counts, so that a language of any size is ranked over many tasks.

Defined results: null texts are empty; a null language is `und`; empty tables and texts without a phrase give no rows;
equal scores fall to the more frequent phrase, then to the phrase in byte order; other columns are ignored; pieces longer
than half a megabyte are counted in overlapping cuts, so that a worker's memory is bounded by the longest text, not by what is
derived from it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineflow.llm import _bytes
from lineflow.llm._shared import materialise

MOST = 5
SALTS = 16


class Limits(NamedTuple):
    """What bounds a task's memory; no value changes a result.

    Bits of the prune map as a power of two, bytes of text handled at a time, bytes at which a piece is cut, n-grams that
    a task adds up before it ships them, memory of its DuckDB.
    """

    bits: int = 26
    chunk: int = 1 << 19
    cut: int = 1 << 19
    flush: int = 500_000
    memory: str = "150MB"


LIMITS = Limits()

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9] = 32
_FOLD[np.frombuffer(b".,;:!?\x0b\x0c\r", dtype=np.uint8)] = 10
_BLANK = np.zeros(256, dtype=bool)
_BLANK[32] = True


def _strings(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))


def _slices(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each span as one string array."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return _strings(raw[at], offsets)


def cut_pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(pieces, row of each) of texts that each end in a line feed: folded, one space between words, none at the ends."""
    raw = _FOLD[raw]
    space, stop = raw == 32, raw == 10
    before = np.concatenate([[True], space[:-1] | stop[:-1]])
    drop = (space | stop) & before  # a blank or stop behind another; what is left of a run is its first byte
    # A run with a stop anywhere in it is a stop.
    run = np.cumsum((space | stop) & ~before)
    broken = np.zeros(int(run[-1]) + 1 if len(run) else 1, dtype=bool)
    broken[run[stop]] = True
    gap = (space | stop) & ~before
    raw = np.where(gap & broken[run], np.uint8(10), raw)
    kept = np.flatnonzero(~drop)
    small = raw[kept]
    ends = np.flatnonzero(small == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    row = np.searchsorted(offsets, kept[ends], side="right") - 1 if len(ends) else ends
    held = ends > starts
    return _slices(small, starts[held], ends[held]), row[held]


def _pieces(batches: Iterator[pa.RecordBatch], limits: Limits = LIMITS) -> Iterator[pa.RecordBatch]:
    """(lang, piece, own, m): own is how many of its words may begin an n-gram, the others follow in the next cut."""
    for whole in batches:
        for b in _bytes.parts(whole, limits.chunk):
            pieces, row = cut_pieces(*_bytes.text_column(b["text"]))
            if not len(pieces):
                continue
            code = b["lang"].dictionary_encode()
            t = pa.table({"lang": pa.array(code.indices.to_numpy()[row]), "piece": pieces}).group_by(["lang", "piece"]).aggregate([([], "count_all")])
            lang = code.dictionary.take(t["lang"].combine_chunks())
            text = t["piece"].combine_chunks().cast(pa.large_string())
            raw, offs = _bytes.text_column(text)
            m = t["count_all"].combine_chunks().cast(pa.int64())
            long = np.flatnonzero(np.diff(offs) > limits.cut)
            own = np.bincount(np.searchsorted(offs, np.flatnonzero(raw == 32), side="right") - 1, minlength=len(text)) + 1
            rest = np.setdiff1d(np.arange(len(text)), long)
            yield _piece_rows(lang.take(pa.array(rest)), text.take(pa.array(rest)), own[rest], m.take(pa.array(rest)))
            for k in long:
                body = raw[offs[k] : offs[k + 1]]
                words = np.concatenate([[0], np.flatnonzero(body == 32) + 1, [len(body) + 1]])
                first = 0
                while first < len(words) - 1:
                    upto = min(max(first + 1, int(np.searchsorted(words, words[first] + limits.cut))), len(words) - 1)
                    end = words[min(upto + MOST - 1, len(words) - 1)] - 1
                    part = pa.array([body[words[first] : end].tobytes().decode()], pa.large_string())
                    yield _piece_rows(lang.slice(k, 1), part, np.array([upto - first]), m.slice(k, 1))
                    first = upto


def _piece_rows(lang: pa.Array, text: pa.Array, own: np.ndarray, m: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang.cast(pa.string()), text.cast(pa.string()), pa.array(own, pa.int64()), m], names=["lang", "piece", "own", "m"])


def distinct_pieces(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(lang, piece, own, m) with one row per language and piece."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"))
    rows = texts.mapInArrow(lambda batches: _pieces(batches, limits), "lang string, piece string, own long, m long")
    return rows.groupBy("lang", "piece", "own").agg(F.sum("m").alias("m"))


def _key(lang_hash: np.ndarray, gram_hash: np.ndarray, bits: int) -> np.ndarray:
    """Bit of a phrase in the prune map."""
    return (_bytes.mix(gram_hash ^ lang_hash) >> np.uint64(64 - bits)).astype(np.int64)


def _lang_hash(lang: pa.Array) -> np.ndarray:
    raw, offs = _bytes.text_column(lang)
    return _bytes.span_hash(_bytes.prefix_hash(raw), offs[:-1], offs[1:]) * np.uint64(3)


def _known(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def grams(b: pa.RecordBatch, lengths: range, words_map: np.ndarray | None, pairs_map: np.ndarray | None) -> Iterator[pa.Table]:
    """(lang, phrase, f) of the n-grams of a batch of pieces, equal ones added up; ids of words make keys, not hashes."""
    raw, offs = _bytes.text_column(b["piece"])
    starts, ends, counts = _bytes.word_spans(raw, offs, _BLANK)
    if not len(starts):
        return
    row = _bytes.row_of(counts)
    place = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = counts[row] - place  # words from here to the end of the piece
    mine = place < b["own"].to_numpy()[row]
    weight = b["m"].to_numpy().astype(np.int64)[row]
    code = b["lang"].dictionary_encode()
    lang = code.indices.to_numpy()[row].astype(np.int64)
    seed = _lang_hash(code.dictionary)
    word = _slices(raw, starts, ends).dictionary_encode().indices.to_numpy().astype(np.int64)
    prefix = _bytes.prefix_hash(raw)

    def known(bits: np.ndarray | None, key: np.ndarray, k: int, use: np.ndarray) -> np.ndarray:
        """Whether the k words from each place of `use` may be frequent; asked once for each different key."""
        ok = np.zeros(len(starts), dtype=bool)
        if bits is None:
            ok[use] = True
        elif len(use):
            _, one, back = np.unique(key, return_index=True, return_inverse=True)
            at = use[one]
            ok[use] = _known(bits, _key(seed[lang[at]], _bytes.span_hash(prefix, starts[at], ends[at + k - 1]), len(bits).bit_length() + 2))[back]
        return ok

    ids = word * len(code.dictionary) + lang
    alive, key = np.arange(len(starts)), ids
    fine = known(words_map, ids, 1, alive)
    for k in range(1, lengths.stop):
        if k > 1:
            # A phrase of k words is one of k-1 and the next word; both ends must be known.
            dense = np.unique(key, return_inverse=True)[1]
            wide = np.full(len(starts), -1, dtype=np.int64)
            wide[alive] = dense
            ok = (left[alive] >= k) & (fine[np.minimum(alive + 1, len(fine) - 1)] if k == 2 else pair[np.minimum(alive + k - 2, len(fine) - 1)])
            alive = alive[ok]
            key = wide[alive] * (int(ids.max()) + 1) + ids[alive + k - 1]
        if k == 1:
            alive, key = alive[fine], key[fine]
        if k == 2:
            pair = known(pairs_map, key, 2, alive)
            alive, key = alive[pair[alive]], key[pair[alive]]
        if k in lengths and len(alive):
            own = mine[alive]
            uniq, one, back = np.unique(key[own], return_index=True, return_inverse=True)
            at = alive[own][one]
            f = np.zeros(len(uniq), dtype=np.int64)
            np.add.at(f, back, weight[alive[own]])
            if len(at):
                yield pa.table({"lang": code.dictionary.take(pa.array(lang[at])).cast(pa.string()), "phrase": _slices(raw, starts[at], ends[at + k - 1]).cast(pa.string()), "f": pa.array(f)})


def _summed(tables: Iterator[pa.Table], least: int, spill: str, memory: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Sums by language and phrase in DuckDB, out of core; after `most` rows those so far are handed on.

    In order of phrases, because neighbours that begin alike take half the room in the shuffle.
    """
    con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": spill, "preserve_insertion_order": False})
    con.execute("create table g (lang varchar, phrase varchar, f bigint)")
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        yield from con.sql(f"select lang, phrase, sum(f)::bigint f from g group by lang, phrase having sum(f) >= {least} order by lang, phrase").to_arrow_reader(20_000)
        con.execute("truncate g")

    try:
        for t in tables:
            con.register("t", t)
            con.execute("insert into g select lang, phrase, f from t")
            con.unregister("t")
            held += t.num_rows
            if most and held >= most:
                yield from flush()
                held = 0
        if held:
            yield from flush()
    finally:
        con.close()


def _plain(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    kind = {"lang": pa.string(), "phrase": pa.string(), "f": pa.int64(), "bit": pa.int64()}
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([b[c].cast(kind[c]) for c in names], names=names)


def count(pieces: DataFrame, lengths: range, least: int, words_map=None, pairs_map=None, limits: Limits = LIMITS) -> DataFrame:
    """(lang, phrase, f, bit) of the n-grams of `lengths` words with f >= least.

    The maps are broadcast bitmaps, or None; a phrase one of whose words or pairs isn't in them is left out.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = (None if m is None else np.frombuffer(m.value, dtype=np.uint8) for m in (words_map, pairs_map))
        chunks = (t for whole in batches for b in _sized(whole, limits.chunk) for t in grams(b, lengths, words, pairs))
        with tempfile.TemporaryDirectory() as spill:
            yield from _plain(_summed(chunks, 1, spill, limits.memory, limits.flush), ["lang", "phrase", "f"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as spill:
            for b in _plain(_summed((pa.Table.from_batches([x]) for x in batches if x.num_rows), least, spill, limits.memory), ["lang", "phrase", "f"]):
                raw, offs = _bytes.text_column(b["phrase"])
                code = b["lang"].dictionary_encode()
                bit = _key(_lang_hash(code.dictionary)[code.indices.to_numpy()], _bytes.span_hash(_bytes.prefix_hash(raw), offs[:-1], offs[1:]), limits.bits)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bit + 1)], names=["lang", "phrase", "f", "bit"])

    sent = pieces.select("lang", "piece", "own", "m").mapInArrow(emit, "lang string, phrase string, f long")
    return sent.repartition("lang", "phrase").mapInArrow(gather, "lang string, phrase string, f long, bit long")


def _sized(whole: pa.RecordBatch, chunk: int) -> Iterator[pa.RecordBatch]:
    size = np.diff(_bytes.text_column(whole["piece"])[1])
    upto, lo = np.cumsum(size), 0
    while lo < whole.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + chunk, side="right")))
        yield whole.slice(lo, hi - lo)
        lo = hi


def bitmap(counted: DataFrame, bits: int):
    """Broadcast map of the phrases of `counted`, put together from pieces of 32,768 bits: 2**bits / 8 bytes at the most."""
    spark = counted.sparkSession
    parts = counted.groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in parts.collect():
        # Places count from 1, and so do buckets.
        out[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return spark.sparkContext.broadcast(out.tobytes())


def weakest_cut(a: str, n: str, parts: str) -> str:
    """SQL: the part (score, k, l, r) with the lowest floor(1000 * a * n / (l * r)), the first of equals."""
    big = lambda x: f"cast({x} as decimal(38, 0))"
    return f"array_min(transform({parts}, p -> named_struct('score', ({big('1000')} * {a} * {n}) div ({big('p.l')} * p.r), 'k', p.k, 'l', p.l, 'r', p.r)))"


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, inside: int = 100, limits: Limits = LIMITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` best phrases of 2 to 5 words with a >= `least`.

    A phrase inside a longer candidate with 100 * f(longer) >= inside * a is dropped.
    """
    pieces = materialise(distinct_pieces(docs, limits), "pieces")
    total = pieces.groupBy("lang").agg(F.sum(F.col("own") * F.col("m")).alias("n"))
    words = materialise(count(pieces, range(1, 2), least, limits=limits), "words")
    words_map = bitmap(words, limits.bits)
    pairs = materialise(count(pieces, range(2, 3), least, words_map, limits=limits), "pairs")
    longer = materialise(count(pieces, range(3, MOST + 1), least, words_map, bitmap(pairs, limits.bits), limits), "longer")
    known = words.unionByName(pairs).unionByName(longer).drop("bit")
    found = pairs.unionByName(longer).select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    asked = found.select("lang", "phrase", F.expr("explode(sequence(1, size(w) - 1)) as k"), "w")
    sides = "array(named_struct('side', 0, 'part', array_join(slice(w, 1, k), ' ')), named_struct('side', 1, 'part', array_join(slice(w, k + 1, size(w)), ' ')))"
    asked = asked.selectExpr("lang", "phrase", "k", f"inline({sides})").withColumn("salt", F.pmod(F.xxhash64("phrase", "k"), F.lit(SALTS)).cast("int"))
    held = known.selectExpr("lang", "phrase as part", "f", f"explode(sequence(0, {SALTS - 1})) as salt")
    replies = asked.join(held, ["lang", "part", "salt"]).select("lang", "phrase", "k", "side", "f")
    cover = found.selectExpr("lang", "w", "a as by", "size(w) as z", "explode(sequence(2, size(w) - 1)) as size").where("z > 2")
    cover = cover.selectExpr("lang", "by", "w", "size", "explode(sequence(1, z - size + 1)) as at").selectExpr("lang", "array_join(slice(w, at, size), ' ') as phrase", "by")
    none = lambda kind: F.lit(None).cast(kind)
    everything = (
        found.select("lang", "phrase", "a", none("int").alias("k"), none("int").alias("side"), none("bigint").alias("f"), none("bigint").alias("by"))
        .unionByName(replies, allowMissingColumns=True)
        .unionByName(cover, allowMissingColumns=True)
    )
    agg = [F.max("a").alias("a"), F.max("by").alias("by"), *[F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"p{k}_{s}") for k in range(1, MOST) for s in (0, 1)]]
    one = everything.groupBy("lang", "phrase").agg(*agg).where(f"a is not null and coalesce(100 * by < {inside} * a, true)")
    parts = F.expr("filter(array(" + ", ".join(f"named_struct('k', {k}, 'l', p{k}_0, 'r', p{k}_1)" for k in range(1, MOST)) + "), p -> p.l is not null and p.r is not null)").alias("parts")
    scored = one.select("lang", "phrase", "a", parts).join(total, "lang").select("lang", "phrase", "a", "n", F.expr(weakest_cut("a", "n", "parts")).alias("cut"))
    scored = materialise(scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), "scored")
    return ranked(scored, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def ranked(rows: DataFrame, group: list[str], order: list[Column], top: int) -> DataFrame:
    """The first `top` rows of each group with their rank from 1; a group lies over as many partitions as its size asks."""
    by = [*[F.col(c) for c in group], *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = materialise(placed.select("*", F.spark_partition_id().alias("part_"), F.monotonically_increasing_id().alias("row_")), "ranked")
    pieces = placed.groupBy("part_", *group).agg(F.min("row_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(*group).orderBy("part_")) - F.col("n_")
    pieces = pieces.withColumn("before_", before).where(F.col("before_") < top)
    return placed.join(pieces, ["part_", *group]).withColumn("rank", (F.col("before_") + F.col("row_") - F.col("first_") + 1).cast("long")).where(F.col("rank") <= top).select(*rows.columns, "rank")
