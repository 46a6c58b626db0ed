"""Operator 5: exact removal of repeated 100-byte strings by prefix-free parsing.

Trigger: the position in a window of SPAN bytes whose GRAM-byte rolling hash is least (leftmost on ties).  It depends on
the window's bytes alone, so equal windows have equal triggers.  A phrase is the text under a maximal run of windows
with one trigger; it has less than 2 * SPAN bytes.  Phrases overlap by what a window needs, as in prefix-free parsing, so
no window is cut.  The dictionary is the set of distinct phrases, the parse the sequence of their fingerprints.

Parse: an occurrence of a phrase that is not its first repeats all of its windows.  Only first occurrences are left, and
those whose trigger string has no other phrase hold no repeated window at all.

Dictionary: the suffixes of the other phrases, cut at SPAN bytes, are sorted by their bytes; this is the dictionary's
suffix array in parts, one trigger string never in two.  Suffixes with equal bytes stand in the order of the parse, and
all but the first of them repeat.  The suffixes of a trigger with more phrases than one step holds are sorted once more
by Spark, again by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineflow.llm._bytes import BASE_INV, U64, mix, parts, powers, prefix_hash, rolling, span_hash, text_column
from lineflow.llm._shared import materialise

SPAN, GRAM = 100, 32
#: Bytes handled at once; longer documents are cut with an overlap of SPAN - 1 bytes, which only cuts phrases.
CHUNK = 1 << 20
#: Phrases whose suffixes are sorted in one step.
PHRASES = 4096
_POSITION = U64((1 << 24) - 1)


def least_grams(raw: np.ndarray, prefix: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Trigger of the window at every position: where the least gram hash of the window lies."""
    n = len(raw) - gram + 1
    h = mix((prefix[gram:] - prefix[:n]) * powers(BASE_INV, len(prefix))[:n])
    m = (h & ~_POSITION) | np.arange(n, dtype=U64)
    width, need = 1, span - gram + 1
    while width * 2 <= need:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < need:
        m = np.minimum(m[: len(m) - (need - width)], m[need - width :])
    return (m & _POSITION).astype(np.int64)


def phrases(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(piece, trigger string hash, phrase hash, first window, last window) over pieces raw[starts:ends], by position."""
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < span:
        return none, none.astype(U64), none.astype(U64), none, none
    trigger = least_grams(raw, rolling(raw), span, gram)
    prefix = prefix_hash(raw)
    edge = np.zeros(len(raw) + 1, dtype=np.int32)
    long = ends - starts >= span
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - span + 1, -1)
    at = np.flatnonzero(np.cumsum(edge)[: len(trigger)])
    if not len(at):
        return none, none.astype(U64), none.astype(U64), none, none
    t = trigger[at]
    new = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    lo, hi, t = at[new], at[np.append(new[1:], len(at)) - 1], t[new]
    key = span_hash(prefix, t, t + gram)
    phrase = mix(span_hash(prefix, lo, hi + span) + (t - lo).astype(U64) * U64(0x632BE59BD9B4E019))
    piece = np.searchsorted(starts, lo, side="right") - 1
    return piece, key, phrase, lo - starts[piece], hi - starts[piece]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, starts, ends, doc ids, texts' t, offset in the document) of pieces, about CHUNK bytes at a time."""
    for batch in batches:
        for part in parts(batch, CHUNK):
            part = part.take(pa.array(np.lexsort((part["t"].to_numpy(), part["doc_id"].to_numpy()))))
            raw, offsets = text_column(part["text"])
            ids, t = part["doc_id"].to_numpy(), part["t"].to_numpy()
            if len(raw) <= CHUNK:
                yield raw, offsets[:-1], offsets[1:], ids, t, np.zeros(len(ids), dtype=np.int64)
                continue
            # A part over CHUNK is one document.
            for s in range(0, len(raw), CHUNK):
                e = min(len(raw), s + CHUNK + SPAN - 1)
                yield raw[s:e], np.array([0]), np.array([e - s]), ids[:1], t[:1], np.array([s])


_ROW = "kind int, k long, c long, doc_id long, t long, lo long, n long"
_NAMES = ["kind", "k", "c", "doc_id", "t", "lo", "n"]
#: Kinds of rows: an occurrence, windows known to repeat (lo to lo + n), windows still to be compared.
OCCURS, REPEATS, OPEN = 0, 1, 2


def _rows(kind: int, *columns: np.ndarray, names: list[str] = _NAMES) -> pa.RecordBatch:
    first = pa.array(np.full(len(columns[0]), kind, dtype=np.int32))
    return pa.RecordBatch.from_arrays([first, *[pa.array(x.view(np.int64) if x.dtype == U64 else x) for x in columns]], names=names)


def _first_in_order(c: np.ndarray, where: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(first, repeat) masks of rows in corpus order, by value of c; a row at the place of the first is no repeat."""
    order = np.argsort(c, kind="stable")
    s = c[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
    first = np.zeros(len(c), dtype=bool)
    first[order[new]] = True
    other = np.zeros(len(c), dtype=bool)
    other[order] = np.any([x[head] != x[order] for x in where], axis=0)
    return first, ~first & other


def _runs(mark: np.ndarray, *where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) indexes of runs of marked rows whose last column rises by one and whose others stay."""
    *same, at = where
    joins = np.zeros(len(mark), dtype=bool)
    joins[1:] = mark[1:] & mark[:-1] & (at[1:] == at[:-1] + 1)
    for x in same:
        joins[1:] &= x[1:] == x[:-1]
    start = np.flatnonzero(mark & ~joins)
    stop = np.ones(len(mark), dtype=bool)
    stop[:-1] = ~joins[1:]
    return start, np.flatnonzero(mark & stop)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrase occurrences, of each phrase only the chunk's first; its others are known to repeat."""
    for raw, starts, ends, ids, texts, base in _chunks(batches):
        piece, k, c, lo, hi = phrases(raw, starts, ends)
        if not len(k):
            continue
        doc, t, lo, n = ids[piece], texts[piece], lo + base[piece], hi - lo
        first, repeat = _first_in_order(c, (doc, t, lo))
        yield _rows(OCCURS, *(x[first] for x in (k, c, doc, t, lo, n)))
        # Repeats need no meeting place: any key will do; neighbours become one row.
        at = np.flatnonzero(repeat)
        if len(at):
            join = np.zeros(len(at), dtype=bool)
            join[1:] = (np.diff(at) == 1) & (piece[at[1:]] == piece[at[:-1]])
            a, b = at[~join], at[np.append(np.flatnonzero(~join)[1:], len(at)) - 1]
            zero = np.zeros(len(a), dtype=np.int64)
            yield _rows(REPEATS, mix(doc[a].astype(U64)), zero, doc[a], t[a], lo[a], lo[b] + n[b] - lo[a])


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (k, c, doc_id, t, lo): repeats, and the first occurrences under a trigger of several phrases."""
    last, held, several = None, None, False
    for batch in batches:
        kind, k, c, doc, t, lo, n = (batch[x].to_numpy() for x in _NAMES)
        known = kind == REPEATS
        yield _rows(REPEATS, *(x[known] for x in (k, c, doc, t, lo, n)))
        k, c, doc, t, lo, n = (x[~known] for x in (k, c, doc, t, lo, n))
        if not len(k):
            continue
        if last is None:
            last = (k[0] ^ 1, 0, 0, 0, 0)
        new_k = k != np.append(last[0], k[:-1])
        new_c = new_k | (c != np.append(last[1], c[:-1]))
        # First occurrence that each row belongs to; rows of the carried phrase look at the one before the batch.
        at = np.maximum.accumulate(np.where(new_c, np.arange(len(k)), -1))
        head = [np.where(at < 0, old, x[at]) for old, x in zip(last[2:], (doc, t, lo))]
        repeat = ~new_c & ((doc != head[0]) | (t != head[1]) | (lo != head[2]))
        yield _rows(REPEATS, *(x[repeat] for x in (k, c, doc, t, lo, n)))
        group = np.cumsum(new_k)
        distinct = np.bincount(group, weights=new_c, minlength=group[-1] + 1)
        if held is not None or several:
            distinct[0] += 2 if several else 1
        open_ = new_c & (distinct[group] >= 2)
        yield _rows(OPEN, *(x[open_] for x in (k, c, doc, t, lo, n)))
        if held is not None and distinct[0] >= 2 and not several:
            yield _rows(OPEN, *held)
        several = distinct[group[-1]] >= 2
        if several:
            held = None
        elif group[-1] > 0 or held is None:
            i = int(np.flatnonzero(new_k)[-1])
            held = tuple(x[i : i + 1] for x in (k, c, doc, t, lo, n))
        last = (k[-1], c[-1], *(x[-1] for x in head))


_OPEN = "k long, doc_id long, t long, lo long, phrase binary"
_SUFFIX = "kind int, doc_id long, t long, lo long, n long, w binary"
_SUFFIX_NAMES = ["kind", "doc_id", "t", "lo", "n", "w"]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the open phrases of each document."""
    for batch in batches:
        for doc, t, z, ranges in zip(batch["doc_id"].to_pylist(), batch["t"].to_pylist(), batch["z"], batch["ranges"]):
            raw, r = _unzip(z.as_py()), ranges.values
            k, lo, n = (r.field(x).to_numpy() for x in ("k", "lo", "n"))
            for a in range(0, len(k), PHRASES):
                here = slice(a, a + PHRASES)
                cut = [raw[x : x + m + SPAN] for x, m in zip(lo[here].tolist(), n[here].tolist())]
                size = len(cut)
                yield pa.RecordBatch.from_arrays([pa.array(k[here]), pa.array(np.full(size, doc)), pa.array(np.full(size, t)), pa.array(lo[here]), pa.array(cut, pa.binary())], names=["k", "doc_id", "t", "lo", "phrase"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From phrases sorted by (k, doc_id, t, lo): windows that repeat one before, by sorting the suffixes of up to PHRASES
    phrases by their bytes.  First windows of a trigger that one step doesn't hold whole come out OPEN, with their bytes."""

    def step(rows: pa.RecordBatch, split: set[int]) -> Iterator[pa.RecordBatch]:
        raw, offsets = text_column(rows["phrase"])
        per = np.diff(offsets) - SPAN + 1
        row = np.repeat(np.arange(len(per)), per)
        at = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
        w = np.lib.stride_tricks.sliding_window_view(raw, SPAN)[offsets[row] + at]
        doc, t, lo = rows["doc_id"].to_numpy()[row], rows["t"].to_numpy()[row], rows["lo"].to_numpy()[row] + at
        # Rows of one trigger stand in corpus order, and equal windows have one trigger.
        first, repeat = _first_in_order(np.ascontiguousarray(w).view(f"S{SPAN}").ravel(), (doc, t, lo))
        a, b = _runs(repeat, row, lo)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), REPEATS, dtype=np.int32)), *map(pa.array, (doc[a], t[a], lo[a], lo[b] - lo[a])), pa.nulls(len(a), pa.binary())], names=_SUFFIX_NAMES)
        if split:
            late = np.flatnonzero(first & np.isin(rows["k"].to_numpy(), list(split))[row])
            for s in range(0, len(late), 1 << 15):
                i = late[s : s + (1 << 15)]
                bytes_ = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SPAN), len(i), [None, pa.py_buffer(np.ascontiguousarray(w[i]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), OPEN, dtype=np.int32)), *map(pa.array, (doc[i], t[i], lo[i], np.zeros(len(i), dtype=np.int64))), bytes_], names=_SUFFIX_NAMES)

    held, carried = None, None
    for batch in batches:
        for s in range(0, batch.num_rows, PHRASES):
            new = batch.slice(s, PHRASES)
            held = pa.Table.from_batches([new]) if held is None else pa.concat_tables([held, pa.Table.from_batches([new])])
            while held.num_rows >= 2 * PHRASES:
                k = held["k"].to_numpy()
                cut = PHRASES
                while cut and k[cut - 1] == k[cut]:
                    cut -= 1
                cut = cut or PHRASES
                # Triggers that go on from the step before or into the next one.
                split = ({carried} if carried == k[0] else set()) | ({int(k[cut])} if k[cut - 1] == k[cut] else set())
                carried = int(k[cut - 1])
                yield from step(held.slice(0, cut).combine_chunks().to_batches()[0], split)
                held = held.slice(cut)
    if held is not None and held.num_rows:
        k = held["k"].to_numpy()
        yield from step(held.combine_chunks().to_batches()[0], {carried} if carried == k[0] else set())


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From windows sorted by (w, doc_id, t, lo): those that are not the first with their bytes."""
    last = None
    for batch in batches:
        w = batch["w"].to_pylist()
        place = list(zip(batch["doc_id"].to_pylist(), batch["t"].to_pylist(), batch["lo"].to_pylist()))
        out = []
        for i, x in enumerate(w):
            if last is None or x != last[0]:
                last = (x, place[i])
            elif place[i] != last[1]:
                out.append(i)
        keep = batch.take(pa.array(out, pa.int64()))
        yield pa.RecordBatch.from_arrays([keep[c] for c in ("doc_id", "t", "lo", "n")], names=["doc_id", "t", "lo", "n"])


def _codec():
    return pa.Codec("zstd", compression_level=3)


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle, with their length in front."""
    codec = _codec()
    for batch in batches:
        for b in parts(batch, CHUNK):
            raw, offsets = text_column(b["text"])
            data = [int(e - s).to_bytes(8, "little") + codec.compress(raw[s:e].tobytes(), asbytes=True) if e > s else b"" for s, e in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["t"], pa.array(data, pa.binary())], names=["doc_id", "t", "z"])


def _unzip(z: bytes) -> bytes:
    return _codec().decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True) if z else b""


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, t, text): t tells apart texts that share a doc_id, and is 0 throughout where none do."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    texts = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    shared = not texts.where("a <> b").isEmpty()
    return docs.select("doc_id", (F.xxhash64("text") if shared else F.lit(0).cast("long")).alias("t"), "text")


def removal(docs: DataFrame) -> DataFrame:
    """(doc_id, z, ranges array<struct<lo,n>>): compressed text and the windows of `docs` (doc_id, text) that repeat."""
    docs = _keyed(docs)
    seen = docs.mapInArrow(_parse, _ROW).repartition("k").sortWithinPartitions("k", "c", "doc_id", "t", "lo").mapInArrow(_dictionary, _ROW)
    seen = materialise(seen.select("kind", F.when(F.col("kind") == OPEN, F.col("k")).alias("k"), "doc_id", "t", "lo", "n"), "phrases")
    per_doc = lambda rows, *of: rows.groupBy("doc_id", "t").agg(F.collect_list(F.struct(*of)).alias("ranges"))
    zipped = docs.mapInArrow(_zip, "doc_id long, t long, z binary")
    open_ = zipped.join(per_doc(seen.where(F.col("kind") == OPEN), "k", "lo", "n").hint("merge"), ["doc_id", "t"])
    suffixes = open_.mapInArrow(_cut, _OPEN).repartition("k").sortWithinPartitions("k", "doc_id", "t", "lo").mapInArrow(_suffixes, _SUFFIX)
    suffixes = materialise(suffixes, "suffixes")
    place = ["doc_id", "t", "lo", "n"]
    late = suffixes.where(F.col("kind") == OPEN).select("w", *place).repartition("w").sortWithinPartitions("w", "doc_id", "t", "lo")
    known = lambda rows: rows.where(F.col("kind") == REPEATS).select(*place)
    marks = known(seen).union(known(suffixes)).union(late.mapInArrow(_merged, "doc_id long, t long, lo long, n long"))
    return zipped.join(per_doc(marks, "lo", "n").hint("merge"), ["doc_id", "t"], "left").select("doc_id", "z", "ranges")


def covered(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the bytes that windows lo to lo + n cover, as maximal runs."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate((lo + n + SPAN)[order])
    new = np.ones(len(lo), dtype=bool)
    new[1:] = lo[1:] > end[:-1]
    return lo[new], end[np.append(np.flatnonzero(new)[1:], len(lo)) - 1]


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, kept binary, spans array<struct<start,end>>) of `docs` (doc_id, text).

    A byte goes if a SPAN-byte string that covers it also starts earlier: in a document of smaller doc_id, or earlier in
    the same one.  Null text is empty; documents under SPAN bytes lose nothing; rows without doc_id are dropped; equal
    rows are one document and come back repeated; different texts of one doc_id are documents of their own, in order of a
    hash of their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        names = ["doc_id", "n_bytes", "kept", "spans"]
        for batch in batches:
            ids, size, kept, spans, held = [], [], [], [], 0

            def out():
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], names=names)

            for doc, z, ranges in zip(batch["doc_id"].to_pylist(), batch["z"], batch["ranges"]):
                raw = _unzip(z.as_py())
                a, b = covered(*(ranges.values.field(x).to_numpy() for x in ("lo", "n"))) if ranges.is_valid else (np.zeros(0, dtype=np.int64),) * 2
                a, b = a.tolist(), b.tolist()
                ids.append(doc)
                size.append(len(raw))
                kept.append(b"".join(raw[s:e] for s, e in zip([0, *b], [*a, len(raw)])))
                spans.append([{"start": s, "end": e} for s, e in zip(a, b)])
                held += len(raw)
                if held > CHUNK:
                    yield out()
                    ids, size, kept, spans, held = [], [], [], [], 0
            if ids:
                yield out()

    return removal(docs).mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>")


def digest(done: DataFrame) -> DataFrame:
    """Counts and the hash of what deduplicate() keeps."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
