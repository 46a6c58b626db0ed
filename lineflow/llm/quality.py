"""Operator 6: quality classifier.

Random indexing gives every word a vector: each word has a sparse random index vector, drawn from its own hash, and a
word's context vector sums the index vectors of its neighbours over the whole corpus.  The vocabulary has the WORDS most
frequent words of the corpus, told apart by 64-bit hashes, and one entry for all others.  Because rare words say little
one by one, a second vocabulary holds the SHAPES most frequent word forms (capitals, closing signs, length, repetition),
which are indexed like words.  Vectors are pooled per document, and a two-layer numpy network turns the pooled vector
into a probability, calibrated by temperature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineflow.llm._bytes import TABLE_FOLDED, U64, mix, parts, prefix_hash, span_hash, text_column, word_spans
from lineflow.llm._fit import balanced_sample, fit_once, remainder, softmax, temperature
from lineflow.llm._shared import materialise

#: Words and forms of the vocabulary, vector width, non-zeros of an index vector, neighbours on each side.
WORDS, SHAPES, WIDTH, NONZERO, REACH = 1 << 15, 1 << 10, 32, 4, 2
#: Labelled rows of each label that the network is fitted on, at most (about).
PER_LABEL = 3000
#: Bytes of text whose tokens are held at once.
PART = 1 << 20
#: Pairs of neighbours that are held before they are added up (about).
PAIRS = 1 << 21
HIDDEN = 32

#: The upper bit of a hash tells forms from words.
_FORM = U64(1 << 63)
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, form hashes, rows, words per row).

    A word's hash is that of its folded bytes; its form joins capital or not, all capitals, up to two closing non-letter
    bytes, length class, and whether it repeats the word before.
    """
    starts, ends, n = word_spans(raw, offsets)
    rows = np.repeat(np.arange(len(n)), n)
    if not len(starts):
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=U64), rows, n
    h = span_hash(prefix_hash(raw, TABLE_FOLDED), starts, ends)
    length = ends - starts
    first, last = raw[starts], raw[ends - 1]
    second = raw[np.maximum(ends - 2, starts)]
    repeat = np.zeros(len(h), dtype=bool)
    repeat[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    close = np.where(_LETTER[last], 0, last).astype(np.uint64)
    close2 = np.where(_LETTER[second] | (length < 2), 0, second).astype(np.uint64)
    caps = _UPPER[first].astype(np.uint64) + U64(2) * (_UPPER[raw[np.minimum(starts + 1, ends - 1)]] & (length > 1)).astype(np.uint64)
    size = np.minimum(length // 8, 3).astype(np.uint64)
    form = close + close2 * U64(256) + caps * U64(1 << 16) + size * U64(1 << 18) + repeat.astype(np.uint64) * U64(1 << 20)
    return h & ~_FORM, mix(form) | _FORM, rows, n


class Vocabulary:
    """Sorted hashes of words and forms.  Ids: words, one for other words, forms, one for other forms."""

    def __init__(self, hashes: np.ndarray):
        hashes = np.sort(hashes)
        cut = int(np.searchsorted(hashes, _FORM))
        self.words, self.forms = hashes[:cut], hashes[cut:]
        self.size = len(hashes) + 2
        # Sparse index vectors: places and signs from each entry's hash.
        own = np.concatenate([self.words, [U64(0)], self.forms, [_FORM]]).astype(U64)
        h = mix(own[:, None] * U64(NONZERO) + np.arange(NONZERO, dtype=U64)[None] + U64(0xABCDEF))
        self.at, self.sign = (h >> U64(8)).astype(np.int64) % WIDTH, np.where(h & U64(1), 1.0, -1.0)

    def ids(self, words: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for table, h, base in ((self.words, words, 0), (self.forms, forms, len(self.words) + 1)):
            k = np.searchsorted(table, h)
            known = table[np.minimum(k, len(table) - 1)] == h if len(table) else np.zeros(len(h), dtype=bool)
            found.append(base + np.where(known, k, len(table)))
        return found[0], found[1]

    def index_vectors(self) -> np.ndarray:
        out = np.zeros((self.size, WIDTH), dtype=np.float32)
        for k in range(NONZERO):
            np.add.at(out, (np.arange(self.size), self.at[:, k]), self.sign[:, k])
        return out


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The most frequent words and forms of all of `docs` (text); ties fall to the hash.

    A task counts before it ships; WORDS + SHAPES rows reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(back, weights=np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)

        for whole in batches:
            for part in parts(whole, PART):
                words, forms, _, _ = tokens(*text_column(part["text"]))
                held.append(np.unique(np.concatenate([words, forms]), return_counts=True))
                if len(held) == 32:
                    held[:] = [merged()]
        if held:
            keys, n = merged()
            for lo in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + (1 << 16)].view(np.int64)), pa.array(n[lo : lo + (1 << 16)])], names=["hash", "n"])

    counts = docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    # Forms have the sign bit.
    top = lambda rows, most: rows.orderBy(F.desc("n"), "hash").limit(most)
    counts = materialise(counts, "words")
    found = top(counts.where("hash >= 0"), WORDS).union(top(counts.where("hash < 0"), SHAPES)).select("hash").toArrow()
    return Vocabulary(found["hash"].to_numpy().view(U64) if found.num_rows else np.zeros(0, dtype=U64))


class Space:
    """A vocabulary and its context vectors, rows of unit length."""

    def __init__(self, words: Vocabulary, vectors: np.ndarray):
        self.words, self.vectors, self.index = words, vectors, words.index_vectors()

    def pooled(self, column: pa.Array) -> np.ndarray:
        """Mean word vector and mean form vector of each text, and the mean index vector of its forms."""
        words, forms, _, n = tokens(*text_column(column))
        words, forms = self.words.ids(words, forms)
        out = np.zeros((len(n), 3 * WIDTH))
        full = np.flatnonzero(n)
        if not len(full):
            return out
        at = np.concatenate([[0], np.cumsum(n[full])])[:-1]
        for k, (table, ids) in enumerate(((self.vectors, words), (self.vectors, forms), (self.index, forms))):
            for c in range(0, len(full), 256):
                lo, hi = at[c], (at[c + 256] if c + 256 < len(full) else len(words))
                out[full[c : c + 256], k * WIDTH : (k + 1) * WIDTH] = np.add.reduceat(table[ids[lo:hi]], at[c : c + 256] - lo, axis=0, dtype=np.float64)
        out[full] /= n[full][:, None]
        return out


def word_vectors(docs: DataFrame) -> Space:
    """Context vectors of the vocabulary from all of `docs` (text).

    A task keeps one dense sum, whose rows are then added by entry; the result has a fixed size.
    """
    words = vocabulary(docs)

    def rows(total: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(np.abs(total).sum(axis=1))
        lists = pa.ListArray.from_arrays(np.arange(0, len(at) * WIDTH + 1, WIDTH, dtype=np.int32), pa.array(total[at].reshape(-1).astype(np.float32)))
        return pa.RecordBatch.from_arrays([pa.array(at), lists], names=["entry", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(words.size * WIDTH), []

        def pairs(ids, row, reach):
            """Pairs of entries that stand near each other in a row, the earlier one first, as one number each."""
            for step in range(1, min(reach, len(ids) - 1) + 1):
                held.append((ids[:-step] * words.size + ids[step:])[row[step:] == row[:-step]])

        def add():
            """Adds to each entry the index vectors of its neighbours: every pair once, times how often it occurs."""
            pair = np.sort(np.concatenate(held)) if held else np.zeros(0, dtype=np.int64)
            held.clear()
            start = np.flatnonzero(np.diff(pair, prepend=-1))
            n = np.diff(start, append=len(pair))
            left, right = np.divmod(pair[start], words.size)
            for k in range(NONZERO):
                for entry, other in ((left, right), (right, left)):
                    total[:] += np.bincount(entry * WIDTH + words.at[other, k], weights=words.sign[other, k] * n, minlength=len(total))

        for whole in batches:
            for part in parts(whole, PART):
                w, f, row, _ = tokens(*text_column(part["text"]))
                w, f = words.ids(w, f)
                pairs(w, row, REACH)
                pairs(f, row, 1)
                if sum(map(len, held)) >= PAIRS:
                    add()
        add()
        yield rows(total.reshape(-1, WIDTH))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((words.size, WIDTH))
        for b in batches:
            np.add.at(total, b["entry"].to_numpy(), b["v"].flatten().to_numpy().reshape(-1, WIDTH))
        yield rows(total)

    kind = "entry long, v array<float>"
    got = docs.select("text").mapInArrow(run, kind).repartition("entry").mapInArrow(merge, kind).toArrow()
    out = np.zeros((words.size, WIDTH), dtype=np.float32)
    if got.num_rows:
        out[got["entry"].to_numpy()] = got["v"].combine_chunks().flatten().to_numpy().reshape(-1, WIDTH)
    # Sums of whole numbers, exact in any order; then unit rows.
    return Space(words, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9))


class Network:
    """Two layers with tanh between them; inputs standardised; logits divided by the temperature."""

    def __init__(self, w1, b1, w2, b2, mean, scale, heat=1.0):
        self.w1, self.b1, self.w2, self.b2, self.mean, self.scale, self.heat = w1, b1, w2, b2, mean, scale, heat

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2) / self.heat


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 600, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Network:
    """Adam on four fifths of the sample, temperature on the rest; `weight` undoes the balancing of the sample."""
    rng = np.random.default_rng(seed)
    turn = rng.permutation(len(y))
    hold, use = turn[: len(y) // 5], turn[len(y) // 5 :]
    mean, scale = x[use].mean(axis=0), x[use].std(axis=0) + 1e-3
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 2)), np.zeros(2)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        pick = use[rng.integers(0, len(use), min(256, len(use)))]
        z = (x[pick] - mean) / scale
        h = np.tanh(z @ p[0] + p[1])
        d = softmax(h @ p[2] + p[3])
        d[np.arange(len(pick)), y[pick]] -= 1
        d *= (weight[pick] / weight[pick].sum())[:, None]
        back = d @ p[2].T * (1 - h * h)
        grads = [z.T @ back + decay * p[0], back.sum(axis=0), h.T @ d + decay * p[2], d.sum(axis=0)]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(*p, mean, scale)
    if len(hold):
        net.heat = temperature(net.logits(x[hold]), y[hold], weight[hold])
    return net


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[Space, Network | None]:
    """Word vectors of all `docs` and the network from labelled rows; labels with null doc_id or quality are unused."""
    space = word_vectors(docs)
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max((F.col("quality") != 0).cast("int")).alias("y"))
    sample = balanced_sample(marks, "y", per_label, 2)
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # The sample has about two times per_label rows at any size of the input.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "y")), "doc_id")

    def learn(table: pa.Table) -> Network:
        y = table["y"].to_numpy().astype(np.int64)
        x = np.concatenate([space.pooled(part["text"]) for batch in table.select(["text"]).combine_chunks().to_batches() for part in parts(batch, PART)])
        got = np.bincount(y, minlength=2)
        prior = np.array([counts.get(0, 0), counts.get(1, 0)], dtype=float)
        return train(x, y, (prior / np.maximum(got, 1))[y])

    return space, fit_once(rows, ["doc_id", "text", "y"], learn)


def score(docs: DataFrame, model: tuple[Space, Network | None]) -> DataFrame:
    """(doc_id, score) of every row of `docs` (doc_id, text): the probability of label 1.

    Null and empty texts pool to zeros and are scored so; without any label the score is 0.5; texts of any length are
    read whole, repeated rows come back repeated, rows without doc_id too.  Row-local.
    """
    space, net = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, PART):
                got = softmax(net.logits(space.pooled(batch["text"])))[:, 1] if net is not None else np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(got)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: tuple[Space, Network | None], threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` with a score of `threshold` or more, all columns as they are.  Row-local."""
    space, net = model
    if net is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, PART):
                yield batch.filter(pa.array(softmax(net.logits(space.pooled(batch["text"])))[:, 1] >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """Fit on labels whose crc32(doc_id) mod `mod` is not `held`; score every row of `docs`."""
    out = score(docs, fit(docs, labels.where(remainder("doc_id", mod) != held)))
    return out.select("doc_id", (remainder("doc_id", mod) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
