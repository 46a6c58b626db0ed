"""Operator 9: language identification.

Sparse multinomial logistic regression on TF-IDF weighted character n-grams (1 to 3 code points of letters and gaps,
hashed), trained with follow-the-regularised-leader and elastic-net penalties, then temperature calibration on a part of
the sample that the weights have not seen.  Document frequencies come from every training text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineflow.llm._bytes import parts
from lineflow.llm._fit import remainder, softmax, temperature
from lineflow.llm._shared import materialise

#: Hashed feature space, 2**FEATURES; sample bound per language; languages of a block, about; blocks of a Python stage.
FEATURES, PER_LANG, BLOCK, STAGE = 16, 1000, 32, 16
#: Up to this many languages their counts are broadcast, beyond it they are joined by a shuffle.
FEW = 10_000
#: Rows of other blocks in a block's sample, in units of PER_LANG.
OTHERS = 4
#: Bytes of text whose n-grams are held at once; code points of one text that are.
PART, SLICE = 1 << 18, 1 << 18
ORDERS = (1, 2, 3)
SCALE = 20.0
_GAP = 32


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Code point -> folded letter, or a gap for anything that is no letter."""
    import sys
    import unicodedata

    table = np.full(sys.maxunicode + 1, _GAP, dtype=np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _features(points: np.ndarray, rows: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(row << FEATURES | feature) of the n-grams that end at `first` or later, each once, and how often it stands there.

    `points` are folded letters and single gaps; an n-gram stays inside a row, and a gap alone is none.
    """
    found = []
    h = np.zeros(len(points), dtype=np.uint64)
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint64(0x9E3779B97F4A7C15)) ^ ((points[n - 1 :] + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(29)
        inside = rows[:m] == rows[n - 1 :]
        inside[: max(0, first - n + 1)] = False
        if n == 1:
            inside &= points != _GAP
        found.append((rows[:m][inside] << FEATURES) | (h[inside] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - FEATURES)).astype(np.int64))
    return np.unique(np.concatenate(found) if found else np.zeros(0, dtype=np.int64), return_counts=True)


def _collapsed(points: np.ndarray, rows: np.ndarray, after_gap: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded letters and gaps, of neighbouring gaps the first; their rows; rows of the letters alone."""
    letters = _folded()[points]
    gap = letters == _GAP
    keep = ~gap
    keep[1:] |= ~gap[:-1] | (rows[1:] != rows[:-1])
    keep[:1] |= not after_gap
    return letters[keep].astype(np.uint64), rows[keep], rows[~gap]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _long(text: str, row: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The keys, counts and letters of one text, SLICE code points at a time behind the last two letters before them."""
    total, n = np.zeros(1 << FEATURES, dtype=np.int64), 0
    carried = np.zeros(0, dtype=np.uint64)
    for at in range(0, len(text) + 1, SLICE):
        points = _points(("" if at else " ") + text[at : at + SLICE] + (" " if at + SLICE > len(text) else ""))
        letters, _, alone = _collapsed(points, np.zeros(len(points), dtype=np.int64), len(carried) > 0 and carried[-1] == _GAP)
        first, n = len(carried), n + len(alone)
        carried = np.concatenate([carried, letters])
        keys, counts = _features(carried, np.zeros(len(carried), dtype=np.int64), first)
        total[keys] += counts
        carried = carried[-2:]
    at = np.flatnonzero(total)
    return (row << FEATURES) | at, total[at], n


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row << FEATURES | feature in ascending order, how often each stands in its row, letters per row).

    Gaps are single and stand at both ends of a text.  Of a text of any length, SLICE code points are held in numpy at once.
    """
    texts = ["" if t is None else t for t in texts.to_pylist()]
    if any(len(t) > SLICE for t in texts):
        each = [_long(t, k) for k, t in enumerate(texts)]
        return np.concatenate([e[0] for e in each]), np.concatenate([e[1] for e in each]), np.array([e[2] for e in each])
    rows = np.repeat(np.arange(len(texts)), np.array([len(t) for t in texts], dtype=np.int64) + 2)
    points, rows, letters = _collapsed(_points("".join(f" {t} " for t in texts)), rows, False)
    return *_features(points, rows, 0), np.bincount(letters, minlength=len(texts))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts have each feature, and how many texts there are; one dense array a task, then a sum by feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << FEATURES, dtype=np.int64), 0
        for whole in batches:
            for part in parts(whole, PART):
                texts = part["text"]
                keys, _, _ = grams(texts)
                df += np.bincount(keys & ((1 << FEATURES) - 1), minlength=len(df))
                n += len(texts)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["feature", "df"])

    rows = docs.select("text").mapInArrow(run, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros((1 << FEATURES) + 1, dtype=np.float64)
    df[rows["feature"].to_numpy()] = rows["df"].to_numpy()
    return df[:-1], int(df[-1])


class Model:
    """One block: weights (features x languages, and a last column for all languages of other blocks where there are any),
    inverse document frequencies, languages and temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, idf: np.ndarray, heat: float = 1.0):
        self.langs, self.heat = langs, heat
        self.table = (weights * idf[:, None] * SCALE).astype(np.float32)

    def logits(self, keys: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        """Of `n` rows with these n-grams (see `grams`)."""
        r, f = keys >> FEATURES, keys & ((1 << FEATURES) - 1)
        z = np.stack([np.bincount(r, weights=self.table[f, c] * counts, minlength=n) for c in range(self.table.shape[1])], axis=1)
        return z / np.maximum(np.bincount(r, weights=counts, minlength=n), 1)[:, None] / self.heat


def train(table: pa.Table, langs: list[str], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 2, seed: int = 7) -> Model:
    """FTRL-proximal over one block's sample (text, lang, weight), four fifths for the weights and one fifth for the
    temperature, whose rows count by `weight`, the rows they were drawn from.  Any lang outside `langs` is one class."""
    where = {x: k for k, x in enumerate(langs)}
    y = np.array([where.get(x, len(langs)) for x in table["lang"].to_pylist()])
    classes = max(len(langs), int(y.max(initial=0)) + 1)
    drawn = table["weight"].to_numpy()
    docs = []
    for batch in table.select(["text"]).combine_chunks().to_batches():
        for part in parts(batch, PART):
            keys, count, _ = grams(part["text"])
            at = np.searchsorted(keys >> FEATURES, np.arange(part.num_rows + 1))
            keys = (keys & ((1 << FEATURES) - 1)).astype(np.int32)
            docs += [(keys[a:b], count[a:b].astype(np.float32)) for a, b in zip(at[:-1], at[1:])]
    rng = np.random.default_rng(seed)
    turn = rng.permutation(len(y))
    hold = turn[: len(y) // 5]
    z, n = np.zeros((2, 1 << FEATURES, classes))

    def weights(i):
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for d in rng.permutation(turn[len(hold) :]):
            i, c = docs[d]
            if not len(i):
                continue
            x = c / c.sum() * idf[i] * SCALE
            w = weights(i)
            p = softmax((x @ w)[None])[0]
            p[y[d]] -= 1
            g = x[:, None] * p[None]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    model = Model(langs, weights(slice(None)), idf)
    if len(hold):
        logits = np.stack([c @ model.table[i] / max(c.sum(), 1) for i, c in (docs[d] for d in hold)])
        model.heat = temperature(logits, y[hold], drawn[hold])
    return model


def fit(docs: DataFrame, per_lang: int = PER_LANG, block: int = BLOCK) -> list[Model]:
    """Fit on rows of `docs` (doc_id, text, lang) with text and lang, about `per_lang` of each language; none give no model.

    Every value of lang is learned.  Languages fall into blocks of about `block` by their hash, one model each, so that a
    task's memory depends on `block` and `per_lang` alone; a block sees a sample of the other blocks as one more class.
    Models come through the driver, 8 MB a block: their size follows the number of languages, not of texts.
    """
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    df, n = document_frequencies(rows)
    if n == 0:
        return []
    idf = np.log((1 + n) / (1 + df)) + 0.1
    counts = materialise(rows.groupBy(F.col("lang").alias("lang_")).agg(F.count(F.lit(1)).alias("n_")), "langs")
    langs, drawn = counts.agg(F.count(F.lit(1)), F.sum(F.least("n_", F.lit(per_lang)))).first()
    blocks = -(-langs // block)
    uniform = lambda *by: F.xxhash64(*by).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    sample = rows.join(F.broadcast(counts) if langs <= FEW else counts.hint("merge"), F.col("lang") == F.col("lang_"))
    sample = sample.where(uniform("doc_id", F.lit("fit")) * F.col("n_") < per_lang)
    home = F.pmod(F.xxhash64("lang"), F.lit(blocks)).cast("int")
    rate = min(1.0, OTHERS * per_lang / drawn)
    sample = sample.withColumn("home", home).withColumn("weight", F.greatest(F.col("n_") / per_lang, F.lit(1.0)))
    meets = lambda b: (b == F.col("home")) | (uniform("doc_id", "lang", b) < rate)
    sample = sample.select("doc_id", "text", "lang", "weight", "home", F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), meets)).alias("block"))
    sample = sample.withColumn("weight", F.when(F.col("home") == F.col("block"), F.col("weight")).otherwise(F.col("weight") / rate))

    def learn(table: pa.Table) -> pa.Table:
        # Arrival order differs between runs; the model must not.
        table = table.sort_by([("doc_id", "ascending"), ("lang", "ascending")])
        own = sorted({x for x, h, b in zip(*(table[c].to_pylist() for c in ("lang", "home", "block"))) if h == b})
        model = train(table, own, idf) if own else None
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "model": pa.array([pickle.dumps(model)], pa.binary())})

    fitted = sample.groupBy("block").applyInArrow(learn, "block int, model binary").toLocalIterator()
    models = [(r["block"], pickle.loads(bytes(r["model"]))) for r in fitted]
    return [m for _, m in sorted(models, key=lambda m: m[0]) if m is not None]


def identify(docs: DataFrame, models: list[Model]) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of `docs` (doc_id, text).

    A block's probabilities include that of all other blocks; the score is the best one's share of all languages', ties
    fall to the smaller language.  Null text, text without a letter of any alphabet, and everything if there is no model
    get `und` with score 0; texts of any length are read whole, repeated rows come back repeated.  Row-local; a Python
    stage holds STAGE blocks.
    """

    def scored(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in parts(whole, PART):
                    n = batch.num_rows
                    keys, counts, letters = grams(batch["text"])
                    lang = np.array(batch["lang_pred"].to_pylist(), dtype=object)
                    best, mass = (batch[c].to_numpy(zero_copy_only=False).copy() for c in ("best", "mass"))
                    for model in held.value:
                        p = softmax(model.logits(keys, counts, n))[:, : len(model.langs)]
                        at = p.argmax(axis=1)
                        top, name = p[np.arange(n), at], np.array(model.langs, dtype=object)[at]
                        better = (letters > 0) & ((top > best) | ((top == best) & (name < lang)))
                        lang[better], best[better] = name[better], top[better]
                        mass += p.sum(axis=1)
                    kept = {"doc_id": batch["doc_id"], "text": batch["text"], "lang_pred": pa.array(lang, pa.string()), "best": pa.array(best), "mass": pa.array(mass)}
                    yield pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept))

        return run

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.lit("und").alias("lang_pred"), F.lit(-1.0).alias("best"), F.lit(0.0).alias("mass"))
    for at in range(0, len(models), STAGE):
        held = docs.sparkSession.sparkContext.broadcast(models[at : at + STAGE])
        rows = rows.mapInArrow(scored(held), "doc_id long, text string, lang_pred string, best double, mass double")
    return rows.select("doc_id", "lang_pred", F.when((F.col("best") > 0) & (F.col("mass") > 0), F.least(F.col("best") / F.col("mass"), F.lit(1.0))).otherwise(0.0).alias("score"))


def predict_all(docs: DataFrame, mod: int = 4, held: int = 2, block: int = BLOCK) -> DataFrame:
    """Fit on the rows whose crc32(doc_id) mod `mod` is not `held`, predict every row."""
    out = identify(docs, fit(docs.where(remainder("doc_id", mod) != held), block=block))
    return out.select("doc_id", (remainder("doc_id", mod) == held).alias("held_out"), "lang_pred", "score")
