"""Shared pieces of the trained operators: keyed splits, bounded samples, temperature calibration."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str | Column, mod: int) -> Column:
    """crc32 of doc_id as text, modulo `mod`; null where doc_id is null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % mod


def balanced_sample(rows: DataFrame, label: str, per_label: int, most: int, seed: str = "fit") -> DataFrame:
    """About `per_label` rows of each of the `most` most frequent labels, chosen by a keyed hash of doc_id; labels with
    fewer rows come whole.  Ties in frequency fall to the label.

    The counts of those labels, `most` rows at the most, are broadcast; nothing that grows with the table is.
    """
    counts = rows.groupBy(F.col(label).alias("label_")).agg(F.count(F.lit(1)).alias("n_")).orderBy(F.desc("n_"), "label_").limit(most)
    place = (F.xxhash64(F.col("doc_id"), F.lit(seed)).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))).cast("double")
    return rows.join(F.broadcast(counts), F.col(label) == F.col("label_")).where(place * F.col("n_") < per_label).select(*rows.columns)


def fit_once(sample: DataFrame, columns: list[str], train: Callable[[pa.Table], object]) -> object:
    """Train on the bounded sample in one task and return the model, whose size the parameters bound."""
    schema = sample.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            # Arrival order differs between runs; the model must not.
            table = pa.Table.from_batches(got)
            table = table.sort_by([("doc_id", "ascending")])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(table))])], names=["model"])

    row = schema.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(row["model"])) if row is not None else None


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The divisor of the logits with the least cross-entropy on a calibration part, by golden section.

    `weight` undoes a balanced sample, so that the part stands for the rows it was drawn from.  Targets are smoothed by
    1 / (rows + 2), so that a part without errors doesn't ask for certainty.
    """
    if len(y) == 0:
        return 1.0
    slack = 1 / (len(y) + 2)
    target = np.full(logits.shape, slack / max(1, logits.shape[1] - 1))
    target[np.arange(len(y)), y] = 1 - slack

    def loss(log_t: float) -> float:
        return -float(np.average((target * np.log(softmax(logits / np.exp(log_t)) + 1e-300)).sum(axis=1), weights=weight))

    lo, hi, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))
