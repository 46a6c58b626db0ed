"""Streaming over sorted groups inside a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows with equal integer `keys` from batches sorted by them; holds one batch and one group."""
    held: pa.Table | None = None
    for new in batches:
        held = pa.Table.from_batches([new]) if held is None else pa.concat_tables([held, pa.Table.from_batches([new])])
        if not held.num_rows:
            continue
        held = held.combine_chunks()
        key = np.stack([held[c].to_numpy() for c in keys])
        cut = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1]).tolist()
        whole = held.to_batches(max_chunksize=held.num_rows)[0]
        for lo, hi in zip(cut[:-1], cut[1:]):
            yield whole.slice(lo, hi - lo)
        held = held.slice(cut[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks().to_batches(max_chunksize=held.num_rows)[0]
