"""Functions of one text as steps (U-01), and histories with real sequential state (DT-04, the exact LRU of A-20).

A history streams through one task in order, a tool at a time: the state of one tool can't be split.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

def per_document(df: DataFrame, function: Callable[[str], str], text: str = "text") -> DataFrame:
    """`df` with `text` replaced by function(text); null stays null."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if t is None else function(t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def _in_order(df: DataFrame, columns: str, result: str, start: Callable[[], Callable[[dict], bool]]) -> DataFrame:
    """`columns` (tool, us, id, ...) and the boolean `result`: a tool's rows pass a function with memory, made by `start`, in
    order of time and id.

    Spark sorts, and a task streams through its tools holding one of their memories, never a tool's history.
    """
    names = columns.split(", ")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, decide = object(), None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["tool"] != here:
                    here, decide = row["tool"], start()
                out.append(decide(row))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*names, result])

    return df.select(*names).repartition("tool").sortWithinPartitions("tool", "us", "id").mapInArrow(run, f"{fields}, {result} boolean")


def rate_limit(df: DataFrame, per_minute: int, burst: int) -> DataFrame:
    """(tool, us, id) with `allowed`: a token bucket per tool that refills per_minute / 60 a second up to burst (DT-04)."""

    def bucket() -> Callable[[dict], bool]:
        left, last = float(burst), None

        def allowed(row: dict) -> bool:
            nonlocal left, last
            left = min(float(burst), left + (0 if last is None else (row["us"] - last) / 1e6 * per_minute / 60))
            last = row["us"]
            ok = left >= 1
            left -= ok
            return ok

        return allowed

    return _in_order(df, "tool, us, id", "allowed", bucket)


def lru_hits(df: DataFrame, capacity: int = 128) -> DataFrame:
    """(tool, us, id, key) with `hit` under an exact least-recently-used cache per tool; capacity 0 never hits (A-20)."""

    def cache() -> Callable[[dict], bool]:
        held: OrderedDict[str, bool] = OrderedDict()

        def hit(row: dict) -> bool:
            found = row["key"] in held
            held[row["key"]] = True
            held.move_to_end(row["key"])
            if len(held) > capacity:
                held.popitem(last=False)
            return found

        return hit

    return _in_order(df, "tool, us, id, key", "hit", cache)
