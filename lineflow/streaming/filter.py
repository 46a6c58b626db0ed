"""The line filter on a stream (R-01 to R-07).

State per document: timestamps seen, previous line, duplicates pending, blank run.  Order differs from the batch chain on
purpose: timestamps go from the third prefixed line on, rules and extra blanks go before duplicates are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineflow.functions import patterns as P
from lineflow.functions.dialect import java

_ANSI, _STAMP = re.compile(P.ANSI), re.compile(P.TIMESTAMP)
_RULE = re.compile(r"^(?:-[- ]*|=[= ]*|_[_ ]*|~[~ ]*)$")


@dataclass
class LineState:
    """What one document's filter remembers (R-03)."""

    stamped: int = 0
    previous: str = ""
    duplicates: int = 0
    started: bool = False
    blanks: int = 0


def marker(n: int) -> str:
    return f"  ... ({n} duplicate line{'' if n == 1 else 's'})"


def process_line(state: LineState, line: str, paths: tuple[tuple[str, str], ...] = ()) -> str | None:
    """The text to emit for a line, or None (R-01); a pending duplicate marker stands before the next different line."""
    line = _ANSI.sub("", line)
    if m := _STAMP.match(line):
        state.stamped += 1
        bare = m[1] + line[m.end() :]
        if state.stamped >= 3 and bare.strip():
            line = bare
    for old, new in paths:
        line = line.replace(old, new)
    line = line.rstrip(" \t")
    t = line.strip()
    if len(t.encode()) >= 10 and _RULE.match(t):
        return None
    state.blanks = state.blanks + 1 if not t else 0
    if state.blanks > 1:
        return None
    if state.started and line == state.previous:
        state.duplicates += 1
        return None
    out = f"{marker(state.duplicates)}\n{line}" if state.duplicates else line
    state.previous, state.duplicates, state.started = line, 0, True
    return out


def flush(state: LineState) -> str | None:
    """The marker still pending at the end of a stream (R-02)."""
    n, state.duplicates = state.duplicates, 0
    return marker(n) if n else None


_STATE = "stamped int, previous string, duplicates int, started boolean, blanks int"


def filter_stream(lines: DataFrame, idle: str | int = 5000) -> DataFrame:
    """(doc_id, seq, out) of a streaming or static relation (doc_id, seq, line, is_stderr).

    Lines of a document are ordered by seq inside a batch; stderr passes as it is; `idle` milliseconds without a line
    flush a pending marker and end the document's state.  Null lines count as empty.
    """
    if not lines.isStreaming:
        return _batch(lines)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = LineState(*state.get) if state.exists else LineState()
        rows: list[tuple[int, int, str]] = []
        if state.hasTimedOut:
            if (out := flush(held)) is not None:
                rows.append((key[0], -1, out))
            state.remove()
        else:
            got = pd.concat(list(frames)).sort_values("seq")
            rows = _emit(held, key[0], zip(got["seq"], got["line"], got["is_stderr"]))
            state.update(tuple(asdict(held).values()))
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(rows, columns=["doc_id", "seq", "out"])

    return lines.groupBy("doc_id").applyInPandasWithState(run, "doc_id long, seq long, out string", _STATE, "append", "ProcessingTimeTimeout")


def _emit(state: LineState, doc_id: int, got: Iterable[tuple[int, str | None, bool]]) -> list[tuple[int, int, str]]:
    rows = []
    for seq, line, err in got:
        out = (line or "") if err else process_line(state, line or "")
        if out is not None:
            rows.append((doc_id, int(seq), out))
    return rows


def _batch(lines: DataFrame) -> DataFrame:
    """The static form: Spark sorts, and a task streams through its documents holding one state, never a whole document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, LineState()

        def pack(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "seq", "out"])

        for b in batches:
            rows: list[tuple[int, int, str]] = []
            for doc, group in groupby(zip(*[b[c].to_pylist() for c in ("doc_id", "seq", "line", "is_stderr")]), key=lambda r: r[0]):
                if doc != here:
                    if (out := flush(state)) is not None:
                        rows.append((here, -1, out))
                    here, state = doc, LineState()
                rows += _emit(state, doc, [r[1:] for r in group])
            yield pack(rows)
        if (out := flush(state)) is not None:
            yield pack([(here, -1, out)])

    rows = lines.selectExpr("cast(doc_id as bigint) doc_id", "cast(seq as bigint) seq", "line", "is_stderr")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "seq").mapInArrow(run, "doc_id long, seq long, out string")


def with_volume(lines: DataFrame, out: DataFrame, name: str = "volume") -> tuple[DataFrame, DataFrame]:
    """Both relations with observed metrics: bytes and lines that came and went, each line with its LF (R-04).  A listener
    reads them for every micro-batch as `name`_raw and `name`_clean."""
    size = lambda c: F.coalesce(F.sum(F.octet_length(F.coalesce(c, F.lit(""))) + 1), F.lit(0)).alias("bytes")
    return lines.observe(f"{name}_raw", size("line"), F.count(F.lit(1)).alias("lines")), out.observe(f"{name}_clean", size("out"), F.count(F.lit(1)).alias("lines"))


def changed_files(events: DataFrame, quiet: str = "500 milliseconds", late: str = "2 seconds") -> DataFrame:
    """Bursts of file events (root, path, ts) of each watched root that end after a quiet time: one rerun each (R-05)."""
    bursts = events.withWatermark("ts", late).groupBy("root", F.session_window("ts", quiet).alias("burst"))
    return bursts.agg(F.collect_set("path").alias("paths"), F.count(F.lit(1)).alias("events"))


_REQUEST = "id long, type string, since_us long"
_HISTORY = "us long, raw_key string, max_lines long, no_trunc boolean"


def recent_requests(requests: DataFrame, window_us: int = 120_000_000) -> DataFrame:
    """(id, type, since_us) of a stream (id, ts, tool, key, raw_key, max_lines, no_trunc): what repeats the newest earlier
    request of the same tool and key within the window, as an escalation, exactly or similarly (R-06).

    The newest request of a tool and key is all that later ones look at; it goes once the watermark is past its window.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows: list[tuple[int, str, int]] = []
        if state.hasTimedOut:
            state.remove()
        else:
            last = state.get if state.exists else None
            got = pd.concat(list(frames)).assign(us=lambda g: g["ts"].astype("datetime64[us]").astype("int64")).sort_values(["us", "id"])
            for r in got.itertuples():
                if last is not None and r.us - last[0] <= window_us:
                    more = (r.no_trunc and not last[3]) or (last[2] > 0 and r.max_lines > last[2])
                    rows.append((r.id, "escalation" if more else "exact" if r.raw_key == last[1] else "similar", r.us - last[0]))
                # A late request leaves a newer one in place.
                if last is None or r.us >= last[0]:
                    last = (r.us, r.raw_key, r.max_lines, bool(r.no_trunc))
            state.update(last)
            state.setTimeoutTimestamp(max(last[0] + window_us, state.getCurrentWatermarkMs() * 1000) // 1000 + 1)
        yield pd.DataFrame(rows, columns=["id", "type", "since_us"])

    late = requests.withWatermark("ts", f"{window_us} microseconds")
    return late.groupBy("tool", "key").applyInPandasWithState(run, _REQUEST, _HISTORY, "append", "EventTimeTimeout")


def saved_by_command(events: DataFrame) -> DataFrame:
    """Running totals behind the dashboard, for a complete-mode sink (R-07)."""
    return events.groupBy("cmd_type").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("raw_tokens") - F.col("clean_tokens")).alias("saved"))


#: The stamp pattern in its JVM form, for streams that only need it counted.
STAMP_JVM = java(P.TIMESTAMP)
