"""Functions of a user in SQL (U-05): a chain of line steps as a table function, a fold as an aggregate.

Spark partitions, sorts and streams; the user's code sees one line or value at a time.  Columns are checked when a query is
analysed, not in a task.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, DataType, IntegralType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class LineStep(Protocol):
    """What a step remembers of one document; a chain makes a new one for each."""

    def line(self, line: str) -> Iterable[str]:
        """The lines that go on when this one came."""

    def end(self) -> Iterable[str]:
        """The lines that go on when the document is over."""


def each(function: Callable[[str], Iterable[str]]) -> Callable[[], LineStep]:
    """A step without memory."""

    class Each:
        def line(self, line: str) -> Iterable[str]:
            return function(line)

        def end(self) -> Iterable[str]:
            return ()

    return Each


def _named(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"{name!r} is no name of a SQL function")
    return name


def _table(argument: AnalyzeArgument) -> StructType:
    if not argument.isTable:
        raise ValueError("the argument must be a table: table(rows)")
    return argument.dataType


def _column(table: StructType, name: str, kinds: tuple[type, ...], says: str) -> DataType:
    found = [f.dataType for f in table.fields if f.name.lower() == name]
    if len(found) != 1:
        raise ValueError(f"the table needs one column {name}, it has {len(found)}")
    if not isinstance(found[0], kinds):
        raise ValueError(f"column {name} must be {says}, it is {found[0].simpleString()}")
    return found[0]


def register_chain(spark: SparkSession, name: str, *steps: Callable[[], LineStep]) -> None:
    """`select * from name(table(lines))` gives (doc, pos, line) of a relation (doc, pos, line), each document's lines in
    order of pos sent through `steps`.

    The relation is partitioned by doc and sorted by pos; a task streams its documents and holds what one document's steps
    hold.  Other columns are left out.  A null line is an empty one, a null doc is a document, rows without pos come first,
    the order of rows with one pos is open; lines are numbered from 0 again.  An empty relation gives no rows.
    A missing, repeated or wrongly typed column fails the analysis.
    """
    if not steps or not all(map(callable, steps)):
        raise TypeError("a chain needs steps")

    class Chain:
        @staticmethod
        def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
            doc = _column(_table(lines), "doc", (IntegralType, StringType), "an integer or a string")
            _column(lines.dataType, "pos", (IntegralType,), "an integer")
            _column(lines.dataType, "line", (StringType,), "a string")
            schema = StructType([StructField("doc", doc), StructField("pos", LongType()), StructField("line", StringType())])
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("doc")], orderBy=[OrderingColumn("pos")])

        def __init__(self):
            self.held, self.doc, self.n = [step() for step in steps], None, 0

        def _through(self, lines: Iterable[str], at: int) -> Iterator[str]:
            if at == len(self.held):
                yield from lines
                return
            for line in lines:
                yield from self._through(self.held[at].line(line), at + 1)

        def _numbered(self, lines: Iterator[str]):
            for line in lines:
                yield self.doc, self.n, line
                self.n += 1

        def eval(self, row):
            self.doc = row["doc"]
            yield from self._numbered(self._through(("" if row["line"] is None else row["line"],), 0))

        def terminate(self):
            for at, step in enumerate(self.held):
                yield from self._numbered(self._through(step.end(), at + 1))

    spark.udtf.register(_named(name), udtf(Chain))


def register_fold(spark: SparkSession, name: str, takes: DataType, returns: DataType, start: Callable[[], Any], step: Callable[[Any, Any], Any], merge: Callable[[Any, Any], Any], finish: Callable[[Any], Any], most: int = 10_000) -> None:
    """An aggregate in two SQL functions, so that a hot key is folded where its rows are before anything is shuffled:

    `select * from name(table(select * from name_parts(table(rows))))` gives (key, value) for a relation (key, value): value
    is finish of the states of that key, each step(... step(start(), v1) ..., vn) over some of its values, put together by
    `merge` in no certain order.  States must be picklable.

    `name_parts` holds up to `most` keys in a task and hands them on when there are more; `name` streams the states of a
    key.  Null values are left out; a key with none gives finish(start()); a null key is a key; an empty relation gives no
    rows.  Keys are integers or strings, `takes` is the type of the values; columns that are missing, repeated or of
    another type fail the analysis.
    """
    keys = (IntegralType, StringType)
    state = lambda key: StructType([StructField("key", key), StructField("state", BinaryType())])

    class Parts:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            key = _column(_table(rows), "key", keys, "an integer or a string")
            _column(rows.dataType, "value", (type(takes),), takes.simpleString())
            return AnalyzeResult(schema=state(key))

        def __init__(self):
            self.held = {}

        def eval(self, row):
            key, value = row["key"], row["value"]
            if key not in self.held:
                if len(self.held) >= most:
                    yield from self.terminate()
                self.held[key] = start()
            if value is not None:
                self.held[key] = step(self.held[key], value)

        def terminate(self):
            for key, got in self.held.items():
                yield key, pickle.dumps(got)
            self.held = {}

    class Whole:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            key = _column(_table(rows), "key", keys, "an integer or a string")
            _column(rows.dataType, "state", (BinaryType,), "what the parts give")
            return AnalyzeResult(schema=StructType([StructField("key", key), StructField("value", returns)]), partitionBy=[PartitioningColumn("key")])

        def __init__(self):
            self.key, self.got, self.some = None, None, False

        def eval(self, row):
            got = pickle.loads(bytes(row["state"]))
            self.key, self.got, self.some = row["key"], merge(self.got, got) if self.some else got, True

        def terminate(self):
            if self.some:
                yield self.key, finish(self.got)

    spark.udtf.register(_named(name), udtf(Whole))
    spark.udtf.register(_named(f"{name}_parts"), udtf(Parts))
