"""Every registered query of the command-output engine with its SQL twin.

A query is one builder `f(dialect) -> SQL`; Spark runs its Spark form, the DuckDB form is the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lineflow.functions.dialect import Dialect, Duck, Spark
from lineflow.session import line_counter

Builder = Callable[[Dialect], str]

BUILDERS: dict[str, Builder] = {}
#: Spark forms that plan better than the declaration of the same name, which stays their oracle.
SPARK_FORMS: dict[str, Callable[[Spark], str]] = {}
#: Queries with sequential state; some have an oracle that recursion or a self-join can express on small tables.
NATIVE: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
NATIVE_ORACLES: dict[str, str] = {}


def query(name: str) -> Callable[[Builder], Builder]:
    def add(builder: Builder) -> Builder:
        BUILDERS[name] = builder
        return builder

    return add


def spark_form(name: str):
    def add(builder: Callable[[Spark], str]):
        SPARK_FORMS[name] = builder
        return builder

    return add


def native(name: str):
    def add(f):
        NATIVE[name] = f
        return f

    return add


def _load() -> None:
    from lineflow.plans import queries_analytics, queries_commands, queries_native, queries_text  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["a14_saved_by_source"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    run = lambda builder: lambda spark, sf_dir: spark.sql(builder(Spark(sf_dir, line_counter(spark, sf_dir))))
    return {name: run(builder) for name, builder in (BUILDERS | SPARK_FORMS).items()} | NATIVE


def oracles() -> dict[str, str]:
    _load()
    return {name: builder(Duck()) for name, builder in BUILDERS.items()} | NATIVE_ORACLES
