"""Every registered query of the engine against its SQL twin on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lineflow.plans import catalog

SF = Path("/root/testdata/sf0.001")
TABLES = "customer documents events orders part lineitem conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_matches_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(catalog.oracles()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(v) for _, v in sorted(zip(names, row))) for row in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(catalog.NATIVE))
def test_native_query_runs(spark, name):
    assert catalog.queries()[name](spark, str(SF)).count() > 0


def test_line_windows_share_one_exchange(spark):
    """Window operators over one line relation plan a single exchange."""
    from lineflow.functions.dialect import Spark
    from lineflow.operators import generic
    from lineflow.plans import views

    d = Spark(str(SF))
    plan = spark.sql(f"select * from {generic.strip_timestamps(d, views.log_lines(d) + ' v')} q")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
