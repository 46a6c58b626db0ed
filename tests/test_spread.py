"""Lines are dealt over tasks by how many there are: a task's share, and so its memory, doesn't grow with the tables."""

from collections import Counter
from pathlib import Path

import pytest

from lineflow.functions import dialect
from lineflow.plans import catalog

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test data")


@pytest.mark.parametrize("name", ["f13_traces_documents", "f13_traces", "c02_find_documents", "t01_truncate_30", "t02_escalate_hint"])
def test_tasks_grow_with_lines(spark, monkeypatch, name):
    query = catalog.queries()[name]
    plain = query(spark, str(SF))
    few = plain.rdd.getNumPartitions()
    monkeypatch.setattr(dialect, "TASK_LINES", 40)
    dealt = query(spark, str(SF))
    assert few <= dialect.FEW_TASKS < dealt.rdd.getNumPartitions()
    assert Counter(map(tuple, dealt.collect())) == Counter(map(tuple, plain.collect()))


def test_assembled_chain_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(dialect, "TASK_LINES", 40)
    plan = catalog.queries()["u01_chain_generic"](spark, str(SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc" in plan


def test_line_operators_are_not_dealt(spark, monkeypatch):
    monkeypatch.setattr(dialect, "TASK_LINES", 1)
    for name in ("c03_git_documents", "c05_ls", "c10_make"):
        plan = catalog.queries()[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name
