"""The multi-index: order and completeness of the traversal, recall on the test tables, many dimensions, ids below zero."""

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_llm import classes_of

from lineflow.llm import embeddings

SF = Path("/root/testdata/sf0.1/embeddings.parquet")


@pytest.mark.parametrize("span", [1, 3])
def test_traversal_visits_cells_in_order(span):
    """The heap visits what sorting all pairs of places would, nearest first, and stops at the radius."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8))
    grid = embeddings.Grid((embeddings.codebook(x[:, :4], 12), embeddings.codebook(x[:, 4:], 12)), span)
    home, low = grid.bounds(x[:20])
    first, second = grid.sequences(low)
    for k in range(20):
        for radius in (0.0, 0.1, 1.0, 100.0):
            total = first[k][:, None] + second[k][None]
            want = sorted((total[i, j], i * 12 + j) for i, j in zip(*np.nonzero(total <= radius)))
            got = grid.traverse(first[k], second[k], radius)
            bound = [total[c // 12, c % 12] for c in got]
            assert sorted(got) == sorted(c for _, c in want) and bound == sorted(bound)
        assert grid.traverse(first[k], second[k], 0.0)[:1] == [grid.cells(home)[k]]


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_recall_on_the_test_table(spark):
    table = pq.read_table(SF)
    good = [(i, v) for i, v in zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist()) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.array([v for _, v in good], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # The table has no links at 0.95, so the threshold is one that 1,000 pairs meet.
    every = (x @ x.T)[np.triu_indices(len(x), 1)]
    threshold = float(np.partition(every, -1000)[-1000])
    want = dict(zip([i for i, _ in good], (x @ x.T >= threshold).sum(axis=1) - 1))
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.read.parquet(str(SF)), threshold).collect()}
    assert len(got) == table.num_rows and all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.99 * sum(want.values()) > 100


def test_many_dimensions_and_any_id(spark):
    rng = np.random.default_rng(3)
    rows, at = [], -5
    for dim in (1, 2, 3, 5, 8, 13):
        base = rng.normal(size=(6, dim))
        for v in np.concatenate([base, base * 3, base + 0.01 * rng.normal(size=base.shape)]):
            rows.append((at, v.tolist()))
            at += 1
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    near = lambda a, b: len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.95
    want = classes_of(sorted(unit), near)
    for i in unit:
        assert (got[i]["n_links"], got[i]["component_id"]) == (sum(near(i, j) for j in unit if j != i), want[i])
