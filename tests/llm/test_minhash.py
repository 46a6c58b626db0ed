"""Near-duplicates: buckets of several blocks, chains through one bucket, repeated and long rows."""

import random
from itertools import combinations

import pytest
from test_llm import classes_of, prose, shingles

from lineflow.llm import minhash


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    linked = set(links)
    return classes_of(sorted(sets), lambda a, b: (a, b) in linked)


@pytest.mark.parametrize("block, pivots", [(4, 1), (8, 3), (256, 16)])
def test_groups_beyond_one_block(spark, monkeypatch, block, pivots):
    """Groups of near copies, chains of drifting copies and loners that share buckets: components equal brute force."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PIVOTS", pivots)
    r = random.Random(6)
    rows, base, drift = [], prose(5, 200).split(), prose(5, 200).split()
    for i in range(40):
        rows.append((i, " ".join([*base[: i * 4], f"edit{i}", *base[i * 4 + 1 :]])))
        drift = [*drift[: i * 4], f"drift{i}", *drift[i * 4 + 1 :]]
        rows.append((100 + i, " ".join(drift)))
        far = list(base)
        for k in r.sample(range(200), 5 + i % 4):
            far[k] = f"far{i}x{k}"
        rows.append((200 + i, " ".join(far)))
    rows += [(300 + i, prose(400 + i, 30)) for i in range(20)] + [(400, "a b"), (401, "A  b"), (402, prose(1, 9000)), (403, prose(1, 9000) + " end")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, component int").repartition(5)
    got = minhash.near_duplicates(df).collect()
    want = brute(rows)
    assert len({want[i] for i, _ in rows}) > 20 and {x["doc_id"]: x["component_id"] for x in got} == want


def test_repeated_rows_and_missing_ids(spark):
    a, b = prose(1, 40), prose(2, 40)
    got = minhash.near_duplicates(spark.createDataFrame([(5, a), (5, a), (3, a), (None, a), (7, b), (9, None), (9, "")], "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["component_id"], x["kept"]) for x in got) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True), (9, 9, True), (9, 9, True)]


def test_words_built_to_collide_stay_apart(spark):
    """A word of 1,024 letters and its complement have one hash under any polynomial modulo 2**64."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"{word} one two three four five six"), (4, f"{other} one two three four five six"), (5, f"{word} x {other}"), (6, f"{other} x {word}")]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert all(got[k]["kept"] and got[k]["component_id"] == k for k, _ in rows) and got[3]["n_shingles"] == 3
