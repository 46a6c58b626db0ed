"""Decontamination against brute force: every item length, phrases that all items share, hits in slices, long texts."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from test_llm import brute_distance, prose

from lineflow.llm import decontaminate


def norm(t):
    return re.sub(r"\s+", " ", (t or "").lower()).strip()


def edited(r, text, n):
    t = list(text)
    for _ in range(n):
        k = r.randrange(len(t))
        t[k : k + 1] = r.choice(["", r.choice("xyz"), t[k] + r.choice("xyz")]) or [""]
    return "".join(t)


@pytest.mark.parametrize("common, hits", [(64, 1 << 20), (3, 1 << 20), (3, 7)])
def test_every_length_and_shared_phrases(monkeypatch, common, hits):
    """Items of 24 to 60 characters, those of 30 and 31 with three edits too; common grams only loosen the filter."""
    monkeypatch.setattr(decontaminate, "COMMON", common)
    monkeypatch.setattr(decontaminate, "HITS", hits)
    r = random.Random(2)
    draw = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n)).replace("  ", "a ")[: n - 1] + "z"
    items = [draw(n).strip().rjust(n, "q") for n in range(24, 61)] + [f"question: {draw(40)}? answer: {draw(20)}" for _ in range(12)]
    items = [norm(x) for x in items]
    docs = []
    for k, x in enumerate(items):
        for extra in (0, 1, 2):
            docs.append(f"{draw(30)} {edited(r, x, max(0, len(x) // 10 + extra - 1))} {draw(30)}")
    docs += ["", "question: answer:", "q" * 400, " ".join(items[:20])]
    work = decontaminate.Items(np.arange(len(items)), pa.array(items), 0.1, 24)
    row, item, edits, _ = work.found(pa.array(docs))
    got = {(int(a), int(b)): int(c) for a, b, c in zip(row, item, edits)}
    want = {(i, k): n for i, t in enumerate(docs) for k, x in enumerate(items) if (n := brute_distance(x, norm(t))) <= len(x) // 10}
    assert got == want and len(want) > 80
    assert any(len(items[k]) in (30, 31) and n == 3 for (_, k), n in want.items()) or not any(len(items[k]) in (30, 31) for _, k in want)


def test_three_edits_in_thirty_characters():
    x = "abcdefghijklmnopqrstuvwxyz0123"
    t = "some words " + x[:7] + "#" + x[8:15] + "#" + x[16:23] + "#" + x[24:] + " more"
    row, item, edits, _ = decontaminate.Items(np.array([5]), pa.array([x]), 0.1, 24).found(pa.array([t]))
    assert (row.tolist(), item.tolist(), edits.tolist()) == ([0], [0], [3])


def test_long_text_and_missing_ids(spark):
    item = prose(77, 14)
    long = "filler words go on " * 200_000
    docs = spark.createDataFrame([(1, long + item), (None, "x " + item), (2, long), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (None, "filler words go on filler words")], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["edits"]) for r in got) == [(0, 1, 0), (1, 1, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()) == [2, 3]
