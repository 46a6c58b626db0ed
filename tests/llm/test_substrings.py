"""Substring removal: hot triggers, steps that split a trigger, shared ids, long texts."""

import random
from collections import Counter

import pytest
from test_llm import brute_removal, prose

from lineflow.llm import substrings


def digests(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, ranges int").repartition(parts)
    return [(r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in substrings.digest(substrings.deduplicate(df)).collect()]


@pytest.mark.parametrize("phrases", [3, 50, 4096])
def test_hot_line_and_split_steps(spark, monkeypatch, phrases):
    """A line in every text gives one trigger many phrases; steps that split it lose and add nothing."""
    monkeypatch.setattr(substrings, "PHRASES", phrases)
    monkeypatch.setattr(substrings, "CHUNK", 3000)
    r = random.Random(4)
    line = "a very common line of some seventy bytes that stands in all of the texts"
    rows = [(i, f"{prose(i, 30)} {line} {prose(r.randrange(8), r.randrange(1, 40))}") for i in range(60)]
    rows += [(100 + i, rows[i % 7][1][i:]) for i in range(30)] + [(200, prose(9, 900)), (201, "x" + prose(9, 900)), (202, "z" * 4000)]
    r.shuffle(rows)
    assert dict(digests(spark, rows)) == brute_removal(rows)


def test_texts_that_share_an_id(spark):
    """Equal rows are one document; different texts of one id are documents of their own."""
    a, b = prose(1, 60), prose(2, 80)
    got = Counter(digests(spark, [(1, a), (1, a), (1, b), (1, a + " " + b), (2, a), (None, a), (3, None)]))
    removed = sorted((k, v[1]) for k, v in got.elements())
    assert len(removed) == 6 and removed[-2:] == [(2, len(a)), (3, 0)]
    # Of the texts of id 1, what stands first in hash order stays whole: all of a and b is kept once.
    once = {v for k, v in got if k == 1}
    assert len(once) == 3 and sum(n - gone for n, gone, *_ in once) in range(len(a) + len(b), len(a) + len(b) + 200)
