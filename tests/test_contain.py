"""Containment against `in`: whole lines, nested needles, nulls, documents without text, growth of one long document."""

import random
import time

import pytest

from lineflow.operators import contain


def test_present_is_in():
    r = random.Random(2)
    for _ in range(200):
        text = "\n".join("".join(r.choice("abé ") for _ in range(r.randrange(0, 12))) for _ in range(r.randrange(1, 9)))
        wanted = {"".join(r.choice("abé ") for _ in range(r.randrange(0, 6))) for _ in range(r.randrange(1, 40))}
        assert contain.present(text, wanted) == {w for w in wanted if w in text}


def test_several_automata(monkeypatch):
    monkeypatch.setattr(contain, "AUTOMATON", 5)
    wanted = {f"w{k}" for k in range(50)}
    assert contain.present("xw1y w22z w4", wanted) == {w for w in wanted if w in "xw1y w22z w4"}


@pytest.mark.parametrize("key", ["long", "string"])
def test_rows(spark, key):
    texts = spark.createDataFrame([(1, "alpha\nbeta gamma"), (2, ""), (3, None), (5, "x")], "doc long, text string").selectExpr(f"cast(doc as {key}) as doc", "text")
    rows = [(1, 0, ["alpha", "ta ga", "", None, "no"], "c"), (1, 1, [], "c"), (1, 2, None, None), (2, 0, ["", "a"], "c"), (3, 0, ["a"], "c"), (4, 0, ["a"], "c"), (None, 0, ["a"], "c"), (5, 7, ["x", "xx"], "c"), (5, 7, ["x", "xx"], "c")]
    needles = spark.createDataFrame(rows, "doc long, pos long, needles array<string>, text string").selectExpr(f"cast(doc as {key}) as doc", "pos", "needles", "text")
    got = contain.held(needles, texts)
    assert got.columns == ["doc", "pos", "text", "held"]
    want = [(1, 0, [True, True, True, None, False]), (1, 1, []), (1, 2, None), (2, 0, [True, False]), (5, 7, [True, False]), (5, 7, [True, False])]
    assert sorted((int(r["doc"]), r["pos"], r["held"]) for r in got.collect()) == want


def test_long_document_is_linear(spark):
    """Lines of which none stands whole in the text: the case that was quadratic."""

    def took(n):
        lines = spark.range(n).selectExpr("1L as doc", "id as pos", "concat('error ', id, ' in unit ', id * 7919 % 1000003) as line").repartition(4).cache()
        clean = lines.where("pos % 3 <> 0").groupBy("doc").agg({"line": "collect_list"}).selectExpr("doc", "concat('> ', array_join(`collect_list(line)`, '\\n> ')) as text").cache()
        lines.count(), clean.count()
        began = time.perf_counter()
        found = contain.kept_by_rules(lines, clean).count()
        spent = time.perf_counter() - began
        # A line may be the beginning of a longer one.
        assert n // 3 * 0.9 <= found <= n // 3 + 1
        return spent

    took(500)
    small, large = took(5_000), took(80_000)
    assert large < 16 * max(small, 0.5) * 1.5
