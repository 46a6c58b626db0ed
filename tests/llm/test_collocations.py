"""Collocations against plain counting: nulls, ties, repeated rows, long pieces, crowded prune maps, exact arithmetic."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

from lineflow.llm import collocations, queries

SF = Path("/root/testdata/sf0.1")
SCHEMA = "doc_id long, text string, lang string, score long, bit string"


def expected(rows, least, top, inside=100):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang in f:
        found = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        cover = defaultdict(int)
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    cover[p[i : i + k]] = max(cover[p[i : i + k]], a)
        scored = []
        for p, a in found.items():
            cut = min((1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p)))
            if not (p in cover and 100 * cover[p] >= inside * a):
                scored.append((-cut[0], -a, " ".join(p).encode(), f[lang][p[: cut[1]]], f[lang][p[cut[1] :]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(seed, n=150):
    r = random.Random(seed)
    words = ["the", "Of", "cat", "É", "x1", "a'b", "dog", "über"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ; ", "\x0b", "\x1f "]) for _ in range(r.randrange(1, 60)))
    rows = [(k, text(), r.choice(["en", "en", "en", "fr", None, "und"])) for k in range(n)]
    return rows + [(n, None, "en"), (n, "", None), (n + 1, " . ,\t", "en"), (n + 2, "  \n", "de"), *rows[:20], *[rows[3]] * 50]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("least, top, inside", [(3, 2000, 100), (10, 7, 100), (2, 50, 60), (1, 2000, 100)])
def test_brute_force(spark, least, top, inside):
    rows = corpus(least)
    got = collocations.collocations(frame(spark, rows), least, top, inside).collect()
    assert sorted(map(tuple, got)) == expected(rows, least, top, inside)


def test_crowded_map_and_small_flushes_change_nothing(spark):
    rows = corpus(9)
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows), 4, 100, limits=collocations.Limits(bits=15, flush=50, chunk=300)).collect())) == expected(rows, 4, 100)


def test_long_pieces_are_cut_with_overlap(spark):
    r = random.Random(5)
    rows = [(k, " ".join(r.choice(["aa", "b", "cc", "w" * 70]) for _ in range(400)), "en") for k in range(4)]
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows), 5, 500, limits=collocations.Limits(cut=64)).collect())) == expected(rows, 5, 500)


def test_pieces_are_deduplicated(spark):
    got = collocations.distinct_pieces(frame(spark, [(1, "A  b. a b!c", "en"), (2, "a\tB", "en"), (3, "a b", None)])).collect()
    assert sorted((r["lang"], r["piece"], r["own"], r["m"]) for r in got) == [("en", "a b", 2, 3), ("en", "c", 1, 1), ("und", "a b", 2, 1)]


def test_exact_beyond_64_bits(spark):
    a, n = 3_000_000_000_000, 900_000_000_000_000
    sql = f"select {collocations.weakest_cut('a', 'n', 'parts')} as c from (select {a}L as a, {n}L as n, array(named_struct('k', 1, 'l', {a + 7}L, 'r', {a + 3}L), named_struct('k', 2, 'l', {a}L, 'r', {a + 10}L)) as parts)"
    c = spark.sql(sql).first()["c"]
    want = min((1000 * a * n // (x * y), k, x, y) for k, x, y in ((1, a + 7, a + 3), (2, a, a + 10)))
    assert (c["score"], c["k"], c["l"], c["r"]) == want


def test_empty(spark):
    assert collocations.collocations(frame(spark, []), 1, 10).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None), (2, "one", "en")]), 1, 10).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.OP11)
    got = queries.op11_collocations(spark, str(SF)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
