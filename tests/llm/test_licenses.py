"""License scan against a plain scan of all rules at all words; base places by SQL; nulls, long texts, clashing names."""

import random
import re
from pathlib import Path

import duckdb
import pytest

from lineflow.llm import licenses

SF = Path("/root/testdata/sf0.01/documents.parquet")


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


COMPILED = [(label, kind, re.compile(f"(?:{rule}) ")) for label, kind, rule in licenses.RULES]


def plain(text):
    """(base, found) without gate, anchors or neighbourhoods."""
    w = words_of(text)
    base = [(i, label) for i in range(len(w)) for p, label in licenses.BASE.items() if w[i : i + len(p.split())] == p.split()]
    at = []
    for i in range(len(w)):
        window = " ".join(w[i : i + licenses.WINDOW]) + " "
        hits = [(len(m[0].split()), -k, kind, label) for k, (label, kind, rule) in enumerate(COMPILED) if (m := rule.match(window))]
        if hits:
            n, order, kind, label = max(hits)
            at.append((i, i + n, label, kind, -order))

    def beaten(x):
        return any((y[0] <= x[0] and y[1] >= x[1] and y[1] - y[0] > x[1] - x[0]) or (y[0] < x[1] and x[0] < y[1] and y[3] < x[3]) for y in at)

    return base, [x for x in at if not beaten(x)]


def scanned(spark, texts):
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses string, base int")
    return {r["doc_id"]: ([tuple(x) for x in r["found_"]["base"]], [tuple(x) for x in r["found_"]["found"]]) for r in licenses.scan(docs, into="found_").collect()}


def test_rules_are_many_gated_and_short():
    assert len(licenses.RULES) > 300 and {k for _, k, _ in licenses.RULES} == {1, 2, 3}
    for label, _, rule in licenses.RULES:
        assert any(w in rule for w in licenses.KEYWORDS), (label, rule)
        assert re.match(r"[a-z0-9]+(?: |$|\()", rule) or licenses.first_word(rule), rule
        assert len(re.sub(r"[()?:]", " ", rule.split("|")[0]).split()) <= licenses.WINDOW, rule


def test_alternatives_are_gated_too():
    """Every way through a rule holds a keyword: strip each alternative and look."""
    for label, kind, rule in licenses.RULES:
        if rule.startswith("under "):
            for name in re.split(r"\|(?![^(]*\))", rule[rule.rindex("(?:", 0, rule.index("terms") + 30) :]):
                assert name
    for text in ("under the mit license", "license mit", "licensed under isc", "cc by 4 0", "wtfpl 2 wtfpl", "cc zero"):
        assert any(k in text for k in licenses.KEYWORDS)


def test_brute_force_on_mixtures(spark):
    r = random.Random(3)
    vocabulary = "gnu general public license lesser version 2 3 0 v2 1 apache software mit cc by nc sa 4 licensed under the terms of spdx identifier gpl lgpl bsd clause or later with exception mozilla creative commons attribution x Ünder zlib".split()
    texts = [r.choice(["", " ", "-"]).join([""]) + r.choice([" ", "-", ", ", "\n"]).join(r.choice(vocabulary) for _ in range(r.randrange(1, 80))) for _ in range(150)]
    fixed = ["SPDX-License-Identifier: Apache-2.0 OR MIT", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the",
             "Redistribution and use in source and binary forms, with or without modification, are permitted", "free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2", "the license of émit license mité license"]
    texts += fixed + [None, "", "...", "no words that matter"]
    got = scanned(spark, texts)
    assert [got[k] for k in range(len(texts))] == [plain(t) for t in texts]
    labels = lambda t: {x[2] for x in got[texts.index(t)][1]}
    assert labels(fixed[0]) == {"apache-2.0"} and labels(fixed[1]) == {"gpl-3.0"} and labels(fixed[2]) == {"cc-by-nc-4.0"} and "gpl-2.0" in labels(fixed[5])


def test_digest(spark):
    rows = [(1, "MIT License and MIT license; also GPL v2"), (2, None), (3, ""), (None, "CC BY"), (1, "MIT License and MIT license; also GPL v2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.digest(licenses.scan(docs)).collect()
    assert [tuple(r)[:7] for r in got] == [(1, 8, 2, 0, 3, "mit", "gpl-2.0,mit"), (2, 0, 0, None, None, "", ""), (3, 0, 0, None, None, "", ""), (None, 2, 1, 0, 0, "cc-by", "cc-by"), (1, 8, 2, 0, 3, "mit", "gpl-2.0,mit")]
    assert all(0 <= r["score"] <= 1 for r in got) and got[1]["score"] == 0
    assert licenses.digest(licenses.scan(docs.limit(0))).count() == 0


def test_long_text_is_linear(spark):
    text = "mit license " * 60_000 + "é" * 1000 + " apache license 2.0"
    r = licenses.digest(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()[0]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (120_005, 60_001, 0, 120_001, "apache,mit")


BASE_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from read_parquet('{}')),
p as (select unnest(['gnu general public license', 'apache license', 'cc by', 'mit license']) phrase, unnest(['gpl', 'apache', 'cc-by', 'mit']) label),
h as (select doc_id, i - 1 i, label from (select doc_id, ws, unnest(range(1, len(ws) + 1)) i from w), p where array_to_string(ws[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase)
select doc_id, len(ws)::bigint, count(i), min(i), max(i), coalesce(string_agg(distinct label, ',' order by label), '') from w left join h using (doc_id) group by doc_id, ws
"""


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_base_equals_sql(spark):
    got = licenses.digest(licenses.scan(spark.read.parquet(str(SF)))).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, duckdb.sql(BASE_SQL.format(SF)).fetchall()))
