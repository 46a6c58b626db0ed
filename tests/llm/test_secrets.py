"""Secret spans against SQL, random strings of every alphabet, words and digests that are none, long texts."""

import hashlib
import random
import string
from pathlib import Path

import duckdb
import numpy as np
import pytest

from lineflow.llm import secrets

SF = Path("/root/testdata/sf0.01/documents.parquet")

#: Base counts by plain regular expressions.
BASE = r"""
select doc_id, len(list_filter(regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) n_assign,
    len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) n_access,
    len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) n_hex
from (select doc_id, coalesce(text, '') t from read_parquet('{}'))
"""


def token_spans(text):
    b = text.encode()
    _, start, end = secrets.long_runs(np.frombuffer(b, dtype=np.uint8), np.array([0, len(b)]))
    spans = secrets.all_spans(text, secrets.base_spans(text), list(zip(start.tolist(), end.tolist())), secrets.VOCABULARY, secrets.RATIO)
    return [text[x.start : x.end] for x in spans if x.kind == "token"]


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_base_counts_equal_sql(spark):
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"]) for r in secrets.digest(secrets.find_secrets(spark.read.parquet(str(SF)))).collect()}
    want = {r[0]: tuple(r[1:]) for r in duckdb.sql(BASE.format(SF)).fetchall()}
    assert got == want and all(any(v[k] for v in want.values()) for k in (0, 2))


@pytest.mark.parametrize("alphabet, n, least", [(string.ascii_letters, 20, 190), (string.ascii_lowercase, 28, 160), (string.ascii_uppercase, 24, 185), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32, 195), (string.ascii_letters + string.digits, 16, 180)])
def test_random_strings_of_any_alphabet(alphabet, n, least):
    r = random.Random(7)
    drawn = ["".join(r.choices(alphabet, k=n)) for _ in range(200)]
    assert sum(token_spans(f"key {s} end") == [s] for s in drawn) >= least


def test_given_keys_are_found():
    for key in ("aZkQmXpLvBnRtYwEsDfG1", "MFZWIZLTOQ5DCMRTGQ2TMNZYHE3DAMJS"):
        assert token_spans(f"x {key} y") == [key]


def test_words_and_digests_are_none():
    words = "Geschwindigkeitsbegrenzung internationalization getUserAccountInformation IllegalArgumentException anticonstitutionnellement THISISALLUPPERCASETEXT somelongvariablenamewithoutbreaks documentation2024/internationalization"
    digests = "sha1:MFZWIZLTOQ5DCMRTGQ2TMNZYHE3DAMJS WARC-Payload-Digest:sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ DA39A3EE5E6B4B0D3255BFEF95601890AFD80709 6f1e2d3c-a1b2-4c3d-9e8f-44445555666a 2024-01-15T10-20-30"
    for x in (words + " " + digests).split():
        assert token_spans(x) == [], x


def test_long_texts_and_missing_values(spark):
    long = "é words " * 600_000
    rows = [(1, long + "token=abcdefgh aZ9kQ2mX7pL4vB8nR1tY6wE3 " + long), (None, "deadbeef" * 3), (2, None), (2, ""), (3, "a" * 3_000_000)]
    got = secrets.digest(secrets.find_secrets(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string"))).collect()
    spans = sorted((r["doc_id"] or 0, r["spans"]) for r in got)
    n = len(long)
    assert spans[0] == (0, "hex:0:24") and spans[1] == (1, f"assign:{n}:{n + 14},token:{n + 15}:{n + 39}") and spans[2:4] == [(2, ""), (2, "")] and spans[4][0] == 3
    assert {r["base_sha256"] for r in got if r["doc_id"] == 2} == {hashlib.sha256(b"").hexdigest()}
