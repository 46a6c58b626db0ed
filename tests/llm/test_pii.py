"""Pseudonyms against a plain Feistel network, and texts that recursive patterns or quadratic loops would not survive."""

import hashlib
import random
import re
import time
from datetime import date, timedelta

from test_llm import luhn

from lineflow.llm import pii

KEY = "k"


def digest(tag, turn, value, width=12):
    return hashlib.sha256(f"{KEY}|{tag}|{turn}|{value}".encode()).hexdigest()[:width]


def plain(left, right, a, b, tag):
    for i in range(8):
        if i % 2 == 0:
            left = (left + int(digest(tag, i, right), 16)) % a
        else:
            right = (right + int(digest(tag, i, left), 16)) % b
    return left, right


def plain_text(text, tag):
    def shift(x, hexes):
        out = []
        for i, c in enumerate(x):
            by = int(hexes[i % 32 * 2 : i % 32 * 2 + 2], 16)
            for base, size in ((48, 10), (97, 26), (65, 26)):
                if base <= ord(c) < base + size:
                    c = chr((ord(c) - base + by) % size + base)
                    break
            out.append(c)
        return "".join(out)

    half = len(text) // 2
    left, right = text[:half], text[half:]
    for i in range(8):
        if i % 2 == 0:
            left = shift(left, digest(tag, i, right, 64))
        else:
            right = shift(right, digest(tag, i, left, 64))
    return left + right


def plain_value(kind, m):
    if kind == "email":
        local, domain = m.split("@")
        return f"{plain_text(local, 'email')}@{domain}"
    if kind == "ip":
        o = [int(x) for x in m.split(".")]
        left, right = plain(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        left, right = plain(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
        return f"{left + (2 if left >= 665 else 1):03}-{right // 9999 + 1:02}-{right % 9999 + 1:04}"
    if kind == "date":
        y, mo, d = map(int, m.split("-"))
        n = (date(y, mo, d) - date(1900, 1, 1)).days
        left, right = plain(n // 4297, n % 4297, 17, 4297, "date")
        return str(date(1900, 1, 1) + timedelta(left * 4297 + right))
    if kind == "phone":
        a, b, c = m.split("-")
        low = [0 if x < "200" else 200 for x in (a, b)]
        size = [200 if x < "200" else 800 for x in (a, b)]
        left, right = plain((int(a) - low[0]) * size[1] + int(b) - low[1], int(c), size[0] * size[1], 10_000, "phone")
        return f"{left // size[1] + low[0]:03}-{left % size[1] + low[1]:03}-{right:04}"
    n = len(m) - 2
    a = n // 2
    left, right = plain(int(m[1 : 1 + a]), int(m[1 + a : -1]), 10**a, 10 ** (n - a), "card")
    body = f"{m[0]}{left:0{a}}{right:0{n - a}}"
    return next(body + c for c in "0123456789" if luhn(body + c))


def test_against_a_plain_network(spark):
    r = random.Random(3)
    drawn = []
    for i in range(60):
        digits = "".join(r.choices("0123456789", k=r.choice([12, 14, 15, 18])))
        drawn += [("email", "".join(r.choices("aZ09._%+-", k=r.randrange(1, 12))) + "@x.example.org"), ("ip", ".".join(str(r.randrange(256)) for _ in range(4)))]
        drawn += [("ssn", f"{r.choice([1, 665, 667, 899, r.randrange(1, 660)]):03}-{r.randrange(1, 100):02}-{r.randrange(1, 10_000):04}"), ("date", str(date(1900, 1, 1) + timedelta(r.randrange(73049))))]
        drawn += [("phone", f"{r.randrange(1000):03}-{r.randrange(1000):03}-{r.randrange(10_000):04}"), ("card", next(digits + c for c in "0123456789" if luhn(digits + c)))]
    df = spark.createDataFrame([(i, m) for i, (_, m) in enumerate(drawn)], "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in pii.pseudonymise(df, KEY).collect()}
    for i, (kind, m) in enumerate(drawn):
        assert got[i] == plain_value(kind, m), (kind, m)
    again = {x["doc_id"]: x["text"] for x in pii.pseudonymise(df, "other").collect()}
    assert sum(got[i] == again[i] for i in got) < len(got) // 10


def test_dates_keep_their_notation(spark):
    rows = [(0, "2020-02-29"), (1, "2020/02/29"), (2, "29.02.2020"), (3, "02/29/2020"), (4, "30/02/2020"), (5, "13/13/2020")]
    got = {x["doc_id"]: x["text"] for x in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    y, m, d = got[0].split("-")
    assert [got[i] for i in range(1, 6)] == [f"{y}/{m}/{d}", f"{d}.{m}.{y}", f"{m}/{d}/{y}", rows[4][1], rows[5][1]]


def test_long_texts(spark):
    """200,000 labels, a local part of a million characters, ten megabytes with many values."""
    mails = " ".join(f"user.{i}@mail.example.com" for i in range(20_000))
    rows = [(0, "x@" + "a." * 200_000 + "com"), (1, "q" * 1_000_000 + "@example.com"), (2, mails + " " + "plain words " * 800_000), (3, "1." * 300_000), (4, "x@" + "a-" * 200_000), (5, "a@" * 200_000), (6, "4" * 500_000), (7, "a@b..com c@d.e1 f@g.hh.")]
    began = time.time()
    got = {x["doc_id"]: x for x in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), KEY).collect()}
    assert time.time() - began < 120
    assert got[0]["text"].endswith("@" + "a." * 200_000 + "com") and len(got[0]["pii"]) <= 1
    assert re.fullmatch("[a-z]{1000000}@example.com", got[1]["text"]) and got[1]["text"] != rows[1][1]
    assert len(got[2]["pii"]) == 20_000 and len(got[2]["text"]) == len(rows[2][1])
    assert all(got[i]["text"] == rows[i][1] for i in (3, 4, 5, 6))
    assert re.fullmatch(r"a@b\.\.com c@d\.e1 [a-z]@g\.hh\.", got[7]["text"])


def test_pipeline_stages_spare_clashing_columns(spark, tmp_path):
    """Columns called pii, taken and copies stay as they are."""
    import corpus_pipeline

    rows = [(i if i % 4 else None, f"call 269-555-{i:04} now please " * 3, "a", i, i, "own") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int, Copies int, pii string")
    got = corpus_pipeline.pii_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and {r["pii"] for r in got.collect()} == {"own"} and not any("555-0007" in r["text"] for r in got.collect())
    mixed = corpus_pipeline.mix_stage(spark, docs, str(tmp_path))
    assert mixed.columns == [*docs.columns, "taken_", "copies_"]
    assert all(r["taken_"] == r["copies_"] * 12 and r["Copies"] == r["taken"] for r in mixed.collect()) and mixed.count() > 10
