"""Merkle manifest against plain recursion: unaligned partitions, one-row groups, ties, nulls, tampering."""

import hashlib
import random
import zlib
from pathlib import Path

import duckdb
import pytest

from lineflow.llm import manifest, queries

SF = Path("/root/testdata/sf0.01")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, part int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(r, lower=False):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if lower and r[1] is not None else r[1]
    return sha(*map(field, (r[0], r[3], r[2], r[4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, at):
    for level in tree[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        yield run[: at % 8], run[at % 8 + 1 :]
        at //= 8


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault("0" if r[2] is None else "1" + r[2], []).append(r)
    names = sorted(groups, key=lambda g: g.encode())
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            way = [*siblings(trees[g], i), *siblings(top, k)]
            h = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for left, right in way:
                h = sha(*left, h, *right)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha(*[x for left, right in way for x in (*left, *right)]), h, h == top[-1][0]))
    return out


def rows_of(n, seed):
    r = random.Random(seed)
    langs = ["en"] * 30 + ["de", "fr", None, "é", "EN"]
    rows = [(r.randrange(4 * n), r.choice(["Ab c", "x", "", None, "ÉÀ z", "W" * 500]), r.choice(langs), r.choice(["s", None]), r.choice([1, None])) for _ in range(n)]
    return rows + [(None, "N", "en", None, None), (None, None, None, None, None), (7, "A", "lone", "s", 1), *rows[:3]]


@pytest.mark.parametrize("n, per_part", [(700, 16), (513, 64), (65, 1 << 17), (9, 1)])
def test_brute_force(spark, monkeypatch, n, per_part):
    monkeypatch.setattr(manifest, "PER_PART", per_part)
    rows = rows_of(n, n)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = [tuple(r) for r in manifest.audit(docs).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


def test_node_records(spark, monkeypatch):
    monkeypatch.setattr(manifest, "PER_PART", 20)
    leaves = spark.range(300).selectExpr("'g' as grp", "id as key", "sha2(cast(id as string), 256) as leaf", "cast(null as string) as other")
    tree = levels([hashlib.sha256(str(k).encode()).hexdigest() for k in range(300)])
    want = {(level, at): h for level, nodes in enumerate(tree) if level for at, h in enumerate(nodes)}
    assert {(r["level"], r["at"]): r["digest"] for r in manifest.tree(leaves).nodes().collect()} == want


def test_empty_one_row_and_copies(spark):
    assert manifest.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    one = manifest.audit(spark.createDataFrame([(1, "A", "en", "s", 1, "", 0)], SCHEMA)).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == sha("")
    same = [(5, "t", "en", "s", 1)] * 100
    got = manifest.audit(spark.createDataFrame([(*r, "", 0) for r in same], SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(expected(same), key=str)


def test_long_text(spark):
    rows = [(1, "Äb" * 3_000_000, "en", "s", 6_000_000), (2, "x", "en", "s", 1)]
    got = manifest.audit(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(expected(rows), key=str)


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.OP13)
    got = queries.op13_manifest(spark, str(SF)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
