"""The stages near_dedup and decontam against brute force, whole rows compared."""

import random

from test_llm import DOCS, brute_distance, classes_of, prose, shingles

import corpus_pipeline


def fixture(spark):
    r = random.Random(12)
    item = prose(900, 12)
    rows = [(i, prose(i, 60), "en", "ab"[i % 2], i) for i in range(12)]
    for i in range(48):
        words = rows[i % 12][1].split()
        for _ in range(r.randrange(0, 5)):
            words[r.randrange(len(words))] = f"changed{r.randrange(9)}"
        rows.append((100 + i, " ".join(words), "en", "a", i))
    for i in range(20):
        t = list(item)
        for _ in range(r.randrange(0, 9)):
            t[r.randrange(len(t))] = r.choice("xyz ")
        rows.append((200 + i, prose(300 + i, 15) + " " + "".join(t), "en", "b", i))
    rows += [(300, None, "en", "a", 0), (301, "", None, None, 1), (None, rows[0][1], "en", "a", 2)]
    return rows, item, spark.createDataFrame(rows, DOCS + ", n_chars long")


def same(got, want):
    return sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_near_dedup_stage(spark, tmp_path):
    rows, _, docs = fixture(spark)
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    of = classes_of(sorted(sets), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    want = [r for r in rows if r[0] is None or of[r[0]] == r[0]]
    assert same(corpus_pipeline.near_dedup_stage(spark, docs, str(tmp_path)), want) and 30 < len(want) < len(rows) - 10


def test_decontam_stage(spark, tmp_path):
    rows, item, docs = fixture(spark)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    most = min(int(len(item) * 0.1), (len(item) - 8) // 8)
    want = [r for r in rows if brute_distance(item, " ".join((r[1] or "").split())) > most]
    assert same(corpus_pipeline.decontam_stage(spark, docs, str(tmp_path)), want) and len(rows) - 20 < len(want) < len(rows)
