"""Quality: held-out accuracy on the given labels, the vocabulary against plain counts, long texts."""

import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from test_llm import frame, prose

from lineflow.llm import quality
from lineflow.llm._bytes import text_column

SF = Path("/root/testdata/sf0.1")


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).where("held_out").join(labels.where("quality is not null"), "doc_id").select("score", "predicted", "quality").toPandas()
    one, zero = got[got.quality == 1], got[got.quality == 0]
    ranks = got.score.rank()
    auc = (ranks[got.quality == 1].sum() - len(one) * (len(one) + 1) / 2) / (len(one) * len(zero))
    assert len(got) > 500 and auc > 0.99 and (one.predicted == 1).mean() > 0.98 and (zero.predicted == 0).mean() > 0.9


def test_vocabulary_has_the_most_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(quality, "WORDS", 50)
    texts = [prose(i, 200) for i in range(30)] + [None, ""]
    found = quality.vocabulary(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]))
    counts = Counter(w for t in texts for w in re.findall(r"\S+", t or ""))
    least = sorted(counts.values())[-50]
    hashes = {w: quality.tokens(*text_column(pa.array([w])))[0][0] for w in counts}
    assert len(set(hashes.values())) == len(counts) and len(found.words) == 50
    words = {w for w, h in hashes.items() if h in found.words}
    assert {w for w, n in counts.items() if n > least} <= words and all(counts[w] >= least for w in words)
    ids, _ = found.ids(np.array([hashes[w] for w in words] + [np.uint64(12345)]), np.zeros(0, dtype=np.uint64))
    assert len(set(ids.tolist())) == 51 and ids[-1] == 50


def test_long_text_and_clashing_columns(spark):
    good = [(i, prose(i, 50), None, None) for i in range(100)] + [(900, prose(1, 300_000), None, None), (None, prose(2, 50), None, None)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 50).split()), None, None) for i in range(60)]
    docs = frame(spark, good + bad).withColumnRenamed("component_id", "score")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good[:100]] + [(r[0], 0, 0) for r in bad] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(good) + len(bad) and {r["predicted"] for r in got if r["doc_id"] in (900, None)} == {1}


def test_temperature_of_a_balanced_sample():
    """Weights stand for repeated rows."""
    import numpy as np

    from lineflow.llm._fit import temperature

    r = np.random.default_rng(1)
    z = r.normal(0, 3, (400, 2))
    y = (z[:, 1] + r.normal(0, np.where(z[:, 1] > 0, 6, 1)) > z[:, 0]).astype(int)
    weight = np.where(y == 0, 5, 1)
    some, all_ = temperature(z, y, weight), temperature(np.repeat(z, weight, axis=0), np.repeat(y, weight))
    assert abs(some / all_ - 1) < 0.05 < abs(some / temperature(z, y) - 1)
    assert temperature(z, y, np.full(400, 3.0)) == pytest.approx(temperature(z, y))


@pytest.mark.parametrize("pairs", [1, 1 << 21])
def test_context_vectors_against_plain_sums(spark, monkeypatch, pairs):
    monkeypatch.setattr(quality, "PAIRS", pairs)
    texts = [prose(i, 40) for i in range(12)] + [None, "", "one", "two words"]
    space = quality.word_vectors(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]))
    index, want = space.words.index_vectors(), np.zeros((space.words.size, quality.WIDTH))
    for t in texts:
        words, forms, _, _ = quality.tokens(*text_column(pa.array([t], pa.string())))
        for ids, reach in zip(space.words.ids(words, forms), (quality.REACH, 1)):
            for i, a in enumerate(ids):
                for j, b in enumerate(ids):
                    if 0 < abs(i - j) <= reach:
                        want[a] += index[b]
    want = want.astype(np.float32)
    assert np.array_equal(space.vectors, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9))
