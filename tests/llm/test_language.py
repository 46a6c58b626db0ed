"""N-grams and logits of operator 9 against brute force, blocks of languages, texts longer than a slice."""

import random

import numpy as np
import pyarrow as pa

from lineflow.llm import language

M = (1 << 64) - 1


def brute(text):
    """Count of each feature and number of letters, one n-gram at a time."""
    folded = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else 32 for c in f" {text or ''} "]
    line = [c for k, c in enumerate(folded) if c != 32 or k == 0 or folded[k - 1] != 32]
    seen = {}
    for n in language.ORDERS:
        for at in range(len(line) - n + 1):
            gram = line[at : at + n]
            if gram == [32]:
                continue
            h = 0
            for k, c in enumerate(gram):
                h = (h * 0x9E3779B97F4A7C15 & M) ^ ((c + k + 1) * 0xC2B2AE3D27D4EB4F & M)
                h ^= h >> 29
            f = (h * 0xD6E8FEB86659FD93 & M) >> (64 - language.FEATURES)
            seen[f] = seen.get(f, 0) + 1
    return seen, sum(c != 32 for c in folded)


TEXTS = ["Ab  c", None, "", " . ", "x", "  lead and trail  ", "Straße 12 été", "a1b2", "ab" * 40 + " -- " + "cd " * 9]


def compare(texts):
    keys, counts, letters = language.grams(pa.array(texts, pa.string()))
    assert (np.diff(keys) > 0).all()
    for row, text in enumerate(texts):
        mine = keys >> language.FEATURES == row
        want, n = brute(text)
        assert dict(zip((keys[mine] & ((1 << language.FEATURES) - 1)).tolist(), counts[mine].tolist())) == want and letters[row] == n


def test_grams(monkeypatch):
    compare(TEXTS)
    for cut in (1, 2, 3, 7):
        monkeypatch.setattr(language, "SLICE", cut)
        compare(TEXTS)


def test_logits():
    rng = np.random.default_rng(1)
    idf = rng.random(1 << language.FEATURES) + 0.1
    model = language.Model(["a", "b"], rng.normal(size=(1 << language.FEATURES, 3)), idf, 1.7)
    keys, counts, _ = language.grams(pa.array(TEXTS, pa.string()))
    got = model.logits(keys, counts, len(TEXTS))
    for row, text in enumerate(TEXTS):
        seen, _ = brute(text)
        want = sum((model.table[f].astype(float) * c for f, c in seen.items()), np.zeros(3)) / max(1, sum(seen.values())) / 1.7
        assert np.allclose(got[row], want)


def test_blocks_learn_every_language(spark):
    """Seven languages in blocks of about two are told apart like in one block."""
    r = random.Random(3)
    alphabet = {k: "".join(chr(0x61 + (5 * k + j) % 26) for j in range(5)) for k in range(7)}
    rows = [(i, " ".join("".join(r.choice(alphabet[i % 7]) for _ in range(5)) for _ in range(30)), f"l{i % 7}") for i in range(420)]
    docs = spark.createDataFrame([*rows, (None, "abc", None), (7000, "", "l1"), (7000, "", "l1")], "doc_id long, text string, lang string")
    for block in (2, 32):
        got = language.predict_all(docs, block=block).collect()
        assert len(got) == 423 and all(0 <= g["score"] <= 1 for g in got)
        pred = {g["doc_id"]: g for g in got}
        held = [x for x in rows if pred[x[0]]["held_out"]]
        assert sum(pred[x[0]]["lang_pred"] == x[2] for x in held) >= 0.97 * len(held) > 50
        assert pred[7000]["lang_pred"] == "und"


def test_long_text_is_cut(spark):
    docs = spark.createDataFrame([(k, ("abc " if k % 2 else "xyz ") * (500_000 if k < 3 else 30), "p" if k % 2 else "q") for k in range(60)], "doc_id long, text string, lang string")
    assert all(g["lang_pred"] == ("p" if g["doc_id"] % 2 else "q") for g in language.predict_all(docs).collect())
