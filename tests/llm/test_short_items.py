"""Benchmark items too short for edits are looked for exactly."""

import random
import re

from lineflow.llm import decontaminate


def test_short_items_brute_force(spark):
    r = random.Random(6)
    words = ["who", "wrote", "Faust", "2+2", "é", "a", "capital", "of", "Peru?"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 4)))) for i in range(30)] + [(90, ""), (91, None), (92, " who \t WROTE "), (93, "who wrote"), (94, "?")]
    docs = [(i, r.choice(["", "x", "."]).join([" "] * 2).join(r.choice([*words, "whoever", "rewrote", "fausté"]) for _ in range(r.randrange(0, 12)))) for i in range(60)] + [(98, None), (99, "")]
    norm = lambda t: re.sub(r"[\x20\t-\r]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")).strip(" ")
    want = {}
    for i, t in docs:
        t = norm(t)
        for k, x in items:
            x = norm(x)
            for m in re.finditer(f"(?=({re.escape(x)}))", t) if 0 < len(x.encode()) < 24 else ():
                a, b = m.span(1)
                inside = lambda p: 0 < p < len(t) and t[p - 1].isalnum() and t[p].isalnum()
                if not inside(a) and not inside(b):
                    want.setdefault((i, k), (0, len(x.encode()), len(t[:b].encode())))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["edits"], x["item_chars"], x["doc_end"]) for x in decontaminate.contaminated(table, bench).collect()}
    assert got == want and len(want) > 100
    left = {x["doc_id"] for x in decontaminate.drop_contaminated(table, bench).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in want}
