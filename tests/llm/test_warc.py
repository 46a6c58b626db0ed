"""The capture index: keys that span blocks and directory parts, missing keys, many files."""

import random
from collections import Counter

import pytest

from lineflow.llm import warc


@pytest.mark.parametrize("block, top", [(3, 2), (5, 1), (3000, 1000)])
def test_keys_across_blocks(spark, monkeypatch, block, top):
    """A third of the pages under one url, equal payloads, urls without a host; every capture comes back once."""
    monkeypatch.setattr(warc, "BLOCK", block)
    monkeypatch.setattr(warc, "TOP", top)
    monkeypatch.setattr(warc, "JOINED", 900)
    r = random.Random(8)
    pages = [(i, "http://hot.example.com/x" if i % 3 == 0 else f"https://h{r.randrange(20)}.example.org/p{r.randrange(30)}" if i % 3 == 1 else r.choice([None, "", "plain", "//a", "é://ü/ö"]), r.choice(["", None, "<p>same</p>", f"<p>{i}</p>" * 20])) for i in range(150)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, file string").repartition(6)
    index = warc.build_index(spark, warc.write_archives(df))
    got = warc.read_records(warc.find(spark, index, warc.keys_of(df)), ("url", "payload")).collect()
    assert Counter(x["page_id"] for x in got) == Counter(p[0] for p in pages)
    html = {i: (h or "").encode() for i, _, h in pages}
    first = {}
    for i in sorted(html):
        first.setdefault(html[i], i)
    assert all(x["payload"] == (html[x["page_id"]] if first[html[x["page_id"]]] == x["page_id"] else None) for x in got)
    assert all(x["refers_to"] == (None if x["record_type"] == "response" else first[html[x["page_id"]]]) for x in got)
    for url in ("http://hot.example.com/x", "https://h3.example.org/p1", "http://hot.example.com/", "aaa", "zzz://zzz", "http://0/"):
        want = sorted(p[0] for p in pages if warc.reversed_host_key(p[1]) == warc.reversed_host_key(url))
        assert sorted(x["page_id"] for x in warc.lookup(spark, index, url)) == want


def test_rows_without_id_and_repeats(spark):
    df = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (2, None, None)], "page_id long, url string, html string")
    got = sorted((x["page_id"], x["record_type"], x["payload_bytes"]) for x in warc.captures(df).collect())
    assert got == [(1, "response", 1), (1, "response", 1), (2, "response", 0)]
