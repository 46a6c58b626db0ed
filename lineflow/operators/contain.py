"""Whether texts contain strings: many strings, one document at a time, in time linear in both (J-08, J-09).

A string that is a whole line of the text is found in the set of its lines; the others are looked for together by an
Aho-Corasick automaton, in one pass over the text.  Strings and texts meet once, partitioned by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of strings that one automaton takes; more are looked for in several passes.
AUTOMATON = 16_000_000
#: Up to so many strings are looked for one by one.
FEW = 4


def present(text: str, wanted: set[str]) -> set[str]:
    """The strings of `wanted` that occur in the text."""
    found = wanted & {*text.split("\n"), ""}
    rest = [w for w in wanted - found if len(w) <= len(text)]
    if len(rest) <= FEW:
        return found | {w for w in rest if w in text}
    while rest:
        machine, size = ahocorasick.Automaton(), 0
        while rest and size <= AUTOMATON:
            machine.add_word(w := rest.pop(), w)
            size += len(w)
        machine.make_automaton()
        found.update(w for _, w in machine.iter(text))
    return found


def _marked(batches: Iterator[pa.RecordBatch], n_columns: int) -> Iterator[pa.RecordBatch]:
    """Rows by document, its text (kind 0) before its needles; needles without a text are dropped."""
    doc, text, held = None, None, []

    def done() -> Iterator[pa.RecordBatch]:
        lists = [b["needles"] for b in held]
        wanted = {w for x in lists for w in x.flatten().unique().to_pylist()} - {None}
        found = pa.array(present(text, wanted), pa.string())
        for b, x in zip(held, lists):
            flat = x.flatten()
            mask = pc.if_else(pc.is_valid(flat), pc.is_in(flat, value_set=found), pa.scalar(None, pa.bool_()))
            ends = pc.subtract(x.offsets, x.offsets[0])
            marks = pa.ListArray.from_arrays(ends, mask, mask=pc.is_null(x) if x.null_count else None)
            yield pa.RecordBatch.from_arrays([*[b["row"].field(k) for k in range(n_columns)], marks], names=[*[b["row"].type.field(k).name for k in range(n_columns)], "held"])
        held.clear()

    for batch in batches:
        kinds = batch["kind"].to_pylist()
        heads = [k for k, v in enumerate(kinds) if v == 0]
        for lo, hi in zip([0, *heads], [*heads, len(kinds)]):
            part = batch.slice(lo, hi - lo)
            if part.num_rows and kinds[lo] == 0:
                if held:
                    yield from done()
                doc, text = part["doc"][0], part["text"][0].as_py()
                part = part.slice(1)
            if part.num_rows and doc is not None and text is not None:
                part = part.filter(pc.fill_null(pc.equal(part["doc"], doc), False))
                if part.num_rows:
                    held.append(part)
    if held:
        yield from done()


def held(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of `needles` (doc, needles array<string>, ...) with `held`, per needle whether the document's text has it.

    `texts` (doc, text) has a row per document; needles of a document without one, or with a null text, are left out, a
    null needle is held null, the empty one is held by every text.  One document's text and needles are in memory at a time.
    """
    columns = [c for c in needles.columns if c != "needles"]
    rows = needles.select("doc", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("text"), "needles", F.struct(*columns).alias("row"))
    heads = texts.select("doc", F.lit(0).alias("kind"), "text", F.lit(None).cast("array<string>").alias("needles"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    both = heads.unionByName(rows).repartition("doc").sortWithinPartitions("doc", "kind")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in needles.select(*columns).schema)
    return both.mapInArrow(lambda batches: _marked(batches, len(columns)), f"{fields}, held array<boolean>")


def kept_by_rules(original: DataFrame, clean: DataFrame) -> DataFrame:
    """(doc, pos, line) of `original` that the clean text (doc, text) no longer contains (F-14)."""
    return held(original.select("doc", "pos", "line", F.array("line").alias("needles")), clean).where("not held[0]").select("doc", "pos", "line")
