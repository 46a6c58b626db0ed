"""Operator 10: benchmark decontamination by q-gram lemma filtering.

An occurrence of an item of m characters with at most k edits keeps at least (m - q + 1) - k * q of its q-grams, all on
diagonals within k of each other.  Shared q-grams are counted in diagonal bands of width 2 (k + 1) that overlap by half,
so one band holds them all; bands that reach the bound are verified by banded alignment.  q is Q, or less for an item so
short that the bound would be 0.  Q-grams of more than COMMON items, such as those of a phrase that opens every question,
are not counted and the bound of their items is lowered by their number, but by no more than half: the filter passes
more, the alignment decides as before.  Items under LEAST characters are looked for without edits, from word border to
word border.

Characters are the UTF-8 bytes of a text with A-Z folded and every run of space and 0x09-0x0D made one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineflow.llm._bytes import SPACE, U64, parts, text_column

Q = 8
#: Bytes of documents handled at once, longer ones alone.
PART = 1 << 20
#: Share of an item's characters that may be edited; items under LEAST characters must occur exactly.
RATE, LEAST = 0.1, 24
#: Items that a q-gram may have before it counts as common; q-gram hits expanded at once.
COMMON, HITS = 64, 1 << 20
#: Item text compared in one pass over the documents, which bounds what a pass sends to the tasks (some 30 times that);
#: larger benchmarks take several passes.
PASS_BYTES = 2 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_TABLE_BITS = 20
#: Bytes of words: letters, digits and all of other alphabets.
_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def normalise(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with single spaces, none at the start of a row, and their offsets."""
    if not len(raw):
        return raw, offsets
    space = SPACE[raw]
    keep = ~space
    keep[1:] |= ~space[:-1]
    at = offsets[:-1][offsets[:-1] < len(raw)]
    keep[at] = ~space[at]
    return _FOLD[raw[keep]], np.concatenate([[0], np.cumsum(keep)])[offsets]


def grams(text: np.ndarray) -> np.ndarray:
    """The Q = 8 bytes from each position as one integer: exact, not hashed."""
    x = text.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | (x[k:] << U64(8 * k)) if len(x) > k else x[:0]
    return x


class Grams:
    """The q-grams of the items that share a q, sorted, with a bit table in front."""

    def __init__(self, items: "Items", which: np.ndarray, q: int):
        self.items, self.q = items, q
        # The first q bytes of eight, the lowest ones of the integer.
        self.mask = U64((1 << 8 * q) - 1)
        g, item, pos = [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for k in which:
            x = self.of(items.text[items.offsets[k] : items.ends[k]])
            g.append(x)
            item.append(np.full(len(x), k))
            pos.append(np.arange(len(x)))
        g, item, pos = map(np.concatenate, (g, item, pos))
        order = np.lexsort((item, g))
        g, item, pos = g[order], item[order], pos[order]
        # Items by gram, and the most common grams of every item, which go as far as its bound allows.
        new = np.ones(len(g), dtype=bool)
        new[1:] = g[1:] != g[:-1]
        group = np.cumsum(new) - 1
        fresh = new.copy()
        fresh[1:] |= item[1:] != item[:-1]
        spread = np.bincount(group, weights=fresh, minlength=group[-1] + 1 if len(g) else 0)[group].astype(np.int64)
        by = np.lexsort((-spread, item))
        start = np.searchsorted(item[by], item[by])
        drop = np.zeros(len(g), dtype=bool)
        drop[by] = (spread[by] > COMMON) & (np.arange(len(g)) - start < items.bound[item[by]] // 2)
        items.bound -= np.bincount(item[drop], minlength=len(items.bound))
        g, self.item, self.pos = g[~drop], item[~drop], pos[~drop]
        self.gram, first = np.unique(g, return_index=True)
        self.first = np.append(first, len(g))
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[self._slot(self.gram)] = True

    def of(self, text: np.ndarray, eights: np.ndarray | None = None) -> np.ndarray:
        """The q bytes from each position as one integer: exact, not hashed."""
        g = grams(text) if eights is None else eights
        if self.q == Q or not len(text):
            return g[: max(0, len(text) - self.q + 1)] & self.mask
        # Positions near the end have no eight bytes, but q.
        tail = grams(np.concatenate([text[max(0, len(text) - Q + 1) :], np.zeros(Q - self.q, dtype=np.uint8)]))
        return np.concatenate([g, tail[len(tail) - max(0, len(text) - self.q + 1 - len(g)) :]]) & self.mask

    def hits(self, text: np.ndarray, offsets: np.ndarray, eights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, place in the row, gram) of the shared q-grams, all of some rows at a time."""
        g = self.of(text, eights)
        at = np.flatnonzero(self.table[self._slot(g)]) if len(g) and len(self.gram) else np.zeros(0, dtype=np.int64)
        k = np.minimum(np.searchsorted(self.gram, g[at]), max(0, len(self.gram) - 1))
        hit = self.gram[k] == g[at] if len(at) else np.zeros(0, dtype=bool)
        at, k = at[hit], k[hit]
        row = np.searchsorted(offsets, at, side="right") - 1
        hit = at + self.q <= offsets[row + 1]
        at, k, row = at[hit], k[hit], row[hit]
        upto = np.cumsum(self.first[k + 1] - self.first[k])
        lo = 0
        while lo < len(at):
            hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + HITS, side="right"))
            # Whole rows; a row with more hits than that is counted in slices by regions().
            hi = len(at) if hi >= len(at) else max(int(np.searchsorted(row, row[hi])), int(np.searchsorted(row, row[lo], side="right")))
            yield row[lo:hi], at[lo:hi] - offsets[row[lo:hi]], k[lo:hi]
            lo = hi

    def regions(self, text: np.ndarray, offsets: np.ndarray, eights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, item, first diagonal) of the bands that meet the lemma's bound."""
        edits, bound, most = self.items.edits, self.items.bound, int(self.items.size.max())
        for row, at, k in self.hits(text, offsets, eights):
            wide = int(at.max()) + most + 2
            keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            n = self.first[k + 1] - self.first[k]
            upto = np.concatenate([[0], np.cumsum(n)])
            lo = 0
            while lo < len(k):
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + HITS, side="right")) - 1)
                m = n[lo:hi]
                each = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.first[k[lo:hi]], m)
                item = self.item[each]
                cell = (np.repeat(at[lo:hi], m) - self.pos[each] + most) // (edits[item] + 1)
                key, count = np.unique((np.repeat(row[lo:hi], m) * len(self.items.ids) + item) * wide + cell, return_counts=True)
                keys, counts = np.concatenate([keys, key]), np.concatenate([counts, count])
                lo = hi
            key, back = np.unique(keys, return_inverse=True)
            count = np.bincount(back, weights=counts, minlength=len(key)).astype(np.int64)
            # Band b joins cells b and b + 1, so a band may also begin at an empty cell before a filled one.
            start = np.unique(np.concatenate([key, key - 1]))
            both = np.zeros(len(start), dtype=np.int64)
            both[np.searchsorted(start, key)] += count
            both[np.searchsorted(start, key - 1)] += count
            item = start // wide % len(self.items.ids)
            good = both >= bound[item]
            start, item = start[good], item[good]
            yield start // wide // len(self.items.ids), item, (start % wide) * (edits[item] + 1) - most

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return (g * U64(0x9E3779B97F4A7C15) >> U64(64 - _TABLE_BITS)).astype(np.int64)


class Items:
    """The benchmark's items: texts, edit budgets, q-grams by q, and short ones by length."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, rate: float, least: int):
        self.ids = ids
        self.text, self.offsets = normalise(*text_column(texts))
        # A closing space is no character of an item.
        ends = np.array([e - 1 if e > s and self.text[e - 1] == 32 else e for s, e in zip(self.offsets[:-1], self.offsets[1:])], dtype=np.int64)
        self.ends = ends
        m = ends - self.offsets[:-1]
        self.size = m
        self.edits = np.floor(m * rate + 1e-9).astype(np.int64)
        # The largest q that leaves the bound at 1 or more: (m - q + 1) - k q >= 1.
        q = np.minimum(Q, m // (self.edits + 1))
        least = max(least, 1)
        self.bound = (m - q + 1) - self.edits * q
        if (long := (m >= least) & (q < 1)).any():
            raise ValueError(f"a rate of {rate} leaves items without a q-gram: {ids[long][:5].tolist()}")
        self.grams = [Grams(self, np.flatnonzero((m >= least) & (q == x)), int(x)) for x in np.unique(q[m >= least])]
        # Short items by length: their texts, sorted, and which items they are.
        self.short = {}
        self.edits[m < least] = 0
        for n in np.unique(m[(m > 0) & (m < least)]):
            which = np.flatnonzero(m == n)
            texts = self._strings(self.text, self.offsets[which], int(n))
            order = np.argsort(texts, kind="stable")
            self.short[int(n)] = texts[order], which[order]

    @staticmethod
    def _strings(text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """The n bytes from each position, comparable."""
        return np.ascontiguousarray(text[at[:, None] + np.arange(n)]).view(f"S{n}").ravel()

    def exact(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, end in the row) of every occurrence of a short item between word borders."""
        found = [np.zeros((3, 0), dtype=np.int64)]
        if self.short and len(text):
            word = _WORD[text]
            border = np.ones(len(text) + 1, dtype=bool)
            border[1:-1] = ~(word[1:] & word[:-1])
            border[offsets] = True
            starts = np.flatnonzero(border[:-1])
            row = np.searchsorted(offsets, starts, side="right") - 1
            for n, (texts, which) in self.short.items():
                fit = starts + n <= offsets[row + 1]
                at, of = starts[fit], row[fit]
                fit = border[at + n]
                at, of = at[fit], of[fit]
                for lo in range(0, len(at), 1 << 18):
                    a, r = at[lo : lo + (1 << 18)], of[lo : lo + (1 << 18)]
                    here = self._strings(text, a, n)
                    low, high = np.searchsorted(texts, here, side="left"), np.searchsorted(texts, here, side="right")
                    k = high - low
                    each = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low, k)
                    found.append(np.stack([np.repeat(r, k), which[each], np.repeat(a + n - offsets[r], k)]))
        return tuple(np.concatenate(found, axis=1))

    def verify(self, text: np.ndarray, offsets: np.ndarray, row: np.ndarray, item: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least edit distance of the item to any piece of the text in the band, end of that piece in the row)."""
        best, end = np.full(len(row), 1 << 30), np.zeros(len(row), dtype=np.int64)
        padded = np.append(text, 0)
        for x in np.unique(item):
            pick = np.flatnonzero(item == x)
            k, m = int(self.edits[x]), int(self.size[x])
            pattern = self.text[self.offsets[x] : self.ends[x]]
            width = 2 * (k + 1) + 2 * k + 1
            for lo in range(0, len(pick), 4096):
                part = pick[lo : lo + 4096]
                left = first[part] - k
                lanes = np.arange(width)
                d = np.zeros((len(part), width), dtype=np.int32)
                top, bottom = offsets[row[part]], offsets[row[part] + 1]
                # Lane o of step j stands for j pattern characters used and the text up to left + j + o.
                d[(left[:, None] + lanes) < 0] = 1 << 20
                for j in range(m):
                    where = top[:, None] + left[:, None] + j + lanes
                    inside = (where >= top[:, None]) & (where < bottom[:, None])
                    cost = np.where(inside, padded[np.where(inside, where, len(text))] != pattern[j], 1 << 20)
                    new = d + cost
                    new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
                    # A text may also be skipped before its start is reached.
                    d = np.minimum.accumulate(new - lanes, axis=1) + lanes
                lane = d.argmin(axis=1)
                best[part] = d[np.arange(len(part)), lane]
                end[part] = left + m + lane
        return best, end

    def found(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(row, item, edits, end) of what is within the edit budget: fewest edits, then least end, of each row and item."""
        raw, offsets = normalise(*text_column(texts))
        eights = grams(raw)
        got = [np.stack(r) for x in self.grams for r in x.regions(raw, offsets, eights)]
        row, item, first = np.concatenate([np.zeros((3, 0), dtype=np.int64), *got], axis=1)
        edits, end = self.verify(raw, offsets, row, item, first)
        ok = edits <= self.edits[item]
        short = self.exact(raw, offsets)
        got = [np.concatenate([x[ok], y]) for x, y in zip((row, item, edits, end), (*short[:2], np.zeros(len(short[0]), dtype=np.int64), short[2]))]
        order = np.lexsort(got[::-1])
        row, item, edits, end = (x[order] for x in got)
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        return row[new], item[new], edits[new], end[new]


def _passes(items: DataFrame, item_id: str, text: str) -> Iterator[pa.Table]:
    """The benchmark in parts of at most about PASS_BYTES, dealt by hash of the item."""
    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // PASS_BYTES) or 1
    for k in range(n):
        yield rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).toArrow() if n > 1 else rows.toArrow()


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, item_chars, doc_end): benchmark items that a document holds with at most rate * size edits.

    One row per document row and item, with the fewest edits and where that piece ends in the normalised text.  Null and
    empty texts hold nothing; items shorter than `least` normalised characters must occur exactly between word borders,
    empty items never do; items without item_id are left out, repeated items are reported each, repeated rows come back
    repeated, without doc_id too.  Texts of any length are compared whole.  Row-local against a bounded part of the
    benchmark: no shuffle.
    """
    out = None
    for table in _passes(benchmark, item_id, text):
        items = Items(table["item_id"].to_numpy(), table["text"].combine_chunks(), rate, least)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in (p for whole in batches for p in parts(whole, PART)):
                row, item, edits, end = items.found(batch["text"])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].cast(pa.int64()).take(pa.array(row)), pa.array(items.ids[item]), pa.array(edits.astype(np.int64)), pa.array(items.size[item]), pa.array(end)],
                    names=["doc_id", "item_id", "edits", "item_chars", "doc_end"],
                )

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, edits long, item_chars long, doc_end long")
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, all columns as they are.  Row-local."""
    for table in _passes(benchmark, "item_id", "text"):
        items = Items(table["item_id"].to_numpy(), table["text"].combine_chunks(), rate, least)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in (p for whole in batches for p in parts(whole, PART)):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[items.found(batch["text"])[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
