"""Vectorised kernels over the UTF-8 bytes of Arrow string columns.

A batch of texts is one byte buffer with offsets; words and hashes are computed for all rows at once with numpy, so no
per-word Python object exists.  Hashes that tell texts apart are polynomials modulo the prime 2**61 - 1 over a byte table;
modulo 2**64 every such polynomial has short texts that collide whatever its base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the rolling polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def _byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64((seed * 2 + 1) & MASK))


TABLE = _byte_table(0x5851F42D4C957F2D)
_folded = np.arange(256)
_folded[65:91] += 32
#: The same table with A-Z folded to a-z.
TABLE_FOLDED = TABLE[_folded]
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = {BASE: np.ones(1, dtype=U64), BASE_INV: np.ones(1, dtype=U64)}


#: Powers that a process keeps.
_KEPT = 1 << 21


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling; up to _KEPT of them are kept per process."""
    got = _powers[base]
    while len(got) < n:
        got = np.concatenate([got, got * U64(pow(base, len(got), 1 << 64))])
        if len(got) <= _KEPT:
            _powers[base] = got
    return got[:n]


def text_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def parts(batch: pa.RecordBatch, limit: int, rows: int = 65535) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with up to `rows` rows and about `limit` bytes, single longer rows excepted."""
    size = np.diff(text_column(batch["text"])[1]) if "text" in batch.schema.names else np.full(batch.num_rows, batch.nbytes // max(1, batch.num_rows))
    upto = np.cumsum(size)
    lo = 0
    while lo < batch.num_rows:
        base = upto[lo - 1] if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(upto, base + limit, side="right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def rolling(raw: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """S with S[e] - S[s] = sum of table[raw[j]] * BASE**j for s <= j < e, modulo 2**64.

    Fast, but texts built for it collide: good for choosing places, not for telling texts apart.
    """
    out = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(table[raw] * powers(BASE, len(raw)), out=out[1:])
    return out


#: Modulus of the hashes that tell texts apart, a prime, and their base with its inverse.
PRIME = (1 << 61) - 1
POINT = 0x1B873593CC9E2D51 % PRIME
POINT_INV = pow(POINT, -1, PRIME)
_P, _LOW31, _LOW30 = U64(PRIME), U64((1 << 31) - 1), U64((1 << 30) - 1)
_points = {POINT: np.ones(1, dtype=U64), POINT_INV: np.ones(1, dtype=U64)}


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> U64(61))
    return np.where(x >= _P, x - _P, x)


def _shifted(x: np.ndarray) -> np.ndarray:
    """x * 2**31 modulo PRIME, not reduced, under 2**62 for x under 2**61."""
    return (x >> U64(30)) + ((x & _LOW30) << U64(31))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME for values under PRIME."""
    ah, al, bh, bl = a >> U64(31), a & _LOW31, b >> U64(31), b & _LOW31
    return _reduced(((ah * bh) << U64(1)) + _shifted(_reduced(ah * bl + al * bh)) + _reduced(al * bl))


def points(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME, grown by doubling; up to _KEPT of them are kept per process."""
    got = _points[base]
    while len(got) < n:
        got = np.concatenate([got, times(got, np.full(len(got), pow(base, len(got), PRIME), dtype=U64))])
        if len(got) <= _KEPT:
            _points[base] = got
    return got[:n]


def prefix_hash(raw: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """Running sums of a byte's 30-bit value times POINT**place modulo PRIME, their upper and lower halves apart."""
    value, at = (table >> U64(34))[raw], points(POINT, len(raw))
    term = _reduced(_shifted(value * (at >> U64(31))) + value * (at & _LOW31))
    out = np.zeros((2, len(raw) + 1), dtype=U64)
    np.cumsum(term >> U64(31), out=out[0, 1:])
    np.cumsum(term & _LOW31, out=out[1, 1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent hash of each byte span: a polynomial modulo PRIME with the length, finalised."""
    hi, lo = prefix[:, ends] - prefix[:, starts]
    whole = _reduced(_reduced(_shifted(_reduced(hi))) + _reduced(lo))
    return mix(times(whole, points(POINT_INV, prefix.shape[1])[starts]) * U64(8) + (ends - starts).astype(U64))


def word_spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, counts per row) of the words, the maximal runs of non-space bytes inside a row."""
    n = len(raw)
    word = ~space[raw]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = word
    rows = offsets[:-1][offsets[:-1] < n]
    before[rows] = False
    starts = np.flatnonzero(word & ~before[:n])
    after = np.zeros(n + 1, dtype=bool)
    after[:n] = word
    after[offsets[1:]] = False
    ends = np.flatnonzero(word & ~after[1:]) + 1
    at = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(at)


def row_of(counts: np.ndarray) -> np.ndarray:
    """Row number of each item when row i has counts[i] items."""
    return np.repeat(np.arange(len(counts)), counts)
