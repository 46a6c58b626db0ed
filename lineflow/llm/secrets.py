"""Operator 8: secret scan by fixed patterns and by token efficiency.

Random strings compress badly under a byte-pair vocabulary learned from text: they have few characters a token.  Runs of
RUN or more characters that mix letters and digits are tokenised, and those under RATIO characters a token become `token`
spans, unless they are a known digest or identifier: hex digests of usual lengths, labelled base32 digests, UUIDs, dates,
and short words and numbers between signs.  Letters alone take LETTERS characters and LETTER_RATIO, which words of any of
the usual languages stay above.  Of a run that a pattern span touches, what the span leaves is
tested.  A run that is not random as a whole is tested in parts, so that words around a secret, as in a path or a URL, do
not hide it: stretches of segments that are no words or numbers, the segments between / . - _ = and, within a long
segment, windows of WINDOW characters.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineflow.llm._bytes import parts, text_column, word_spans

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation of byte-level BPE; runs without spaces only meet its letter, digit and sign branches.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
#: Bytes of texts scanned at once, longer ones alone.
PART = 4 << 20
RUN, WINDOW, RATIO = 16, 20, 2.0
LETTERS, LETTER_RATIO = 20, 1.85

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Digests and identifiers that are no secrets: hex digests of usual lengths, UUIDs, plain numbers, short words and numbers between signs.
DIGEST = re.compile(r"(?:(?:md5|sha1|sha256|sha512)[-:=])?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
IDENTIFIER = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_.=-]+|(?:[A-Za-z]{2,11}[0-9]{0,4}|[0-9]{1,8})(?:[/_.=-]+(?:[A-Za-z]{2,11}[0-9]{0,4}|[0-9]{1,8}|[a-z]))*[/_.=-]*")
#: Dates with a time of day, also no secrets.
INSTANT = re.compile(r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}[Tt_.-]?[0-9]{2}[-_.]?[0-9]{2}[-_.]?(?:[0-9]{2})?(?:[.-][0-9]+)?[Zz]?")
#: UUIDs, digests of usual lengths and base32 digests with their label inside a run.
KNOWN = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|(?<=sha1[:=/-])[A-Z2-7]{32})(?![0-9A-Za-z])")
SEGMENT = re.compile(r"[^/._=-]+")
#: A segment that is a word or a number and so parts a stretch of odd segments.
PLAIN = re.compile(r"[A-Z]?[a-z]{2,}[0-9]{0,4}|[A-Z]{2,}[0-9]{0,4}|[0-9]{1,8}|[A-Za-z]")
_CLASS = np.zeros(256, dtype=bool)
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True


class Span(NamedTuple):
    kind: str
    start: int
    end: int


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    import tiktoken

    try:
        f = open(vocabulary, "rb")
    except OSError as e:
        raise ValueError(f"every executor needs the vocabulary file {vocabulary}; name another with `vocabulary`") from e
    with f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_ratio(run: str, vocabulary: str = VOCABULARY) -> float:
    return len(run) / max(1, len(encoding(vocabulary).encode_ordinary(run)))


def random_like(run: str, vocabulary: str, ratio: float) -> bool:
    core = run.strip("+/_.=-")
    if len(core) < RUN or not re.search("[A-Za-z]", core):
        return False
    if DIGEST.fullmatch(core) or IDENTIFIER.fullmatch(core) or INSTANT.fullmatch(core):
        return False
    if re.search("[0-9]", core):
        return token_ratio(core, vocabulary) < ratio
    return len(core) >= LETTERS and token_ratio(core, vocabulary) < min(ratio, LETTER_RATIO)


def free_parts(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What `taken` leaves of [start, end), parts of RUN or more characters."""
    out = []
    for a, b in sorted(taken):
        if a < end and b > start:
            out.append((start, a))
            start = max(start, b)
    return [(a, b) for a, b in [*out, (start, end)] if b - a >= RUN]


def random_windows(segment: str, vocabulary: str, ratio: float) -> list[tuple[int, int]]:
    """Unions of the windows of whole tokens, WINDOW or more characters, that mix letters and digits under the ratio."""
    enc = encoding(vocabulary)
    at = np.concatenate([[0], np.cumsum([len(t) for t in enc.decode_tokens_bytes(enc.encode_ordinary(segment))])])
    raw = np.frombuffer(segment.encode(), dtype=np.uint8)
    digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
    letters = np.concatenate([[0], np.cumsum(raw >= 65)])
    i = np.arange(np.searchsorted(at, at[-1] - WINDOW, side="right"))
    i, j = np.append(i, i[-1]), np.append(np.searchsorted(at, at[i] + WINDOW), len(at) - 1)
    a, b = at[i], at[j]
    hit = (b - a < ratio * (j - i)) & (digits[b] > digits[a]) & (letters[b] > letters[a])
    out: list[tuple[int, int]] = []
    for x, y in zip(a[hit].tolist(), b[hit].tolist()):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], y)
        else:
            out.append((x, y))
    return out


def random_parts(text: str, start: int, end: int, vocabulary: str, ratio: float) -> list[tuple[int, int]]:
    """Random-looking parts of text[start:end], a run: the whole of it, or else stretches, segments and windows, none
    overlapping.  Known digests and identifiers inside it, for which what stands before the run counts too, are left out."""
    known = [m.span() for m in KNOWN.finditer(text, start, end)]
    if not known and random_like(text[start:end], vocabulary, ratio):
        return [(start, end)]
    out: list[tuple[int, int]] = []
    for lo, hi in free_parts(start, end, known):
        segments = [m.span() for m in SEGMENT.finditer(text, lo, hi)]
        odd = [PLAIN.fullmatch(text, a, b) is None for a, b in segments]
        k = 0
        while k < len(segments):
            n = k + 1
            while odd[k] and n < len(segments) and odd[n] and segments[n][0] == segments[n - 1][1] + 1:
                n += 1
            a, b = segments[k][0], segments[n - 1][1]
            if n > k + 1 and random_like(text[a:b], vocabulary, ratio):
                out.append((a, b))
            else:
                for a, b in segments[k:n]:
                    if random_like(text[a:b], vocabulary, ratio):
                        out.append((a, b))
                    elif b - a > WINDOW and DIGEST.fullmatch(text, a, b) is None:
                        out += [(a + x, a + y) for x, y in random_windows(text[a:b], vocabulary, ratio)]
            k = n
    return out


def base_spans(text: str) -> list[Span]:
    """Pattern spans, leftmost non-overlapping for each kind, failing matches dropped, by start then kind."""
    found = [Span("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [Span("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [Span("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def all_spans(text: str, base: list[Span], runs: list[tuple[int, int]], vocabulary: str, ratio: float) -> list[Span]:
    added = []
    for s, e in runs:
        for lo, hi in free_parts(s, e, [(b.start, b.end) for b in base if b.start < e and s < b.end]):
            added += [Span("token", x, y) for x, y in random_parts(text, lo, hi, vocabulary, ratio)]
    return sorted(base + added, key=lambda s: (s.start, KINDS.index(s.kind)))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def long_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) in code points of the row, of maximal runs of RUN or more candidate characters."""
    starts, ends, _ = word_spans(raw, offsets, ~_CLASS)
    keep = ends - starts >= RUN
    starts, ends = starts[keep], ends[keep]
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    row = np.searchsorted(offsets, starts, side="right") - 1
    return row, points[starts] - points[offsets[row]], points[ends] - points[offsets[row]]


def find_secrets(docs: DataFrame, vocabulary: str = VOCABULARY, ratio: float = RATIO) -> DataFrame:
    """(doc_id, secrets array<struct<kind,start,end>>) of every row of `docs` (doc_id, text); no value leaves its text.

    Offsets are code points, end exclusive; null and empty texts have no spans; texts of any length are scanned whole;
    repeated rows stay repeated, rows without doc_id too; other columns are ignored.  `vocabulary` is a file that every
    executor has at the same path.  Row-local: no shuffle.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, PART, 2048):
                raw, offsets = text_column(batch["text"])
                row, start, end = long_runs(raw, offsets)
                bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
                signs = np.concatenate([[0], np.cumsum((raw == 58) | (raw == 61))])[offsets]
                out = []
                for i in range(batch.num_rows):
                    a, b = bounds[i], bounds[i + 1]
                    if a == b and signs[i] == signs[i + 1]:
                        out.append([])
                        continue
                    # Without a sign there is no assignment, without a long run no key and no digest.
                    text = batch["text"][i].as_py()
                    base = base_spans(text) if a < b else [Span("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
                    spans = all_spans(text, base, list(zip(start[a:b].tolist(), end[a:b].tolist())), vocabulary, ratio)
                    out.append([s._asdict() for s in spans])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(out, kind)], names=["doc_id", "secrets"])

    columns = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return columns.mapInArrow(run, "doc_id long, secrets array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """The counted and hashed form of find_secrets()."""
    of = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "token")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))
