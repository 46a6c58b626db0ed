"""Operator 4: WARC archives with revisit records and a two-level capture index.

Archives hold one gzip member a record, as range readers expect.  They are written by Spark's own text writer, so any
Hadoop file system and the commit protocol work: a gzip member ends in the high byte of its length, which is 0 below
16 MiB, so that byte is left to the writer as its line separator.  Longer records are cut into several members.

The index sorts reversed-host keys, packs BLOCK lines into a gzip member, and keeps a sparse directory of each block's
first key, file, offset and length.  A lookup of any number of keys finds their blocks in the directory, range-reads each
block once, binary-searches it, and range-reads the records.  Tasks open files by path with pyarrow, so the folder must be
in a store that it reads (local or mounted, HDFS, S3, GCS, Azure).
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineflow.llm._shared import materialise, shared_path

#: Captures in a compressed index block.
BLOCK = 3000
#: Directory entries under one entry of the list that lookups carry; it has one entry for 3,000,000 captures and one a file.
TOP = 1000
#: Neighbouring ranges are read together up to this size; parts of a frequent payload's pages.
JOINED, SALTS = 4 << 20, 16
_PIECE = 8 << 20
_DATE = "2024-01-01T00:00:00Z"
_ID = "urn:lineflow:page:"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def reversed_host_key(url: str | None) -> str:
    """`https://a.b.org:80/x#y` -> `org,b,a)/x`; a url without a host keeps its text; null is empty."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url or "")
    if not m:
        return re.sub(r"[\x00-\x20]", lambda c: f"%{ord(c[0]):02X}", url or "")
    rest = re.sub(r"[\x00-\x20]", lambda c: f"%{ord(c[0]):02X}", m[2]) or "/"
    return ",".join(reversed(m[1].lower().split("."))) + ")" + rest


def members(data: bytes) -> bytes:
    """Gzip members of up to 8 MiB each, without the last byte, a zero that the line separator restores."""
    out = b"".join(zlib.compress(data[k : k + _PIECE], 6, wbits=31) for k in range(0, max(1, len(data)), _PIECE))
    assert out[-1] == 0
    return out[:-1]


def gunzip(data: bytes) -> bytes:
    out = []
    while data:
        d = zlib.decompressobj(wbits=31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def opened(path: str) -> BinaryIO:
    """A file of any store that pyarrow reads, by the path that Spark gives."""
    store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_file(name)


def members_of(f: BinaryIO, piece: int = 1 << 20, step: int = 1 << 14) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, content) of each gzip member of a file, read a piece at a time and fed in small steps, so that little
    is handed back at a member's end."""
    buffer, base, at = b"", 0, 0
    while True:
        d, out, start = zlib.decompressobj(wbits=31), [], at
        while not d.eof:
            if at - base >= len(buffer):
                buffer, base = f.read(piece), at
                if not buffer:
                    if at > start:
                        raise ValueError("archive ends inside a member")
                    return
            fed = buffer[at - base : at - base + step]
            out.append(d.decompress(fed))
            at += len(fed)
        at -= len(d.unused_data)
        yield start, at, b"".join(out)


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit that carries the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    uri = re.sub(r"[\x00-\x20]", lambda c: f"%{ord(c[0]):02X}", url or "")
    lines = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{page_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}"]
    lines.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; a response's payload is checked against its digest."""
    end = data.index(b"\r\n\r\n")
    head = dict(x.split(": ", 1) for x in data[:end].decode().split("\r\n")[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    at = block.index(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", block[:at])[1])
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    payload = block[at + 4 :]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    refers = head.get("WARC-Refers-To")
    number = lambda s: int(s[len(_ID) + 1 : -1])
    return {"page_id": number(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": number(refers) if refers else None, "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, least: int = 0, path: str | None = None) -> str:
    """Write a record per row of `pages` (page_id, url, html); the folder of the archives is returned.

    Of equal payloads of at least `least` bytes the one with the smallest page_id is the response and others revisit it.
    Null html is an empty payload, null url an empty URI; rows without page_id are left out; control characters of a
    url are percent-encoded.  An empty table gives a folder without records.
    """
    path = path or shared_path(pages.sparkSession, "warc")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long"), "url", body.alias("payload"))
    marks = rows.where(F.octet_length("payload") >= least).select("page_id", F.sha1("payload").alias("digest"))
    marks = materialise(marks, "digests")
    firsts = marks.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # One payload, such as the empty one, may belong to a third of all pages: its rows meet in SALTS parts.
    firsts = firsts.select("digest", "first", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    parts = marks.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    revisits = parts.join(firsts, ["digest", "salt"]).where("page_id <> first").select("page_id", "first").distinct()
    full = rows.join(revisits.hint("merge"), "page_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                made = [members(record(i, u.as_py(), p.as_py(), f.as_py())) for i, u, p, f in zip(part["page_id"].to_pylist(), part["url"], part["payload"], part["first"])]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    full.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\u0000").text(path)
    return path


_FIELDS = {"page_id": pa.int64(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()}
_EXTRA = {"url": pa.string(), "payload": pa.binary(), "file": pa.string(), "offset": pa.int64(), "length": pa.int64()}
_SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} {_SQL[(_FIELDS | _EXTRA)[n]]}" for n in names)


def _batches(rows: Iterable[dict], names: list[str], most: int = 512) -> Iterator[pa.RecordBatch]:
    """Rows as batches of `most`, or of JOINED bytes of payload."""
    kinds, held, size = _FIELDS | _EXTRA, [], 0
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], kinds[n]) for n in names], names=names)
    for r in rows:
        held.append(r)
        size += len(r["payload"] or b"") if "payload" in names else 0
        if len(held) >= most or size > JOINED:
            yield pack()
            held, size = [], 0
    if held:
        yield pack()


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path")


def scan(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Walk every archive: (file, offset, length) and the fields of each record, `keep` adding url or payload."""
    names = ["file", "offset", "length", *_FIELDS, *keep]

    def walk(file: str) -> Iterator[dict]:
        data, start = b"", None
        with opened(file) as f:
            for at, end, content in members_of(f):
                start = at if start is None else start
                data += content
                head = data.find(b"\r\n\r\n")
                if head < 0 or len(data) < head + 8 + int(re.search(rb"\r\nContent-Length: (\d+)", data[:head])[1]):
                    continue
                yield parse(data) | {"file": file, "offset": start, "length": end - start}
                data, start = b"", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch["path"].to_pylist():
                yield from _batches(walk(file), names)

    return _files(spark, path).mapInArrow(run, _schema(names))


def keys_of(pages: DataFrame, *columns: str) -> DataFrame:
    """(key, columns) of `pages` (url, columns)."""
    schema = pages.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([reversed_host_key(u) for u in b["url"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([keys, *[b[c] for c in columns]], names=["key", *columns])

    return pages.select("url", *columns).mapInArrow(run, ", ".join(["key string", *[f"{f.name} {f.dataType.simpleString()}" for f in schema]]))


def build_index(spark: SparkSession, archives: str, path: str | None = None) -> str:
    """Write the two-level index of the archives: `blocks` (gzip members of sorted lines) and `directory` (Parquet)."""
    path = path or shared_path(spark, "index")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[str] = []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([members("".join(lines).encode())], pa.binary())], names=["value"])

        for b in batches:
            for row in zip(*[b[c].to_pylist() for c in ("key", "page_id", "file", "offset", "length")]):
                lines.append("\t".join(map(str, row)) + "\n")
                if len(lines) == BLOCK:
                    yield block()
                    lines.clear()
        if lines:
            yield block()

    captures = keys_of(scan(spark, archives, ("url",)), "page_id", "file", "offset", "length")
    ordered = materialise(captures, "captures").orderBy("key", "page_id")
    ordered.mapInArrow(pack, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\u0000").text(f"{path}/blocks")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch["path"].to_pylist():
                rows, lines, start = [], b"", None
                with opened(file) as f:
                    for at, end, content in members_of(f):
                        start, lines = at if start is None else start, lines + content
                        # A block of very long keys takes several members; its last one ends with a line.
                        if lines.endswith(b"\n"):
                            rows.append((lines[: lines.index(b"\t")].decode(), file, start, end - start))
                            lines, start = b"", None
                names = ["first_key", "file", "offset", "length"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=names)

    _files(spark, f"{path}/blocks").mapInArrow(listed, "first_key string, file string, offset long, length long").write.parquet(f"{path}/directory")
    return path


_PLACE = "file string, offset long, length long"


def _blocks_of(spark: SparkSession, index: str, keys: DataFrame) -> DataFrame:
    """(file, offset, length, key): the index blocks that may hold each key of `keys` (key), without repeats."""
    directory = spark.read.parquet(f"{index}/directory")
    nth = F.row_number().over(Window.partitionBy("file").orderBy("offset"))
    top = sorted(r["first_key"] for r in directory.withColumn("nth", nth).where((F.col("nth") - 1) % TOP == 0).select("first_key").collect())
    names = ["part", "key", "wanted", "file", "offset", "length"]
    schema = f"part long, key string, wanted boolean, {_PLACE}"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the part of the directory that they belong to, the last one that begins at or before their key; a
        wanted key that parts begin with is looked for in each of them and in the one before."""
        for b in batches:
            key, wanted = b["key"].to_pylist(), b["wanted"].to_pylist()
            last = [bisect.bisect_right(top, k) - 1 for k in key]
            first = [max(0, bisect.bisect_left(top, k) - 1) if w else x for k, w, x in zip(key, wanted, last)]
            row, part = [], []
            for i, (x, y) in enumerate(zip(first, last)):
                row += [i] * (y - x + 1)
                part += range(x, y + 1)
            got = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *got.columns], names=names)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by part, key, directory first: a key's blocks are those that begin with it and the one before."""
        here, before, same, begins = None, None, [], None
        for b in batches:
            out = []
            for part, key, wanted, *place in zip(*[c.to_pylist() for c in b.columns]):
                if part != here:
                    here, before, same, begins = part, None, [], None
                if not wanted:
                    if begins != key:
                        before, same, begins = same[-1] if same else before, [], key
                    same.append(place)
                elif begins == key:
                    out += [(*x, key) for x in ([before] if before else []) + same]
                elif same:
                    out.append((*same[-1], key))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["file", "offset", "length", "key"])

    wanted = keys.where("key is not null").select("key").distinct().selectExpr("key", "true wanted", "cast(null as string) file", "cast(null as bigint) offset", "cast(null as bigint) length")
    rows = directory.selectExpr("first_key key", "false wanted", "file", "offset", "length").union(wanted).mapInArrow(placed, schema)
    return rows.repartition("part").sortWithinPartitions("part", "key", "wanted", "file", "offset").mapInArrow(found, f"{_PLACE}, key string")


def find(spark: SparkSession, index: str, keys: DataFrame) -> DataFrame:
    """(key, page_id, file, offset, length) of every capture of the keys in `keys` (key); each block is read once a task."""
    names = ["key", "page_id", "file", "offset", "length"]
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lines, firsts = None, [], []
        for b in batches:
            out = []
            for *place, key in zip(*[b[c].to_pylist() for c in ("file", "offset", "length", "key")]):
                if place != held:
                    with opened(place[0]) as f:
                        f.seek(place[1])
                        lines = [x.split("\t") for x in gunzip(f.read(place[2])).decode().split("\n")[:-1]]
                    held, firsts = place, [x[0] for x in lines]
                out += lines[bisect.bisect_left(firsts, key) : bisect.bisect_right(firsts, key)]
            cast = (str, int, str, int, int)
            yield pa.RecordBatch.from_arrays([pa.array([c(r[k]) for r in out], t) for k, (c, t) in enumerate(zip(cast, types))], names=names)

    blocks = _blocks_of(spark, index, keys).repartition("file", "offset").sortWithinPartitions("file", "offset", "key")
    return blocks.mapInArrow(run, "key string, page_id long, file string, offset long, length long")


def read_records(captures: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The fields of the records at (file, offset, length), read by range; `keep` adds url or payload.

    Ranges of one stretch of an archive meet in one task, which reads neighbours together.
    """
    names = [*_FIELDS, *keep]

    def records(rows: Iterator[tuple[str, int, int]]) -> Iterator[dict]:
        f, name, held = None, None, []

        def flush():
            if held:
                f.seek(held[0][0])
                data = memoryview(f.read(held[-1][0] + held[-1][1] - held[0][0]))
                for at, n in held:
                    yield parse(gunzip(bytes(data[at - held[0][0] : at - held[0][0] + n])))
                held.clear()

        for file, offset, length in rows:
            if file != name or held and (offset != held[-1][0] + held[-1][1] or offset + length - held[0][0] > JOINED):
                yield from flush()
            if file != name:
                if f is not None:
                    f.close()
                f, name = opened(file), file
            held.append((offset, length))
        yield from flush()
        if f is not None:
            f.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b["file"].to_pylist(), b["offset"].to_pylist(), b["length"].to_pylist()))
        yield from _batches(records(rows), names)

    stretch = F.floor(F.col("offset") / (64 << 20))
    return captures.select("file", "offset", "length").repartition("file", stretch).sortWithinPartitions("file", "offset").mapInArrow(run, _schema(names))


def lookup(spark: SparkSession, index: str, url: str) -> list[dict]:
    """Every capture of a url: directory search, block search, record reads, all by range."""
    keys = spark.createDataFrame([(reversed_host_key(url),)], "key string")
    return [r.asDict() for r in read_records(find(spark, index, keys), ("url", "payload")).collect()]


def captures(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row of `pages` (page_id, url, html): they
    are written as archives, indexed, looked up by the keys of their urls, and read back by range."""
    spark = pages.sparkSession
    index = build_index(spark, write_archives(pages, least))
    return read_records(find(spark, index, keys_of(pages)))
