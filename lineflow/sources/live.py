"""Live lines as a streaming source (S-03): what is appended to the files of a folder, line by line, told apart by stream.

    spark.dataSource.register(LiveLines)
    spark.readStream.format("lineflow_lines").option("path", folder).option("stderr", ".err").load()

Offsets are bytes by file, kept in the query's checkpoint, so a restart repeats and loses nothing.  A line counts once its
line feed is there.  Rows: file, place of the line in bytes, is_stderr, line.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a line at the most, longer ones are left out; bytes that a task reads.
LONGEST, PER_TASK = 1 << 20, 64 << 20
_STEP = 1 << 16


class Piece(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def _last_feed(fs: pafs.FileSystem, file: str, start: int, end: int) -> int:
    """The place behind the last line feed in [start, end), or start."""
    with fs.open_input_file(file) as f:
        while end > start:
            lo = max(start, end - _STEP)
            f.seek(lo)
            at = f.read(end - lo).rfind(b"\n")
            if at >= 0:
                return lo + at + 1
            end = lo
    return start


class LiveReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.uri = options["path"] if "://" in options["path"] else f"file://{options['path']}"
        self.stderr, self.per_task = options.get("stderr", ".err"), int(options.get("perTask", PER_TASK))

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Where every file's last whole line ends; files are looked at from where the last call left them."""
        fs, root = self._open()
        known = getattr(self, "known", {})
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        now = {}
        for x in found:
            if x.type == pafs.FileType.File and not x.base_name.startswith(("_", ".")):
                start = known.get(x.path, 0)
                now[x.path] = start if x.size <= start else _last_feed(fs, x.path, start, x.size)
        self.known = known | now
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        """Byte ranges of whole lines, cut at line feeds so that no task gets much more than per_task bytes."""
        fs, _ = self._open()
        out = []
        for file, upto in sorted(end.items()):
            lo = start.get(file, 0)
            while lo < upto:
                hi = upto if upto - lo <= self.per_task else max(_last_feed(fs, file, lo, lo + self.per_task), lo)
                # A line longer than a piece goes with what follows it.
                hi = upto if hi == lo else hi
                out.append(Piece(file, lo, hi))
                lo = hi
        return out

    def read(self, piece: Piece) -> Iterator[tuple]:
        fs, root = self._open()
        name = piece.file.removeprefix(root).lstrip("/")
        with fs.open_input_file(piece.file) as f:
            f.seek(piece.start)
            at, rest, skipping = piece.start, b"", False
            left = piece.end - piece.start
            while left > 0:
                got = f.read(min(left, 1 << 22))
                if not got:
                    break
                left -= len(got)
                *lines, rest = (rest + got).split(b"\n")
                for x in lines:
                    if len(x) <= LONGEST and not skipping:
                        yield name, at, self.stderr in name, x.removesuffix(b"\r").decode("utf-8", "replace")
                    at, skipping = at + len(x) + 1, False
                if len(rest) > LONGEST:
                    at, rest, skipping = at + len(rest), b"", True


class LiveLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lineflow_lines"

    def schema(self) -> str:
        return "file string, at long, is_stderr boolean, line string"

    def streamReader(self, schema) -> LiveReader:
        return LiveReader(self.options)
