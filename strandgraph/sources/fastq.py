"""A FASTQ source that reads byte ranges of files, each in a task of its own, without a written copy of the lines.

``spark.read.format("fastq_ranges").load(path)`` after ``register``; ``path`` is a file, a folder, or a pattern in its last
part, on a file system that ``pyarrow.fs`` can open. Options: ``columns`` (of id, seq, qual; only these leave the reader) and ``rangeBytes``.

A record belongs to the range that its first byte lies in. A task finds its first record by rule: a line that begins with
"@" whose next but one begins with "+" starts a record, since the line after a quality line's next one holds letters. Where a task's last
record ends, the next must begin by the same rule, so that nothing between two ranges is skipped unseen. Blank lines do not count. Compressed
files are one range. Records that are cut or not whole raise with their byte; a name without any further line is no record.
"""

from __future__ import annotations

import io
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from os.path import abspath

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandgraph.sources.sequences import letters

RANGE_BYTES, BATCH = 1 << 26, 4096
FIELDS = ("id", "seq", "qual")
PACKED = {".gz": "gzip", ".bz2": "bz2"}


@dataclass
class Range(InputPartition):
    """Bytes from ``start`` to ``end`` of a file; a compressed file has no end."""

    path: str
    start: int
    end: int | None
    packed: str | None = None


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and its name there."""
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), abspath(re.sub("^file:/+", "/", path))


def files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the files of a path; hidden ones are left out."""
    fs, name = opened(path)
    prefix = path[: len(path) - len(name)] if "://" in path and path.endswith(name) else ""
    folder, _, last = name.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f for f in fs.get_file_info(pafs.FileSelector(folder or "/")) if fnmatch(f.base_name, last)]
    else:
        found = [fs.get_file_info(name)]
        if found[0].type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        if found[0].type == pafs.FileType.Directory:
            found = fs.get_file_info(pafs.FileSelector(name, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._")


class Lines:
    """Lines that are not blank, with the byte that each starts at, and a look at those to come."""

    def __init__(self, source: io.BufferedReader, at: int) -> None:
        self.source, self.at, self.ahead = source, at, deque()

    def peek(self, n: int) -> list[tuple[int, bytes]]:
        """The next n lines, fewer where the file ends."""
        while len(self.ahead) < n and (line := self.source.readline()):
            if line.strip():
                self.ahead.append((self.at, line.rstrip(b" \r\n")))
            self.at += len(line)
        return list(self.ahead)[:n]

    def skip(self, n: int) -> None:
        for _ in range(n):
            self.ahead.popleft()


def lines_from(part: Range, start: int) -> Lines:
    """The lines of a file that begin at ``start`` or behind it."""
    fs, name = opened(part.path)
    if part.packed:
        return Lines(io.BufferedReader(fs.open_input_stream(name, compression=part.packed), 1 << 20), 0)
    source = io.BufferedReader(fs.open_input_file(name), 1 << 20)
    if not start:
        return Lines(source, 0)
    source.seek(start - 1)
    return Lines(source, start - 1 + len(source.readline()))


def to_record(lines: Lines) -> int | None:
    """Moves to the first line that starts a record, and gives its byte; none where no further record is."""
    while len(seen := lines.peek(3)) == 3:
        if seen[0][1].startswith(b"@") and seen[2][1].startswith(b"+"):
            return seen[0][0]
        lines.skip(1)
    return None


def records(part: Range) -> Iterator[tuple[str, str, str]]:
    """(id, seq, qual) of the records that start in a range."""
    lines = lines_from(part, part.start)
    if part.start and to_record(lines) is None:
        return

    def wrong(at: int, what: str) -> ValueError:
        return ValueError(f"{part.path}: byte {at} {what}")

    while seen := lines.peek(4):
        at = seen[0][0]
        if len(seen) == 1 and seen[0][1].startswith(b"@"):
            at = None  # a name alone at the end
        if part.end is not None and (at is None or at >= part.end):
            if to_record(lines_from(part, part.end)) != at:
                raise wrong(seen[0][0], "does not start a whole record")
            return
        if at is None:
            return
        if not seen[0][1].startswith(b"@"):
            raise wrong(at, "does not start a record")
        head, seq, mark, quality = (*(x for _, x in seen), b"", b"", b"")[:4]
        if not mark.startswith(b"+") or len(quality) != len(seq):
            raise wrong(at, "starts a record without a mark or without a quality for each letter")
        lines.skip(4)
        yield head[1:].decode(errors="replace"), seq.decode(errors="replace"), quality.decode(errors="replace")


class FastqReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], size: int) -> None:
        self.path, self.columns, self.size = path, columns, size

    def partitions(self) -> list[Range]:
        made = []
        for name, length in files(self.path):
            packed = next((kind for ending, kind in PACKED.items() if name.endswith(ending)), None)
            made += [Range(name, 0, None, packed)] if packed else [Range(name, at, min(at + self.size, length)) for at in range(0, length, self.size)]
        return made

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        places = [FIELDS.index(c) for c in self.columns]
        rows: list[tuple[str, ...]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in places], self.columns)

        for record in records(partition) if partition else ():
            rows.append(record)
            if len(rows) == BATCH:
                yield batch()
                rows = []
        if rows:
            yield batch()


class FastqRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq_ranges"

    def _columns(self) -> list[str]:
        return [c.strip() for c in self.options.get("columns", "id,seq,qual").split(",")]

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in self._columns())

    def reader(self, schema: object) -> FastqReader:
        return FastqReader(self.options["path"], self._columns(), int(self.options.get("rangeBytes", RANGE_BYTES)))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(FastqRanges)
    return spark


def read_fastq_ranges(spark: SparkSession, path: str, on_bad: str = "fail", size: int = RANGE_BYTES) -> DataFrame:
    """(id, seq) as ``read_fastq`` gives them, by ranges of ``size`` bytes."""
    found = register(spark).read.format("fastq_ranges").option("columns", "id,seq").option("rangeBytes", size).load(path)
    return found.select("id", letters(F.col("seq"), on_bad).alias("seq"))
