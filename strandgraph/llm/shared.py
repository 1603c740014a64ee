"""What several operators of this package share: the shared folder, and words of whole texts as hashes.

Texts reach the tasks as Arrow columns. ``TextBatch`` looks at a column's bytes in place, so that words are
hashed with a handful of numpy passes over the buffer rather than one Python call a word.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are hashed at a time; bounds the temporary arrays of a task.
SLICE_BYTES = 1 << 20
#: Rows of text in an Arrow batch.
BATCH_ROWS = 1000


#: What operators keep in a worker process between tasks, by operator.
_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """An operator's own store in this worker process."""
    return _KEPT.setdefault(owner, {})


def make_room(owner: str = "") -> None:
    """Drop what other operators keep: workers live on, and the next operator needs their memory."""
    for name, store in _KEPT.items():
        if name != owner:
            store.clear()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; one of its own only where none is set and all runs on one machine."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = tempfile.mkdtemp(prefix="strandgraph-checkpoint-")
        spark.sparkContext.setCheckpointDir(got)
    return got


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> SparkSession:
    """Hand texts to Python in batches of few rows: a batch of long documents must fit a worker beside the JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


#: Names of the tables that this driver has written.
_WRITTEN: set[str] = set()


def materialise(df: DataFrame, name: str, codec: str | None = None, most_rows: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors.

    ``most_rows`` is how many rows a file has at most; 0 sets no bound.
    """
    own = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/{own}"
    _WRITTEN.add(own)
    df.write.option("maxRecordsPerFile", most_rows).parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1] in _WRITTEN:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Byte classes: True where a UTF-8 byte belongs to a word. Letters A-Z count as a-z.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class TextBatch:
    """The bytes of a string column: row i is data[offsets[i]:offsets[i + 1]]. Null reads as empty."""

    def __init__(self, column: pa.Array | pa.ChunkedArray) -> None:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
        if column.null_count:
            column = pc.fill_null(column, "")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, where, data = column.buffers()
        step = np.int64 if wide else np.int32
        if len(column):
            self.offsets = np.frombuffer(where, step)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        else:
            self.offsets = np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def slices(self, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
        """Runs of rows of at most ``most`` bytes; a longer row is a run of its own."""
        lo, n = 0, len(self)
        while lo < n:
            hi = int(np.searchsorted(self.offsets, self.offsets[lo] + most, side="right")) - 1
            hi = min(n, max(hi, lo + 1))
            yield lo, hi
            lo = hi

    def words(self, inside: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Yields (first row, end row, words of each row, hash, start, end of each word); starts are into ``data``."""
        for lo, hi in self.slices():
            begin, end = int(self.offsets[lo]), int(self.offsets[hi])
            raw = self.data[begin:end]
            mark = np.zeros(len(raw) + 1, np.int8)
            mark[:-1] = inside[raw]
            cuts = self.offsets[lo + 1 : hi] - begin
            cuts = cuts[(cuts > 0) & (cuts < len(raw))]
            edge = np.diff(mark, prepend=np.int8(0))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            broken = np.unique(cuts[(mark[cuts] == 1) & (mark[cuts - 1] == 1)]) if len(cuts) else cuts
            if len(broken):
                starts, ends = np.sort(np.concatenate([starts, broken])), np.sort(np.concatenate([ends, broken]))
            hashes = hash_spans(raw, starts, ends)
            # rows that hold no byte get no word; side="left" at equal offsets keeps that so
            first = np.searchsorted(starts, self.offsets[lo : hi + 1] - begin, side="left")
            yield lo, hi, np.diff(first), hashes, starts + begin, ends + begin


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Spans beyond so many bytes are hashed one by one; spans that are hashed together.
_LONG, _TOGETHER = 512, 1 << 17
_LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, A-Z read as a-z.

    Eight bytes at a time go through two lanes of multiply and shift mixing. The second multiplies each block before
    it adds it, so texts whose structure cancels out in one lane do not in the other.
    """
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    low, high = int(starts.min()), int(ends.max())
    text = folded(raw[low:high])
    eight = np.lib.stride_tricks.sliding_window_view(text, 8)
    for i in range(0, len(starts), _TOGETHER):
        at, size = starts[i : i + _TOGETHER] - low, (ends - starts)[i : i + _TOGETHER]
        one, two = size.astype(np.uint64) * _LANES[0], size.astype(np.uint64) * _LANES[1]
        live, done = np.flatnonzero(size <= _LONG), 0
        while len(live):
            rest = size[live] - done
            block = eight[at[live] + done].view("<u8")[:, 0] & _TAIL[np.minimum(rest, 8)]
            one[live] = mix64(one[live] ^ block)
            two[live] = mix64(two[live] + block * _LANES[0])
            live, done = live[rest > 8], done + 8
        out[i : i + _TOGETHER] = mix64(one ^ (two >> np.uint64(32)) ^ (two << np.uint64(32)))
        for k in np.flatnonzero(size > _LONG).tolist():
            digest = hashlib.blake2b(text[at[k] : at[k] + size[k]], digest_size=8).digest()
            out[i + k] = int.from_bytes(digest, "little")
    return out


def folded(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z, and eight more for reads beyond the end."""
    return np.concatenate([_LOWER[raw], np.zeros(8, np.uint8)])


def equal_spans(one: np.ndarray, at_one: np.ndarray, two: np.ndarray, at_two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of each pair of spans, out of two ``folded`` buffers, are the same."""
    eight = [np.lib.stride_tricks.sliding_window_view(x, 8) for x in (one, two)]
    same, live, done = np.ones(len(size), bool), np.flatnonzero(size > 0), 0
    while len(live):
        rest = size[live] - done
        a, b = (x[at[live] + done].view("<u8")[:, 0] for x, at in zip(eight, (at_one, at_two), strict=True))
        other = ((a ^ b) & _TAIL[np.minimum(rest, 8)]) != 0
        same[live[other]] = False
        live, done = live[~other & (rest > 8)], done + 8
    return same


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run of n, one run after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
