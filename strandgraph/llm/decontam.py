"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of ten consecutive benchmark words (an item of fewer words is one window). A shift table over
blocks of two words tells how far the search may skip when a block ends a position; blocks that end a pattern
lead to the bucket of patterns with that suffix, whose words are then compared one by one, first as hashes and then
as bytes. Many cursors, each over a short stretch of one text, advance together in numpy.

The tables of up to BLOCK_WORDS benchmark words are made in one task, as flat arrays of some 60 bytes a word, and told to
all tasks. A larger benchmark is more such blocks in files of the shared folder: documents are still read once, and a task
reads one block after another for each CHUNK_BYTES of its texts. So memory is bounded by a block, whatever the benchmark's size;
the search itself takes its time for each block.

Edge cases: null or empty texts and items have no words; null item ids are no items; repeated rows are searched row by
row; an empty benchmark hits nothing; further columns are not read. Texts are searched whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.shared import ALNUM, TextBatch, binary_array, equal_spans, folded, materialise, mix64, ranges

WINDOW, BLOCK_WORDS, STRETCH = 10, 1 << 19, 128
#: Candidates that are compared at a time.
TOGETHER = 1 << 20
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FACTORS = mix64(np.arange(31, 31 + 2 * WINDOW, dtype=np.uint64).reshape(2, WINDOW)) | np.uint64(1)


@dataclass
class Words:
    """Folded text, and where in it each word stands, with its hash."""

    text: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def alike(self, at: np.ndarray, other: Words, there: np.ndarray, n: int) -> np.ndarray:
        """Whether the n words from each place have the hashes of the other's from its place."""
        same = np.flatnonzero(self.hashes[at] == other.hashes[there])
        for j in range(1, n):
            same = same[self.hashes[at[same] + j] == other.hashes[there[same] + j]]
        out = np.zeros(len(at), bool)
        out[same] = True
        return out

    def same(self, at: np.ndarray, other: Words, there: np.ndarray, n: int) -> np.ndarray:
        """Whether the n words from each place are those of the other from its place, byte by byte."""
        out = [np.zeros(0, bool)]
        for i in range(0, len(at), TOGETHER // n + 1):
            a, b = ((x[i : i + TOGETHER // n + 1, None] + np.arange(n)).ravel() for x in (at, there))
            long = self.sizes[a] == other.sizes[b]
            equal = long & equal_spans(self.text, self.starts[a], other.text, other.starts[b], np.where(long, self.sizes[a], 0))
            out.append(equal.reshape(-1, n).all(1))
        return np.concatenate(out)


def _block_keys(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the block of ``width`` words that ends at each place."""
    return mix64(hashes[at] * np.uint64(3) + (hashes[at - 1] * np.uint64(5) if width == 2 else np.uint64(1)))


@dataclass
class Patterns:
    """The distinct windows of one length, as places in the benchmark's words, with the shift table and the suffix buckets."""

    size: int
    #: first word of each pattern; its items are item[item_from[p]:item_from[p + 1]]
    at: np.ndarray
    item_from: np.ndarray
    item: np.ndarray
    keys: np.ndarray
    shifts: np.ndarray
    near: np.ndarray
    suffixes: np.ndarray
    by_suffix: np.ndarray

    @classmethod
    def of(cls, words: Words, size: int, first: np.ndarray, count: np.ndarray, item: np.ndarray) -> Patterns:
        """From items at ``first`` with ``count`` words each; all have ``size`` words at least, and one more only where size is WINDOW."""
        n = count - size + 1
        at, owner = ranges(first, n), np.repeat(item, n)
        # equal windows are one pattern; two hashes order them, and the words decide
        one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for j in range(size):
            one += words.hashes[at + j] * _FACTORS[0, j]
            two += words.hashes[at + j] * _FACTORS[1, j]
        order = np.lexsort((at, two, one))
        at, owner, one, two = at[order], owner[order], one[order], two[order]
        new = np.ones(len(at), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        del one, two
        rest = np.flatnonzero(~new)
        new[rest[~words.same(at[rest], words, at[rest - 1], size)]] = True
        group = np.cumsum(new) - 1
        pairs = np.unique(np.column_stack([group, owner]), axis=0) if len(rest) else np.column_stack([group, owner])
        distinct = at[new]
        width = min(2, size)
        # how far a window's end may still be when a block ends at a place of an item
        ends = ranges(first + width - 1, count - width + 1)
        ahead = np.maximum(0, np.repeat(first + size - 1, count - width + 1) - ends)
        keys = _block_keys(words.hashes, ends, width)
        order = np.lexsort((ahead, keys))
        keys, lead = np.unique(keys[order], return_index=True)
        near = np.zeros(1 << 18, bool)
        near[(keys >> np.uint64(46)).astype(np.int64)] = True
        suffixes = _block_keys(words.hashes, distinct + size - 1, width)
        by_suffix = np.argsort(suffixes, kind="stable")
        return cls(
            size,
            distinct.astype(np.int32),
            np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)).astype(np.int32),
            pairs[:, 1].astype(np.int32),
            keys,
            ahead[order][lead].astype(np.uint8),
            near,
            suffixes[by_suffix],
            by_suffix.astype(np.int32),
        )

    def search(self, words: Words, first: np.ndarray, counts: np.ndarray, benchmark: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence in rows of words."""
        width = min(2, self.size)
        at, stop = _stretches(first + self.size - 1, first + counts)
        found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(at):
            key = _block_keys(words.hashes, at, width)
            step = np.full(len(at), self.size - width + 1)
            maybe = np.flatnonzero(self.near[(key >> np.uint64(46)).astype(np.int64)])
            if len(maybe):
                where = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
                known = self.keys[where] == key[maybe]
                step[maybe[known]] = self.shifts[where[known]]
                hit = np.flatnonzero(step == 0)
                if len(hit):
                    lo, hi = (np.searchsorted(self.suffixes, key[hit], side=s) for s in ("left", "right"))
                    part = np.cumsum(hi - lo) // TOGETHER
                    for own in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(part)) + 1):
                        start = np.repeat(at[hit[own]] - self.size + 1, (hi - lo)[own])
                        pattern = self.by_suffix[ranges(lo[own], (hi - lo)[own])].astype(np.int64)
                        alike = words.alike(start, benchmark, self.at[pattern].astype(np.int64), self.size)
                        found_at.append(start[alike])
                        found.append(pattern[alike])
                    step[hit] = 1
            at = at + step
            on = at < stop
            at, stop = at[on], stop[on]
        start, pattern = np.concatenate(found_at), np.concatenate(found)
        same = words.same(start, benchmark, self.at[pattern].astype(np.int64), self.size)
        return start[same], pattern[same]


def _stretches(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(0, -(-(end - begin) // STRETCH))
    rows = np.repeat(np.arange(len(begin)), n)
    start = begin[rows] + (np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)) * STRETCH
    return start, np.minimum(start + STRETCH, end[rows])


@dataclass
class Block:
    """Benchmark items: their names in order, their words, and their patterns by length."""

    names: list[str]
    words: Words
    patterns: list[Patterns]


def build(ids: pa.Array, texts: pa.Array) -> Block:
    """The tables of items; ids are strings, and an id may stand for several texts."""
    names, item = np.unique(np.array(ids.to_pylist(), object).astype(str), return_inverse=True) if len(ids) else ([], np.zeros(0, np.int64))
    batch = TextBatch(texts)
    parts = list(batch.words(ALNUM))
    none = np.zeros(0, np.int64)
    n = np.concatenate([none, *(p[2] for p in parts)])
    starts, ends = (np.concatenate([none, *(p[i] for p in parts)]) for i in (4, 5))
    words = Words(folded(batch.data), np.concatenate([none.astype(np.uint64), *(p[3] for p in parts)]), starts.astype(np.int32), (ends - starts).astype(np.int32))
    first, size = np.cumsum(n) - n, np.minimum(n, WINDOW)
    groups = [np.flatnonzero(size == s) for s in range(1, WINDOW + 1)]
    return Block(list(names), words, [Patterns.of(words, s, first[g], n[g], item[g]) for s, g in enumerate(groups, 1) if len(g)])


@dataclass
class Found:
    """Of each text its number of words, of each maximal run of hit words (row, first, end), and the items (row, item)."""

    n_words: np.ndarray
    runs: np.ndarray
    items: np.ndarray


def scan(column: pa.Array | pa.ChunkedArray, block: Block) -> Found:
    batch, counts = TextBatch(column), [np.zeros(0, np.int64)]
    runs, items = [np.zeros((0, 3), np.int64)], [np.zeros((0, 2), np.int64)]
    for lo, hi, n_words, hashes, starts, ends in batch.words(ALNUM):
        begin = int(batch.offsets[lo])
        words = Words(folded(batch.data[begin : int(batch.offsets[hi])]), hashes, starts - begin, ends - starts)
        first, hit = np.cumsum(n_words) - n_words, np.zeros(len(hashes) + 1, bool)
        row_of = np.repeat(np.arange(hi - lo), n_words)
        counts.append(n_words)
        for p in block.patterns:
            at, which = p.search(words, first, n_words, block.words)
            for j in range(p.size):
                hit[at + j] = True
            row, which = np.divmod(np.unique(row_of[at] * len(p.at) + which), len(p.at))
            n = p.item_from[which + 1] - p.item_from[which]
            items.append(np.column_stack([np.repeat(row, n) + lo, p.item[ranges(p.item_from[which].astype(np.int64), n.astype(np.int64))]]))
        at = np.flatnonzero(hit)
        if len(at):
            apart = np.flatnonzero((np.diff(at) > 1) | (row_of[at[1:]] != row_of[at[:-1]]))
            head, tail = at[np.concatenate(([0], apart + 1))], at[np.concatenate((apart, [len(at) - 1]))]
            row = row_of[head]
            runs.append(np.column_stack([row + lo, head - first[row], tail + 1 - first[row]]))
    return Found(np.concatenate(counts), np.concatenate(runs), np.unique(np.concatenate(items), axis=0))


#: A task's text that meets the blocks of a large benchmark together, so that each block is read once for it.
CHUNK_BYTES = 1 << 25


def pattern_blocks(benchmark: DataFrame) -> DataFrame:
    """The blocks (data) of a benchmark, made in tasks: one row and one file each.

    Items of more than an eighth of a block are cut into pieces that overlap by a window less a word, which have the same
    windows, so that no item makes a block much larger than the others.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = rows.agg(F.sum(F.regexp_count("text", F.lit(_WORD))).alias("words"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(1, -(-(size["words"] or 0) // BLOCK_WORDS), -(-(size["bytes"] or 0) // (16 * BLOCK_WORDS)))
    most = max(1, BLOCK_WORDS // 8)
    counted = rows.withColumn("n", F.regexp_count("text", F.lit(_WORD)).cast("int"))
    whole, long = counted.where(F.col("n") <= most + WINDOW), counted.where(F.col("n") > most + WINDOW)
    words = long.select("item_id", "n", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("words"))
    places = words.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.col("n") - WINDOW, F.lit(most))).alias("at"))
    pieces = places.select("item_id", F.array_join(F.slice("words", F.col("at") + 1, F.lit(most + WINDOW - 1)), " ").alias("text"))
    blocked = whole.select("item_id", "text").union(pieces).withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))

    def made(group: pa.Table) -> pa.Table:
        block = build(group["item_id"].combine_chunks(), group["text"].combine_chunks())
        return pa.table({"data": binary_array([pickle.dumps(block, protocol=5)])})

    return materialise(blocked.groupBy("block").applyInArrow(made, "data binary"), "patterns", most_rows=1)


Blocks = Callable[[], Iterator[Block]]


def blocks_of(benchmark: DataFrame) -> tuple[Blocks, int]:
    """How a task gets at the blocks, one at a time, and how many bytes of text should meet them together.

    One block is told to all tasks; of more, tasks read one after another from the shared folder, so that neither the driver
    nor a task ever holds more than one.
    """
    stored = pattern_blocks(benchmark)
    if stored.count() > 1:
        files = sorted(stored.inputFiles())
        return lambda: _read(files), CHUNK_BYTES
    row = stored.first()
    block = pickle.loads(bytes(row["data"])) if row else build(pa.array([], pa.string()), pa.array([], pa.string()))
    told = benchmark.sparkSession.sparkContext.broadcast(block)
    return lambda: iter([told.value]), 0


def _read(files: list[str]) -> Iterator[Block]:
    for uri in files:
        system, path = pa_fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            for data in pq.read_table(f, columns=["data"])["data"]:
                yield pickle.loads(data.as_buffer())


def _together(batches: Iterator[pa.RecordBatch], at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches whose column ``at`` has ``most`` bytes or more, but for the last; with ``most`` 0, as they come."""
    if most == 0:
        yield from batches
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(at).nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def scan_all(column: pa.Array, blocks: Iterator[Block]) -> tuple[Found, list[str]]:
    """What all blocks find in the texts, runs that meet or overlap as one, and the sorted names that ``items`` count."""
    parts = []
    for block in blocks:
        found = scan(column, block)
        which, own = np.unique(found.items[:, 1], return_inverse=True)
        parts.append((found, found.items[:, 0], own, [block.names[i] for i in which]))
        del block
    names = sorted({name for part in parts for name in part[3]})
    place = {name: i for i, name in enumerate(names)}
    items = [np.column_stack([row, np.array([place[x] for x in own_names], np.int64)[own]]) for _, row, own, own_names in parts]
    runs = merged_runs(np.concatenate([p[0].runs for p in parts]))
    return Found(parts[0][0].n_words, runs, np.unique(np.concatenate(items), axis=0)), names


def merged_runs(runs: np.ndarray) -> np.ndarray:
    """Maximal runs (row, first, end), in order, of runs in any order that may overlap."""
    if len(runs) == 0:
        return runs
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    apart = int(runs[:, 2].max()) + 1
    start, end = runs[:, 0] * apart + runs[:, 1], np.maximum.accumulate(runs[:, 0] * apart + runs[:, 2])
    head = np.flatnonzero(np.concatenate(([True], (start[1:] > end[:-1]) | (runs[1:, 0] != runs[:-1, 0]))))
    last = np.concatenate((head[1:], [len(runs)])) - 1
    return np.column_stack([runs[head, 0], runs[head, 1], end[last] - runs[head, 0] * apart])


_SPANS = "array<struct<first:int,end:int>>"


def _lists(row: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """A list for each of n rows out of values in the order of their rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, spans of hit words and sorted items found, for every row of ``docs``; documents are read once."""
    blocks, most = blocks_of(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _together(batches, 1, most):
            found, names = scan_all(b.column(1), blocks())
            span = pa.StructArray.from_arrays([pa.array(found.runs[:, i].astype(np.int32)) for i in (1, 2)], ["first", "end"])
            items = _lists(found.items[:, 0], pa.array(names, pa.string()).take(pa.array(found.items[:, 1])), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.n_words), _lists(found.runs[:, 0], span, b.num_rows), items], ["doc_id", "n_words", "spans", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, spans {_SPANS}, items array<string>")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find(docs, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["first"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark window occurs."""
    at = docs.columns.index("text")
    blocks, most = blocks_of(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _together(batches, at, most):
            clean = np.ones(b.num_rows, bool)
            for block in blocks():
                clean[scan(b.column(at), block).runs[:, 0]] = False
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
