"""Token counts that follow edits without encoding the whole text again.

Each document keeps a segment tree: a leaf for every pre-token between white space with its number of tokens and its
place, and the sums of subtrees above. White space always ends a token, so an edit can only change the leaves that it
touches, those at its borders included: only that region of the text is read and encoded anew, its leaves are set, and the
sums on their paths follow. Trees are stored beside their texts and read back as they are; nothing of them is made again.

Edits are (start, end, text) in code points of the text before any edit. Of edits that overlap the one that starts first
(then the one that ends first) counts and the others are rejected; bounds beyond the text are moved to its end; null
bounds or texts read as 0 or empty.

Edge cases: null or empty text has no leaves and no tokens; null ids and repeated rows keep their rows; a document without
edits, or with null for the list, keeps its count; an empty table gives no rows; a column ``edits`` counts where it is a
list of structs (start, end, text) with places of any whole numbers, and is not read where it is anything else; further columns are not read. Texts of any length are counted whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandgraph.llm import tokens
from strandgraph.llm.shared import NON_SPACE, binary_array, materialise

Edit = tuple[int, int, str]
EDITS = "array<struct<start:bigint,end:bigint,text:string>>"
#: Nodes under one of the level above.
FAN = 16
_KINDS = (np.dtype("u1"), np.dtype("<u2"), np.dtype("<u4"))


class SegmentTree:
    """Sums of runs of FAN nodes, level by level; the last level is the whole."""

    def __init__(self, leaves: np.ndarray, above: list[np.ndarray] | None = None) -> None:
        self.levels = [leaves.astype(np.int64), *(above or [])]
        while above is None and len(self.levels[-1]) > 1:
            self.levels.append(np.add.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), FAN)))

    @property
    def total(self) -> int:
        return int(self.levels[-1][0]) if len(self.levels[-1]) else 0

    def set(self, leaf: int, value: int) -> None:
        change = value - int(self.levels[0][leaf])
        if change:
            for level in self.levels:
                level[leaf] += change
                leaf //= FAN


class Tree:
    """The segment tree of a text, where each leaf stands in code points and in bytes, and the text's length."""

    def __init__(self, sums: SegmentTree, edges: np.ndarray, byte_edges: np.ndarray, length: int) -> None:
        self.sums, self.length = sums, length
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.byte_starts, self.byte_ends = byte_edges[0::2], byte_edges[1::2]

    def packed(self) -> bytes:
        """All arrays one after the other, each in the narrowest type that holds it; places as distances."""
        edges, byte_edges = (np.column_stack(p).ravel() for p in ((self.starts, self.ends), (self.byte_starts, self.byte_ends)))
        same = np.array_equal(edges, byte_edges)
        steps = [np.diff(edges, prepend=0), np.zeros(0, np.int64) if same else np.diff(byte_edges, prepend=0)]
        out = []
        for x in [np.array([self.length]), *steps, *self.sums.levels]:
            kind = next(i for i, k in enumerate(_KINDS) if not len(x) or int(x.max()) <= np.iinfo(k).max)
            out += [bytes([kind]), len(x).to_bytes(4, "little"), x.astype(_KINDS[kind]).tobytes()]
        return b"".join(out)

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        arrays, at = [], 0
        while at < len(data):
            kind, n = _KINDS[data[at]], int.from_bytes(data[at + 1 : at + 5], "little")
            arrays.append(np.frombuffer(data, kind, n, at + 5).astype(np.int64))
            at += 5 + n * kind.itemsize
        edges = np.cumsum(arrays[1])
        return cls(SegmentTree(arrays[3], arrays[4:]), edges, np.cumsum(arrays[2]) if len(arrays[2]) else edges, int(arrays[0][0]))


def tree_of(text: str | None, memo: tokens.WordMemo) -> Tree:
    """The tree of a whole text."""
    text = text or ""
    if text.isascii():
        inside = np.zeros(len(text) + 2, np.int8)
        inside[1:-1] = NON_SPACE[np.frombuffer(text.encode(), np.uint8)]
        edges = byte_edges = np.flatnonzero(np.diff(inside))
    else:
        edges = np.array([m.span() for m in tokens.WORD.finditer(text)], np.int64).ravel()
        # where a code point starts in the bytes
        sizes = np.diff(np.flatnonzero((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80), append=len(text.encode()))
        byte_edges = np.concatenate(([0], np.cumsum(sizes)))[edges]
    counts = np.array(list(map(len, map(memo.__getitem__, tokens.words(text)))), np.int64) // 2
    return Tree(SegmentTree(counts), edges, byte_edges, len(text))


def accepted(edits: list[Edit], length: int) -> list[Edit]:
    """Edits in order, without those that overlap an earlier one."""
    out: list[Edit] = []
    for start, end, text in sorted((min(max(a or 0, 0), length), min(max(b or 0, a or 0, 0), length), t or "") for a, b, t in edits):
        if not out or start > out[-1][1] or (start == out[-1][1] and end > start):
            out.append((start, end, text))
    return out


def regions(text: bytes | memoryview, tree: Tree, edits: list[Edit]) -> Iterator[tuple[int, int, tuple[int, int], tuple[int, int], str]]:
    """(first leaf, last leaf, places, bytes, new text) of each part of the text that accepted edits touch, leaves at its
    borders included. Of the text's bytes only these are read; the tree has leaves."""
    n, starts, ends = len(tree.starts), tree.starts, tree.ends
    found: list[tuple[int, int, list[Edit]]] = []
    for edit in edits:
        lo, hi = bisect_left(ends, edit[0]), bisect_right(starts, edit[1]) - 1
        if hi < lo:  # between two leaves: the one before, or the first, takes the new text in
            lo = hi = max(0, hi)
        if found and (lo <= found[-1][1] or min(starts[lo], edit[0]) <= found[-1][2][-1][1]):
            found[-1] = (found[-1][0], max(hi, found[-1][1]), [*found[-1][2], edit])
        else:
            found.append((lo, hi, [edit]))
    for lo, hi, own in found:
        # the leaves and the white space on both their sides
        first = int(ends[lo - 1]) if lo else 0
        begin, end = int(tree.byte_ends[lo - 1]) if lo else 0, int(tree.byte_starts[hi + 1]) if hi + 1 < n else len(text)
        near = bytes(text[begin:end]).decode()
        a, b = min(int(starts[lo]), own[0][0]), max(int(ends[hi]), own[-1][1])
        old = near[a - first : b - first]
        at = begin + len(near[: a - first].encode())
        yield lo, hi, (a, b), (at, at + len(old.encode())), edited(old, [(s - a, e - a, t) for s, e, t in own])


def recount(text: bytes | memoryview, tree: Tree, edits: list[Edit], memo: tokens.WordMemo) -> tuple[int, int, int]:
    """(tokens after the edits, edits made, leaves encoded anew). Leaves of a region count as its first one, so that only
    sums on their paths change; ``spliced`` gives the tree of the new text."""
    edits = accepted(edits, tree.length)
    if not edits:
        return tree.sums.total, 0, 0
    if not len(tree.starts):
        return len(memo.ids(edited(bytes(text).decode(), edits))) // 2, len(edits), 0
    renewed = 0
    for lo, hi, _, _, piece in regions(text, tree, edits):
        tree.sums.set(lo, len(memo.ids(piece)) // 2)
        for leaf in range(lo + 1, hi + 1):
            tree.sums.set(leaf, 0)
        renewed += hi - lo + 1
    return tree.sums.total, len(edits), renewed


def spliced(text: bytes | memoryview, tree: Tree, edits: list[Edit], memo: tokens.WordMemo) -> tuple[bytes, Tree]:
    """The text and its tree after the edits, as the next edits need them: leaves of edited regions give way to those of
    their new text, the ones behind move, and sums are added up from the leaves; no other leaf is encoded."""
    edits = accepted(edits, tree.length)
    if not edits:
        return bytes(text), tree
    if not len(tree.starts):
        whole = edited(bytes(text).decode(), edits)
        return whole.encode(), tree_of(whole, memo)
    out, counts, edges, byte_edges = [], [], [], []
    leaf = byte = moved = byte_moved = 0

    def keep(end: int) -> None:
        counts.append(tree.sums.levels[0][leaf:end])
        edges.append(np.column_stack((tree.starts[leaf:end], tree.ends[leaf:end])).ravel() + moved)
        byte_edges.append(np.column_stack((tree.byte_starts[leaf:end], tree.byte_ends[leaf:end])).ravel() + byte_moved)

    for lo, hi, (a, b), (byte_a, byte_b), piece in regions(text, tree, edits):
        keep(lo)
        new, raw = tree_of(piece, memo), piece.encode()
        out += [bytes(text[byte:byte_a]), raw]
        counts.append(new.sums.levels[0])
        edges.append(np.column_stack((new.starts, new.ends)).ravel() + a + moved)
        byte_edges.append(np.column_stack((new.byte_starts, new.byte_ends)).ravel() + byte_a + byte_moved)
        moved, byte_moved = moved + len(piece) - (b - a), byte_moved + len(raw) - (byte_b - byte_a)
        leaf, byte = hi + 1, byte_b
    keep(len(tree.starts))
    out.append(bytes(text[byte:]))
    sums = SegmentTree(np.concatenate(counts))
    return b"".join(out), Tree(sums, np.concatenate(edges), np.concatenate(byte_edges), tree.length + moved)


def edited(text: str, edits: list[Edit]) -> str:
    out, done = [], 0
    for start, end, new in edits:
        out += [text[done:start], new]
        done = end
    return "".join([*out, text[done:]])


def _lists_edits(table: DataFrame) -> bool:
    """Whether a column ``edits`` is a list of (start, end, text), with places of any whole numbers."""
    kind = table.schema["edits"].dataType if "edits" in table.columns else None
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
        return False
    fields = {f.name: f.dataType for f in kind.elementType}
    return fields.keys() == {"start", "end", "text"} and isinstance(fields["text"], T.StringType) and all(isinstance(fields[c], T.IntegralType) for c in ("start", "end"))


def build_trees(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text, edits (where there is such a list), n_tokens and the packed tree, stored in the shared folder."""
    path = vocabulary or tokens.vocabulary_path()
    extra = [F.col("edits").cast(EDITS)] if _lists_edits(docs) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = tokens.memo(path)
        for b in batches:
            totals, trees = [], []
            for text in b.column(1).to_pylist():
                tree = tree_of(text, memo)
                totals.append(tree.sums.total)
                trees.append(tree.packed())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(totals, pa.int64()), binary_array(trees)], [*b.schema.names, "n_tokens", "tree"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text", *extra).mapInArrow(run, f"doc_id {kind}, text string, " + f"edits {EDITS}, " * len(extra) + "n_tokens long, tree binary")
    return materialise(made, "trees", "zstd")


def _raw(column: pa.Array) -> list[memoryview]:
    """The bytes of each text, in place; null reads as empty."""
    _, where, data = column.buffers()
    step = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(where, step)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else [0]
    view = memoryview(data) if data is not None else memoryview(b"")
    return [view[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _given(b: pa.RecordBatch, propose: Callable[[str], list[Edit]] | None) -> list[list[Edit]]:
    """The edits of each row of a batch: what ``propose`` says of its text, else those of its column."""
    if propose:
        return [propose(t) if t else [] for t in b.column("text").to_pylist()]
    return [[(e["start"], e["end"], e["text"]) for e in x or [] if e] for x in b.column("edits").to_pylist()]


def _need_edits(trees: DataFrame, propose: Callable[[str], list[Edit]] | None) -> None:
    if propose is None and not _lists_edits(trees):
        raise ValueError("the table has no column edits that lists (start, end, text), and no edits are proposed")


def apply_edits(trees: DataFrame, propose: Callable[[str], list[Edit]] | None = None, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_tokens_after, n_edits, n_leaves, n_renewed; edits from the column, or from each text by ``propose``."""
    _need_edits(trees, propose)
    path = vocabulary or tokens.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = tokens.memo(path)
        for b in batches:
            rows = []
            for text, data, edits in zip(_raw(b.column("text")), b.column("tree").to_pylist(), _given(b, propose), strict=True):
                tree = Tree.unpacked(data)
                rows.append((*recount(text, tree, edits, memo), len(tree.starts)))
            after, made, renewed, leaves = (pa.array([r[i] for r in rows], pa.int64()) for i in range(4))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), after, made, leaves, renewed], ["doc_id", "n_tokens", "n_tokens_after", "n_edits", "n_leaves", "n_renewed"])

    kind = trees.schema["doc_id"].dataType.simpleString()
    return trees.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_tokens_after long, n_edits long, n_leaves long, n_renewed long")


def edited_trees(trees: DataFrame, propose: Callable[[str], list[Edit]] | None = None, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text, n_tokens and tree after the edits, stored: the table that the next round of edits begins from.

    A null text is empty from here on. Edits of the next round come from ``propose`` or are joined on by ``with_edits``.
    """
    _need_edits(trees, propose)
    path = vocabulary or tokens.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = tokens.memo(path)
        for b in batches:
            made = [spliced(text, Tree.unpacked(data), edits, memo) for text, data, edits in zip(_raw(b.column("text")), b.column("tree").to_pylist(), _given(b, propose), strict=True)]
            cols = [pa.array([t.decode() for t, _ in made], pa.string()), pa.array([t.sums.total for _, t in made], pa.int64()), binary_array([t.packed() for _, t in made])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "text", "n_tokens", "tree"])

    kind = trees.schema["doc_id"].dataType.simpleString()
    return materialise(trees.mapInArrow(run, f"doc_id {kind}, text string, n_tokens long, tree binary"), "trees", "zstd")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs``, or stored trees, with the edits of a table (doc_id, start, end, text) as a column; one document's edits are one list."""
    listed = edits.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text")).alias("edits"))
    kept = [c for c in ("n_tokens", "tree") if c in docs.columns]
    return docs.select("doc_id", "text", *kept).join(listed, "doc_id", "left")


_NOISE = re.compile(r"([*&%#$!])\1+|[ \t]{2,}")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+")


def cleaning(text: str) -> list[Edit]:
    """The edits of a plain cleaning step: runs of signs go, runs of blanks become one, addresses become a mark."""
    out = [(m.start(), m.end(), " " if m[0].isspace() else "") for m in _NOISE.finditer(text)]
    return out + [(m.start(), m.end(), "<email>") for m in _ADDRESS.finditer(text)] if "@" in text else out
