"""Trie of conversation prefixes by adaptive radix trees.

A turn (role, text) has an id of fixed width, 16 bytes of the SHA-256 of its role and text in big-endian order; a
conversation is the bytes of its turns' ids. Conversations are sorted by these bytes over all tasks, so that the members
of any prefix lie side by side. Each task cuts its run into blocks of bounded size and puts each into an adaptive radix tree:
nodes of 4, 16, 48 and 256 places that grow when full, with paths of single children compressed to bytes. Only places at
whole turns are nodes of the trie; those inside an id are not.

A node whose members lie inside one block is finished there, with its subtree. Only nodes on the path of a block's first or last
conversation are open: they may go on in the next block. Open nodes are merged by their path, a few for each block, and their
subtree sums come from doubling of parent pointers. So a first turn, or a whole conversation, that a third of all rows
share is spread over blocks; no group is gathered in one task.

Edge cases: rows without conv_id take no part; null role or text is empty; turns go by number, null first, and turns of one
number by their ids, so repeated rows stay repeated; a conversation without turns ends at the root; an empty table gives no
rows, as the root would have no member. A conversation is one row of 16 bytes a turn, as a document is one text.
Further columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.shared import materialise

#: Bytes of a turn's id.
WIDTH = 16
#: Turns of a block, at which it is closed; a longer conversation is a block of its own. Bounds the memory of a tree.
BLOCK_TURNS = 1 << 16
#: The first turns of every fifth conversation go before its neighbours' own: at most so many.
SHARED = 5
MOST_SHARED = 9


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes) of rows (conv_id, turn, role, text): ids of the turns in hex, and the bytes of their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    one = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), F.substring(F.sha2(told.cast("binary"), 256), 1, 2 * WIDTH).alias("id"), F.octet_length(text).cast("long").alias("size")).alias("t"),
    )
    return one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def branched(convs: DataFrame) -> DataFrame:
    """Conversations rebuilt: the first h turns of the conversation c - c % 5, then c's own after its first h; h is the
    CRC-32 of c as text, modulo 9."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED)).cast("int")
    own = convs.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"))
    first = convs.where(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("base"), *(F.slice(c, 1, MOST_SHARED).alias(f"first_{c}") for c in ("ids", "sizes")))
    both = own.join(first, "base", "left")

    def put(c: str) -> Column:
        begun = F.slice(F.coalesce(F.col(f"first_{c}"), F.slice(c, 1, 0)), F.lit(1), F.col("h"))
        return F.concat(begun, F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))).alias(c)

    return both.select("conv_id", put("ids"), put("sizes"))


class Few:
    """Up to 4 or 16 children: sorted bytes beside their nodes."""

    __slots__ = ("keys", "nodes", "room")

    def __init__(self, room: int = 4) -> None:
        self.keys, self.nodes, self.room = bytearray(), [], room

    def get(self, b: int) -> Node | None:
        at = self.keys.find(b)
        return None if at < 0 else self.nodes[at]

    def put(self, b: int, node: Node) -> Few | Many | Full:
        at = bisect_left(self.keys, b)
        if at < len(self.keys) and self.keys[at] == b:
            self.nodes[at] = node
            return self
        if len(self.keys) == self.room:
            return self.grown().put(b, node)
        self.keys.insert(at, b)
        self.nodes.insert(at, node)
        return self

    def grown(self) -> Few | Many:
        if self.room == 4:
            wide = Few(16)
            wide.keys, wide.nodes = self.keys, self.nodes
            return wide
        many = Many()
        for b, node in zip(self.keys, self.nodes, strict=True):
            many.put(b, node)
        return many

    def all(self) -> Iterator[Node]:
        return iter(self.nodes)


class Many:
    """Up to 48 children: a place for each byte that tells where its node is."""

    __slots__ = ("index", "nodes")
    ROOM = 48

    def __init__(self) -> None:
        self.index, self.nodes = bytearray(256), []

    def get(self, b: int) -> Node | None:
        at = self.index[b]
        return self.nodes[at - 1] if at else None

    def put(self, b: int, node: Node) -> Many | Full:
        if self.index[b]:
            self.nodes[self.index[b] - 1] = node
        elif len(self.nodes) == self.ROOM:
            full = Full()
            for k, at in enumerate(self.index):
                if at:
                    full.put(k, self.nodes[at - 1])
            return full.put(b, node)
        else:
            self.nodes.append(node)
            self.index[b] = len(self.nodes)
        return self

    def all(self) -> Iterator[Node]:
        return (self.nodes[at - 1] for at in self.index if at)


class Full:
    """A place for each of 256 children."""

    __slots__ = ("nodes",)

    def __init__(self) -> None:
        self.nodes: list[Node | None] = [None] * 256

    def get(self, b: int) -> Node | None:
        return self.nodes[b]

    def put(self, b: int, node: Node) -> Full:
        self.nodes[b] = node
        return self

    def all(self) -> Iterator[Node]:
        return (n for n in self.nodes if n is not None)


class Node:
    """The bytes of a path without branches, who ends after them, and the children by their next byte."""

    __slots__ = ("path", "ends", "children")

    def __init__(self, path: bytes) -> None:
        self.path, self.ends, self.children = path, [], None


def _alike(path: bytes, key: bytes, at: int) -> int:
    """How many bytes of ``path`` the key goes on with."""
    if key.startswith(path, at):
        return len(path)
    low, high = 0, min(len(path), len(key) - at)
    while low < high:  # the first `low` bytes are alike, those up to `high` may be
        mid = (low + high + 1) // 2
        if path[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Tree:
    """An adaptive radix tree over keys of bytes."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes, name: int) -> None:
        node, above, at = self.root, None, 0
        while True:
            same = _alike(node.path, key, at)
            if same < len(node.path):
                upper = Node(node.path[:same])
                upper.children = Few().put(node.path[same], node)
                node.path = node.path[same + 1 :]
                above.children = above.children.put(key[at - 1], upper)
                node = upper
            at += same
            if at == len(key):
                node.ends.append(name)
                return
            down = node.children.get(key[at]) if node.children else None
            if down is None:
                leaf = Node(key[at + 1 :])
                leaf.ends.append(name)
                node.children = (node.children or Few()).put(key[at], leaf)
                return
            node, above, at = down, node, at + 1


class Found:
    """A node of the trie inside a block; lo and hi are the places of its first and last member."""

    __slots__ = ("depth", "conv", "parent", "up", "n", "children", "leaves", "saved", "inside", "size", "ends", "lo", "hi")


def block_nodes(names: list[int], keys: list[bytes], sizes: list[list[int]], width: int = WIDTH) -> list[Found]:
    """Nodes of the trie of sorted conversations, with their counts inside this block.

    ``leaves`` and ``saved`` are of the whole subtree, ``inside`` holds (children, leaves, saved) of finished children alone.
    """
    tree, last = Tree(), len(keys) - 1
    for i, key in enumerate(keys):
        tree.insert(key, i)
    out: list[Found] = []
    stack: list[list] = [[tree.root, 0, None, [], 0, -1, 0, 0]]  # node, bytes above, children to come, tops, n, lo, hi, smallest id
    while stack:
        frame = stack[-1]
        node, above = frame[0], frame[1]
        end = above + len(node.path)
        if frame[2] is None:
            frame[2] = node.children.all() if node.children else iter(())
            if node.ends:
                frame[4], frame[5], frame[6], frame[7] = len(node.ends), node.ends[0], node.ends[-1], names[node.ends[0]]
        down = next(frame[2], None)
        if down is not None:
            stack.append([down, end + 1, None, [], 0, -1, 0, 0])
            continue
        stack.pop()
        _, _, _, tops, n, lo, hi, smallest = frame
        # aligned places after the parent's last byte, deepest first; the root has that of no byte
        first = above + -above % width
        for place in range(end - end % width, first - 1, -width):
            tops = [_one(place // width, smallest, n, lo, hi, tops, sizes, node.ends if place == end else [], last, names)]
            out.append(tops[0])
        if stack:
            up = stack[-1]
            up[3].extend(tops)
            if not up[4]:
                up[5], up[6], up[7] = lo, hi, smallest
            else:
                up[5], up[6], up[7] = min(up[5], lo), max(up[6], hi), min(up[7], smallest)
            up[4] += n
    return out


def _one(depth: int, smallest: int, n: int, lo: int, hi: int, below: list[Found], sizes: list[list[int]], ends: list[int], last: int, names: list[int]) -> Found:
    f = Found()
    f.depth, f.conv, f.parent, f.up, f.n, f.lo, f.hi, f.children = depth, smallest, None, None, n, lo, hi, len(below)
    f.size = sizes[lo][depth - 1] if depth else 0
    f.leaves, f.saved = (sum(b.leaves for b in below) or 1), sum(b.saved for b in below) + (n - 1) * f.size
    shut = [b for b in below if b.lo != 0 and b.hi != last]
    f.inside = (len(shut), sum(b.leaves for b in shut), sum(b.saved for b in shut))
    f.ends = ",".join(str(names[i]) for i in ends) if ends else None
    for b in below:
        b.parent, b.up = smallest, f
    return f


def _digests(key: bytes) -> list[bytes]:
    """A digest of each whole-turn prefix of a key."""
    h = hashlib.sha256()
    out = [h.digest()[:WIDTH]]
    for at in range(0, len(key), WIDTH):
        h.update(key[at : at + WIDTH])
        out.append(h.copy().digest()[:WIDTH])
    return out


ROWS = pa.schema(
    [("block", pa.int64()), ("open", pa.bool_()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n", "children", "leaves", "saved", "size")]
    + [("ends", pa.string())]
)
ROWS_SQL = "block long, open boolean, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n long, children long, leaves long, saved long, size long, ends string"


def _rows(block: int, names: list[int], keys: list[bytes], sizes: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """One row a node. Of an open node: its path's digest, what finished children add, and a piece of its list of ends.
    Of a finished one: its results; ``parent`` is set where the parent is open."""
    last = len(keys) - 1
    left, right = _digests(keys[0]), _digests(keys[-1])

    def path(f: Found) -> bytes | None:
        return left[f.depth] if f.lo == 0 else right[f.depth] if f.hi == last else None

    out: list[tuple] = []
    for f in block_nodes(names, keys, sizes):
        own, above = path(f), path(f.up) if f.up else None
        if own is None:
            ends = hashlib.sha256((f.ends or "").encode()).hexdigest()
            out.append((block, False, None, above, f.depth, f.conv, None if above else f.parent, f.n, f.children, f.leaves, f.saved, f.size, ends))
        else:
            out.append((block, True, own, above, f.depth, f.conv, None, f.n, *f.inside, f.size, f.ends))
        if len(out) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ROWS.types, strict=True)], schema=ROWS)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ROWS.types, strict=True)], schema=ROWS)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's sorted conversations; their numbers rise through the table."""
    number, turns = 0, 0
    names: list[int] = []
    keys: list[bytes] = []
    sizes: list[list[int]] = []
    part = 0
    for b in batches:
        for name, key, size, part in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):  # noqa: B007
            if keys and turns + len(size) > BLOCK_TURNS:
                yield from _rows((part << 32) + number, names, keys, sizes)
                number, turns, names, keys, sizes = number + 1, 0, [], [], []
            names.append(name)
            keys.append(key)
            sizes.append(size)
            turns += len(size) + 1
    if keys:
        yield from _rows((part << 32) + number, names, keys, sizes)


def _digest_of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) of rows (node, piece) sorted by node and place; one running hash, whatever a list's length."""
    node, h, got = None, None, False
    done: list[tuple[bytes, str]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])

    for b in batches:
        for own, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if own != node:
                if h is not None:
                    done.append((node, h.hexdigest()))
                node, h, got = own, hashlib.sha256(), False
            if got:
                h.update(b",")
            h.update(piece.encode())
            got = True
        if done:
            yield batch()
            done = []
    if h is not None:
        done.append((node, h.hexdigest()))
        yield batch()


def _with_subtrees(tree: DataFrame) -> DataFrame:
    """(node, leaves, saved) summed over subtrees, of rows (node, parent, leaves, saved) that are one tree.

    After round k a row holds the sums of what is less than 2^k below it and points 2^k above, so the rounds are the
    logarithm of the depth.
    """
    now = tree.select("node", F.col("parent").alias("up"), "leaves", "saved")
    while now.where("up is not null").limit(1).count():
        below = now.where("up is not null").groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")).withColumnRenamed("up", "node")
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next"))
        told = now.join(below, "node", "left").join(above, "up", "left")
        now = materialise(told.select("node", F.col("next").alias("up"), *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved"))), "trie-sums")
    return now.select("node", "leaves", "saved")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie of
    conversations (conv_id, ids, sizes)."""
    keyed = convs.select("conv_id", F.unhex(F.array_join("ids", "")).alias("key"), "sizes")
    spread = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id().cast("long"))
    made = materialise(spread.mapInArrow(_block_rows, ROWS_SQL), "trie-nodes")
    seen = made.where("open")
    sums = {c: F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")}
    merged = seen.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("size").alias("size"), F.max("parent").alias("parent"), *sums.values())
    merged = materialise(merged, "trie-open")
    kids = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    tree = merged.join(kids, "node", "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0)))
    leaf = F.when(F.col("children") == 0, 1).otherwise(0)
    tree = materialise(tree.withColumn("leaves", F.col("leaves") + leaf).withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("size")), "trie-tree")
    pieces = seen.where("ends is not null").select("node", "ends", "block").repartition("node").sortWithinPartitions("node", "block").select("node", "ends")
    digests = pieces.mapInArrow(_digest_of_pieces, "node binary, ends_sha256 string")
    up = tree.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    opened = (
        tree.drop("leaves", "saved")
        .join(_with_subtrees(tree), "node")
        .join(digests, "node", "left")
        .join(up, "parent", "left")
        .withColumn("ends", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    )
    # a finished child of an open node finds it among the open nodes of its own block, so no key has more rows than a block
    parents = seen.select("block", "node").join(tree.select("node", F.col("conv_id").alias("above")), "node").select("block", F.col("node").alias("parent"), "above")
    shut = made.where(~F.col("open")).join(parents, ["block", "parent"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    names = {"conv_id": "conv_id", "depth": "depth", "parent_conv_id": "parent_conv_id", "n": "n_convs", "children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens", "ends": "ends_sha256"}
    out = [F.col(a).alias(b) for a, b in names.items()]
    return opened.select(*out).unionByName(shut.select(*out))


def trie_of(turns: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations of a table (conv_id, turn, role, text)."""
    return prefix_trie(branched(conversations_of(turns)))
