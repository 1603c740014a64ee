"""Exact n-gram Jaccard join of whole documents through a token-group matrix.

Documents are sets of 5-word shingles; two link when 4 * |intersection| >= 3 * |union| (a similarity of 0.75).

1. Documents with equal sets form a class; from here on a class is its smallest document.
2. Similar classes are put into groups: classes that share the minimum of one of four hash orders are compared with
   one hub each, so a family of thousands of near copies costs thousands of comparisons, not millions.
   Verified links give components; a group is a component with the unlinked classes around its hubs, cut into cells of bounded size.
3. The token-group matrix, in long form (token, cell): a class links to nothing in a cell unless one of the first quarter of its
   shingles, in one global order, is among those of the cell. Common shingles come last in that order, so shared
   passages rarely meet. The overlap of a class with a cell's tokens and the cell's sizes bound the similarity; only
   qualifying (class, cell) pairs are opened.
4. Opening a cell bounds the class once more by the union of the cell's whole sets; then the overlaps with all its
   members are counted exactly.

Counts go over whole texts and all documents. A wrong or missing entry of the list of common shingles can cost time,
never a link. Shingles are told apart by 64-bit hashes.

Edge cases: null or empty text has no shingles and is its own component; fewer words than five form one shingle; rows
that share an id are one node; a null id gets its class's component, or null; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.shared import NON_SPACE, TextBatch, binary_array, make_room, materialise, mix64, release

WIDTH, ORDERS = 5, 4
#: Shingles in a cell, and queries that meet one copy of it.
CELL, QUERIES = 200_000, 512
#: A shingle is common from so many documents on; of the common ones so many, the most frequent, are told to all tasks.
COMMON, COMMON_MOST = 50, 1 << 20
#: Tokens that a task gathers before it hands them on.
HELD = 1 << 18
_FACTORS = mix64(np.arange(11, 11 + WIDTH, dtype=np.uint64)) | np.uint64(1)
_SEEDS = mix64(np.arange(71, 71 + ORDERS, dtype=np.uint64))


def shingle_sets(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    make_room()
    for lo, hi, n_words, words, _, _ in TextBatch(column).words(NON_SPACE):
        full = max(0, len(words) - WIDTH + 1)
        mixed = np.zeros(full, np.uint64)
        for j in range(WIDTH):
            mixed += words[j : j + full] * _FACTORS[j]
        mixed = mix64(mixed)
        first = np.cumsum(n_words) - n_words
        for i in range(hi - lo):
            a, n = int(first[i]), int(n_words[i])
            if n >= WIDTH:
                yield np.unique(mixed[a : a + n - WIDTH + 1])
            elif n:
                yield mix64((words[a : a + n] * _FACTORS[:n]).sum(keepdims=True) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)


def prefix_length(n: int) -> int:
    """Two sets that link share one of the first so many elements of each, whatever the order."""
    return n - (3 * n + 3) // 4 + 1 if n else 0


class _Ranges:
    """Gathers numbers by their leading bits and hands them on as one blob for each range."""

    def __init__(self, bits: int) -> None:
        self.bits, self.parts, self.size = bits, [], 0

    def add(self, *columns: np.ndarray) -> bool:
        self.parts.append(columns)
        self.size += len(columns[0])
        return self.size >= max(HELD, 64 << self.bits)

    def take(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)] if self.parts else [np.zeros(0, np.uint64)]
        self.parts, self.size = [], 0
        order = np.argsort(columns[0], kind="stable")
        columns = [c[order] for c in columns]
        where = (columns[0] >> np.uint64(64 - self.bits)).astype(np.int64)
        ranges, first = np.unique(where, return_index=True)
        return ranges, columns, np.append(first, len(where))


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return binary_array([values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _range_bits(docs: DataFrame) -> int:
    """Ranges enough that what one of them holds stays small as the input, and so its partitions, grow."""
    return int(np.clip(np.ceil(np.log2(8 * max(1, docs.rdd.getNumPartitions()))), 8, 20))


def common_shingles(docs: DataFrame, bits: int) -> np.ndarray:
    """Leading ``bits + 32`` bits of shingles that many documents hold among their first two fifths; at most COMMON_MOST."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = _Ranges(bits), set()

        def emit() -> pa.RecordBatch:
            # a frequent shingle leaves a task as one counted entry, so no range grows with its documents
            ranges, (tokens,), cuts = held.take()
            new = np.ones(len(tokens), bool)
            new[1:] = tokens[1:] != tokens[:-1]
            first = np.flatnonzero(new)
            counts = np.diff(np.append(first, len(tokens))).astype(np.uint32)
            low, at = ((tokens[first] << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32), np.searchsorted(first, cuts)
            once, before = counts == 1, np.concatenate(([0], np.cumsum(counts == 1)))
            pairs = np.column_stack([low[~once], counts[~once]])
            return pa.RecordBatch.from_arrays([pa.array(ranges), _blobs(low[once], before[at]), _blobs(pairs, at - before[at])], ["r", "once", "more"])

        for b in batches:
            for s in shingle_sets(b.column(1)):
                if len(s):
                    pool = s[: 2 * len(s) // 5 + 1]
                    key = hash(pool.tobytes())
                    if key not in seen and (len(seen) > 1 << 17 or seen.add(key) is None) and held.add(pool):
                        yield emit()
        yield emit()

    def count(group: pa.Table) -> pa.Table:
        once = np.frombuffer(b"".join(group["once"].to_pylist()), np.uint32)
        more = np.frombuffer(b"".join(group["more"].to_pylist()), np.uint32).reshape(-1, 2)
        value, inverse = np.unique(np.concatenate([once, more[:, 0]]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([np.ones(len(once)), more[:, 1]]), len(value))
        often = n > COMMON
        r = np.full(int(often.sum()), group["r"][0].as_py(), np.int64)
        return pa.table({"t": (r << 32) | value[often].astype(np.int64), "n": n[often].astype(np.int64)})

    found = _texts(docs).mapInArrow(gather, "r long, once binary, more binary").groupBy("r").applyInArrow(count, "t long, n long")
    return np.sort(found.orderBy(F.desc("n"), "t").limit(COMMON_MOST).select("t").toArrow()["t"].to_numpy().astype(np.uint64))


def describe(docs: DataFrame) -> DataFrame:
    """Of each document: its number of shingles, a digest of the set, a key of the class, and the minimum of each hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, keys, least = [], [], [], []
            for s in shingle_sets(b.column(1)):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(class_key(digests[-1]) if len(s) else None)
                least.append([int(mix64(s ^ seed).min().view(np.int64)) for seed in _SEEDS] if len(s) else [None] * ORDERS)
            mins = [pa.array([m[k] for m in least], pa.int64()) for k in range(ORDERS)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.int64()), *mins], ["doc_id", "n", "d", "k", *(f"m{i}" for i in range(ORDERS))])

    return _texts(docs).mapInArrow(run, "doc_id long, n long, d binary, k long, " + ", ".join(f"m{i} long" for i in range(ORDERS)))


def class_key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def id_bitmaps(ids: DataFrame, bits: int = 22) -> DataFrame:
    """2**bits bits set by the hashes of ids, as 4 KB maps: half a megabyte at most, however many ids."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    return ids.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_map"))


def maybe_among(docs: DataFrame, maps: DataFrame, bits: int = 22) -> DataFrame:
    """``docs`` with ``_maybe``: false where the id is certainly not among those of the maps. No shuffle."""
    at = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << bits))
    bit = F.bitmap_bit_position(at)
    byte = F.expr("cast(conv(hex(substring(_map, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)")
    placed = docs.withColumns({"_bucket": F.bitmap_bucket_number(at), "_bit": bit}).join(F.broadcast(maps), "_bucket", "left")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0, F.lit(False))
    return placed.withColumn("_maybe", hit).drop("_bucket", "_bit", "_map")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents without these ids; only those that the bitmap cannot clear are shuffled."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    flagged = maybe_among(docs.select("doc_id", whole), id_bitmaps(ids))
    clear = flagged.where(~F.col("_maybe")).select("row")
    return clear.union(flagged.where("_maybe").join(ids, "doc_id", "left_anti").select("row")).select("row.*")


def open_cells(docs: DataFrame, members: DataFrame, queries: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of query documents with those of the members of the cells they are sent to.

    members and queries: (grp, sub, doc_id, comp). A cell's members meet at most about QUERIES queries in one run;
    further queries meet another copy of the members. Rows stream through sorted partitions, members first, so a task
    holds one cell's sets only. Of the links between what a run has already joined none is returned.
    """
    salts = queries.groupBy("grp", "sub").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("salts"))
    ids = members.select("doc_id").union(queries.select("doc_id")).distinct()
    texts = maybe_among(_texts(docs), id_bitmaps(ids)).where("_maybe").drop("_maybe")
    asked = queries.join(salts, ["grp", "sub"]).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    held = members.join(salts, ["grp", "sub"]).withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)")))
    columns: list[Column] = [F.col(c) for c in ("grp", "sub", "salt", "side", "doc_id", "comp", "text")]
    rows = held.withColumn("side", F.lit(0)).unionByName(asked.withColumn("side", F.lit(1))).join(texts, "doc_id").select(*columns)
    ordered = rows.repartition("grp", "sub", "salt").sortWithinPartitions("grp", "sub", "salt", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, Cell()
        for b in batches:
            out: list[tuple[int, int]] = []
            heads = zip(*(b.column(i).to_pylist() for i in range(6)), strict=True)
            for (*where, side, doc_id, comp), s in zip(heads, shingle_sets(b.column(6)), strict=True):
                if where != key:
                    key, cell = where, Cell()
                if side == 0:
                    cell.add(doc_id, comp, s)
                else:
                    out += cell.ask(doc_id, comp, s)
            if out:
                a, z = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


class Cell:
    """The sets of a cell's members as one sorted list of (shingle, member), and which components its links have joined."""

    def __init__(self) -> None:
        self.names: list[int] = []
        self.sets: list[np.ndarray] = []
        self.comps: list[int] = []
        self.above: dict[int, int] = {}
        self.ready = False

    def add(self, name: int, comp: int, shingles: np.ndarray) -> None:
        self.names.append(name)
        self.comps.append(comp)
        self.sets.append(shingles)

    def root(self, comp: int) -> int:
        while (up := self.above.get(comp, comp)) != comp:
            self.above[comp] = self.above.get(up, up)
            comp = up
        return comp

    def ask(self, name: int, comp: int, shingles: np.ndarray) -> list[tuple[int, int]]:
        if not self.ready:
            self.sizes = np.array([len(s) for s in self.sets])
            tokens = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
            order = np.argsort(tokens, kind="stable")
            self.tokens, self.owner = tokens[order], np.repeat(np.arange(len(self.sets)), self.sizes)[order]
            self.comp, self.sets, self.ready = np.array(self.comps), [], True
        first, n = np.searchsorted(self.tokens, shingles), np.searchsorted(self.tokens, shingles, side="right")
        n = n - first
        # what the union of the cell lacks no member has
        if 4 * np.count_nonzero(n) < 3 * len(shingles):
            return []
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        linked = np.flatnonzero(7 * both >= 3 * (len(shingles) + self.sizes))
        out = []
        for i in linked[np.unique(self.comp[linked], return_index=True)[1]].tolist():
            one, two = self.root(comp), self.root(int(self.comp[i]))
            if one != two:
                self.above[max(one, two)] = min(one, two)
                out.append((name, self.names[i]))
        return out


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of an edge list (a, b); comp is the smallest node that links reach.

    Each round takes the smallest label among neighbours and then the label of that label, so long chains shorten
    geometrically; rounds are written to the shared folder.
    """
    pairs = materialise(edges.union(edges.select("b", "a")).distinct(), "pairs")
    labels = materialise(pairs.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("comp")), "labels")
    while True:
        near = pairs.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        before = labels
        labels_next = materialise(low.join(jump, "next", "left").select("node", F.least("next", "far").alias("comp"), (F.least("next", "far") != F.col("comp")).alias("moved")), "labels")
        moved = labels_next.where("moved").limit(1).count()
        labels = labels_next.select("node", "comp")
        release(before)
        if not moved:
            release(pairs)
            return labels


def hub_pairs(classes: DataFrame) -> DataFrame:
    """(hub, c): each class with the smallest class that shares the minimum of a hash order and may be similar by size."""
    pairs = None
    for i in range(ORDERS):
        hubs = classes.groupBy(f"m{i}").agg(F.min(F.struct("c", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1")
        met = classes.join(hubs, f"m{i}").where("c <> hub.c and 4 * least(n, hub.n) >= 3 * greatest(n, hub.n)").select(F.col("hub.c").alias("hub"), "c")
        pairs = met if pairs is None else pairs.union(met)
    return materialise(pairs.distinct(), "hubs")


def hub_links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links between classes and their hubs: at most ORDERS comparisons a class."""
    queries = pairs.select(F.col("hub").alias("grp"), F.lit(0).alias("sub"), F.col("c").alias("doc_id"), F.col("c").alias("comp"))
    members = queries.select("grp", "sub").distinct().select("grp", "sub", F.col("grp").alias("doc_id"), F.col("grp").alias("comp"))
    return materialise(open_cells(docs, members, queries), "links")


def form_groups(classes: DataFrame, pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """(c, n, k, comp, grp, sub): every class in a cell of similar classes.

    A group is a component with the classes that have no link yet but whose hub lies in it; cells split it by hash into
    parts of about CELL shingles in all.
    """
    placed = classes.select("c", "n", "k").join(comps.withColumnRenamed("node", "c"), "c", "left")
    near = pairs.groupBy("c").agg(F.min("hub").alias("hub")).join(comps.select(F.col("node").alias("hub"), F.col("comp").alias("of_hub")), "hub", "left")
    grouped = placed.join(near, "c", "left").select("c", "n", "k", F.coalesce("comp", "c").alias("comp"), F.coalesce("comp", "of_hub", "hub", "c").alias("grp"))
    sizes = grouped.groupBy("grp").agg(F.ceil(F.sum("n") / CELL).alias("cells")).where("cells > 1")
    sub = F.pmod(F.xxhash64("c"), F.coalesce("cells", F.lit(1))).cast("int")
    return materialise(grouped.join(sizes, "grp", "left").select("c", "n", "k", "comp", "grp", sub.alias("sub")), "nodes")


def postings(docs: DataFrame, common: np.ndarray, bits: int) -> DataFrame:
    """(t, k): the prefix shingles of classes, as far as two classes or more have them.

    Shingles meet by ranges of their hashes; common ones, which many classes have anyway, by ranges of their class's
    key, so no range grows with the number of classes that share a passage.
    """
    flags = np.zeros(1 << 20, bool)
    flags[(common >> np.uint64(bits + 32 - 20)).astype(np.int64)] = True
    told = docs.sparkSession.sparkContext.broadcast((common, flags))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (often, near), rare, frequent, seen = told.value, _Ranges(bits), _Ranges(bits), set()

        def emit(held: _Ranges) -> pa.RecordBatch:
            if not held.size:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), binary_array([]), binary_array([])], ["r", "tokens", "keys"])
            ranges, (by, other), cuts = held.take()
            if held is frequent:
                return pa.RecordBatch.from_arrays([pa.array(ranges + (1 << bits)), _blobs(other, cuts), _blobs(by, cuts)], ["r", "tokens", "keys"])
            return pa.RecordBatch.from_arrays([pa.array(ranges), _blobs(by, cuts), _blobs(other, cuts)], ["r", "tokens", "keys"])

        for b in batches:
            for s in shingle_sets(b.column(1)):
                if not len(s):
                    continue
                key = class_key(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if key in seen:
                    continue
                if len(seen) < 1 << 17:
                    seen.add(key)
                p, n_rare = prefix_length(len(s)), len(s)
                maybe = np.flatnonzero(near[(s >> np.uint64(44)).astype(np.int64)]) if len(often) else []
                if len(maybe):
                    lead = s[maybe] >> np.uint64(32 - bits)
                    where = np.minimum(np.searchsorted(often, lead), len(often) - 1)
                    is_common = np.zeros(len(s), bool)
                    is_common[maybe] = often[where] == lead
                    s, n_rare = np.concatenate([s[~is_common], s[is_common]]), len(s) - int(is_common.sum())
                n_rare = min(p, n_rare)
                if rare.add(s[:n_rare], np.full(n_rare, key, np.int64)):
                    yield emit(rare)
                if p > n_rare and frequent.add(np.full(p - n_rare, key, np.int64).view(np.uint64), s[n_rare:p]):
                    yield emit(frequent)
        yield emit(rare)
        yield emit(frequent)

    def meet(group: pa.Table) -> pa.Table:
        tokens = np.frombuffer(b"".join(group["tokens"].to_pylist()), np.uint64)
        keys = np.frombuffer(b"".join(group["keys"].to_pylist()), np.int64)
        order = np.lexsort((keys, tokens))
        tokens, keys = tokens[order], keys[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
        tokens, keys = tokens[new], keys[new]
        same = tokens[1:] == tokens[:-1]
        shared = np.full(len(tokens), group["r"][0].as_py() >= 1 << bits)
        shared[1:] |= same
        shared[:-1] |= same
        return pa.table({"t": tokens[shared].view(np.int64), "k": keys[shared]})

    return _texts(docs).mapInArrow(gather, "r long, tokens binary, keys binary").groupBy("r").applyInArrow(meet, "t long, k long")


def qualifying(matrix: DataFrame) -> DataFrame:
    """(grp, sub, doc_id, comp): classes to be compared with cells that hold classes of components of smaller number.

    matrix: (t, c, n, comp, grp, sub). A class and a member that link share at least one prefix shingle; with s shared
    ones their overlap is below s + 3/4 of the larger set, and a link asks for 3/7 of both.
    """
    cells = matrix.groupBy("t", "grp", "sub").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("least"))
    met = matrix.select("t", "c", "n", "comp").join(cells, "t").where("least < comp and 4 * hi >= 3 * n and 3 * lo <= 4 * n")
    seen = met.groupBy("c", "n", "comp", "grp", "sub").agg(F.count("*").alias("shared"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    low, high = F.greatest("lo", F.ceil(F.col("n") * 3 / 4)), F.least("hi", F.floor(F.col("n") * 4 / 3))

    def possible(m: Column) -> Column:
        return F.col("shared") + F.ceil(F.greatest(F.col("n"), m) * 3 / 4) >= F.ceil((F.col("n") + m) * 3 / 7)

    return seen.where(possible(low) | possible(high)).select("grp", "sub", F.col("c").alias("doc_id"), "comp")


def link(docs: DataFrame, repeated_ids: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of every row of ``docs``; where no id is repeated the look for such can be left out."""
    bits = _range_bits(docs)
    described = materialise(describe(docs), "described")
    classes = materialise(
        described.where("n > 0")
        .groupBy("d")
        .agg(F.min("doc_id").alias("c"), F.min("n").alias("n"), F.min("k").alias("k"), *(F.min(f"m{i}").alias(f"m{i}") for i in range(ORDERS)))
        .where("c is not null"),
        "classes",
    )
    pairs = hub_pairs(classes)
    near = hub_links(docs, pairs)
    nodes = form_groups(classes, pairs, components(near))
    shared = materialise(postings(docs, common_shingles(docs, bits), bits).join(nodes, "k").select("t", "c", "n", "comp", "grp", "sub"), "postings")
    across = shared.groupBy("t").agg(F.min("comp").alias("one"), F.max("comp").alias("two")).where("one <> two").select("t")
    queries = materialise(qualifying(shared.join(across, "t", "left_semi")), "qualifying")
    members = nodes.select("grp", "sub", F.col("c").alias("doc_id"), "comp").join(queries.select("grp", "sub").distinct(), ["grp", "sub"], "left_semi")
    links = near.union(open_cells(docs, members, queries))
    if repeated_ids:
        several = described.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("doc_id")
        texts = described.select("doc_id", "d").join(materialise(several, "several"), "doc_id", "left_semi").join(classes.select("d", "c"), "d")
        links = links.union(texts.where("doc_id <> c").select("doc_id", "c").distinct())
    reached = components(links)
    release(pairs, near, nodes, shared, queries)
    final = classes.select("d", "c").join(reached.withColumnRenamed("node", "c"), "c", "left").select("d", "c", F.coalesce("comp", "c").alias("comp"))
    return described.join(final, "d", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"), F.coalesce("c", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with one row left of each component of texts: that of the smallest id.

    Rows are told apart by their number in a written copy, so repeated rows, rows without an id and different texts of
    one id are each judged by their own text. Of rows with equal ids the first counts, rows without an id come
    last. Texts without a shingle are one document where they share an id.
    """
    own = "_id_before_numbering"
    names = [own if c == "doc_id" else c for c in docs.columns]
    numbered = materialise(docs.withColumnRenamed("doc_id", own).withColumn("doc_id", F.monotonically_increasing_id()), "numbered")
    linked = link(numbered, repeated_ids=False).join(numbered.select("doc_id", own), "doc_id")
    rows = materialise(linked.select("doc_id", own, F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("comp")), "rows")
    # an id stands for a text only where there is none
    group = [F.col("comp"), F.when(F.col("comp").isNull(), F.col(own)), F.when(F.col("comp").isNull() & F.col(own).isNull(), F.col("doc_id"))]
    first = rows.groupBy(*(g.alias(f"g{i}") for i, g in enumerate(group))).agg(F.min(F.struct(F.col(own).isNull().alias("none"), F.col(own), F.col("doc_id"))).alias("first"))
    gone = materialise(rows.select("doc_id").join(first.select("first.doc_id"), "doc_id", "left_anti"), "gone")
    return without(numbered, gone).select(*(F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns, strict=True)))
