"""Pairs of short reads within one or two edits, where reads are so many that most of their neighbours exist.

The shorter of two reads is cut into ``most`` + 1 segments, of which one is untouched. Reads are dealt out by segments, a few rows
each, and a task that holds a group looks the variants of its reads up among them. Each pair is found in one group only: behind an
equal first segment; else before an equal last one; else, of three, around an equal middle one, with one edit on either
side. So neither candidates nor edges are shuffled, and how many rows are follows the reads, whatever the edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.operators.storage import stored

LETTERS = "ACGTN"
#: Rows of a group that one task holds; a larger one is dealt into parts that meet each other.
BLOCK = 1 << 17
#: Rows whose variants are looked up at once.
STEP = 1 << 10
#: Pairs of a group up to which all are compared, as that is cheaper than variants.
FEW = 1 << 13
#: Rows of a returned batch.
BATCH = 1 << 18
#: Letters up to which a read is a number of 32 bits (``codes``).
CODED = 15
#: Pairs whose neighbours are compared at once.
WALK = 1 << 12
#: Of a row: both sides of the pairs of one length, or the side that is looked up only; asked rows have the number of their way.
BOTH, OWN = -1, -2
#: (letters more, segment, its shift) in which a read is asked for; the first are those of its own segments.
WAYS = {
    1: [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 1)],
    2: [(0, 0, 0), (0, 1, 0), (0, 2, 0), (0, 1, 1), (1, 0, 0), (1, 2, 1), (1, 1, 0), (1, 1, 1), (2, 0, 0), (2, 2, 2), (2, 1, 1)],
}


def _code(letters: np.ndarray, bits: int) -> np.ndarray:
    """The letters of each row as one number; the first letter is lowest."""
    return (letters.astype(np.int64) << (bits * np.arange(letters.shape[1], dtype=np.int64))).sum(axis=1, dtype=np.int64)


def _others(letter: np.ndarray, q: int) -> list[np.ndarray]:
    return [(letter + x) % q for x in range(1, q)]


def _substituted(letters: np.ndarray, q: int, bits: int) -> list[list[np.ndarray]]:
    """For each place what other letters there add to the number."""
    wide = letters.astype(np.int64)
    return [[(new - wide[:, p]) << (bits * p) for new in _others(wide[:, p], q)] for p in range(wide.shape[1])]


def _inserted(letters: np.ndarray, q: int, bits: int, places: list[int] | None = None) -> list[np.ndarray]:
    """Numbers with a letter put in; before an equal letter is left out, as it is behind it too."""
    wide, made = letters.astype(np.int64), []
    for p in places if places is not None else range(wide.shape[1] + 1):
        low, high = _code(wide[:, :p], bits), _code(wide[:, p:], bits) << (bits * (p + 1))
        news = _others(wide[:, p], q) if p < wide.shape[1] else [np.full(len(wide), x) for x in range(q)]
        made += [low + high + (new << (bits * p)) for new in news]
    return made


def variants(letters: np.ndarray, less: int, most: int, q: int, bits: int) -> dict[int, list[np.ndarray]]:
    """By edits, at most ``most``: numbers of what rows of letters become when ``less`` letters fewer are left."""
    n = letters.shape[1]
    cut = lambda *ps: np.delete(letters, ps, axis=1)
    if less == -1:
        return {1: _inserted(letters, q, bits)} if most else {}
    if less == 2:
        return {2: [_code(cut(*ps), bits) for ps in combinations(range(n), 2)]} if most >= 2 else {}
    if less == 1:
        made: dict[int, list[np.ndarray]] = {1: [], 2: []}
        for p in range(n) if most else ():
            left = cut(p)
            code = _code(left, bits)
            made[1].append(code)
            if most > 1:
                made[2] += [code + x for xs in _substituted(left, q, bits) for x in xs]
        return made
    code, subs = _code(letters, bits), _substituted(letters, q, bits)
    made = {0: [code], 1: [code + x for xs in subs for x in xs] if most else [], 2: []}
    if most > 1:
        made[2] = [code + x + y for xs, ys in combinations(subs, 2) for x in xs for y in ys]
        for p in range(n):  # nearer places than two apart change two letters at most
            made[2] += _inserted(cut(p), q, bits, [i for i in range(n) if abs(i - p) > 1])
    return made


class Own:
    """The rows of a group that are looked up, by the number of their letters outside the segment."""

    def __init__(self, codes: np.ndarray, width: int) -> None:
        self.dense = 1 << width <= max(1 << 16, 32 * len(codes)) and width <= 24
        if self.dense:
            self.at = np.full(1 << width, -1, dtype=np.int32)
            self.at[codes] = np.arange(len(codes), dtype=np.int32)
        else:
            self.order = np.argsort(codes)
            self.codes = codes[self.order]

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``codes`` of numbers that there are, and their rows."""
        if self.dense:
            rows = self.at[codes]
            hit = np.flatnonzero(rows >= 0)
            return hit, rows[hit].astype(np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = np.flatnonzero(self.codes[at] == codes)
        return hit, self.order[at[hit]]


def _less_one(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Which rows of letters become those of ``shorter`` when one letter goes."""
    n = shorter.shape[1]
    if not n:
        return np.ones(len(shorter), dtype=bool)
    before = np.cumprod(longer[:, :n] == shorter, axis=1).sum(axis=1)
    after = np.cumprod((longer[:, 1:] == shorter)[:, ::-1], axis=1).sum(axis=1)
    return before + after >= n


def _elsewhere(a: np.ndarray, b: np.ndarray, later: np.ndarray, way: tuple[int, int, int], cuts: list[int]) -> np.ndarray:
    """Which pairs of letters, a own and b asked, another group has too, and is the one to give."""
    less, segment, shift = way
    n, parts = cuts[-1], len(cuts) - 1
    if segment == 0:
        return np.zeros(len(a), dtype=bool)
    same = lambda x, y: (x == y).all(axis=1)
    known = same(a[:, : cuts[1]], b[:, : cuts[1]])
    if segment == parts - 1:
        return known
    begin, end = cuts[1], cuts[2]
    known |= same(a[:, end:], b[:, end + less :])
    middle = same(a[:, begin:end], b[:, begin:end])
    if (less, shift) == (0, 1):
        known |= middle & ((a != b).sum(axis=1) <= 2)
        # either may be the one that is asked for; where both are found so, the one of the smaller number is own
        turned = same(b[:, begin:end], a[:, begin + 1 : end + 1])
        known |= later & turned & _less_one(a[:, : begin + 1], b[:, :begin]) & _less_one(b[:, end:], a[:, end + 1 :])
    if (less, shift) == (1, 1):
        known |= middle & ((a[:, :begin] != b[:, :begin]).sum(axis=1) == 1) & _less_one(b[:, end:], a[:, end:])
    return known


def _edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The edit distance of each row of letters to the other's."""
    last = [np.full(len(a), j, dtype=np.int16) for j in range(b.shape[1] + 1)]
    for i in range(a.shape[1]):
        now = [np.full(len(a), i + 1, dtype=np.int16)]
        for j in range(b.shape[1]):
            now.append(np.minimum(np.minimum(now[j], last[j + 1]) + 1, last[j] + (a[:, i] != b[:, j])))
        last = now
    return last[-1]


def met(own: np.ndarray, asked: np.ndarray, own_vid: np.ndarray, asked_vid: np.ndarray, way: tuple[int, int, int], cuts: list[int], most: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of own, row of asked, edits) of the pairs that this group is to give; letters are numbers below ``q``."""
    less, segment, shift = way
    bits, n = (2 if q <= 4 else 3), cuts[-1]
    begin, end = cuts[segment], cuts[segment + 1]
    middle = 0 < segment < most
    if len(own) * len(asked) <= FEW:
        a, b = (x.ravel() for x in np.indices((len(own), len(asked))))
        keep = own_vid[a] < asked_vid[b] if (less, shift) == (0, 0) else own_vid[a] != asked_vid[b]
        a, b = a[keep], b[keep]
        one, two = _edits(own[a, :begin], asked[b, : begin + shift]), _edits(own[a, end:], asked[b, end + shift :])
        keep = (one == 1) & (two == 1) if middle else (one + two >= 1) & (one + two <= most)
        a, b, weight = a[keep], b[keep], (one + two)[keep].astype(np.int64)
        keep = ~_elsewhere(own[a], asked[b], own_vid[a] > asked_vid[b], way, cuts)
        yield a[keep], b[keep], weight[keep]
        return
    known = Own(_code(np.concatenate([own[:, :begin], own[:, end:]], axis=1), bits), bits * (n - end + begin))
    for at in range(0, len(asked), STEP):
        some = asked[at : at + STEP]
        left, right = (variants(x, d, 1 if middle else most, q, bits) for x, d in ((some[:, : begin + shift], shift), (some[:, end + shift :], less - shift)))
        keys = []
        for one, lefts in left.items():
            for two, rights in right.items():
                if not lefts or not rights or not 1 <= one + two <= most or (middle and (one, two) != (1, 1)):
                    continue
                few, many = sorted([lefts, [x << (bits * begin) for x in rights]], key=len)
                many = np.stack(many)
                for other in few:
                    hit, row = known.find((many + other).ravel())
                    keys.append(((row * len(some) + hit % len(some)) << 1) | (one + two - 1))
        found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
        pair = found >> 1
        fresh = np.ones(len(pair), dtype=bool)
        fresh[1:] = pair[1:] != pair[:-1]
        a, b, weight = pair[fresh] // len(some), pair[fresh] % len(some) + at, (found[fresh] & 1) + 1
        keep = own_vid[a] < asked_vid[b] if (less, shift) == (0, 0) else own_vid[a] != asked_vid[b]
        a, b, weight = a[keep], b[keep], weight[keep]
        keep = ~_elsewhere(own[a], asked[b], own_vid[a] > asked_vid[b], way, cuts)
        yield a[keep], b[keep], weight[keep]


class Shared:
    """Whether two rows have a key in common: bits of the keys there are, or, of many keys, one by one."""

    def __init__(self, column: pa.ListArray) -> None:
        sizes = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy()
        keys, number = np.unique(flat, return_inverse=True)
        row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.bits = len(keys) <= 512
        if self.bits:
            self.has = np.zeros((len(sizes), max(1, -(-len(keys) // 64))), dtype=np.uint64)
            np.bitwise_or.at(self.has, (row, number >> 6), np.uint64(1) << (number & 63).astype(np.uint64))
        else:
            self.has = np.full((len(sizes), sizes.max(initial=0)), -1, dtype=np.int64)
            self.has[row, place] = number

    def any(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.bits:
            return (self.has[a] & self.has[b]).any(axis=1)
        out = np.zeros(len(a), dtype=bool)
        for i in range(self.has.shape[1]):
            own = self.has[a, i]
            for j in range(self.has.shape[1]):
                out |= (own == self.has[b, j]) & (own >= 0)
        return out


def codes(seq: Column) -> Column:
    """Reads of up to CODED letters A, C, G, T as numbers: two bits a letter, the first lowest, and a one above the last."""
    return F.conv(F.concat(F.lit("1"), F.translate(F.reverse(seq), "ACGT", "0123")), 4, 10).cast("int")


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which numbers of ``codes`` are of reads at most one edit apart."""
    apart = x ^ y
    letters = (apart | (apart >> np.uint32(1))) & np.uint32(0x55555555)
    first = letters & (~letters + np.uint32(1))  # the first letter that differs
    same = (letters == first) & (apart < x) & (apart < y)  # marks of equal lengths cancel out
    # with a letter left out of the longer one, nothing differs from there on, and the marks meet
    return same | (((x >> np.uint32(2)) ^ y) < np.minimum(first, y)) | (((y >> np.uint32(2)) ^ x) < np.minimum(first, x))


class Walks:
    """Whether two rows have neighbours (lists of ``codes``) that are the same read, or one edit apart: walks of two and three edges."""

    def __init__(self, column: pa.ListArray) -> None:
        offsets = column.offsets.to_numpy().astype(np.int64)
        self.start, self.size = offsets[:-1] - offsets[0], np.diff(offsets)
        self.flat = column.flatten().to_numpy().astype(np.uint32)

    def joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        # neighbours of the row that has fewer are taken one after the other; pairs that have met leave
        fewer = self.size[a] <= self.size[b]
        few, many = np.where(fewer, a, b), np.where(fewer, b, a)
        order = np.flatnonzero(self.size[few] > 0)
        order = order[np.argsort(self.size[many[order]], kind="stable")]
        for at in range(0, len(order), WALK):
            rows = order[at : at + WALK]
            one, two = few[rows], many[rows]
            wide = np.arange(self.size[two[-1]])
            others = self.flat[self.start[two][:, None] + np.minimum(wide, self.size[two][:, None] - 1)]
            step = 0
            while len(rows):
                hit = _close(self.flat[self.start[one] + step][:, None], others).any(axis=1)
                out[rows[hit]] = True
                step += 1
                stay = ~hit & (self.size[one] > step)
                rows, one, others = rows[stay], one[stay], others[stay]
        return out


def _group(most: int, least: int, schemes: int, walks: bool, key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, dst, weight, kept) of a group (n, segment, ...) of rows (vid, rest, way, keys...); with ``walks`` pairs of weight 2 are
    given only where a walk joins the neighbours of their ends (near)."""
    table = pa.Table.from_batches(list(batches)).combine_chunks()
    if table.num_rows < 2:
        return
    n, segment = key[0].as_py(), key[1].as_py()
    cuts = [i * n // (most + 1) for i in range(most + 2)]
    way, vid = table["way"].to_numpy(), table["vid"].to_numpy()
    own = np.flatnonzero(way < 0)
    if not len(own):
        return
    text = table["rest"].combine_chunks().cast(pa.string())
    raw = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
    starts = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    number = np.zeros(256, dtype=np.uint8)
    number[np.frombuffer(LETTERS.encode(), dtype=np.uint8)] = np.arange(len(LETTERS))
    q = len(LETTERS) if bool((raw == ord("N")).any()) else len(LETTERS) - 1
    letters = lambda rows, size: number[raw[starts[rows][:, None] + np.arange(size)]]
    shared = [Shared(table[f"keys{i}"].combine_chunks()) for i in range(schemes)]
    walk = Walks(table["near"].combine_chunks()) if walks else None
    mine = letters(own, n)
    for w, (less, at, shift) in enumerate(WAYS[most]):
        rows = np.flatnonzero((way == w) | ((way == BOTH) & ((less, shift) == (0, 0)))) if at == segment else own[:0]
        if not len(rows):
            continue
        for a, b, weight in met(mine, letters(rows, n + less), vid[own], vid[rows], (less, at, shift), cuts, most, q):
            a, b = own[a], rows[b]
            kept = np.zeros(len(a), dtype=np.int32)
            for i, scheme in enumerate(shared):
                for k in range(0, len(a), BATCH):
                    kept[k : k + BATCH] |= scheme.any(a[k : k + BATCH], b[k : k + BATCH]).astype(np.int32) << i
            keep = (weight >= least) & ((kept > 0) | (not schemes))
            if walk:
                far = np.flatnonzero(keep & (weight == 2))
                keep[far] = walk.joins(a[far], b[far])
            x, y = vid[a[keep]], vid[b[keep]]
            columns = [np.minimum(x, y), np.maximum(x, y), weight[keep].astype(np.int32), kept[keep]]
            for k in range(0, len(x), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + BATCH]) for c in columns], ["src", "dst", "weight", "kept"])


def dealt(work: DataFrame, most: int, sizes: list[int], keys: list[str]) -> DataFrame:
    """(n, segment, held, p, pb, vid, rest, way, keys...) of rows (vid, rest, keys...) whose shorter one has one of ``sizes`` letters."""
    parts = most + 1
    ways = ", ".join(f"struct({less} as less, {segment} as segment, {shift} as shift, {BOTH if (less, shift) == (0, 0) else w} as way)" for w, (less, segment, shift) in enumerate(WAYS[most]))
    each = work.select("vid", "rest", *keys, F.expr(f"inline(array({ways}))")).withColumn("n", F.length("rest") - F.col("less")).where(F.col("n").isin(sizes))
    begin, end = (F.floor(F.col("n") * (F.col("segment") + i) / parts).cast("int") for i in (0, 1))
    rows = each.select("n", "segment", F.col("rest").substr(begin + F.col("shift") + 1, end - begin).alias("held"), "vid", "rest", "way", *keys)
    by = ["n", "segment", "held"]
    large = rows.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("s")).where("s > 1")
    told = large.collect()  # one row for each BLOCK rows at most
    zero = F.lit(0)
    if not told:
        return rows.select(*by, zero.alias("p"), zero.alias("pb"), "vid", "rest", "way", *keys)
    large = rows.sparkSession.createDataFrame(told, large.schema)
    spread = rows.join(F.broadcast(large), by, "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("vid"), F.col("s")).cast("int"))
    every = F.sequence(F.lit(0), F.col("s") - 1)
    first = F.element_at(F.map_from_arrays(F.array(*(F.lit(x[1]) for x in WAYS[most] if (x[0], x[2]) == (0, 0))), F.array(*(F.lit(w) for w, x in enumerate(WAYS[most]) if (x[0], x[2]) == (0, 0)))), F.col("segment"))
    at = lambda p, pb, way: F.struct(p.alias("p"), pb.alias("pb"), way.cast("int").alias("way"))
    looked = F.transform(every, lambda pb: at(F.col("own"), pb, F.lit(OWN)))
    asked = F.transform(every, lambda p: at(p, F.col("own"), F.when(F.col("way") == BOTH, first).otherwise(F.col("way"))))
    placed = F.when(F.col("s") == 1, F.array(at(zero, zero, F.col("way")))).when(F.col("way") == BOTH, F.concat(looked, asked)).otherwise(asked)
    return spread.select(*by, "vid", "rest", *keys, F.inline(placed)).select(*by, "p", "pb", "vid", "rest", "way", *keys)


def short_pairs(work: DataFrame, most: int, least: int, sizes: list[int], keys: list[str], near: str | None = None) -> DataFrame:
    """(src, dst, weight, kept) of rows (vid, rest, keys...), each pair once, whose shorter one has one of ``sizes`` letters.

    Reads are of A, C, G, T and N. ``keys`` name lists of numbers; of pairs only those that share one are given, and the bits of
    ``kept`` say in which lists. Without keys all pairs are. ``near`` names a list of the ``codes`` of a read's neighbours, where of
    pairs of weight 2 only those are wanted that a walk of up to three edges of weight 1 leads between.
    """
    beside = [f"keys{i}" for i in range(len(keys))] + (["near"] if near else [])
    named = work.select("vid", "rest", *(F.col(k).alias(name) for k, name in zip([*keys, *([near] if near else [])], beside, strict=True)))
    rows = dealt(named, most, sizes, beside)
    by = ["n", "segment", "held", "p", "pb"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def found(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _group(most, least, len(keys), near is not None, key, batches)

    return rows.repartition(tasks, *by).groupBy(*by).applyInArrow(found, "src long, dst long, weight int, kept int")


def walked_pairs(vertices: DataFrame) -> DataFrame | None:
    """(src, dst, weight): pairs of weight 1, and those of weight 2 that a walk of up to three of the former leads between; none
    where a read is too long for ``codes`` or has other letters.

    Reads learn their neighbours first and take them along when they are dealt out, so walks are looked for where a pair is found.
    What is shuffled are reads, and of edges those of weight 1; what is stored are reads with their neighbours.
    """
    odd = F.count_if(~F.col("seq").rlike("^[ACGT]*$"))
    told = vertices.groupBy(F.length("seq").alias("size")).agg(odd.alias("odd")).collect()
    if any(r["size"] is None or r["size"] > CODED or r["odd"] for r in told):
        return None
    sizes = [r["size"] for r in told]
    coded = vertices.select("vid", "seq", codes(F.col("seq")).alias("code"))
    ones = short_pairs(coded.select(F.col("code").cast("long").alias("vid"), F.col("seq").alias("rest")), 1, 1, sizes, [])
    ends = F.inline(F.array(*(F.struct(F.col(x).cast("int").alias("code"), F.col(y).cast("int").alias("other")) for x, y in (("src", "dst"), ("dst", "src")))))
    near = ones.select(ends).groupBy("code").agg(F.collect_list("other").alias("near"))
    beside = coded.hint("merge").join(near.hint("merge"), "code", "left").select("vid", F.col("seq").alias("rest"), F.coalesce("near", F.expr("cast(array() as array<int>)")).alias("near"))
    return short_pairs(stored(beside, "walks"), 2, 1, sizes, [], "near").drop("kept")
