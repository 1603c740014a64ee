"""Pairs within two edits among reads of one length that have most of their letters in common, as copies of one amplicon have.

Letters are packed, two bits each. Pairs apart by substitutions agree in all but as many of ``PARTS`` segments; reads that do are brought
together, and all of a group are compared, which is a few operations on packed words for a pair. A group too large for that is cut
again, by the letters that its reads may differ in. Pairs apart by a letter left out and one put in elsewhere
have the same letters once each has lost one. Each pair is given once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Segments that a read, or what is left of it, is cut into.
PARTS = 6
#: Rows of a group up to which all are compared.
LARGE = 1 << 11
#: Pairs that are compared at once.
STEP = 1 << 16
#: Rows of which groups are looked through at once; a larger group is held whole.
ROWS = 1 << 15

_LOW = np.uint64(0x5555555555555555)
_NUMBER = np.zeros(256, dtype=np.uint64)
_NUMBER[np.frombuffer(b"ACGT", dtype=np.uint8)] = np.arange(4, dtype=np.uint64)
_Pairs = tuple[np.ndarray, np.ndarray]


def _packed(letters: np.ndarray) -> np.ndarray:
    """Rows of letters below 4, 32 in a word."""
    n = letters.shape[1]
    out = np.zeros((len(letters), -(-n // 32)), dtype=np.uint64)
    for at in range(n):
        out[:, at // 32] |= letters[:, at] << np.uint64(2 * (at % 32))
    return out


def _unpacked(codes: np.ndarray, n: int) -> np.ndarray:
    return np.stack([(codes[:, at // 32] >> np.uint64(2 * (at % 32))) & np.uint64(3) for at in range(n)], axis=1)


def _mask(places: list[int], words: int) -> np.ndarray:
    out = np.zeros(words, dtype=np.uint64)
    for at in places:
        out[at // 32] |= np.uint64(3) << np.uint64(2 * (at % 32))
    return out


def _cut(places: list[int]) -> list[list[int]]:
    return [places[i * len(places) // PARTS : (i + 1) * len(places) // PARTS] for i in range(PARTS)]


def _first_plan(most: int) -> np.ndarray:
    """For each set of segments, as bits, the first way to leave ``most`` segments out that leaves these out."""
    plans = list(combinations(range(PARTS), most))
    return np.array([next((i for i, out in enumerate(plans) if all(s in out for s in range(PARTS) if told >> s & 1)), -1) for told in range(1 << PARTS)])


def _hamming(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), dtype=np.uint8)
    for w in range(codes.shape[1]):
        apart = codes[a, w] ^ codes[b, w]
        out += np.bitwise_count((apart | (apart >> np.uint64(1))) & _LOW)
    return out


def _meetings(start: np.ndarray, end: np.ndarray) -> Iterator[_Pairs]:
    """All pairs of rows of each group [start, end), some at a time."""
    first = np.concatenate([np.arange(s, e - 1) for s, e in zip(start.tolist(), end.tolist(), strict=True)] or [np.zeros(0, dtype=np.int64)])
    many = np.repeat(end, end - start - 1) - first - 1
    stop = np.cumsum(many)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + STEP, "right")))
        a = np.repeat(first[at:to], many[at:to])
        yield a, a + 1 + np.arange(len(a)) - np.repeat(stop[at:to] - many[at:to] - (stop[at - 1] if at else 0), many[at:to])
        at = to


def _bounds(new: np.ndarray) -> _Pairs:
    start = np.flatnonzero(new)
    return start, np.append(start[1:], len(new))


def _near(codes: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> Iterator[_Pairs]:
    for a, b in _meetings(start, end):
        # the last words rarely are equal where the first are not, so the count of all is made at once
        keep = np.flatnonzero(_hamming(codes, a, b) <= most)
        yield a[keep], b[keep]


def similar(codes: np.ndarray, places: list[int], most: int) -> Iterator[_Pairs]:
    """Pairs of rows of packed letters within ``most`` substitutions, each once, of rows that differ in ``places`` only."""
    if len(codes) <= LARGE or len(places) < PARTS:
        yield from _near(codes, np.array([0]), np.array([len(codes)]), most)
        return
    parts, first = _cut(places), _first_plan(most)
    masks = [_mask(part, codes.shape[1]) for part in parts]
    for number, out in enumerate(combinations(range(PARTS), most)):
        left = [at for s in out for at in parts[s]]
        held = codes & ~_mask(left, codes.shape[1])
        order = np.lexsort(held.T)
        own, held = codes[order], held[order]
        start, end = _bounds(np.append(True, (held[1:] != held[:-1]).any(axis=1)))
        small = end - start <= LARGE
        found = [_near(own, start[small & (end - start > 1)], end[small & (end - start > 1)], most)]
        for s, e in zip(start[~small].tolist(), end[~small].tolist(), strict=True):
            found.append(_further(similar(own[s:e], left, most), s))
        for each in found:
            for a, b in each:
                keep = first[_segments(own[a] ^ own[b], masks)] == number
                yield order[a[keep]], order[b[keep]]


def _further(found: Iterator[_Pairs], rows: int) -> Iterator[_Pairs]:
    for a, b in found:
        yield a + rows, b + rows


def _segments(apart: np.ndarray, masks: list[np.ndarray]) -> np.ndarray:
    """The segments in which rows differ, as bits."""
    return sum(((apart & mask).any(axis=1).astype(np.int64) << s for s, mask in enumerate(masks)), np.zeros(len(apart), dtype=np.int64))


def _grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of sorted rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [table[c].to_numpy() for c in by]
        cut = int(np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))[-1] + 1) if any((k != k[-1]).any() for k in keys) else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        count = 0 if cut else count // 2  # of a group larger than that more rows are waited for
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    words = [c for c in table.column_names if c.startswith("c")]
    return table["vid"].to_numpy(), np.stack([table[c].to_numpy() for c in words], axis=1).view(np.uint64)


def _given(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(weight.astype(np.int32))], ["src", "dst", "weight"])


def _met(rows: DataFrame, by: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(run, "src long, dst long, weight int")


def _mixed(words: np.ndarray) -> np.ndarray:
    """One number for each row of words; equal rows have equal numbers."""
    out = np.zeros(len(words), dtype=np.uint64)
    for w in range(words.shape[1]):
        out = (out ^ words[:, w]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _letters(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return _NUMBER[np.frombuffer("".join(batch["rest"].to_pylist()).encode(), dtype=np.uint8)].reshape(-1, n)


def substituted(work: DataFrame, n: int, most: int, least: int) -> DataFrame:
    """(src, dst, weight) of reads (vid, rest) of ``n`` letters A, C, G, T that up to ``most`` substitutions part."""
    words, parts, first = -(-n // 32), _cut(list(range(n))), _first_plan(most)
    plans = [[at for s in out for at in parts[s]] for out in combinations(range(PARTS), most)]
    masks, names = [_mask(part, words) for part in parts], [f"c{w}" for w in range(words)]

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                codes = _packed(_letters(batch, n))
                for number, left in enumerate(plans):
                    columns = [_mixed(codes & ~_mask(left, words)), np.full(len(codes), number, dtype=np.int32), batch["vid"].to_numpy(), *codes.T.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["h", "plan", "vid", *names])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(rows, ["plan", "h"]):
            vid, codes = _columns(table)
            plan, h = table["plan"].to_numpy(), table["h"].to_numpy()
            start, end = _bounds(np.append(True, (h[1:] != h[:-1]) | (plan[1:] != plan[:-1])))
            small = (end - start > 1) & (end - start <= LARGE)
            found = [_near(codes, start[small], end[small], most)]
            for s, e in zip(start[end - start > LARGE].tolist(), end[end - start > LARGE].tolist(), strict=True):
                places = list(range(n)) if _clash(codes[s:e], plans[plan[s]]) else plans[plan[s]]
                found.append(_further(similar(codes[s:e], places, most), s))
            for each in found:
                for a, b in each:
                    keep = first[_segments(codes[a] ^ codes[b], masks)] == plan[a]
                    a, b = a[keep], b[keep]
                    weight = _hamming(codes, a, b)
                    keep = weight >= max(least, 1)
                    yield _given(vid[a[keep]], vid[b[keep]], weight[keep])

    schema = f"h long, plan int, vid long, {', '.join(f'{c} long' for c in names)}"
    return _met(work.select("vid", "rest").mapInArrow(deal, schema), ["plan", "h"], run)


def _clash(codes: np.ndarray, left: list[int]) -> bool:
    """Whether rows of one number differ in letters that they should have in common."""
    held = codes & ~_mask(left, codes.shape[1])
    return bool((held != held[0]).any())


def moved(work: DataFrame, n: int) -> DataFrame:
    """(src, dst, weight 2) of reads (vid, rest) of ``n`` letters that are equal once each has lost a letter, and that more than two substitutions part."""
    words = -(-n // 32)
    names = [f"c{w}" for w in range(words)]
    draw = np.random.default_rng(1)
    base = draw.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
    value = draw.integers(1, 1 << 63, 4, dtype=np.uint64)

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                letters = _letters(batch, n)
                codes, told = _packed(letters), value[letters.astype(np.int64)]
                here, back = told * base, np.zeros_like(told)
                back[:, 1:] = told[:, 1:] * base[:-1]
                before = np.cumsum(here, axis=1) - here
                after = np.cumsum(back[:, ::-1], axis=1)[:, ::-1] - back
                for at in range(n):
                    # any letter of a run may go; it is the first that does
                    own = np.flatnonzero(letters[:, at] != letters[:, at - 1]) if at else np.arange(len(letters))
                    columns = [(before[own, at] + after[own, at]).view(np.int64), np.full(len(own), at, dtype=np.int32), batch["vid"].to_numpy()[own], *codes[own].T.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["h", "place", "vid", *names])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(rows, ["h"]):
            vid, codes = _columns(table)
            place, h = table["place"].to_numpy(), table["h"].to_numpy()
            start, end = _bounds(np.append(True, h[1:] != h[:-1]))
            for a, b in _meetings(start[end - start > 1], end[end - start > 1]):
                keep = (vid[a] != vid[b]) & (place[a] != place[b])
                a, b = a[keep], b[keep]
                keep = _hamming(codes, a, b) > 2
                a, b = a[keep], b[keep]
                at = np.arange(n - 1)
                one, two = (np.take_along_axis(_unpacked(codes[x], n), at + (at >= place[x][:, None]), axis=1) for x in (a, b))
                keep = (one == two).all(axis=1)
                yield _given(vid[a[keep]], vid[b[keep]], np.full(keep.sum(), 2))

    schema = f"h long, place int, vid long, {', '.join(f'{c} long' for c in names)}"
    return _met(work.select("vid", "rest").mapInArrow(deal, schema), ["h"], run).distinct()


def one_length(groups: DataFrame) -> int | None:
    """The length of all rows (grp, vid, rest), if there is one, they are of one group and their letters are A, C, G and T."""
    size = F.length("rest")
    told = groups.agg(F.min(size).alias("least"), F.max(size).alias("most"), F.max("grp").alias("grp"), F.count_if(~F.col("rest").rlike("^[ACGT]*$")).alias("odd")).first()
    return told["most"] if told["least"] == told["most"] and told["most"] and not told["odd"] and told["grp"] == 0 else None
