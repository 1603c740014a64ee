"""Pairs of vertices within an edit distance.

``exact`` finds every such pair with equi-joins only, in work that follows the number of reads. ``among`` gives the pairs that
share a bucket: what a self-join of the buckets with verification gives, by whichever way is cheaper.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations, pairwise, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.functions import kmers
from strandgraph.functions.distance import edits_within
from strandgraph.operators import short
from strandgraph.operators.dense import moved, one_length, substituted
from strandgraph.operators.storage import stored

#: From segments of so many letters on, shared segments are rarer than shared deletions are costly.
SEGMENT_LEAST = 6
#: A segment that more reads than this have is not joined on alone, but with more of the read.
OFTEN = 24
#: How much more frequent a key of most of a read may be.
EASIER = 4
#: Distances up to which dense reads are cut into twice as many segments; beyond, ways to leave some out are too many.
WIDE = 2
#: Reads for each value that the kept letters of a read can have, on average, for which fewer segments are enough.
CROWD = 4
#: Letters up to which distances are worked out by the SQL function.
LONG = 64
#: Rows of one key from which on it is looked for where the rows are, so that no task gets them all; such keys are few, and are broadcast.
HEAVY = 1 << 16
#: Pairs for each bucket entry up to which a self-join of buckets is the cheaper way.
PAIRS_A_READ = 20


def plans(most: int, parts: int, shorter: bool = False) -> list[list[int]]:
    """Ways in which a read of ``parts`` segments, ``most`` of them edited, lies in another one up to ``most`` letters longer, or ``shorter`` too.

    Each is [which segments are left out, letters more, then (first segment, end segment, shift) of each run that is kept],
    filled up with empty runs. Edits allow a shift to change only as often as there are edits.
    """
    made = {}
    for name, out in enumerate(combinations(range(parts), most)):
        cuts = [-1, *out, parts]
        for less in range(-most if shorter else 0, most + 1):
            for middle in product(range(-most, most + 1), repeat=most - 1):
                shifts = [0, *middle, less]
                if sum(abs(b - a) for a, b in pairwise(shifts)) <= most:
                    runs = [(a + 1, b, s) for (a, b), s in zip(pairwise(cuts), shifts, strict=True) if b > a + 1]
                    runs += [(parts, parts, less)] * (most + 1 - len(runs))
                    made[name, less, *(x for run in runs for x in run)] = None
    return [list(x) for x in made]


def keyed(work: DataFrame, most: int, parts: int, own: bool, ways: list[list[int]] | None = None, sizes: list[int] | None = None) -> DataFrame:
    """(h, grp, vid, size, rest) of rows (grp, vid, rest), one for each plan that fits: the hash of the letters kept, and those left.

    ``own`` are the places of a read's own segments; the others are where another read's could be. ``ways`` gives some of
    the plans. With ``sizes`` only keys for shorter reads of these lengths are made, and ``rest`` stays whole.
    """
    wanted = ways or [p for p in plans(most, parts) if not own or not any([p[1], *p[4::3]])]
    names = ["name", "less", *(f"{x}{k}" for k in range(most + 1) for x in ("first", "end", "shift"))]
    told = ", ".join(f"struct({', '.join(map(str, p))})" for p in wanted)
    kinds = ", ".join(f"{x}: int" for x in names)
    rows = work.select("grp", "vid", "rest", F.length("rest").alias("size"), F.expr(f"inline(cast(array({told}) as array<struct<{kinds}>>))"))
    n = F.col("size") - F.col("less")
    at = lambda segment, k: ((F.col(segment) * n / parts).cast("int") + F.col(f"shift{k}"))
    # places are columns of their own, so that each is worked out once a row
    ends = [(F.col(f"from{k}"), F.col(f"to{k}")) for k in range(most + 1)]
    placed = rows.select("grp", "vid", "rest", "size", "name", n.alias("n"), *(at(f"{x}{k}", k).alias(f"{y}{k}") for k in range(most + 1) for x, y in (("first", "from"), ("end", "to"))))
    gaps = list(zip([F.lit(0), *(stop for _, stop in ends)], [*(start for start, _ in ends), F.col("size")], strict=True))
    fits = reduce(Column.__and__, (begin <= end for begin, end in gaps), F.col("n") >= (most + 1) * SEGMENT_LEAST)
    cut = lambda begin, end: F.col("rest").substr(begin + 1, end - begin)
    kept, left = [cut(*x) for x in ends], [cut(*x) for x in gaps]
    if sizes is not None:
        fits &= F.col("n").isin(sizes)
    rest = F.concat(*left) if sizes is None else F.col("rest")
    return placed.where(fits).select(F.xxhash64("grp", "n", "name", *kept).alias("h"), "grp", "vid", "size", rest.alias("rest"))


def segment_candidates(work: DataFrame, most: int, parts: int, often: int | None) -> tuple[DataFrame, DataFrame | None]:
    """(a, b) of rows (grp, vid, rest) that agree in all but ``most`` of ``parts`` segments, and the keys of those too frequent to pair.

    Of the segments of the shorter rest, ``most`` edits leave all but ``most`` untouched, so both rests have these, each
    at most ``most`` letters apart from its place. What more than ``often`` rows have makes no candidates.
    """
    own = keyed(work, most, parts, True).select("h", F.col("vid").alias("a"), F.col("size").alias("la"))
    asked = keyed(work, most, parts, False).select("h", F.col("vid").alias("b"), F.col("size").alias("lb"))
    frequent = None
    if often is not None:
        frequent = frequent_keys(own, often)
        if frequent is not None:
            own = lacking(own, frequent)
    shorter_first = (F.col("la") < F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("a") < F.col("b")))
    return own.hint("merge").join(asked, "h").where(shorter_first).select("a", "b"), frequent


def frequent_keys(keys: DataFrame, often: int) -> DataFrame | None:
    """(h, n) of the keys that more than ``often`` rows have; none if there are none."""
    found = stored(keys.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > often), "frequent")
    return found if found.head(1) else None


def _heavy(frequent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys of more than HEAVY rows, one for each HEAVY rows at most, and the others."""
    return F.broadcast(frequent.where(F.col("n") > HEAVY).select("h")), frequent.where(F.col("n") <= HEAVY).select("h")


def lacking(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """Rows whose key is not frequent; those of the heaviest keys are gone before the others are dealt out by key."""
    heavy, light = _heavy(frequent)
    return rows.join(heavy, "h", "left_anti").hint("merge").join(light, "h", "left_anti")


def sharing(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """Rows whose key is frequent; those of the heaviest keys stay where they are."""
    heavy, light = _heavy(frequent)
    return rows.join(heavy, "h", "left_semi").union(rows.join(heavy, "h", "left_anti").hint("merge").join(light, "h", "left_semi"))


def having(work: DataFrame, most: int, parts: int, frequent: DataFrame) -> DataFrame:
    """The rows (grp, vid, rest) that have any of the frequent keys, as they are."""
    asked = keyed(work, most, parts, False).select("h", "vid")
    return work.hint("merge").join(sharing(asked, frequent).select("vid").distinct(), "vid", "left_semi")


def without_kept(work: DataFrame, most: int, parts: int, frequent: DataFrame) -> DataFrame:
    """Groups (grp, vid, rest) of what shares a frequent key, without the letters that it keeps: the rest still is within the distance."""
    rows = keyed(work, most, parts, False).select("h", "vid", "rest")
    return sharing(rows, frequent).select(F.col("h").alias("grp"), "vid", "rest").distinct()


def short_rows(work: DataFrame, most: int) -> DataFrame:
    """The rows that segments do not serve: those of too few letters, and those within reach of these."""
    return work.where(F.length("rest") < (most + 1) * SEGMENT_LEAST + most)


def remainders(work: DataFrame, most: int, *also: str) -> DataFrame:
    """(h, vid): hashes of what up to ``most`` deletions leave of rows (grp, vid, rest), each remainder of a row once.

    Places of deletions are columns and rise; those past the end delete nothing. Of the ways to one remainder the one that keeps
    the earliest letters counts: each deleted letter differs from the next one kept.
    """
    rows, size = work.select("grp", "vid", "rest", F.lit(0).alias("p0")), F.length("rest")
    for k in range(1, most + 1):
        rows = rows.select("*", F.explode(F.sequence(F.least(F.col(f"p{k - 1}") + 1, size + 1), size + 1)).alias(f"p{k}"))
    places = [F.col(f"p{k}") for k in range(most + 1)]
    letter = lambda at: F.col("rest").substr(at, F.lit(1))
    first, after = F.lit(True), None
    for k in range(most, 0, -1):
        after = places[k] + 1 if k == most else F.when(places[k + 1] == places[k] + 1, after).otherwise(places[k] + 1)
        first &= (places[k] > size) | (letter(places[k]) != letter(after))
    stops = [*places[1:], size + 1]
    kept = [F.col("rest").substr(a + 1, F.greatest(b - a - 1, F.lit(0))) for a, b in zip(places, stops, strict=True)]
    return rows.where(first).select(F.xxhash64("grp", F.concat(*kept)).alias("h"), "vid", *also)


def deletion_candidates(work: DataFrame, most: int) -> DataFrame:
    """(a, b) of rows (grp, vid, rest) that share a remainder after up to ``most`` deletions from each; for short rests.

    Sizes are estimated from the reads, of which remainders are many times as many: the hint keeps them from being broadcast.
    """
    left = remainders(work, most).withColumnRenamed("vid", "a").hint("merge")
    return left.join(left.withColumnRenamed("a", "b"), "h").where("a < b").select("a", "b")


def dense_candidates(work: DataFrame, most: int, often: int) -> list[DataFrame]:
    """(a, b) among reads (grp, vid, rest) whose segments are too frequent to pair them, in rounds over shorter rests."""
    parts, made = 2 * (most + 1) if most <= WIDE else most + 1, []
    while True:
        found, frequent = segment_candidates(work, most, parts, often * EASIER)
        made.append(found)
        if frequent is None:
            return made
        work = stored(without_kept(work, most, parts, frequent), "groups")
        made.append(deletion_candidates(short_rows(work, most), most))


def as_work(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.lit(0).cast("long").alias("grp"), "vid", F.col("seq").alias("rest"))


def candidates(vertices: DataFrame, most: int, often: int = OFTEN) -> DataFrame:
    """(a, b), each pair once, among which are all pairs of ``vertices`` within ``most`` edits.

    Reads of (most + 1) * SEGMENT_LEAST letters and more are found by one of most + 1 segments; shorter ones, and those
    within reach of them, by deletions. Reads that have a segment more than ``often`` others have, of one amplicon or
    behind one primer, meet by all but ``most`` of twice as many segments. Where these are frequent too, they
    become a group, in which only the letters left are looked at; these get shorter each round.
    """
    work = as_work(vertices)
    found, frequent = segment_candidates(work, most, most + 1, often)
    made = [found, deletion_candidates(short_rows(work, most), most)]
    if frequent is not None:
        made += dense_candidates(stored(having(work, most, most + 1, frequent), "dense"), most, often)
    both = reduce(DataFrame.union, made)
    return both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(found: DataFrame, vertices: DataFrame, least: int, most: int) -> DataFrame:
    """(src, dst, weight) of the candidates (a, b) within the range; letters meet the pairs only here, once a pair."""
    a, b = (vertices.select(F.col("vid").alias(v), F.col("seq").alias(s)) for v, s in (("a", "sa"), ("b", "sb")))
    close = F.abs(F.length("sa") - F.length("sb")) <= most
    # beyond ``most`` the function says -1, so one comparison is enough and the distance is not worked out for each bound
    weight = F.when(close, F.levenshtein("sa", "sb", most)).otherwise(-1)
    weighed = found.hint("merge").join(a, "a").hint("merge").join(b, "b").select(F.col("a").alias("src"), F.col("b").alias("dst"), weight.cast("int").alias("weight"))
    return weighed.where(F.col("weight") >= max(least, 0))


def parts_for(sizes: list[int], n: int, most: int) -> dict[int, list[int]]:
    """Lengths by the number of segments that their reads are cut into, where ``n`` reads are looked through.

    With more segments more letters are kept, so fewer of many reads agree by chance, but there are more ways to leave some out.
    """
    made: dict[int, list[int]] = {}
    for size in sizes:
        if size >= (most + 1) * SEGMENT_LEAST:
            enough = (p for p in range(most + 1, 2 * (most + 1)) if CROWD * 4 ** (size * (p - most) // p) >= n)
            made.setdefault(next(enough, 2 * (most + 1)), []).append(size)
    return made


def _weighed(met: DataFrame, least: int, most: int, long: bool = False) -> DataFrame:
    """(src, dst, weight) of pairs (a, sa, b, sb) within the range, in the task that has made the pair.

    The work of the SQL function grows with the square of the letters, so distances of ``long`` reads are worked out for whole batches.
    """
    met = met.where(F.abs(F.length("sa") - F.length("sb")) <= most)
    if long:

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                weight = edits_within(batch["sa"], batch["sb"], most)
                keep = np.flatnonzero(weight >= max(least, 0))
                a, b = (batch[x].to_numpy()[keep] for x in "ab")
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(a, b), np.maximum(a, b), weight[keep])], ["src", "dst", "weight"])

        return met.mapInArrow(run, "src long, dst long, weight int")
    weighed = met.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.levenshtein("sa", "sb", most).cast("int").alias("weight"))
    return weighed.where(F.col("weight") >= max(least, 0))


def segment_pairs(work: DataFrame, most: int, parts: int, sizes: list[int], every: list[int], often: int, least: int) -> tuple[DataFrame, DataFrame | None]:
    """(src, dst, weight) of rows (grp, vid, rest) whose shorter one has one of ``sizes`` letters, and the frequent keys.

    As ``segment_candidates``, but letters go with the keys, so that no pair is shuffled before it is verified. Ways that no
    two of the lengths there are (``every``) allow are left out. Of two reads of one length either may be the one whose
    segments are looked for, so of each shift and its opposite one is enough.
    """
    ways = [p for p in plans(most, parts)]
    shifted = [p for p in ways if any([p[1], *p[4::3]]) and (p[1] or next(s for s in p[4::3] if s) > 0)]
    shifted = [p for p in shifted if any(size + p[1] in every for size in sizes)]
    of = lambda df, v, s: df.select("h", F.col("vid").alias(v), F.col("rest").alias(s))
    keys = keyed(work, most, parts, True, sizes=sizes)
    frequent = frequent_keys(keys, often)
    if frequent is not None:
        keys = lacking(keys, frequent)
    own = of(keys, "a", "sa")
    made = [own.hint("merge").join(of(keys, "b", "sb"), "h").where("a < b")]
    if shifted:
        asked = keyed(work, most, parts, False, shifted, sizes)
        if frequent is not None:
            asked = asked.join(_heavy(frequent)[0], "h", "left_anti")
        made.append(own.hint("merge").join(of(asked, "b", "sb"), "h").where("a <> b"))
    return _weighed(reduce(DataFrame.union, made), least, most, max(every) > LONG), frequent


def deletion_pairs(work: DataFrame, most: int, least: int) -> DataFrame:
    """(src, dst, weight) of short rows (grp, vid, rest) that share a remainder; letters go with it."""
    left = remainders(work, most, "rest").toDF("h", "a", "sa").hint("merge")
    return _weighed(left.join(left.toDF("h", "b", "sb"), "h").where("a < b"), least, most)


def _searched(vertices: DataFrame, least: int, most: int, often: int, keys: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """Pairs within the range: (src, dst, weight), each once, whose shorter read is long, or that are found by deletions; and
    those of ``short.short_pairs``. ``keys`` are columns of ``vertices`` that only the latter look at; no pair is in both."""
    work, limit = as_work(vertices), (most + 1) * SEGMENT_LEAST
    size, odd = F.length("seq"), F.count_if(~F.col("seq").rlike(f"^[{short.LETTERS}]*$"))
    told = vertices.where("seq is not null").groupBy(size.alias("size")).agg(F.count("*").alias("n"), odd.alias("odd")).collect()
    every, made, dense, brief = [r["size"] for r in told], [], [], None
    n = sum(r["n"] for r in told)
    for parts, sizes in sorted(parts_for(every, n, most).items()):
        found, frequent = segment_pairs(work, most, parts, sizes, every, often, least)
        made.append(found)
        if frequent is not None:
            dense.append(having(work, most, parts, frequent))
    if few := [size for size in every if size < limit]:
        if most in short.WAYS and not any(r["odd"] for r in told if r["size"] < limit + most):
            brief = short.short_pairs(vertices.where(size < limit + most).select("vid", F.col("seq").alias("rest"), *keys), most, least, few, keys)
        else:
            made.append(deletion_pairs(short_rows(work, most), most, least))
    met: list[DataFrame] = []
    if dense:
        groups = stored(reduce(DataFrame.union, dense).distinct(), "dense")
        n = one_length(groups) if most <= WIDE else None
        if n is not None:
            # all pairs of these reads are found here, so others are of reads of which one at most is among them
            ids = groups.select("vid", F.lit(True).alias("among"))
            met = [substituted(groups, n, most, least), *([moved(groups, n)] if most == 2 else [])]
            made = [_not_both(reduce(DataFrame.union, made).distinct(), ids)]
        else:
            both = reduce(DataFrame.union, dense_candidates(groups, most, often)).where("a <> b")
            made.append(verified(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), vertices, least, most))
    rest = [reduce(DataFrame.union, made).distinct()] if made and not met else made
    return (reduce(DataFrame.union, [*rest, *met]) if made else None), brief


def _not_both(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of which not both ends are in ``ids`` (vid, among)."""
    for end in ("src", "dst"):
        edges = edges.hint("merge").join(ids.withColumnsRenamed({"vid": end, "among": f"{end}_among"}), end, "left")
    return edges.where("src_among is null or dst_among is null").select("src", "dst", "weight")


def exact(vertices: DataFrame, least: int, most: int, often: int = OFTEN) -> DataFrame:
    """Every pair within the range, of reads of any lengths. ``vertices`` are read more than once: store them.

    The way of ``candidates``, in as many segments as the number of reads asks for. Pairs are verified where they are
    met and made distinct after that, so what is shuffled follows the reads and the edges, not the candidates. Pairs of short
    reads, of which there may be hundreds a read, are found once each and are not shuffled at all.
    """
    rest, brief = _searched(vertices, least, most, often, [])
    made = [x for x in (rest, brief.drop("kept") if brief else None) if x is not None]
    if not made:
        return vertices.limit(0).select(F.col("vid").alias("src"), F.col("vid").alias("dst"), F.lit(0).alias("weight"))
    return reduce(DataFrame.union, made)


def exact_in(vertices: DataFrame, buckets: list[tuple[DataFrame, list[str]]], least: int, most: int, often: int = OFTEN) -> DataFrame:
    """(src, dst, weight, kept): every pair within the range that shares a bucket of any of the schemes (rows, key columns); the
    bits of ``kept`` say of which. ``in_buckets`` of ``exact``, but keys go with the short reads, so that their edges are not joined.
    """
    lists = [keys_of(rows.select("vid", F.xxhash64(*by).alias("key"))).withColumnRenamed("keys", f"keys{i}") for i, (rows, by) in enumerate(buckets)]
    names = [f"keys{i}" for i in range(len(lists))]
    told = reduce(lambda df, own: df.hint("merge").join(own, "vid", "left"), lists, vertices.select("vid", "seq"))
    none = F.expr("cast(array() as array<bigint>)")
    keyed_rows = stored(told.select("vid", "seq", *(F.coalesce(k, none).alias(k) for k in names)), "keys")
    rest, brief = _searched(keyed_rows, least, most, often, names)
    made = [brief] if brief else []
    if rest is not None:
        ends = [keyed_rows.select(F.col("vid").alias(end), *(F.col(k).alias(f"{end}_{k}") for k in names)) for end in ("src", "dst")]
        beside = rest.hint("merge").join(ends[0], "src").hint("merge").join(ends[1], "dst")
        bits = reduce(Column.__add__, (F.when(F.arrays_overlap(f"src_{k}", f"dst_{k}"), 1 << i).otherwise(0) for i, k in enumerate(names)))
        made.append(beside.select("src", "dst", "weight", bits.cast("int").alias("kept")).where("kept > 0"))
    if not made:
        return vertices.limit(0).select(F.col("vid").alias("src"), F.col("vid").alias("dst"), F.lit(0).alias("weight"), F.lit(0).alias("kept"))
    return reduce(DataFrame.union, made)


def keys_of(buckets: DataFrame, by: list[str] = ["key"]) -> DataFrame:  # noqa: B006
    """(vid, keys): the sorted keys of each vertex, as many as its letters allow."""
    key = F.col(by[0]) if len(by) == 1 else F.struct(*by)
    return buckets.groupBy("vid").agg(F.sort_array(F.collect_set(key)).alias("keys"))


def _with_keys(edges: DataFrame, buckets: DataFrame, by: list[str]) -> DataFrame:
    """Edges beside the keys of both their ends."""
    keys = keys_of(buckets, by)
    one = edges.hint("merge").join(keys.select(F.col("vid").alias("src"), F.col("keys").alias("src_keys")), "src")
    return one.hint("merge").join(keys.select(F.col("vid").alias("dst"), F.col("keys").alias("dst_keys")), "dst")


def in_buckets(edges: DataFrame, buckets: DataFrame, by: list[str] = ["key"]) -> DataFrame:  # noqa: B006
    """Edges (each once) whose ends share a bucket: equal to joining each bucket with itself and verifying all its pairs."""
    return _with_keys(edges.select("src", "dst", "weight"), buckets, by).where(F.arrays_overlap("src_keys", "dst_keys")).select("src", "dst", "weight")


def in_sub_buckets(edges: DataFrame, listed: DataFrame, routes: DataFrame) -> DataFrame:
    """Edges whose ends (vid, parents, keys) have a key in common and one of the parents of ``routes``. Lists are not taken apart:
    only parents that both ends of an edge have are, and they are one edge again before that is shuffled."""
    lists = listed.select("vid", "parents", F.transform("keys", lambda k: F.xxhash64(k)).alias("keys"))
    ends = [lists.select(F.col("vid").alias(end), F.col("parents").alias(f"{end}_parents"), F.col("keys").alias(f"{end}_keys")) for end in ("src", "dst")]
    beside = edges.hint("merge").join(ends[0], "src").hint("merge").join(ends[1], "dst").where(F.arrays_overlap("src_keys", "dst_keys"))
    shared = beside.select("src", "dst", "weight", F.explode(F.array_intersect("src_parents", "dst_parents")).alias("parent"))
    return shared.join(routes, "parent", "left_semi").select("src", "dst", "weight").distinct()


def _bucket_meetings(buckets: DataFrame, block: int, by: list[str], letters: DataFrame | None = None) -> DataFrame:
    """(a, b), and (sa, sb) where ``letters`` (vid, seq) are given, that share a bucket; each pair once, in the least key that both have.

    A bucket of n vertices is dealt into s = ceil(n / block) parts; every part meets every other once, so no task holds
    more than two parts. The number of pairs still grows with the square of a bucket. Rows with lists of keys are small
    when packed and large in memory: the hints keep Spark from broadcasting them, which it decides by packed sizes.
    """
    parts = buckets.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("s"))
    lower = F.slice("keys", F.lit(1), F.col("at"))
    own, seq = keys_of(buckets, by), []
    if letters is not None:
        own, seq = own.hint("merge").join(letters.select("vid", "seq"), "vid"), ["seq"]
    each = own.select("vid", *seq, "keys", F.posexplode("keys").alias("at", "own")).select("vid", *seq, lower.alias("lower"), *((F.col("own") if len(by) == 1 else F.col(f"own.{c}")).alias(c) for c in by))
    rows = each.hint("merge").join(parts, by).withColumn("p", F.pmod(F.xxhash64("vid"), F.col("s")).cast("int"))
    side = lambda v, mine, other: rows.select(*by, F.col("vid").alias(v), *(F.col(x).alias(f"s{v}") for x in seq), F.col("lower").alias(f"l{v}"), F.col("p").alias(mine), F.explode(F.expr("sequence(0, s - 1)")).alias(other))
    left, right = side("a", "pa", "pb"), side("b", "pb", "pa")
    return left.hint("merge").join(right, [*by, "pa", "pb"]).where((F.col("a") < F.col("b")) & ~F.arrays_overlap("la", "lb")).select("a", *(f"s{v}" for v in "a" if seq), "b", *(f"s{v}" for v in "b" if seq))


def bucket_candidates(buckets: DataFrame, block: int = 2000, by: list[str] = ["key"]) -> DataFrame:  # noqa: B006
    """(a, b) that share a bucket, each once."""
    return _bucket_meetings(buckets, block, by)


def bucket_pairs(buckets: DataFrame, vertices: DataFrame, least: int, most: int, block: int = 2000, by: list[str] = ["key"]) -> DataFrame:  # noqa: B006
    """The direct way, for schemes of small buckets: self-join of buckets, those over ``block`` vertices in blocks. Letters go with
    the keys, so that pairs are verified where they meet."""
    return _weighed(_bucket_meetings(buckets, block, by, vertices), least, most)


def many_pairs(buckets: DataFrame, by: list[str] = ["key"]) -> bool:  # noqa: B006
    """Whether the pairs of buckets outnumber PAIRS_A_READ for each of their rows."""
    own = buckets.groupBy(*by).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.sum("n").alias("rows")).first()
    return (own["pairs"] or 0) > PAIRS_A_READ * max(1, own["rows"] or 0)


def among(buckets: DataFrame, vertices: DataFrame, least: int, most: int, every: Callable[[], DataFrame] | None = None, by: list[str] = ["key"], block: int = 2000) -> DataFrame:  # noqa: B006
    """Pairs within the range that share a bucket. All ways give the same pairs.

    Small buckets are joined with themselves. Where their pairs outnumber PAIRS_A_READ for each read, as with four-letter
    keys on many reads, all pairs within the range are filtered by their buckets: those of ``every``, made only then, or
    where they are found.
    """
    if not many_pairs(buckets, by):
        return bucket_pairs(buckets, vertices, least, most, block, by)
    if every is None:
        return exact_in(vertices, [(buckets, by)], least, most).drop("kept")
    return in_buckets(every().where(F.col("weight").between(least, most)), buckets, by)


def bucket_stats(edges: DataFrame, buckets: DataFrame) -> DataFrame:
    """key, bucket_size, total_pairs, positive_cases, negative_cases; each edge, met once, counts for all keys that its ends share."""
    own = buckets.groupBy("key").agg(F.count("*").alias("bucket_size"))
    shared = _with_keys(edges.select("src", "dst"), buckets, ["key"]).select(F.explode(F.array_intersect("src_keys", "dst_keys")).alias("key"))
    hits = shared.groupBy("key").agg(F.count("*").alias("hits"))
    n, hit = F.col("bucket_size"), F.coalesce("hits", F.lit(0))
    total = (n * (n - 1) / 2).cast("long")
    return own.join(hits, "key", "left").select("key", "bucket_size", total.alias("total_pairs"), hit.alias("positive_cases"), (total - hit).alias("negative_cases"))
