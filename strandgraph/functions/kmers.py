"""k-mers, gapped k-mers, minimizers and sketches of a sequence column, as SQL expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Hash = Callable[..., Column]
_NO_STRINGS = "cast(array() as array<string>)"


def hash_md5(*parts: Column) -> Column:
    """A hash that other engines can reproduce."""
    return F.md5(F.concat_ws("|", *parts))


def hash_fast(*parts: Column) -> Column:
    """The hash for production: 64 bits, no strings."""
    return F.xxhash64(*parts)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often and in whatever loop ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def segments(seq: Column, n: int) -> Column:
    """n segments of floor(length / n) letters; the last takes the rest."""
    size = F.floor(F.length(seq) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: seq.substr(i * size + 1, F.when(i == n - 1, F.length(seq)).otherwise(size)))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers by start; none of a shorter sequence."""
    starts = F.sequence(F.lit(1), F.length(seq) - (k - 1))
    return F.when(F.length(seq) >= k, F.transform(starts, lambda i: seq.substr(i, F.lit(k)))).otherwise(F.expr(_NO_STRINGS))


def gapped(seq: Column, k: int) -> Column:
    """Every second letter from each start, k letters in all; starts run to length - 2k + 1 (counted from 0).

    Letters at odd and at even places are taken once; a gapped k-mer is a plain substring of one of the two.
    """
    every_other = lambda x: F.regexp_replace(x, "(.).?", "$1")
    both = F.array(every_other(seq), every_other(seq.substr(F.lit(2), F.length(seq))))
    starts = F.sequence(F.lit(0), F.length(seq) - (2 * k - 1))
    made = bound(both, lambda b: F.transform(starts, lambda i: F.get(b, i % 2).substr((F.shiftright(i, 1) + 1), F.lit(k))))
    return F.when(F.length(seq) >= 2 * k - 1, made).otherwise(F.expr(_NO_STRINGS))


def occurrences(words: Column, first: int = 1) -> Column:
    """(word, at, occ) in the order of words: its place in the list, and which occurrence of the word it is.

    In the sorted list equal words are runs, so one sort and one pass over the runs are enough.
    """
    placed = F.sort_array(F.transform(words, lambda x, i: F.struct(x.alias("word"), i.alias("at"))))

    def counted(xs: Column) -> Column:
        places = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        heads = F.filter(places, lambda i: (i == 0) | (F.get(xs, i)["word"] != F.get(xs, i - 1)["word"]))
        return bound(heads, lambda hs: numbered(xs, hs))

    def numbered(xs: Column, hs: Column) -> Column:
        run = lambda h, j: F.sequence(F.lit(first), F.coalesce(F.get(hs, j + 1), F.size(xs)) - h - 1 + first)
        return F.zip_with(xs, F.flatten(F.transform(hs, run)), lambda x, occ: F.struct(x["word"].alias("word"), x["at"].alias("at"), occ.alias("occ")))

    return bound(placed, counted)


def with_occurrence(words: Column, first: int = 1) -> Column:
    """(word, occ) in the order of the list: which occurrence of the word in it each is."""
    by_place = F.sort_array(F.transform(occurrences(words, first), lambda w: F.struct(w["at"].alias("at"), w["word"].alias("word"), w["occ"].alias("occ"))))
    return F.transform(by_place, lambda w: F.struct(w["word"].alias("word"), w["occ"].alias("occ")))


def window_minima(values: Column, window: int) -> Column:
    """Minimum of each run of ``window`` values; of fewer values, their minimum alone.

    Minima of runs of 1, 2, 4, ... values come from two of the length before; two of the longest cover a window. So each
    value is looked at a logarithm of the window's times.
    """
    longest = 1 << (window.bit_length() - 1)
    steps = F.expr(f"cast(array({', '.join(str(1 << s) for s in range(longest.bit_length() - 1))}) as array<int>)")
    doubled = lambda vs: F.aggregate(steps, vs, lambda runs, step: F.transform(runs, lambda x, i: F.least(x, F.get(runs, i + step))))
    covered = lambda vs, runs: F.transform(F.slice(runs, 1, F.size(vs) - (window - 1)), lambda x, i: F.least(x, F.get(runs, i + (window - longest))))
    return bound(values, lambda vs: F.when(F.size(vs) < window, F.array(F.array_min(vs))).otherwise(bound(doubled(vs), lambda runs: covered(vs, runs))))


def lexicographic_minimizers(seq: Column, k: int, window: int) -> Column:
    """Smallest k-mer of each window; a sequence with fewer k-mers is one window."""
    return F.when(F.length(seq) >= k, F.array_distinct(window_minima(kmers(seq, k), window))).otherwise(F.expr(_NO_STRINGS))


def hashed_minimizers(seq: Column, k: int, window: int, seed: int, hash_of: Hash = hash_fast) -> Column:
    """Smallest k-mer hash of each window; none where a sequence has fewer k-mers than a window."""
    hashes = F.transform(kmers(seq, k), lambda w: hash_of(F.lit(str(seed)), w))
    return F.when(F.length(seq) - k + 1 >= window, F.array_distinct(window_minima(hashes, window)))


def gapped_min_hashes(seq: Column, k: int, seeds: list[int], hash_of: Hash = hash_fast) -> Column:
    """For each seed the smallest hash over gapped k-mers with their occurrence; nulls for sequences too short for any."""
    least = lambda ws, seed: F.array_min(F.transform(ws, lambda w: hash_of(F.lit(str(seed)), w["word"], w["occ"].cast("string"))))
    return bound(occurrences(gapped(seq, k)), lambda ws: F.array(*(least(ws, seed) for seed in seeds)))


def gapped_words(seq: Column, k: int) -> Column:
    """Every gapped k-mer with its occurrence, as one string each."""
    return F.transform(occurrences(gapped(seq, k)), lambda w: F.concat_ws("|", w["word"], w["occ"].cast("string")))


def prefix_sketch(seq: Column, k: int, size: int) -> Column:
    """The first ``size`` k-mers; null for sequences shorter than k."""
    return F.when(F.length(seq) >= k, F.array_join(F.slice(kmers(seq, k), 1, size), "|"))


def order_min_sketches(seq: Column, k: int, size: int, seeds: list[int], hash_of: Hash = hash_fast) -> Column:
    """For each seed the ``size`` k-mers of smallest hash (with occurrence, from 0), in the order of their positions; null
    for sequences shorter than k."""

    def sketch(words: Column, seed: int) -> Column:
        ranked = F.sort_array(F.transform(words, lambda w: F.struct(hash_of(F.lit(str(seed)), w["word"], w["occ"].cast("string")).alias("h"), w["at"].alias("i"), w["word"].alias("w"))))
        by_place = F.sort_array(F.transform(F.slice(ranked, 1, size), lambda r: F.struct(r["i"].alias("i"), r["w"].alias("w"))))
        return F.array_join(F.transform(by_place, lambda r: r["w"]), "|")

    return F.when(F.length(seq) >= k, bound(occurrences(kmers(seq, k), 0), lambda ws: F.array(*(sketch(ws, s) for s in seeds))))


def order_min_sketch(seq: Column, k: int, size: int, seed: int, hash_of: Hash = hash_fast) -> Column:
    """The same for one seed."""
    return order_min_sketches(seq, k, size, [seed], hash_of)[0]


def deletions(seq: Column, most: int) -> Column:
    """All sequences that up to ``most`` deletions leave, each once."""

    def once(x: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(x))
        cut = F.transform(places, lambda i: F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, F.length(x))))
        return F.when(F.length(x) > 0, cut).otherwise(F.expr(_NO_STRINGS))

    out = last = F.array(seq)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, once)))
        out = F.concat(out, last)
    return F.array_distinct(out)
