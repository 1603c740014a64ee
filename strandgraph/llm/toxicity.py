"""Toxic passages by maximum-scoring segments over token log-odds.

Training, on a bounded sample of labelled documents: for every token (a word, and its first 4, 5 and 6 bytes as stems)
count how often it stands in toxic and in other documents, each context once, so that copies add nothing. Tokens that lean
to toxic documents beyond chance get as score their log-odds ratio under an informative Dirichlet prior; every
other word gets the same small penalty. All tokens that pass the test are kept; it asks for several occurrences of each, so
their number is bounded by the words of the sample.

Scoring, in one pass over each whole text: the linear-time scan for all maximal scoring segments, whose expected count by
chance follows the extreme-value law E = K n exp(-lambda S). lambda solves the law's equation for the rate and the mean
score of chance hits; K is fitted so that E gives the number of segments of at least a mean hit's score that the sample's
other documents hold. Significant segments are passages; the evidence of a document, summed over its passages, is
calibrated to a probability.

Edge cases: null or empty text has no segment and gets the score of no evidence; null ids keep their row, not held
out; repeated rows are scored row by row; without labels of both classes every score is 0.5; further columns are not
read. Texts of any length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.labelled import fold, labelled_sample, logistic, platt
from strandgraph.llm.shared import ALNUM, TextBatch, hash_spans, materialise, mix64

#: At most so many labelled documents are fitted on.
SAMPLE = 20_000
FOLDS, HELD_OUT = 5, 0
STEMS = (4, 5, 6)
#: Words' worth of prior; occurrences in toxic documents, and surplus of the test (in nats), from which a token is toxic.
PRIOR, LEAST, SURPLUS = 1000.0, 2, 1.0
#: How many times as likely in toxic documents a token must be.
LEAN = 3.0
#: Chance count of a segment below which it is reported as a passage.
E_VALUE = 0.01


def token_hashes(data: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words, then of their stems; 0 where a word is not longer than the stem."""
    out = [words]
    for size in STEMS:
        long = np.flatnonzero(ends - starts > size)
        h = np.zeros(len(words), np.uint64)
        if len(long):
            base = int(starts[0])
            h[long] = hash_spans(data[base : int(ends[-1])], starts[long] - base, starts[long] - base + size) ^ np.uint64(size)
        out.append(h)
    return out


@dataclass(frozen=True)
class Lexicon:
    """Sorted token hashes with scores, the penalty of other words, and the calibrations."""

    keys: np.ndarray
    weights: np.ndarray
    penalty: float
    rate: float
    scale: float
    slope: float = 1.0
    intercept: float = 0.0

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes))
        near = np.zeros(1 << 16, bool)
        near[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        out = np.zeros(len(hashes))
        at = np.flatnonzero(near[(hashes >> np.uint64(48)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        out[at] = np.where(self.keys[where] == hashes[at], self.weights[where], 0)
        return out


def segments(at: np.ndarray, weights: np.ndarray, penalty: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a word sequence that scores ``weights`` at positions ``at`` and -penalty elsewhere.

    The scan keeps a stack of candidate segments with the running totals at their left and right ends; each new
    positive score is merged leftwards as long as that raises the total. Every segment is pushed and merged once.
    Returns (first word, end word, score).
    """
    stack: list[tuple[int, int, float, float, int]] = []
    total, before = 0.0, -1
    for p, w in zip(at.tolist(), weights.tolist(), strict=True):
        total -= penalty * (p - before - 1)
        before = p
        first, left, right = p, total, total + w
        total = right
        # the nearest segment whose left total is smaller; those that a link passes over have larger ones
        j = len(stack) - 1
        while j >= 0 and stack[j][2] >= left:
            j = stack[j][4]
        while j >= 0 and stack[j][3] < right:
            first, _, left, _, link = stack[j]
            del stack[j:]
            j = link
        stack.append((first, p + 1, left, right, j))
    return [(int(a), int(b), r - l) for a, b, l, r, _ in stack]


def weighed(column: pa.Array | pa.ChunkedArray, lexicon: Lexicon) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: its number of words, the places and weights of the words that score, and all words' bounds."""
    batch = TextBatch(column)
    for lo, hi, n_words, words, starts, ends in batch.words(ALNUM):
        weight = np.zeros(len(words))
        for h in token_hashes(batch.data, words, starts, ends):
            weight = np.maximum(weight, lexicon.look_up(h))
        hits = np.flatnonzero(weight > 0)
        first = np.cumsum(n_words) - n_words
        cut = np.searchsorted(hits, np.append(first, len(words)))
        for i in range(hi - lo):
            own, a, z = hits[cut[i] : cut[i + 1]], int(first[i]), int(first[i] + n_words[i])
            yield int(n_words[i]), own - a, weight[own], starts[a:z] - batch.offsets[lo + i], ends[a:z] - batch.offsets[lo + i]


def scan(column: pa.Array | pa.ChunkedArray, lexicon: Lexicon) -> Iterator[tuple[int, list[tuple[int, int, float]], np.ndarray, np.ndarray]]:
    """For each text: its number of words, its segments by word, and the words' bounds."""
    for n, at, weight, starts, ends in weighed(column, lexicon):
        yield n, segments(at, weight, lexicon.penalty) if len(at) else [], starts, ends


def log_e(score: np.ndarray | float, n: int, lexicon: Lexicon) -> np.ndarray:
    """Logarithm of the number of segments of at least this score that chance puts into n words."""
    return np.log(lexicon.scale * max(n, 1)) - lexicon.rate * np.asarray(score, float)


def evidence(n: int, found: list[tuple[int, int, float]], lexicon: Lexicon) -> float:
    """Summed surplus of the segments over chance; 0 without any."""
    return float(np.maximum(0, -log_e([s for _, _, s in found], n, lexicon)).sum()) if found else 0.0


def _occurrences(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, token, context) of every word and stem; the context is the word with both its neighbours."""
    text = TextBatch(column)
    for lo, hi, n_words, words, starts, ends in text.words(ALNUM):
        row = np.repeat(np.arange(lo, hi), n_words)
        left, right = np.roll(words, 1), np.roll(words, -1)
        # a text's first and last words have no neighbour beyond it
        last = np.cumsum(n_words)[n_words > 0] - 1
        left[last - n_words[n_words > 0] + 1] = right[last] = 0
        context = mix64(left * np.uint64(3) + words * np.uint64(5) + right * np.uint64(7))
        for h in token_hashes(text.data, words, starts, ends):
            used = np.flatnonzero(h)
            yield row[used], h[used], context[used]


def count_tokens(rows: DataFrame) -> DataFrame:
    """h, toxic, other: how often a token stands in documents of either class; counted in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, keys, toxic = b.column(0).to_numpy(zero_copy_only=False), [], []
            for row, h, _ in _occurrences(b.column(1)):
                keys.append(h)
                toxic.append(label[row])
            if keys:
                u, inverse, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
                t = np.bincount(inverse, np.concatenate(toxic), len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(t), pa.array(n - t)], ["h", "toxic", "other"])

    return rows.mapInArrow(run, "h long, toxic long, other long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def count_contexts(rows: DataFrame, keys: np.ndarray) -> DataFrame:
    """The same for the tokens in ``keys``, counting each context once, so that copies of a document add nothing."""
    probe = Lexicon(keys, np.ones(len(keys)), 0.0, 1.0, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
            for row, h, context in _occurrences(b.column(1)):
                at = np.flatnonzero(probe.look_up(h))
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(context[at].view(np.int64)), pa.array(label[row[at]])], ["h", "context", "label"])

    found = rows.mapInArrow(run, "h long, context long, label int").distinct()
    return found.groupBy("h").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("other"))


def significant(tokens: DataFrame, share: float, candidates: int) -> DataFrame:
    """Tokens that are more than LEAN times as likely in toxic documents, beyond what chance would give one of ``candidates`` tokens.

    ``share`` of all words stand in toxic documents. The Chernoff bound of the binomial tail is the test.
    """
    share = LEAN * share / (LEAN * share + 1 - share)
    n = F.col("toxic") + F.col("other")
    a = F.col("toxic") / n
    bits = n * (a * F.log(a / F.lit(share)) + F.when(a < 1, (1 - a) * F.log((1 - a) / F.lit(1 - share))).otherwise(0.0))
    return tokens.where(F.col("toxic") >= LEAST).where(a > share).where(bits - float(np.log(max(candidates, 2))) >= SURPLUS)


def weigh(tokens: DataFrame, n_toxic: float, n_other: float) -> DataFrame:
    """The log-odds ratio of each token under a Dirichlet prior at its pooled rate."""
    share = (F.col("toxic") + F.col("other")) / F.lit(n_toxic + n_other)
    yes, no = F.col("toxic") + share * PRIOR, F.col("other") + share * PRIOR
    return tokens.select("h", (F.log(yes / (n_toxic + PRIOR - yes)) - F.log(no / (n_other + PRIOR - no))).alias("w")).where("w > 0")


def penalty_of(q1: float, q0: float) -> float:
    """What a word outside the lexicon costs: its log-odds for the other class, given the hit rates of toxic and of other words."""
    return float(np.clip(-np.log((1 - min(q1, 0.99)) / (1 - min(q0, 0.98))), 0.01, 1.0))


def rate_of(q0: float, weight: float, penalty: float) -> float:
    """lambda: the positive root of q0 exp(lambda weight) + (1 - q0) exp(-lambda penalty) = 1, by bisection."""
    low, high = 1e-6, 50.0 / max(weight, 1e-6)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if q0 * np.exp(mid * weight) + (1 - q0) * np.exp(-mid * penalty) < 1 else (low, mid)
    return low


def scale_of(found: int, score: float, rate: float, n: int) -> float:
    """K: with it the law gives ``found`` segments of at least ``score`` in n words of other documents."""
    return float((found + 0.5) * np.exp(rate * score) / (n + 1))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, parts: int = FOLDS, held_out: int = HELD_OUT) -> Lexicon | None:
    rows = materialise(labelled_sample(docs, labels, "toxic", parts, held_out, most), "toxic-sample")
    tokens = materialise(count_tokens(rows), "toxic-tokens")
    total = tokens.agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"), F.count("*").alias("v")).first()
    if not total["t"] or not total["o"]:
        return None
    share = total["t"] / (total["t"] + total["o"])
    first = np.sort(significant(tokens, share, total["v"]).select("h").toArrow()["h"].to_numpy().view(np.uint64))
    clear = significant(count_contexts(rows, first), share, total["v"])
    kept = weigh(clear, float(total["t"]), float(total["o"])).toArrow()
    keys, weights = kept["h"].to_numpy().view(np.uint64), kept["w"].to_numpy()
    order = np.argsort(keys)
    draft = Lexicon(keys[order], weights[order], 0.0, 1.0, 1.0)

    # how often the words of either class hit the lexicon, and how much each hit weighs
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(n, len(w), float(w.sum())) for n, _, w, _, _ in weighed(b.column(1), draft)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64())))], ["label", "n", "hit", "weight"])

    r = {x["label"]: x for x in rows.mapInArrow(hits, "label int, n long, hit long, weight double").groupBy("label").agg(*(F.sum(c).alias(c) for c in ("n", "hit", "weight"))).collect()}
    q1, q0 = ((r[k]["hit"] + 0.5) / (r[k]["n"] + 1.0) for k in (1, 0))
    weight = (r[0]["weight"] + r[1]["weight"]) / max(1, r[0]["hit"] + r[1]["hit"]) or 1.0
    penalty = penalty_of(q1, q0)
    chance = Lexicon(draft.keys, draft.weights, penalty, rate_of(q0, weight, penalty), 1.0)

    # what the extreme-value law is fitted to: chance segments of a mean hit's score and more
    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [sum(s >= weight for _, _, s in f) for _, f, _, _ in scan(b.column(1), chance)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])

    by_chance = rows.where("label = 0").mapInArrow(chances, "n long").agg(F.sum("n")).first()[0] or 0
    model = Lexicon(chance.keys, chance.weights, penalty, chance.rate, scale_of(by_chance, weight, chance.rate, r[0]["n"]))

    def evidences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([evidence(n, f, model) for n, f, _, _ in scan(b.column(1), model)], pa.float64())], ["label", "x"])

    seen = rows.mapInArrow(evidences, "label int, x double").toArrow()
    slope, intercept = platt(np.log1p(seen["x"].to_numpy()), seen["label"].to_numpy())
    return Lexicon(model.keys, model.weights, model.penalty, model.rate, model.scale, slope, intercept)


PASSAGES = "array<struct<start:long,end:long,score:double,log_e:double>>"


def passages(docs: DataFrame, model: Lexicon | None) -> DataFrame:
    """doc_id, score, predicted, and every significant passage as a span of UTF-8 bytes with its score."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("log_e", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, spans = np.full(b.num_rows, 0.5), [[] for _ in range(b.num_rows)]
            if model:
                for i, (n, found, starts, ends) in enumerate(scan(b.column(1), model)):
                    score[i] = np.log1p(evidence(n, found, model))
                    for a, z, s in found:
                        e = float(log_e(s, n, model))
                        if e <= np.log(E_VALUE):
                            spans[i].append({"start": int(starts[a]), "end": int(ends[z - 1]), "score": s, "log_e": e})
                score = logistic(model.slope * score + model.intercept)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, kind)], ["doc_id", "score", "predicted", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int, passages {PASSAGES}")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of passages of every document."""
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    found = passages(docs, train(docs, labels))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
