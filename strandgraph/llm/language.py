"""Language of texts by a convolutional network over bytes.

Texts are cut into windows of a fixed number of bytes that overlap by the widest filter less one, so each run of bytes
under a filter is seen once, over the whole text. Bytes are embedded, filters of several widths slide over each window,
each filter keeps its largest answer, and a softmax gives the languages. The windows of a document are averaged before
the softmax. The network is trained here in numpy, on a bounded sample of labelled windows.

Edge cases: a text that is null or has no letter is ``und`` with score 0.0, as is every text where no labelled row can be
learned from. One known language is always the answer, with score 1.0. A null doc_id is neither learned from nor held out.
Repeated rows are each answered; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.labelled import fold
from strandgraph.llm.shared import _LOWER as LOWER
from strandgraph.llm.shared import TextBatch, make_room

FOLDS, HELD_OUT = 4, 2
#: Labelled documents and languages that are learned from, and windows of each document.
SAMPLE, LANGUAGES, WINDOWS = 4000, 1000, 4
WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4, 5), 16, 8
#: Windows that go through the network at a time.
TOGETHER = 32
PAD, WIDEST = 256, max(WIDTHS)
#: Positions a window covers: the last bytes begin the next window.
STEP = WINDOW - WIDEST + 1
UNKNOWN = "und"


@dataclass
class Network:
    """Weights: bytes (257, EMBED), filters (WIDEST * EMBED, all filters), their bias, and the softmax's."""

    names: list[str]
    bytes_: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(names: list[str], rng: np.random.Generator) -> Network:
        n = FILTERS * len(WIDTHS)
        table = rng.normal(0, 0.5, (257, EMBED))
        table[PAD] = 0
        filters = rng.normal(0, 1, (WIDEST * EMBED, n)) * np.sqrt(2 / (EMBED * np.repeat(WIDTHS, FILTERS)))
        return Network(names, *(x.astype(np.float32) for x in (table, filters * mask(), np.zeros(n), rng.normal(0, 0.1, (n, len(names))), np.zeros(len(names)))))

    def weights(self) -> list[np.ndarray]:
        return [self.bytes_, self.filters, self.bias, self.out, self.out_bias]

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, WIDEST * EMBED): what the widest filter sees at each position."""
        seen = self.bytes_[windows]
        return np.concatenate([seen[:, k : windows.shape[1] - WIDEST + 1 + k] for k in range(WIDEST)], axis=2)

    def pooled(self, patches: np.ndarray) -> np.ndarray:
        """Answers (windows, positions, filters) before their maximum."""
        return (patches.reshape(-1, patches.shape[2]) @ self.filters).reshape(*patches.shape[:2], -1)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        most = self.pooled(self.patches(windows)).max(1) + self.bias
        return np.maximum(most, 0) @ self.out + self.out_bias


def mask() -> np.ndarray:
    """1 where a filter of its width has a weight."""
    live = np.repeat(np.array(WIDTHS), FILTERS)
    return (np.repeat(np.arange(WIDEST), EMBED)[:, None] < live).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(net: Network, windows: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross entropy; through a maximum only its position gets any."""
    patches = net.patches(windows)
    answers = net.pooled(patches)
    where = answers.argmax(1)
    n, filters = where.shape
    most = np.take_along_axis(answers, where[:, None], 1)[:, 0] + net.bias
    hidden = np.maximum(most, 0)
    wrong = softmax(hidden @ net.out + net.out_bias)
    wrong[np.arange(n), label] -= 1
    wrong /= n
    back = (wrong @ net.out.T) * (most > 0)
    best = patches[np.arange(n)[:, None], where]  # (windows, filters, WIDEST * EMBED)
    to_filters = np.einsum("nf,nfk->kf", back, best) * mask()
    to_patch = (back[:, :, None] * net.filters.T).reshape(n, filters, WIDEST, EMBED)
    at = windows[np.arange(n)[:, None, None], where[:, :, None] + np.arange(WIDEST)].ravel()
    to_bytes = np.stack([np.bincount(at, weights=to_patch[..., e].ravel(), minlength=257) for e in range(EMBED)], 1)
    to_bytes[PAD] = 0
    return [to_bytes, to_filters, back.sum(0), hidden.T @ wrong, wrong.sum(0)]


def train(windows: np.ndarray, label: np.ndarray, names: list[str], epochs: int = 8, batch: int = 128, rate: float = 0.004, seed: int = 5) -> Network:
    """Adam over shuffled batches; windows are shortened at random, so that short texts are learned too."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(names, rng)
    first, second, t = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()], 0
    steps = epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            own = windows[order[at : at + batch]].copy()
            keep = np.where(rng.random(len(own)) < 0.3, rng.integers(8, WINDOW + 1, len(own)), WINDOW)
            own[np.arange(WINDOW) >= keep[:, None]] = PAD
            t += 1
            slow = rate * (1 - 0.9 * t / steps)
            for w, g, m, v in zip(net.weights(), gradients(net, own, label[order[at : at + batch]]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= slow * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def cut(text: TextBatch, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, first byte) of each window of the texts low to high; an empty text has one."""
    size = np.diff(text.offsets[low : high + 1])
    n = np.maximum(1, -(-(size - WIDEST + 1) // STEP))
    row = np.repeat(np.arange(low, high), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, text.offsets[row] + k * STEP


def bytes_at(text: TextBatch, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) bytes, A-Z as a-z; PAD beyond a text's end."""
    place = at[:, None] + np.arange(WINDOW)
    inside = place < text.offsets[row + 1][:, None]
    if not len(text.data):
        return np.full(place.shape, PAD)
    return np.where(inside, LOWER[text.data[np.minimum(place, len(text.data) - 1)]].astype(np.int64), PAD)


def turns_for(sizes: list[int], wanted: int) -> int:
    """How many rows each language may give so that together, as far as they have them, they give ``wanted``."""
    left, languages = wanted, sorted(sizes)
    for k, n in enumerate(languages):
        share = -(-left // (len(languages) - k))
        if n >= share:
            return share
        left -= n
    return max(languages, default=0) + 1


def labelled_windows(docs: DataFrame) -> DataFrame:
    """(lang, windows) of at most SAMPLE documents outside the held-out fold, of up to LANGUAGES languages.

    A document's turn is a hash of it, as a share of one, times the size of its language, so that languages take turns until one
    has no more. From the sizes follows which turns can matter: about twice the sample passes a filter in its own
    task, whatever the number of documents, before the sample is sorted out. Each document gives WINDOWS windows at places that hashes choose.
    """
    own = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    counted = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    sizes = docs.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in counted], "lang string, n long")
    last_turn = turns_for([r["n"] for r in counted], 2 * SAMPLE)
    raw, seed = F.encode("text", "utf-8"), F.xxhash64("doc_id", F.octet_length("text"))
    last = F.greatest(F.octet_length("text") - WINDOW, F.lit(0)) + 1
    places = [F.pmod(F.xxhash64(seed, F.lit(k)), last).cast("int") + 1 for k in range(WINDOWS)]
    windows = F.array_distinct(F.array(*(F.substring(raw, at, WINDOW) for at in places)))
    turn = F.pmod(seed, F.lit(1 << 30)) * F.col("n") / (1 << 30)
    chosen = own.join(F.broadcast(sizes), "lang").withColumn("turn", turn).where(F.col("turn") < last_turn)
    return chosen.select("lang", windows.alias("windows"), "turn").orderBy("turn", "lang", "windows").limit(SAMPLE).select("lang", "windows")


def fit(docs: DataFrame) -> Network | None:
    """The network of a table's labelled documents; none where no row can be learned from."""
    rows = labelled_windows(docs).toArrow().to_pylist()
    names = sorted({r["lang"] for r in rows})
    pairs = sorted({(w, names.index(r["lang"])) for r in rows for w in r["windows"]})
    if not pairs:
        return None
    text = TextBatch(pa.array([w for w, _ in pairs], pa.large_binary()))
    windows = bytes_at(text, np.arange(len(pairs)), text.offsets[:-1])
    return train(windows, np.array([label for _, label in pairs]), names)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for b in batches:
            text, known = TextBatch(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)
            names, scores = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
            for low, high in text.slices() if net else ():
                row, at = cut(text, low, high)
                total = np.zeros((high - low, len(net.names)))
                for i in range(0, len(row), TOGETHER):
                    np.add.at(total, row[i : i + TOGETHER] - low, net.logits(bytes_at(text, row[i : i + TOGETHER], at[i : i + TOGETHER])))
                share = softmax(total / np.bincount(row - low, minlength=high - low)[:, None])
                live = low + np.flatnonzero(known[low:high].astype(bool))
                best = share.argmax(1)[live - low]
                names[live], scores[live] = np.array(net.names, object)[best], share[live - low, best]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names.tolist(), pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    own = docs.select("doc_id", "text", letters.alias("letters"))
    return own.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those outside the held-out fold."""
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return predict(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
