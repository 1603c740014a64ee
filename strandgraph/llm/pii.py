"""Personal data: base patterns, and a skip-chain conditional random field that makes labels consistent in a document.

The base patterns find e-mail addresses, IP addresses, card and phone numbers; their spans always stay. Nodes of the
random field are the base spans (observed) and further look-alikes: long runs of digits, addresses written around
the sign. Neighbours in the text share a chain potential. A skip edge joins each node to the next one with
the same or a similar token, however far, and each look-alike to the first observed node of each kind with such a token,
with a potential for equal labels. Loopy sum-product messages run until they settle, for at most as many rounds as
there are nodes (ROUNDS, if that is more); a look-alike whose marginal favours a kind is added as a span, also
where the document has no base span, or the look-alike no edge: its shape alone can favour a kind.

The node and chain potentials are learned from all documents, with the base labels as distant supervision: counts of
(shape, label) and (label, label), tables whose size is fixed by the shapes and labels, not by the corpus.

Edge cases: null or empty text has no spans; null ids and repeated rows keep their rows; an empty table teaches nothing
and returns nothing; further columns are not read. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.shared import materialise

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
#: Potential of a skip edge between equal labels, and bounds of the learned potentials (in nats).
SKIP, MOST, CHAIN_MOST = 4.0, 3.0, 1.0
#: Code points between neighbours that still share a chain potential.
REACH = 80
#: Rounds that any document may take; one of more nodes may take as many as it has nodes.
ROUNDS, DAMPING, SETTLED = 1000, 0.5, 1e-4

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}")
#: Starts only where a run of letters starts, so that long runs cost linear time.
_AROUND = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+) ?[(\[](?:at|AT|At)[)\]] ?([A-Za-z0-9-]+(?: ?(?:\.|[(\[](?:dot|DOT|Dot)[)\]]) ?[A-Za-z0-9-]+)+)")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DOT = re.compile(r" ?(?:\.|[(\[](?:dot|DOT|Dot)[)\]]) ?")

Span = tuple[int, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, not overlapping; every sign is looked at once, so that long runs cost linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, start)
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(values)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out: list[Span] = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


@dataclass(frozen=True)
class Node:
    start: int
    end: int
    label: int  # OTHER where no base span says otherwise
    token: str  # equal for the same or similar tokens
    shape: str


def _node(text: str, start: int, end: int, label: int) -> Node:
    own = text[start:end]
    if label == 0 or (label == OTHER and not own[-1].isdigit()) or _AROUND.fullmatch(own):
        m = _AROUND.fullmatch(own)
        token = f"{m[1]}@{_DOT.sub('.', m[2])}" if m else own
        return Node(start, end, label, token.lower().rstrip("."), "address")
    digits = _NOT_DIGIT.sub("", own)
    if label == 1:
        return Node(start, end, label, own, "dotted")
    return Node(start, end, label, digits[-9:], f"digits {min(len(digits), 20)}")


def nodes(text: str, base: list[Span]) -> list[Node]:
    """Base spans and look-alikes that touch none of them, in the order of the text."""
    out = [_node(text, a, b, k) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken] or [len(text) + 1])
    reach = np.maximum.accumulate(np.array([b for _, b in taken] or [0]))

    def free(a: int, b: int) -> bool:
        i = int(np.searchsorted(starts, b)) - 1
        return i < 0 or i >= len(reach) or reach[i] <= a

    looks = [m.span() for m in _NUMBER.finditer(text)]
    if "(" in text or "[" in text:
        looks += [m.span() for m in _AROUND.finditer(text)]
    out += [_node(text, a, b, OTHER) for a, b in looks if free(a, b)]
    return sorted(out, key=lambda x: (x.start, x.end))


@dataclass(frozen=True)
class Field:
    """Learned potentials: of each label for a shape, and of each pair of labels for neighbours."""

    unary: dict[str, np.ndarray]
    chain: np.ndarray

    def added(self, found: list[Node]) -> list[Span]:
        """Look-alikes that the field labels, given the observed nodes."""
        if all(x.label != OTHER for x in found):
            return []
        n, k = len(found), OTHER + 1
        unary = np.zeros((n, k))
        for i, x in enumerate(found):
            if x.label != OTHER:
                unary[i] = -1e3
                unary[i, x.label] = 0
            else:
                unary[i] = self.unary.get(x.shape, np.zeros(k))
        # two nodes share one edge: the potentials of several reasons to join them add up
        joined: dict[tuple[int, int], np.ndarray] = {}
        last: dict[str, int] = {}
        observed: dict[str, dict[int, int]] = {}
        for i, x in enumerate(found):
            if x.label != OTHER:
                observed.setdefault(x.token, {}).setdefault(x.label, i)
        skip = SKIP * np.eye(k)
        for i, x in enumerate(found):
            if i and x.start - found[i - 1].end <= REACH:
                joined[i - 1, i] = self.chain
            same = {(last[x.token], i)} if x.token in last else set()
            if x.label == OTHER:
                same |= {(min(i, j), max(i, j)) for j in observed.get(x.token, {}).values()}
            for edge in same:
                joined[edge] = joined[edge] + skip if edge in joined else skip
            last[x.token] = i
        edges, kinds = np.array(list(joined), np.int64).reshape(-1, 2), np.array(list(joined.values())).reshape(-1, k, k)
        marginal = beliefs(unary, edges, kinds)
        best = marginal.argmax(1)
        return [(int(best[i]), x.start, x.end) for i, x in enumerate(found) if x.label == OTHER and best[i] != OTHER and marginal[i, best[i]] > 0.5]


def beliefs(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    """Marginals by damped loopy sum-product over a pairwise field; exact on trees."""
    n_edges, k = len(edges), unary.shape[1]
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    table = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(n_edges) + n_edges, np.arange(n_edges)])
    message, total, live = np.zeros((2 * n_edges, k)), unary.astype(float), np.arange(2 * n_edges)
    for _ in range(max(ROUNDS, len(unary)) if n_edges else 0):
        inner = (total[source[live]] - message[back[live]])[:, :, None] + table[live]
        top = inner.max(1)
        new = top + np.log(np.exp(inner - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        step = new - message[live]
        message[live] += (1 - DAMPING) * step
        np.add.at(total, target[live], (1 - DAMPING) * step)
        # the next round is for messages that still move, and those of nodes that these reach
        moved, reached = np.zeros(2 * n_edges, bool), np.zeros(len(unary), bool)
        moved[live[np.abs(step).max(1) >= SETTLED]] = True
        reached[target[moved]] = True
        live = np.flatnonzero(moved | reached[source])
        if not len(live):
            break
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


_BASE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_NODES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32()), ("token", pa.string()), ("shape", pa.string())]))
_FOUND = "base array<struct<kind:int,start:int,end:int>>, nodes array<struct<start:int,end:int,label:int,token:string,shape:string>>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and nodes of every row: the one pass that reads texts. Tokens are told apart by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, every = [], []
            for text in b.column(1).to_pylist():
                spans = base_spans(text) if text else []
                base.append([{"kind": k, "start": a, "end": z} for k, a, z in spans])
                every.append([{"start": x.start, "end": x.end, "label": x.label, "token": hashlib.blake2b(x.token.encode(), digest_size=12).hexdigest(), "shape": x.shape} for x in nodes(text, spans)] if text else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, _BASE), pa.array(every, _NODES)], ["doc_id", "base", "nodes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_FOUND}")


def learn(docs: DataFrame) -> Field:
    return learn_from(find(docs))


def learn_from(found: DataFrame) -> Field:
    """Potentials from the counts of all documents. The tables have one row for each shape and label pair seen, a few dozen."""
    here, after = F.col("nodes"), F.expr("slice(nodes, 2, size(nodes))")
    alone = F.transform(here, lambda x: F.struct(x["shape"].alias("shape"), x["label"].alias("one"), F.lit(-1).alias("two")))

    def neighbours(x: Column, y: Column) -> Column:
        return F.when(y["start"] - x["end"] <= REACH, F.struct(F.lit("").alias("shape"), x["label"].alias("one"), y["label"].alias("two")))

    rows = found.where(F.size("nodes") > 0).select(F.explode(F.concat(alone, F.filter(F.zip_with(here, after, neighbours), lambda p: p.isNotNull()))).alias("c"))
    counts = rows.groupBy("c.shape", "c.one", "c.two").agg(F.count("*").alias("n")).collect()
    k = OTHER + 1
    shapes: dict[str, np.ndarray] = {}
    pairs = np.ones((k, k))
    for r in counts:
        if r["two"] < 0:
            shapes.setdefault(r["shape"], np.ones(k))[r["one"]] += r["n"]
        else:
            pairs[r["one"], r["two"]] += r["n"]
    joint = pairs / pairs.sum()
    chain = np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)))
    unary = {s: np.clip(np.log(c) - np.log(c[OTHER]), -MOST, MOST) for s, c in shapes.items()}
    return Field(unary, np.clip(chain, -CHAIN_MOST, CHAIN_MOST))


def all_spans(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by kind, then start."""
    base = base_spans(text) if text else []
    return base, sorted(base + field.added(nodes(text, base))) if text else base


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base counts of each kind, base_sha256, spans as text, and how many the field added."""
    found = materialise(find(docs), "nodes")
    told = docs.sparkSession.sparkContext.broadcast(field or learn_from(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans, more = [], [], [], []
            for given, every in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                base = [(x["kind"], x["start"], x["end"]) for x in given]
                added = told.value.added([Node(**x) for x in every])
                counts.append([sum(s[0] == k for s in base) for k in range(OTHER)])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(sorted(base + added)))
                more.append(len(added))
            cols = [pa.array([c[k] for c in counts], pa.int64()) for k in range(OTHER)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def redacted(text: str | None, field: Field) -> str | None:
    """The text with every span replaced by its kind in angle brackets; of spans that overlap, one mark for all."""
    if not text:
        return text
    _, spans = all_spans(text, field)
    out, done = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= done:
            out += [text[done:a], f"<{KINDS[k]}>"]
        done = max(done, b)
    return "".join([*out, text[done:]]) if spans else text


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with personal data replaced; ``n_chars``, where there is one, follows."""
    told = docs.sparkSession.sparkContext.broadcast(learn(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([redacted(t, told.value) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else b.column(i) for i in range(b.num_columns)], schema=b.schema)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
