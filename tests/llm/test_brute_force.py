"""Trained operators against plain versions of the same definitions, on small tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandgraph.llm import pii, quality, toxicity
from strandgraph.llm.labelled import platt
from tests.llm.cases import TEXTS, documents, labels
from tests.llm.test_text_operators import classified


def training_rows(docs, marks, kind, parts, held):
    """(label, text) of the documents that a model may learn from."""
    chosen = {}
    for m in marks.collect():
        if m.doc_id is not None and m[kind] in (0, 1) and zlib.crc32(str(m.doc_id).encode()) % parts != held:
            chosen[m.doc_id] = max(chosen.get(m.doc_id, 0), m[kind])
    return [(chosen[r.doc_id], r.text) for r in docs.collect() if r.doc_id in chosen]


def flat_gradient(x, label, slope, intercept):
    """Whether no small change of a logistic fit with smoothed targets betters it."""
    pos, neg = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(a, b):
        z = a * x + b
        return float((np.logaddexp(0, z) - target * z).sum())

    here = loss(slope, intercept)
    steps = [(d * max(abs(slope), 1e-3), e) for d in (-0.02, 0, 0.02) for e in (-0.02, 0, 0.02)]
    return all(here <= loss(slope + d, intercept + e) + 0.02 for d, e in steps)


def plain_tokens(text):
    """For each word its tokens (the word and its stems), and its context."""
    folded = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    out = []
    for i, w in enumerate(words):
        context = (words[i - 1] if i else None, w, words[i + 1] if i + 1 < len(words) else None)
        out.append(([(0, w), *((k, w[:k]) for k in (4, 5, 6) if len(w) > k)], context))
    return out


def plain_lean(toxic, other, share, vocabulary):
    n, limit = toxic + other, 3 * share / (3 * share + 1 - share)
    if toxic < 2 or toxic / n <= limit:
        return False
    a = toxic / n
    tail = n * (a * math.log(a / limit) + ((1 - a) * math.log((1 - a) / (1 - limit)) if a < 1 else 0))
    return tail - math.log(max(vocabulary, 2)) >= 1


def plain_segments(scores):
    """By definition: the best segment first, then those on its left and on its right."""

    def best(lo, hi):
        top = max(((sum(scores[a:b]), -a, -b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
        if top[0] <= 1e-9:
            return []
        a, b = -top[1], -top[2]
        return best(lo, a) + [(a, b, top[0])] + best(b, hi)

    return best(0, len(scores))


def plain_toxicity(rows):
    """(weights, penalty, lambda, K, log1p of each row's evidence)."""
    counts, contexts = {0: Counter(), 1: Counter()}, set()
    for label, text in rows:
        for tokens, context in plain_tokens(text):
            counts[label].update(tokens)
            contexts |= {(t, context, label) for t in tokens}
    total = {k: sum(c.values()) for k, c in counts.items()}
    share, vocabulary = total[1] / (total[0] + total[1]), len(set(counts[0]) | set(counts[1]))
    first = {t for t in counts[1] if plain_lean(counts[1][t], counts[0][t], share, vocabulary)}
    seen = Counter((t, label) for t, _, label in contexts if t in first)
    weights = {}
    for t in first:
        yes, no = seen[t, 1], seen[t, 0]
        if plain_lean(yes, no, share, vocabulary):
            part = (yes + no) / (total[0] + total[1]) * 1000
            w = math.log((yes + part) / (total[1] + 1000 - yes - part)) - math.log((no + part) / (total[0] + 1000 - no - part))
            if w > 0:
                weights[t] = w
    scored = [(label, [max((weights.get(t, 0) for t in tokens), default=0) for tokens, _ in plain_tokens(text)]) for label, text in rows]
    words, hits, mass = Counter(), Counter(), 0.0
    for label, own in scored:
        words[label] += len(own)
        hits[label] += sum(w > 0 for w in own)
        mass += sum(own)
    q1, q0 = ((hits[k] + 0.5) / (words[k] + 1) for k in (1, 0))
    mean = mass / (hits[0] + hits[1])
    penalty = min(max(-math.log((1 - q1) / (1 - q0)), 0.01), 1)
    low, high = 1e-6, 50 / mean
    while high - low > 1e-13 * high:
        mid = (low + high) / 2
        low, high = (mid, high) if q0 * math.exp(mid * mean) + (1 - q0) * math.exp(-mid * penalty) < 1 else (low, mid)
    parts = [(label, len(own), plain_segments([w if w > 0 else -penalty for w in own])) for label, own in scored]
    chance = sum(s >= mean - 1e-12 for label, _, own in parts if label == 0 for *_, s in own)
    scale = (chance + 0.5) * math.exp(low * mean) / (words[0] + 1)
    evidence = [sum(max(0, low * s - math.log(scale * max(n, 1))) for *_, s in own) for _, n, own in parts]
    return weights, penalty, low, scale, np.log1p(evidence)


def test_toxicity_is_what_its_definition_says(spark):
    r, rows, marks = random.Random(4), [], []
    common = ["".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 8))) for _ in range(60)]
    for i in range(160):
        text = [r.choice(common) for _ in range(r.randint(0, 14))]
        bad = i % 4 == 0
        for word in [r.choice(["idiot", "Idiots", "moron", "scümbag"]) for _ in range(r.randint(1, 3) * bad)] + ["moron"] * (i % 37 == 1):
            text.insert(r.randint(0, len(text)), word)
        rows.append((i, " ".join(text)))
        marks.append((i, 0, int(bad)))
    rows += rows[:20] + [(900, None), (901, ""), (None, "idiot")]
    docs, marked = documents(spark, rows), labels(spark, [*marks, (900, 0, 0), (901, 0, 0), (None, 0, 1), (3, 1, None)])
    learned = training_rows(docs, marked, "toxic", 5, 0)
    weights, penalty, rate, scale, x = plain_toxicity(learned)
    model = toxicity.train(docs, marked)
    assert len(weights) > 5 and len(model.keys) == len(weights)
    assert np.allclose(np.sort(model.weights), sorted(weights.values()), rtol=1e-9)
    assert (model.penalty, model.rate, model.scale) == (pytest.approx(penalty), pytest.approx(rate, rel=1e-6), pytest.approx(scale, rel=1e-5))
    assert flat_gradient(x, np.array([label for label, _ in learned]), model.slope, model.intercept)
    got = {(r.doc_id, r.score) for r in toxicity.classify(docs, marked).collect()}
    want = {text: 1 / (1 + math.exp(-(model.slope * e + model.intercept))) for (_, text), e in zip(learned, x, strict=True)}
    for i, text in rows:
        if text in want:
            assert any(d == i and s == pytest.approx(want[text], rel=1e-5) for d, s in got)


def plain_features(text):
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    fold = lambda x: x.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    lines = [fold(x) for x in raw.split(b"\n") if x]
    odds = lambda count, total: math.log((count + 0.5) / (max(total - count, 0) + 0.5))
    sizes = [len(w) for w in words]
    mean = sum(sizes) / max(len(words), 1)
    square = sum(s * s for s in sizes) / max(len(words), 1)
    low = [fold(w) for w in words]
    odd_end = sum(not (chr(w[-1]).isascii() and (chr(w[-1]).isalnum() or chr(w[-1]) in ".,;:?") or w[-1] > 127) for w in words)
    entropy = -sum(n / len(raw) * math.log(n / len(raw)) for n in Counter(raw).values())
    return [
        *(math.log1p(v) for v in (len(raw), len(words), len(lines), mean, max(square - mean**2, 0))),
        entropy,
        *(odds(sum(raw.count(b) for b in set(members)), len(raw)) for members in quality._CLASSES.values()),
        odds(len(set(low)), len(words)),
        odds(sum(a == b for a, b in itertools.pairwise(low)), len(words)),
        odds(odd_end, len(words)),
        odds(sum(w == b"|" for w in words), len(words)),
        odds(len(set(lines)), len(lines)),
        math.log1p(len(raw) / max(len(lines), 1)),
    ]


def test_quality_is_what_its_definition_says(spark):
    docs, marks = classified(spark, "quality")
    learned = training_rows(docs, marks, "quality", 3, 1)
    x, label = np.array([plain_features(t) for _, t in learned]), np.array([y for y, _ in learned])
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = (x - centre) / scale
    own = [np.cov(z[label == k], rowvar=False) for k in (0, 1)]
    count = [int((label == k).sum()) for k in (0, 1)]
    pooled = ((count[0] - 1) * own[0] + (count[1] - 1) * own[1]) / (len(z) - 2)

    def log_density(k, point):
        share = max(0.15, min(1, x.shape[1] / count[k]))
        s = (1 - share) * own[k] + share * pooled
        s = 0.98 * s + 0.02 * np.trace(s) / len(s) * np.eye(len(s))
        apart = point - z[label == k].mean(0)
        return math.log(count[k] / len(z)) - np.linalg.slogdet(s)[1] / 2 - apart @ np.linalg.solve(s, apart) / 2

    model = quality.train(docs, marks)
    texts = sorted({t or "" for _, t in [*TEXTS, *learned[:40]]})
    want = []
    for t in texts:
        point = (np.array(plain_features(t)) - centre) / scale
        want.append(log_density(1, point) - log_density(0, point))
    seen = {}
    for r in quality.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        seen[r.text or ""] = r.score
    margins = np.array([log_density(1, p) - log_density(0, p) for p in z])
    assert flat_gradient(margins, label, model.slope, model.intercept)
    for t, m in zip(texts, want, strict=True):
        if t in seen:
            assert seen[t] == pytest.approx(1 / (1 + math.exp(-min(500, max(-500, model.slope * m + model.intercept)))), rel=1e-4, abs=1e-9)
    assert len(set(seen) & set(texts)) > 30


@pytest.mark.parametrize("seed", range(5))
def test_calibration_has_a_flat_gradient(seed):
    rng = np.random.default_rng(seed)
    label = (rng.random(300) < 0.3).astype(int)
    x = rng.normal(size=300) * 10**seed / 100 + label * 10**seed / 100
    assert flat_gradient(x, label, *platt(x, label))


def plain_added(found, field):
    """Exhaustive marginals; None where the edges close a loop, which messages only approximate."""
    k = pii.OTHER + 1
    edges = {}
    for i, x in enumerate(found):
        if i and x.start - found[i - 1].end <= pii.REACH:
            edges[i - 1, i] = field.chain
        before = [j for j in range(i) if found[j].token == x.token][-1:]
        firsts = {}
        for j, y in enumerate(found):
            if y.token == x.token and y.label != pii.OTHER and x.label == pii.OTHER:
                firsts.setdefault(y.label, j)
        for j in {*before, *firsts.values()}:
            e = (min(i, j), max(i, j))
            if x.label == pii.OTHER or j in before:
                edges.setdefault(e, np.zeros((k, k)))
                edges[e] = edges[e] + (4.0 * np.eye(k))
    group = list(range(len(found)))
    for a, b in edges:
        if group[a] == group[b]:
            return None
        group = [group[a] if g == group[b] else g for g in group]
    total = np.zeros((len(found), k))
    for state in itertools.product(*([x.label] if x.label != pii.OTHER else range(k) for x in found)):
        p = math.exp(sum(field.unary.get(x.shape, np.zeros(k))[s] for x, s in zip(found, state) if x.label == pii.OTHER) + sum(t[state[a], state[b]] for (a, b), t in edges.items()))
        for i, s in enumerate(state):
            total[i, s] += p
    total /= total.sum(1, keepdims=True)
    return [(int(t.argmax()), x.start, x.end) for x, t in zip(found, total) if x.label == pii.OTHER and t.argmax() != pii.OTHER and t.max() > 0.5]


def test_added_spans_are_those_of_exhaustive_marginals():
    r, rng, k = random.Random(1), np.random.default_rng(1), pii.OTHER + 1
    pieces = ["+1 (499) 555-6503", "(499) 555-6503", "555-010-4477", "bob (at) x (dot) org", "bob@x.org", "amy [at] y.org", "10.0.0.1", "4111 1111 1111 1111", "4111 1111 1111 1112"]
    judged = some = 0
    for _ in range(250):
        text = "".join(r.choice(pieces) + r.choice([" and ", " " + "x" * 100 + " "]) for _ in range(r.randint(1, 5)))
        found = pii.nodes(text, pii.base_spans(text))
        shapes = {x.shape for x in found}
        field = pii.Field({s: rng.uniform(-3, 3, k) for s in shapes}, rng.uniform(-1, 1, (k, k)))
        want = plain_added(found, field)
        if want is not None:
            assert field.added(found) == want
            judged, some = judged + 1, some + bool(want)
    assert judged > 100 and some > 30
