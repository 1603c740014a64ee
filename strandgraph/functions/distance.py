"""Edit distances of many pairs of texts at once, up to a bound, in work that follows their letters and not the square of these."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs worked out at once.
STEP = 1 << 10


def _letters(texts: pa.Array, width: int, filled: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of letters, filled up with a number that no letter has; sizes)."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype="<i4")
    rows = np.full((len(sizes), width), filled, dtype=np.int32)
    rows[np.arange(width) < sizes[:, None]] = flat
    return rows, sizes


def _within(left: pa.Array, right: pa.Array, most: int) -> np.ndarray:
    width = max(pc.max(pc.utf8_length(x)).as_py() for x in (left, right)) + most + 1
    (a, la), (b, lb) = _letters(left, width, -1), _letters(right, width, -2)
    row, place = np.arange(len(la)), np.arange(width, dtype=np.int32)
    apart = {}
    for k in range(-most, most + 1):
        # for each place of the first text the next one whose letter is not the other's, k places further
        differs = np.ones(a.shape, dtype=bool)
        ours, theirs = slice(max(0, -k), width - max(0, k)), slice(max(0, k), width - max(0, -k))
        differs[:, ours] = a[:, ours] != b[:, theirs]
        apart[k] = np.minimum.accumulate(np.where(differs, place, width)[:, ::-1], axis=1)[:, ::-1]
    out = np.full(len(la), -1, dtype=np.int32)
    far = {0: apart[0][:, 0].astype(np.int64)}  # how much of the first text is behind, by how many letters more the other has
    for e in range(most + 1):
        if e:
            none = np.full(len(la), -width, dtype=np.int64)
            ways = {k: np.maximum(np.maximum(far.get(k, none) + 1, far.get(k - 1, none)), far.get(k + 1, none) + 1) for k in range(-e, e + 1)}
            far = {}
            for k, way in ways.items():
                at = np.minimum(way, np.minimum(la, lb - k))
                far[k] = np.where((at >= 0) & (at + k >= 0), apart[k][row, np.clip(at, 0, width - 1)], -width)
        for k in far:
            out[(out < 0) & (lb - la == k) & (far[k] >= la)] = e
    return out


def edits_within(left: pa.Array, right: pa.Array, most: int) -> np.ndarray:
    """The edit distance of each pair of texts, or -1 where it is more than ``most``."""
    parts = [_within(left.slice(at, STEP), right.slice(at, STEP), most) for at in range(0, len(left), STEP)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
