"""Parameter rules of the bucketing schemes, from the shortest read length and the distance range."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

SHORTEST, LONGEST = 6, 300
K_LEAST, K_MOST = 4, 27


def _whole(x: float) -> int:
    """Rounded, halves away from zero."""
    return math.floor(x + 0.5)


def segment_count(length: int) -> int:
    """Segments of the shortest read: two below 50 letters, three from there."""
    if not SHORTEST <= length <= LONGEST:
        raise ValueError(f"reads of {SHORTEST} to {LONGEST} letters have default parameters; the shortest has {length}")
    return 2 if length < 50 else 3


def use_segments(length: int, wanted: bool = True) -> bool:
    """Reads below 16 letters are never cut."""
    return wanted and length >= 16


def lexicographic_k(length: int, ratio: float = 0.3) -> int:
    n = segment_count(length)
    return min(K_MOST, max(K_LEAST, _whole(ratio * n * (1 + length // n) / (3 + n * ratio))))


@dataclass(frozen=True)
class Scheme:
    """k, the window in k-mers, and the number of segments (1: the whole read)."""

    k: int
    window: int
    segments: int = 1


def lexicographic(length: int, alpha: float = 0.5, ratio: float = 0.3, segmentation: bool = True) -> Scheme:
    n = segment_count(length)
    k, w = lexicographic_k(length, ratio), int(length // n * alpha)
    window = w if w - k + 1 <= 2 else w - k + 1
    return Scheme(k, max(2, window), n if use_segments(length, segmentation) else 1)


def hashed(length: int, beta: float = 2, expected: int = 6, segmentation: bool = True) -> Scheme:
    n = segment_count(length)
    cut = use_segments(length, segmentation)
    c, unit = (expected // n, length // n) if cut else (expected, length)
    k = max(K_LEAST, math.ceil((2 * (unit + 1) - c) / (c * beta + 2)))
    w = math.ceil(k * beta)
    return Scheme(k, k + 1 if w >= unit - k + 1 else w, n if cut else 1)


def gapped_k(length: int, distance: int, default_k: int = 4, probability: float = 0.86) -> int:
    if length <= 50:
        return default_k
    k = math.ceil((1 - probability) * (2 + length) / (distance + 2 - 2 * probability))
    return min(K_MOST, max(K_LEAST, k))


def gapped_times(length: int, most: int) -> int:
    return 4 if length < 16 else 3 if most in (1, 2) else 1


def seeds(length: int, most: int, seed: int = 2024, default_k: int = 4, probability: float = 0.86, times: int | None = None) -> list[tuple[int, int]]:
    """(seed, k) for each distance from ``most`` down to 1, ``times`` each. Values are reproducible, not those of another program."""
    draw = random.Random(seed)
    times = times or gapped_times(length, most)
    return [(draw.getrandbits(62), gapped_k(length, d, default_k, probability)) for d in range(most, 0, -1) for _ in range(times)]


def take_all_gapped(length: int, chosen: list[tuple[int, int]]) -> bool:
    """Whether to use every gapped k-mer as a key: one k, and as many draws as there are start positions.

    The number of positions is taken as an unsigned number, so a read too short for any wraps round and says no.
    """
    ks = {k for _, k in chosen}
    return len(ks) == 1 and len(chosen) >= (length - 2 * next(iter(ks)) + 1) % (1 << 64)
