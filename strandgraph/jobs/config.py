"""Settings of a graph build, checked before any data is read."""

from __future__ import annotations

from dataclasses import dataclass

MODES = ("brute_force", "minimizer_gomh", "miniception_gomh", "miniception", "omh")


@dataclass(frozen=True)
class GraphConfig:
    """All settings; those left at None come from the parameter rules and the shortest read."""

    mode: str = "minimizer_gomh"
    max_distance: int = 2
    min_distance: int = 1
    default_params: bool = True
    k: int | None = None
    window: int | None = None
    segments: int | None = None
    alpha: float = 0.5
    beta: float = 2.0
    n_kmer: int = 6
    ratio: float = 0.3
    probability: float = 0.86
    bin_size_max: int = 10_000
    gapped_k: int = 4
    gapped_times: int | None = None
    seed: int = 2024
    visit_depth: int = 15
    segmentation: bool = True
    omh_k: int = 18
    omh_m: int = 3
    omh_l: int = 2
    omh_variant: str = "prefix"
    miniception_k: int = 18
    miniception_w: int = 19
    #: "buckets": a large bucket is handled by the number of its sub-buckets; "size": by the size of each.
    routing: str = "buckets"
    hash_name: str = "fast"
    #: Reads outside the usual lengths: "warn" keeps and counts them, "drop" leaves them out, "fail" stops.
    on_bad_length: str = "warn"
    #: Reads with other letters than a sequence has: "fail" stops, "null" leaves them out.
    on_bad: str = "fail"

    def __post_init__(self) -> None:
        object.__setattr__(self, "mode", self.mode.lower())
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if not 0 <= self.min_distance <= self.max_distance or self.max_distance < 1:
            raise ValueError("distances must satisfy 0 <= min <= max and max >= 1")
        if not self.default_params and None in (self.k, self.window, self.segments):
            raise ValueError("without default parameters, k, window and segments must be given")
        if self.routing not in ("buckets", "size"):
            raise ValueError("routing must be buckets or size")
        if self.on_bad_length not in ("warn", "drop", "fail") or self.on_bad not in ("fail", "null"):
            raise ValueError("on_bad_length must be warn, drop or fail, on_bad fail or null")
        if self.bin_size_max < 2 or self.visit_depth < 1:
            raise ValueError("bin_size_max must be 2 or more, visit_depth 1 or more")
