import pytest

from strandgraph.functions import params
from strandgraph.jobs.config import GraphConfig

# shortest read: segments, lexicographic k and window, gapped k at distances 2 and 1, hashed k and window
GOLDEN = {
    6: (2, 4, 2, 4, 4, 4, 5), 7: (2, 4, 2, 4, 4, 4, 5), 12: (2, 4, 3, 4, 4, 4, 8), 15: (2, 4, 3, 4, 4, 4, 8), 16: (2, 4, 4, 4, 4, 4, 5),
    24: (2, 4, 3, 4, 4, 4, 8), 32: (2, 4, 5, 4, 4, 4, 8), 49: (2, 4, 9, 4, 4, 6, 12), 50: (3, 4, 5, 4, 4, 6, 7), 75: (3, 6, 7, 5, 9, 9, 10),
    100: (3, 8, 9, 7, 12, 11, 22), 150: (3, 12, 14, 10, 17, 17, 18), 250: (3, 19, 23, 16, 27, 28, 29), 300: (3, 23, 28, 19, 27, 34, 35),
}


@pytest.mark.parametrize("length", GOLDEN)
def test_golden_table(length):
    n, k, window, g2, g1, hk, hw = GOLDEN[length]
    lex, hashed = params.lexicographic(length), params.hashed(length)
    assert params.segment_count(length) == n
    assert (lex.k, lex.window) == (k, window) and (hashed.k, hashed.window) == (hk, hw)
    assert (params.gapped_k(length, 2), params.gapped_k(length, 1)) == (g2, g1)
    assert lex.segments == hashed.segments == (n if length >= 16 else 1)


@pytest.mark.parametrize("length", [0, 5, 301])
def test_lengths_without_rules(length):
    with pytest.raises(ValueError):
        params.lexicographic(length)


def test_gapped_plan():
    assert [params.gapped_times(n, m) for n, m in ((12, 2), (16, 2), (16, 1), (16, 3))] == [4, 3, 3, 1]
    assert len(params.seeds(12, 2)) == 8 and params.seeds(12, 2) == params.seeds(12, 2) != params.seeds(12, 2, seed=1)
    assert params.take_all_gapped(12, params.seeds(12, 2)) and not params.take_all_gapped(24, params.seeds(24, 2))
    assert not params.take_all_gapped(6, params.seeds(6, 2))  # too short for any start: the count wraps round
    assert not params.take_all_gapped(75, params.seeds(75, 2))


@pytest.mark.parametrize("bad", [{"mode": "x"}, {"min_distance": 3}, {"max_distance": 0, "min_distance": 0}, {"default_params": False}, {"routing": "x"}, {"bin_size_max": 1}])
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        GraphConfig(**bad)


def test_mode_names_ignore_case():
    assert GraphConfig(mode="OMH").mode == "omh"
