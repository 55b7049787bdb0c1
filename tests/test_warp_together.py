import numpy as np

from cadenza.operators import warp as W


def test_small_pairs_are_filled_side_by_side(monkeypatch):
    """As the single pair's path, ties and sequences of unequal length included, and with one call of the cost for a diagonal of all."""
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (1, 6), (7, 1), (5, 9), (12, 12)):
        a, b = rng.integers(0, 3, (20, n)).astype(float), rng.integers(0, 3, (20, m)).astype(float)
        asked = []
        pair, step, i, j = W._paths(a, b, lambda x, y: asked.append(1) or W.distance(x, y))
        assert len(asked) == n + m - 1
        for p in range(20):
            want = W._Pair(a[p], b[p], W.distance).path()
            assert np.array_equal(np.c_[i, j][pair == p], want) and step[pair == p].tolist() == list(range(len(want)))
