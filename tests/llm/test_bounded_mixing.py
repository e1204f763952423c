import numpy as np
import pytest

from cipherledger.llm import source_mixing as M


def test_chances_meet_targets():
    rng = np.random.default_rng(3)
    lang = {"en": 62, "de": 15, "fr": 14, "es": 9}
    cells = [(f"s{i}", x, str(k), float(n * (40 if i == 0 else 1) * rng.integers(1, 9) * (k + 1) ** 2)) for i in range(20) for x, n in lang.items() for k in range(5)]
    goals = [M.tempered(M._mass(cells, m)) for m in range(3)]
    w = M.rake(cells, goals)
    p = M.bounded(cells, w, goals, M.RATE)
    n = np.array([c[-1] for c in cells])
    assert 0 <= p.min() and p.max() <= 1
    for m, goal in enumerate(goals):
        for v, share in goal.items():
            assert sum(x * y for x, y, c in zip(p, n, cells) if c[m] == v) / (p * n).sum() == pytest.approx(share, abs=1e-3)
