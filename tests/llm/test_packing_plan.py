"""The rounds of the packing plan against best fit, one piece at a time; letters of the language ID."""

from collections import Counter

import numpy as np
import pytest

from signalmill.llm.common import has_letter
from signalmill.llm.packing import plan_rounds


def best_fit(lengths, capacity):
    """Longest piece first, each into the smallest gap that is large enough."""
    gaps = []
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        gap = min(fits) if fits else capacity
        if fits:
            gaps.remove(gap)
        gaps.append(gap - length)
    return Counter(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_rounds_are_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 90))
    lengths = (1 + rng.random(int(rng.integers(0, 250))) ** rng.integers(1, 4) * (capacity - 1)).astype(int).tolist()
    filled, placed = {}, Counter()
    for length, first, count, window, per, offset in plan_rounds(dict(Counter(lengths)), capacity):
        for k in range(count):
            at = window + k // per
            assert filled.get(at, 0) == offset + k % per * length  # gapless
            filled[at] = filled.get(at, 0) + length
            placed[length, first + k] += 1
    assert set(placed.values()) <= {1} and Counter(n for n, _ in placed) == Counter(lengths)
    assert Counter(capacity - f for f in filled.values()) == best_fit(lengths, capacity)
    assert set(filled) == set(range(len(filled)))


def test_number_signs_are_no_letters():
    assert not any(map(has_letter, ("", "½ ² ① Ⅷ", "12 _-", "́"))) and all(map(has_letter, ("1a", "日", "ª", "é")))
