"""The packing search runs to the bound, or until generations stop to gain."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from gridloom.llm import packing


def _counts(seed: int, low: int, high: int, n: int) -> np.ndarray:
    return np.bincount(np.random.default_rng(seed).integers(low, high, n), minlength=1025)


# lengths, and how far from the bound the search may end; the bound itself can't always be met
MIXES = [((4, 100, 513, 4000), 1), ((4, 180, 400, 6000), 2), ((4, 250, 600, 4000), 7), ((4, 1, 1025, 3000), 4), ((7, 1, 300, 5000), 1)]


@pytest.mark.parametrize("mix, gap", MIXES)
def test_islands_end_near_the_bound(spark, mix, gap):
    counts = _counts(*mix)
    plan = packing.plan_packing(spark, counts)
    held = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 1024 and times > 0
        held.update({s: times * n for s, n in Counter(pattern).items()})
    assert held == Counter({s: int(n) for s, n in enumerate(counts) if n})
    least = packing.bound(counts, 1024)
    assert least <= packing.bins(plan) <= least + gap
    assert packing.bins(plan) <= packing.bins(packing.best_fit(counts, 1024))


def test_more_patience_never_packs_worse():
    counts = _counts(3, 250, 600, 1500)
    plans = [packing.evolve(counts, 1024, [], 1, patience) for patience in (0, 20, 200)]
    assert packing.bins(plans[0]) >= packing.bins(plans[1]) >= packing.bins(plans[2]) >= packing.bound(counts, 1024)


def test_a_million_times_the_items_takes_no_longer(spark):
    counts = _counts(4, 1, 1025, 3000)
    plan = packing.evolve(counts * 1_000_000, 1024, [], 1, 20)
    assert packing.bins(plan) <= packing.bins(packing.best_fit(counts, 1024)) * 1_000_000
    assert len(plan) < 20_000
