import random
from functools import lru_cache

import numpy as np
import pytest

from vellum.llm import packing


def fewest(sizes, capacity):
    """Containers of an optimal packing, by dynamic programming over subsets."""
    n = len(sizes)
    best = [(n + 1, 0)] * (1 << n)
    best[0] = (0, capacity)
    for mask in range(1, 1 << n):
        for i in range(n):
            if mask >> i & 1:
                used, fill = best[mask ^ 1 << i]
                best[mask] = min(best[mask], (used, fill + sizes[i]) if fill + sizes[i] <= capacity else (used + 1, sizes[i]))
    return best[-1][0]


@pytest.mark.parametrize("low,high,capacity", [(1, 20, 20), (6, 20, 20), (5, 15, 24), (8, 30, 50), (1, 6, 12)])
def test_reduction_loses_no_optimum(low, high, capacity):
    rng = random.Random(low * 100 + high)
    fixed_sizes = 0
    for _ in range(60):
        sizes = [rng.randint(low, high) for _ in range(9)]
        count = np.bincount(sizes, minlength=capacity + 1)
        fixed = packing.reduce_sizes(count, capacity)
        rest = [int(s) for s in np.repeat(np.arange(len(count)), count)]
        assert sorted(rest + [s for f in fixed for s in f]) == sorted(sizes) and all(sum(f) <= capacity for f in fixed)
        assert len(fixed) + fewest(rest, capacity) == fewest(sizes, capacity)
        fixed_sizes += len(sizes) - len(rest)
    assert fixed_sizes > 60


def test_single_pairs_and_triples_are_fixed():
    reduced = lambda sizes, capacity: sorted(packing.reduce_sizes(np.bincount(sizes, minlength=capacity + 1), capacity))
    assert reduced([19, 5, 5], 20) == [(5, 5), (19,)] and reduced([13, 7, 4], 20) == [(4,), (13, 7)]
    assert (10, 6, 4) in reduced([10, 6, 5, 4], 20) or reduced([10, 6, 5, 4], 20) == []


@pytest.mark.parametrize("seed", range(4))
def test_reduced_packing_is_never_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.lognormal(5.5, 1.2, 3000).astype(int), 2048)
    _, used = packing.pack_sizes(sizes, 2048)
    plain = best_fit(tuple(sorted((int(s) for s in sizes), reverse=True)), 2048)
    count = np.bincount(sizes, minlength=2049)
    count[0] = 0
    fixed = sum(len(f) for f in packing.reduce_sizes(count, 2048))
    assert used <= plain and fixed > 0.3 * len(sizes[sizes > 1024])


@lru_cache
def best_fit(sizes, capacity):
    rooms = {}
    used = 0
    for s in sizes:
        room = min((r for r in rooms if r >= s and rooms[r]), default=None)
        if room is None:
            room, used = capacity, used + 1
        else:
            rooms[room] -= 1
        rooms[room - s] = rooms.get(room - s, 0) + 1
    return used
