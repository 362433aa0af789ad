"""The reduction of op1's plan: it goes past lengths it cannot decide, and an optimal packing stays reachable."""

import random
from collections import Counter

from lorekeep.llm import packing


def fewest(items, capacity):
    """Fewest bins, by trying."""
    items = sorted(items, reverse=True)

    def fits(bins, i):
        if i == len(items):
            return True
        for b in {room: k for k, room in enumerate(bins)}.values():
            if bins[b] >= items[i]:
                bins[b] -= items[i]
                if fits(bins, i + 1):
                    return True
                bins[b] += items[i]
        return False

    n = -(-sum(items) // capacity)
    while not fits([capacity] * n, 0):
        n += 1
    return n


def test_reduction_keeps_an_optimum():
    rng, passed = random.Random(6), 0
    for _ in range(4000):
        capacity = rng.choice((10, 12, 20, 50))
        least = rng.choice((1, capacity // 5, capacity // 4))
        counts = Counter(rng.randint(least, capacity) for _ in range(rng.choice((6, 8, 10))))
        fixed, rest = packing.dominance(dict(counts), capacity)
        assert sum(n for _, n in fixed) + fewest(Counter(rest).elements(), capacity) == fewest(counts.elements(), capacity)
        passed += any(max(b) < max(rest, default=0) and capacity not in (sum(s * q for s, q in b.items()), max(b)) for b, _ in fixed)
    assert passed  # a bin was fixed below a length that was not decided


def test_known_cases():
    for items, capacity, want in (([10, 15, 20, 44, 48, 50], 50, 4), ([5, 6, 7, 9, 11, 18], 20, 3), ([3, 3, 3, 3, 4, 4, 8, 8, 9, 10], 10, 6)):
        assert sum(n for _, n in packing.plan(dict(Counter(items)), capacity)) == want
