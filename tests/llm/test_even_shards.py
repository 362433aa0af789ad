"""Shards beside a large group of equal texts are filled evenly."""

import random

from lorekeep.llm import sharding


def test_shards_beside_a_large_group_are_even():
    for at in (0, 500, 999):
        sizes = [10] * 1000
        sizes[at] = 5000  # a third of the bytes
        capacity, cuts = sharding.minimax_cuts(sizes, 24)
        runs = [sum(sizes[a:b]) for a, b in zip([0, *cuts], cuts)]
        assert capacity == max(runs) and len(runs) == 24
        assert sorted(runs)[-2] <= 2 * (sum(sizes) - 5000) / 23 and min(runs) > 0


def test_even_cuts_keep_the_capacity():
    rng = random.Random(8)
    for _ in range(500):
        sizes = [rng.choice((1, 2, 3, 50, rng.randint(1, 500))) for _ in range(rng.randint(1, 80))]
        shards = rng.randint(1, 30)
        capacity, cuts = sharding.minimax_cuts(sizes, shards)
        runs = [sum(sizes[a:b]) for a, b in zip([0, *cuts], cuts)]
        assert max(runs) <= capacity and len(runs) <= shards and cuts[-1] == len(sizes) and sum(runs) == sum(sizes)
        assert all(a < b for a, b in zip([0, *cuts], cuts))
