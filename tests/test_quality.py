"""Subset sums and the two layers against all subsets."""

import itertools
import random
from collections import Counter

import pytest

from plumbline.operators import quality


def plain(values, target):
    """The least number of items of any subset near the target."""
    for n in range(1, len(values) + 1):
        if any(abs(sum(c) - target) < 0.5 for c in itertools.combinations(values, n)):
            return n
    return None


@pytest.mark.parametrize("seed", range(60))
def test_shortest_subset(seed):
    rng = random.Random(seed)
    grain = rng.choice([1, 1, 0.5, 0.125])
    values = [rng.randint(1, 60) * grain for _ in range(rng.randint(0, 11))]
    values += values[: rng.randint(0, 3)]
    target = rng.choice([rng.uniform(0, 200), float(sum(values[::2])), sum(values[:3]) + 0.25])
    got = quality.shortest_subset(values, target)
    assert (len(got) if got else None) == plain(values, target)
    if got:
        assert abs(sum(got) - target) < 0.5 and not Counter(got) - Counter(values)


def test_many_values():
    """Exact far beyond what all subsets or a greedy choice could do."""
    rng = random.Random(3)
    values = [rng.randint(10, 9000) * 2 for _ in range(60)]
    chosen = rng.sample(values, 25)
    got = quality.shortest_subset(values, sum(chosen))
    assert sum(got) == sum(chosen) and len(got) <= 25
    assert quality.shortest_subset(values, sum(chosen) + 1) is None  # even values, an odd target
    assert quality.shortest_subset([7.0] * 40, 7 * 33) == [7.0] * 33
    assert quality.shortest_subset([9, 9, 9, 5, 5], 10) == [5, 5]  # the largest first leads nowhere
    assert quality.shortest_subset([-3.0, 0.0, 4.0], 4.0) == [4.0] and quality.shortest_subset([1.0], -1) is None and quality.shortest_subset([5.0], 0.2) is None


def test_two_layers(spark):
    lines = [
        (1, 100.0, None), (1, 60.0, 1), (1, 40.0, 1),  # right
        (2, 100.0, None), (2, 60.0, None), (2, 40.0, None),  # all found, none under another
        (3, 100.0, None), (3, 7.0, None),  # a dimension is missing
        (4, 50.0, None), (4, 50.0, None), (4, 50.0, None), (4, None, None), (6, 1.0, None),
    ]
    lines = spark.createDataFrame(lines, "page int, value double, parent int")
    totals = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 150.0), (4, 100.0), (5, 10.0), (7, 0.0)], "page int, total double")
    got = {r.page: r for r in quality.two_layers(lines, totals, ["page"]).collect()}
    assert {k: r.fault for k, r in got.items()} == {1: None, 2: "hierarchy", 3: "search", 4: "hierarchy", 5: "search", 6: None, 7: None}
    assert got[2].subset == [100.0] and got[2].left_out == [40.0, 60.0] and got[2].difference == 100.0
    assert got[4].subset == [50.0, 50.0] and got[4].left_out == [50.0] and got[4].n == 3
    assert got[5].n == 0 and got[5].counted == 0.0 and got[3].subset is None and got[6].total is None
