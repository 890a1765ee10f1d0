import random
from collections import Counter

from corvane.llm import packing


def test_search_beats_best_fit_on_hard_lengths():
    rng = random.Random(5)
    lengths = [rng.randint(600, 900) for _ in range(40_000)]
    first = packing.best_fit(lengths, 2048)
    tally = Counter()
    better = packing.improve(lengths, [list(b) for b in first], 2048, tally)
    assert sorted(i for b in better for i in b) == list(range(len(lengths)))
    assert max(sum(lengths[i] for i in b) for b in better) <= 2048
    assert len(better) < len(first) - 400
    assert tally["emptied"] == len(first) - len(better)
    assert min(tally[k] for k in ("moves", "one for one", "two for one")) > 0


def test_the_squared_fill_never_falls():
    for seed in range(200):
        rng = random.Random(seed)
        capacity = rng.choice([10, 50, 200])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        bins = packing.best_fit(lengths, capacity)
        better = packing.improve(lengths, [list(b) for b in bins], capacity)
        assert sorted(i for b in better for i in b) == list(range(len(lengths)))
        fills = [[sum(lengths[i] for i in b) for b in x] for x in (bins, better)]
        assert max(fills[1], default=0) <= capacity
        assert sum(f * f for f in fills[1]) >= sum(f * f for f in fills[0])
        assert len(better) <= len(bins)
