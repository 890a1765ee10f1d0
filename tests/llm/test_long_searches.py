"""Sequences of many short pieces in the local search of packing."""

from corvane.llm import packing


def test_many_short_pieces_are_moved_out():
    lengths = [900] * 10 + [1] * 500
    better = packing.improve(lengths, [[i] for i in range(10)] + [list(range(10, 510))], 1000)
    assert len(better) == 10 and sorted(i for b in better for i in b) == list(range(510))


def test_many_exchanges_are_made():
    # Each of 1300 sequences has room for one more: a three goes there for a two, 430 times.
    lengths = [1997, 2] * 1300 + [3] * 430
    better = packing.improve(lengths, [[2 * i, 2 * i + 1] for i in range(1300)] + [list(range(2600, 3030))], 2000)
    assert sorted(i for b in better for i in b) == list(range(3030))
    assert sorted(sum(lengths[i] for i in b) for b in better) == [860] + [1999] * 870 + [2000] * 430
