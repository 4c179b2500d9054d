"""The local search of packing looks at every bin of its block."""

from signalcheck.llm import packing


def test_the_only_help_may_come_from_the_fullest_bin():
    # 4 fits nowhere; swapped with the 3 of the fullest bin it is a 3, which fits beside a 97.
    lengths = [4] + [97] * 250 + [95, 3]
    bins = [[0], *([i] for i in range(1, 251)), [251, 252]]
    packed = packing.improve(bins, lengths, 100)
    assert sorted(i for b in packed for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in packed)
    assert len(packed) == 251
