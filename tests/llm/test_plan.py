"""The packing plan uses every piece once and never more sequences than best fit alone."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillpath.llm import packing


def sequences(histogram, capacity):
    found, used = packing.plan(histogram, capacity), {}
    for pattern, times in found:
        assert sum(pattern) <= capacity and times > 0
        for x in pattern:
            used[x] = used.get(x, 0) + times
    assert used == {x: n for x, n in histogram.items() if n}
    return sum(times for _, times in found)


@settings(max_examples=1000, deadline=None)
@given(st.integers(1, 80).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 50), max_size=20))))
def test_never_worse_than_best_fit(case):
    capacity, histogram = case
    n = sequences(histogram, capacity)
    assert n <= sum(times for _, times in packing.best_fit(dict(histogram), capacity))
    assert n * capacity >= sum(x * k for x, k in histogram.items())


def test_large_counts_and_triples():
    r = np.random.Generator(np.random.PCG64(3))
    histogram = {x: int(r.integers(1, 10**7)) for x in range(1, 2049)}
    assert sequences(histogram, 2048) <= sum(times for _, times in packing.best_fit(dict(histogram), 2048))
    assert sequences({70: 4, 15: 4, 10: 4, 5: 4}, 100) == 4
    # best fit alone puts 40 to 50 and needs a third sequence
    lengths = {50: 1, 40: 1, 30: 2, 26: 1, 24: 1}
    assert sequences(lengths, 100) == 2 and sum(n for _, n in packing.best_fit(lengths, 100)) == 3


def test_triples_of_a_sum_are_found_again():
    left = np.zeros(101, np.int64)
    left[[52, 20, 18, 10]] = 3
    sums = packing._Sums(left, 100)
    for _ in range(3):
        found = sums.exact(52)
        assert sorted(found) == [10, 18, 20, 52]
        for x in found:
            left[x] -= 1
