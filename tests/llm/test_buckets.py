"""Exchanges by hash bucket."""

import time

import numpy as np
import pytest

from tidemark.llm.backoff_lm import _pack_lists, _unpack
from tidemark.llm.common import buckets_of


@pytest.mark.parametrize("n_buckets", [1, 16, 7_001])
def test_buckets_of(n_buckets):
    h = np.sort(np.random.default_rng(n_buckets).integers(0, 1 << 64, 3_000, np.uint64))
    h = np.concatenate(([np.uint64(0)], h, [np.uint64((1 << 64) - 1)]))
    buckets, cuts = buckets_of(h, n_buckets)
    width = (1 << 64) // n_buckets
    for k, x, y in zip(buckets.tolist(), cuts.tolist(), cuts[1:].tolist()):
        assert y > x and {min(int(v) // width, n_buckets - 1) for v in h[x:y]} == {k}
    assert cuts[0] == 0 and cuts[-1] == len(h) and np.all(np.diff(buckets) > 0)
    none, cuts = buckets_of(h[:0], n_buckets)
    assert len(none) == 0 and cuts.tolist() == [0]


def test_packed_lists():
    a = np.array([1, 255, 3, 256, 0, 70_000, 2, 2], np.int64)
    cuts = np.array([0, 2, 5, 6, 8])
    lists = _pack_lists(a, cuts).to_pylist()
    assert [x[0] for x in lists] == [1, 2, 8, 1]
    assert [_unpack(x).tolist() for x in lists] == [[1, 255], [3, 256, 0], [70_000], [2, 2]]
    assert _pack_lists(a[:0], np.array([0])).to_pylist() == []


def test_time_does_not_grow_with_the_buckets():
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 300_000, np.uint64))
    c = np.ones(len(h), np.int64)

    def seconds(n_buckets):
        start = time.perf_counter()
        _, cuts = buckets_of(h, n_buckets)
        _pack_lists(c, cuts)
        return time.perf_counter() - start

    few, many = (min(seconds(n) for _ in range(3)) for n in (7_500, 2_500_000))
    assert many < 0.1 + 3 * few  # 333 times as many buckets
