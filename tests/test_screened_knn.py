"""kNN screened by a matrix product equals the plain scan, bit for bit."""

import numpy as np
import pytest

from potentia.operators import neighbors as N


def joined(blocks):
    return [np.concatenate(p) for p in zip(*[(s + r, c, rank, d2) for s, r, c, rank, d2 in blocks])]


@pytest.mark.parametrize("d,n,k", [(8, 1024, 1), (8, 1300, 3), (64, 3000, 10), (300, 2000, 20)])
@pytest.mark.parametrize("offset", [0.0, 1e6])  # far from the origin the product loses digits
def test_same_as_scan(d, n, k, offset):
    x = np.random.default_rng(d + k).normal(size=(n, d)) + offset
    x[100:180] = x[100]  # more equal rows than k: ties by position
    x[n - 1] = x[5]
    for banned in (None, lambda a, b: np.arange(a, b)[:, None] == np.arange(n)[None, :]):
        fast = joined(N._nearest_rows(x[:200], x, (x * x).sum(1), k, banned))
        plain = joined(N._nearest_rows(x[:200], x, None, k, banned))
        assert all(np.array_equal(a, b) for a, b in zip(fast, plain))


def test_groups_with_few_rows_and_overflow():
    x = np.random.default_rng(1).normal(size=(2000, 8))
    label = np.where(np.arange(2000) < 7, 0, 1)
    other = lambda a, b: label[a:b, None] != label[None, :]
    fast = joined(N._nearest_rows(x[:20], x, (x * x).sum(1), 10, other))
    plain = joined(N._nearest_rows(x[:20], x, None, 10, other))
    assert all(np.array_equal(a, b) for a, b in zip(fast, plain)) and (fast[0] < 7).sum() == 49
    x[3] = 1e200
    with np.errstate(over="ignore"):
        size = (x * x).sum(1)
        assert N._screened_topk(x[:5], x, size, 10, None) is None
