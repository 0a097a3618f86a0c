"""Draws of numbers of tables against enumeration, a chain that moves single customers, and the recurrence."""

import math
from collections import Counter

import numpy as np
import pytest

from reportforge.llm import hpylm, seating


def test_first_sweep_is_not_averaged():
    assert hpylm.SWEEPS >= 3 and hpylm.SWEEPS > hpylm.SAMPLES >= 2


def partitions(n):
    """All ways to put n customers at tables, as lists of tables."""
    if n == 0:
        yield []
        return
    for p in partitions(n - 1):
        yield [*p, [n]]
        for k in range(len(p)):
            yield [*p[:k], [*p[k], n], *p[k + 1 :]]


def enumerated(n, rate, d):
    """The law of the number of tables: a table of m customers weighs rate * (1 - d) (2 - d) ... (m - 1 - d)."""
    law = np.zeros(n + 1)
    for p in partitions(n):
        law[len(p)] += math.prod(rate * math.prod(i - d for i in range(1, len(x))) for x in p)
    return law / law.sum()


def by_recurrence(n, rate, d):
    row = np.array([0.0])
    for m in range(1, n):
        t = np.arange(1, m + 1)
        row = np.logaddexp(np.append(row + np.log(m - d * t), -np.inf), np.append(-np.inf, row))
    law = row + np.arange(1, n + 1) * math.log(rate)
    law = np.exp(law - law.max())
    return np.concatenate([[0], law / law.sum()])


def drawn(n, rate, d, many=40_000):
    got = seating.seat(np.full(many, n), np.full(many, rate), d, np.arange(many, dtype=np.uint64) * np.uint64(7919), 3)
    return np.bincount(got, minlength=n + 1) / many


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
@pytest.mark.parametrize("rate, d", [(0.7, 0.5), (0.05, 0.9), (30.0, 0.2)])
def test_law_by_enumeration(n, rate, d):
    want = enumerated(n, rate, d)
    assert np.abs(drawn(n, rate, d) - want).max() < 4.5 * (0.25 / 40_000) ** 0.5
    assert np.allclose(want, by_recurrence(n, rate, d))


def test_chain_that_reseats_one_customer_given_all_others():
    """The move itself: one customer leaves, and comes back given where all others sit."""
    n, rate, d, rng = 6, 0.7, 0.5, np.random.default_rng(1)
    at, seen = [0] * n, Counter()
    for step in range(60_000):
        k = int(rng.integers(n))
        others = Counter(t for i, t in enumerate(at) if i != k)
        names = [*others, max(others) + 1]
        weight = np.array([others[t] - d for t in others] + [rate])
        at[k] = names[int(rng.choice(len(names), p=weight / weight.sum()))]
        seen[len(set(at))] += step >= 1000
    law = np.array([seen[t] for t in range(n + 1)]) / sum(seen.values())
    assert np.abs(law - enumerated(n, rate, d)).max() < 0.02
    assert abs((enumerated(n, rate, d) * np.arange(n + 1)).sum() - 2.19) < 0.01


@pytest.mark.parametrize("n, rate, d, mean", [(200, 0.05, 0.7, 1.07), (200, 3.0, 0.7, 5.37), (2048, 9.0, 0.8, None), (2049, 9.0, 0.8, None), (3000, 250.0, 0.8, None), (900, 2.0, 0.5, None), (700, 900.0, 0.6, None)])
def test_many_customers(n, rate, d, mean):
    want = by_recurrence(n, rate, d)
    if mean:
        assert abs((want * np.arange(n + 1)).sum() - mean) < 0.01
    if n > 600:
        t, w = seating.log_weights(n, rate, d)
        law = np.exp(w - w.max())
        assert np.abs(law / law.sum() - want[t]).max() < 1e-8 and want.sum() - want[t].sum() < 1e-12
    many = 4000 if n > seating.TABLE else 40_000
    many = 300 if rate > 500 else many
    assert np.abs(np.cumsum(drawn(n, rate, d, many) - want)).max() < 2 / many**0.5


def test_very_many_customers_are_a_poisson_number_more_than_one():
    t, w = seating.log_weights(10**9, 3.5, 0.7)
    law = np.exp(w - w.max())
    poisson = np.array([5.0 ** (k - 1) / math.factorial(k - 1) for k in t.tolist()])
    assert np.abs(law / law.sum() - poisson / poisson.sum()).max() < 1e-4


def test_draws_do_not_depend_on_what_is_drawn_beside_them():
    draw = np.random.default_rng(3)
    customers, rate = np.where(np.arange(300) % 30 == 0, draw.integers(4000, 9000, 300), draw.integers(0, 900, 300)), 10 ** draw.uniform(-3, 1, 300)
    keys = draw.integers(0, 1 << 32, 300, dtype=np.uint64)
    whole = seating.seat(customers, rate, 0.7, keys, 2)
    assert (whole == np.concatenate([seating.seat(customers[i : i + 1], rate[i : i + 1], 0.7, keys[i : i + 1], 2) for i in range(300)])).all()
    assert (seating.seat(customers, rate, 0.7, keys, 3) != whole).any() and (whole[customers == 0] == 0).all() and (whole[customers == 1] == 1).all()
    assert len(seating.seat(np.array([], np.int64), np.array([]), 0.7, np.array([], np.uint64), 1)) == 0


def test_packed_numbers():
    for numbers in ([], [0], [0, 255, 256, 70_000], [1 << 62]):
        assert hpylm.unpacked(hpylm.packed(np.array(numbers, np.int64))).tolist() == numbers
