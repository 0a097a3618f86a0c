"""How many tables the customers of one dish have in a Pitman-Yor restaurant, drawn from the law that all else leaves.

n customers at t tables weigh S(n, t) * rate**t, where rate is (strength + discount * tables of the restaurant) * parent's
probability, and S are generalised Stirling numbers: S(1, 1) = 1, S(n + 1, t) = S(n, t - 1) + (n - discount * t) * S(n, t).
That is the law to which taking out one customer and seating it anew given all others leads; it is drawn from at once.

It is also the law of the number of parts, Poisson(rate / discount), given that their Sibuya(discount) sizes sum to n, so
that S(n, t) * discount**t * t! / n! is a coefficient of (1 - (1 - x)**discount)**t: a finite sum for any n.
"""

from __future__ import annotations

import functools
import math

import numpy as np

#: Customers and tables up to which Stirling numbers come from a table, and weights that are worked out at a time.
TABLE, WIDE, AT_ONCE = 2048, 256, 1 << 17
#: Least share of the sum of its parts' sizes that a sum with changing signs may have.
CLEAR = 1e-7
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX[1]
    x = (x ^ (x >> np.uint64(29))) * MIX[2]
    return x ^ (x >> np.uint64(32))


def uniforms(keys: np.ndarray, sweep: int) -> np.ndarray:
    """A number between 0 and 1 for each key and sweep."""
    salt = np.uint64((0x9E3779B97F4A7C15 * (sweep * 1_000_003 + 1)) % (1 << 64))
    return ((mixed(keys.astype(np.uint64) * MIX[0] + salt) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def next_row(row: np.ndarray, n: int, discount: float) -> np.ndarray:
    """log S(n + 1, t) of all t from 1 on, from those of n; `row` has as many t as are asked for."""
    t = np.arange(1, len(row) + 1)
    stay = row + np.log(np.maximum(n - discount * t, 1e-300))
    new = np.concatenate([[-np.inf], row[:-1]])
    return np.logaddexp(np.where(t <= n, stay, -np.inf), new)


@functools.lru_cache(2)
def stirling(discount: float) -> np.ndarray:
    """Row n: log S(n, t) of t = 1 .. WIDE, -inf beyond n."""
    out = np.full((TABLE + 1, WIDE), -np.inf)
    out[1, 0] = 0
    for n in range(1, TABLE):
        out[n + 1] = next_row(out[n], n, discount)
    return out


@functools.lru_cache(1)
def log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def rising(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """log(Gamma(x + a) / Gamma(x)) of positive x and a, without the loss of a difference of two large numbers."""
    z, y = x + a, x + 4
    down, up, w = x * (x + 1) * (x + 2) * (x + 3), z * (z + 1) * (z + 2) * (z + 3), z + 4
    v, u = 1 / (w * w), 1 / (y * y)
    rest = ((v / 1260 - 1 / 360) * v + 1 / 12) / w - ((u / 1260 - 1 / 360) * u + 1 / 12) / y
    return (w - 0.5) * np.log1p(a / y) + a * (np.log(y) - 1) + rest + np.log(down / up)


def likely(n: int, rate: float, discount: float) -> int:
    """A number of tables beyond which less than a double's last bit of the weight lies."""
    mean = rate / discount * max(1.0, discount / (1 - discount))
    return min(n, math.ceil(mean + 12 * math.sqrt(mean) + 40))


def by_sum(t: np.ndarray, n: int, rate: float, discount: float) -> np.ndarray:
    """log of S(n, t) * rate**t up to a constant, by the finite sum with changing signs; nan where its parts cancel."""
    most = int(t[-1])
    fact = log_factorials(1 << max(12, most.bit_length()))
    j = np.arange(1, min(most, 400) + 1)
    y = discount * j
    away = np.array([math.lgamma(1 + x) for x in y]) - np.where(j > 1, rising(np.maximum(n - y, 1.0), y - discount), 0.0)
    # Parts that hold less of the largest than a double's last bits are left out.
    top = fact[most] - fact[j] - fact[most - j] + away
    j = j[: int(np.flatnonzero(top > top[0] - 60).max()) + 1]
    way = np.where(j % 2 == 1, 1.0, -1.0) * np.sin(math.pi * ((discount * j) % 2))
    parts = np.where(t[:, None] >= j, fact[t][:, None] - fact[j] - fact[np.maximum(t[:, None] - j, 0)], -np.inf) + (away[: len(j)] - away[0]) - np.log(t)[:, None]
    highest = parts.max(1, keepdims=True)
    parts = np.exp(parts - highest)
    q, size = (parts * way).sum(1), (parts * np.abs(way)).sum(1)
    good = (q > CLEAR * size) & (len(j) < 400)
    out = np.log(np.where(good, q, 1.0)) + highest[:, 0] + np.log(t) + t * math.log(rate / discount) - fact[t]
    return np.where(good, out, np.nan)


def log_weights(n: int, rate: float, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(t, log of S(n, t) * rate**t up to a constant) of all t that hold any weight, for any n.

    Logarithms of these weights are concave in t, so a few t, ever closer, bracket those that count. Where the sum's parts
    cancel before the weights have fallen, the recurrence is followed up to n.
    """
    low, high = 1, likely(n, rate, discount)
    while True:
        step = max(1, (high - low) // 96)
        t = np.unique(np.append(np.arange(low, high + 1, step), high))
        w = by_sum(t, n, rate, discount)
        clear = int(np.isnan(w).argmax()) if np.isnan(w).any() else len(t)
        if not clear or clear < len(t) and w[clear - 1] > w[:clear].max() - 60:
            break
        t, w = t[:clear], w[:clear]
        if step == 1:
            return t, w
        count = np.flatnonzero(w > w.max() - 60)
        new = int(t[max(count[0] - 1, 0)]), int(t[min(count[-1] + 1, len(t) - 1)])
        if new == (low, high) or new[1] - new[0] <= 4096:
            t = np.arange(new[0], new[1] + 1)
            w = by_sum(t, n, rate, discount)
            if not np.isnan(w).any():
                return t, w
            break
        low, high = new
    most = likely(n, rate, discount)
    row, t = np.full(most, -np.inf), np.arange(1, most + 1)
    row[0] = 0
    for k in range(1, n):
        row = next_row(row, k, discount)
    return t, row + t * math.log(rate)


def chosen(weights: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of each row of log weights the place (from 1) that u picks."""
    sums = np.exp(weights - weights.max(1, keepdims=True)).cumsum(1)
    return 1 + (sums < u[:, None] * sums[:, -1:]).sum(1)


def seat(customers: np.ndarray, rate: np.ndarray, discount: float, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each cell, drawn given its rate; a cell's draw depends on its key and the sweep alone."""
    rate = np.broadcast_to(np.asarray(rate, np.float64), customers.shape)
    u, tables = uniforms(keys, sweep), (customers > 0).astype(np.int64)
    two = customers == 2
    tables[two] += u[two] * (1 - discount + rate[two]) >= 1 - discount
    mean = rate / discount * max(1.0, discount / (1 - discount))
    width = np.minimum(customers, np.ceil(mean + 12 * np.sqrt(mean) + 40))
    tabled = (customers > 2) & (customers <= TABLE) & (width <= WIDE)
    wide = 4
    while wide <= WIDE:
        # Cells of like widths together, whatever their customers.
        some = np.flatnonzero(tabled & (width <= wide) & ((width > wide // 2) | (wide == 4)))
        for at in range(0, len(some), AT_ONCE // wide):
            cut = some[at : at + AT_ONCE // wide]
            tables[cut] = chosen(stirling(discount)[customers[cut], :wide] + np.log(rate[cut])[:, None] * np.arange(1, wide + 1), u[cut])
        wide *= 2
    for c in np.flatnonzero((customers > 2) & ~tabled):
        t, w = log_weights(int(customers[c]), float(rate[c]), discount)
        tables[c] = t[chosen(w[None], u[c : c + 1])[0] - 1]
    return tables
