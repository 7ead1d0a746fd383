"""Gibbs sampling of Chinese-restaurant seating for many dishes at once.

Given an auxiliary v ~ Gamma(theta / d + T) of a restaurant with T tables, the factor of the tables in the seating's
probability, the product of theta + d k over k < T, becomes a product over tables of d v: dishes are then independent,
and all dishes of all restaurants can be drawn at the same time without stale totals. A dish with c customers at tables
of sizes n_1 ... n_t has, given v and the parent's probability p of it, the weight (d v p)^t times the product over its
tables of (1 - d)(2 - d) ... (n - 1 - d).

What the model needs of a dish is its number of tables. Summed over all seatings, t tables weigh (d v p)^t S(c, t), with generalised
Stirling numbers S. Up to EXACT customers these are looked up, and a sweep draws the tables from their law given v: exact, all customers at once. The law is cut
at MOST tables, which dishes with a new table's weight of HEAVY or less reach with no measurable probability; the others are left to the second way.

Dishes of more customers, or of such weight at the start, start from one of PATHS growths, taken by weight. A sweep then takes customers away one after another and seats each again by
its exact conditional: a table of n others with weight n - d, a new table with weight d v p; at most RESEATED of a dish in a sweep, chosen at
random. That leaves the posterior as it is, whatever their number, but few customers move, so such a dish stays near its start; tests
hold its mean number of tables, after the sweeps that the model makes, within ten per cent of exact laws.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Customers up to which the law of the tables is looked up, tables in it, and the weight up to which it serves.
EXACT, MOST, HEAVY = 4096, 256, 16.0
#: Beyond that: customers moved in a sweep, and growths at the start.
RESEATED, PATHS = 32, 64
#: Numbers held at once while dishes are looked up.
BLOCK = 1 << 16


def auxiliary(rng: np.random.Generator, tables: np.ndarray, theta: float, d: float) -> np.ndarray:
    """v of restaurants with so many tables."""
    return rng.gamma(theta / d + tables)


@lru_cache(maxsize=1)
def _log_stirling(d: float) -> np.ndarray:
    """log S(c, t), less the greatest of its row, at [c, t]; S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t)."""
    t = np.arange(MOST + 1)
    out = np.full((EXACT + 1, MOST + 1), -np.inf, np.float32)
    row = np.where(t == 1, 0.0, -np.inf)
    out[1] = row
    for c in range(1, EXACT):
        left = c - d * t
        kept = np.where(left > 0, row + np.log(np.maximum(left, 1e-300)), -np.inf)
        row = np.logaddexp(kept, np.concatenate([[-np.inf], row[:-1]]))
        row -= row.max()
        out[c + 1] = row
    return out


class Seating:
    """Dishes with c >= 2 customers each; a is the weight of a new table, d v p."""

    def __init__(self, rng: np.random.Generator, c: np.ndarray, a: np.ndarray, d: float):
        self.rng, self.d = rng, d
        looked_up = (c <= EXACT) & ((a <= HEAVY) | (c <= MOST))
        few = np.flatnonzero(looked_up)
        self.few = few[np.argsort(c[few], kind="stable")]
        self.c = c[self.few].astype(np.int64)
        self.many = np.flatnonzero(~looked_up)
        self.customers = _Customers(rng, c[self.many], a[self.many], d)

    def sweep(self, a: np.ndarray) -> np.ndarray:
        """The number of tables of each dish after one sweep."""
        found = np.empty(len(self.few) + len(self.many), np.int64)
        found[self.many] = self.customers.sweep(a[self.many])
        at = 0
        while at < len(self.few):  # blocks of dishes of like size
            most = max(8, 2 * int(self.c[at]))
            widest = min(MOST, most)
            stop = min(int(np.searchsorted(self.c, most, "right")), at + max(1, BLOCK // widest))
            some = self.few[at:stop]
            found[some] = self._exactly(self.c[at:stop], a[some], widest)
            at = stop
        return found

    def _exactly(self, c: np.ndarray, a: np.ndarray, widest: int) -> np.ndarray:
        weight = _log_stirling(self.d)[c, 1 : widest + 1] + np.log(a)[:, None] * np.arange(1, widest + 1)
        share = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        return 1 + (share < (self.rng.random(len(c)) * share[:, -1])[:, None]).sum(axis=1)


class _Customers:
    """Dishes whose customers are moved one by one."""

    def __init__(self, rng: np.random.Generator, c: np.ndarray, a: np.ndarray, d: float):
        self.rng, self.d = rng, d
        self.order = np.argsort(-c, kind="stable")
        self.c = c[self.order].astype(np.int64)
        self.t, self.size = self._start(a[self.order])

    def _start(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Some seating near what is likely: of PATHS growths in steps one, drawn by their weights; customers are spread over its tables."""
        c, seated = self.c, 1
        grown, weight = np.ones((PATHS, len(c)), np.int64), np.zeros((PATHS, len(c)))
        while len(c) and c[0] > seated:
            live = int(np.searchsorted(-c, -seated, "left"))
            step = np.minimum(c[:live] - seated, max(1, seated // 8))
            whole = a[:live] + seated - self.d * grown[:, :live]
            weight[:, :live] += step * np.log(whole)
            grown[:, :live] += self.rng.binomial(step, a[:live] / whole)
            seated += max(1, seated // 8)
        lot = (weight + self.rng.gumbel(size=weight.shape)).argmax(axis=0)
        t = grown[lot, np.arange(len(c))]
        first = np.cumsum(t) - t
        weight = self.rng.gamma(1 - self.d, size=int(t.sum())) + 1e-300
        whole = np.add.reduceat(weight, first) if len(t) else weight
        size = 1 + np.floor(np.repeat((c - t) / whole, t) * weight).astype(np.int64)
        if len(t):
            size[first] += c - np.add.reduceat(size, first)
        return t, size

    def sweep(self, a: np.ndarray) -> np.ndarray:
        """The number of tables of each dish after one sweep."""
        rng, d, c, t = self.rng, self.d, self.c, self.t
        a = a[self.order]
        moves = np.minimum(c, RESEATED)
        room = t + moves
        start = np.cumsum(room) - room
        held = np.repeat(start - (np.cumsum(t) - t), t) + np.arange(len(self.size))
        size = np.zeros(int(room.sum()), np.int64)
        size[held] = self.size
        free = start + t
        for k in range(int(moves[0]) if len(moves) else 0):
            m = int(np.searchsorted(-moves, -k, "left"))  # dishes with a customer to move
            ends = np.cumsum(size[: start[m - 1] + room[m - 1]])
            base = ends[start[:m]] - size[start[:m]]
            leaves = rng.integers(0, c[:m])
            table = np.searchsorted(ends, base + leaves, "right")
            size[table] -= 1
            t[:m] -= size[table] == 0
            stay = c[:m] - 1 - d * t[:m]
            opens = rng.random(m) * (a[:m] + stay) < a[:m]
            new = np.flatnonzero(opens)
            size[free[new]] = 1
            free[new] += 1
            t[new] += 1
            rest = np.flatnonzero(~opens)
            while len(rest):  # the table of another customer, taken with probability (n - d) / n
                other = rng.integers(0, c[rest] - 1)
                other += other >= leaves[rest]
                table = np.searchsorted(ends, base[rest] + other, "right")
                taken = rng.random(len(rest)) * size[table] >= d
                size[table[taken]] += 1
                rest = rest[~taken]
        self.size = size[size > 0]
        found = np.empty(len(t), np.int64)
        found[self.order] = t
        return found
