"""Driver-side plan of best-fit packing, from a histogram of lengths.

The histogram has at most `capacity` entries whatever the corpus holds, so the
plan's cost doesn't grow with the documents: it works on runs of equal lengths
and on runs of equally filled sequences, never on single documents.

Linear grouping scheme: large lengths, in descending order, are dealt into
groups of equal cardinality and rounded up to the largest of their group. With
these few sizes, the linear programme over configurations (multisets that fit a
sequence) is solved by column generation; its counts are rounded down. Actual
documents then take the places of the rounded ones, which leaves at least as
much room, and what remains (the fractional rest and the small documents) goes
in by best fit, longest first.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np


class Run(NamedTuple):
    """Pieces of one length with ranks rank..rank+bins*each-1: `each` of them go
    to each of the sequences seq..seq+bins-1, from place `offset` there."""

    length: int
    rank: int
    bins: int
    each: int
    seq: int
    offset: int


def linear_groups(hist: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded size, [(length, count)]) of groups of equal cardinality, largest
    first. Neighbouring groups that round to one size are one group."""
    total = sum(hist.values())
    share = -(-total // groups) if total else 1
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            if room == 0:
                room = share
                if not out or out[-1][0] != length:
                    out.append((length, []))
            n = min(left, room)
            out[-1][1].append((length, n))
            left, room = left - n, room - n
    return out


def _best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within capacity of largest total value."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        best[room] = best[room - 1]
        fits = sizes <= room
        gain = np.where(fits, best[np.where(fits, room - sizes, 0)] + value, -np.inf)
        k = int(gain.argmax())
        if gain[k] > best[room] + 1e-12:
            best[room], last[room] = gain[k], k
    config, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            config[last[room]] += 1
            room -= sizes[last[room]]
    return best[capacity], config


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations with how often to use each, never beyond the demand."""
    s, b = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // s).astype(float))
    x = b / basis.diagonal()
    for _ in range(200 * len(s)):
        dual = np.linalg.solve(basis.T, np.ones(len(s)))
        value, config = _best_configuration(s, dual, capacity)
        if value <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, config)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        theta = max(ratio[out], 0.0)
        x = x - theta * step
        x[out] = theta
        basis[:, out] = config
    counts = np.floor(np.maximum(x, 0) + 1e-6).astype(int)
    while ((used := basis @ counts) > b).any():  # a rounding error of the solver
        counts[int(np.argmax(np.where(counts > 0, basis.T @ np.maximum(used - b, 0), -1)))] -= 1
    return [(basis[:, k].astype(int), int(n)) for k, n in enumerate(counts) if n > 0]


def plan(hist: dict[int, int], capacity: int, groups: int = 48, small: float = 1 / 4) -> list[Run]:
    """Places for all pieces of a histogram {length: count}, lengths 1..capacity."""
    runs: list[Run] = []
    used: dict[int, int] = defaultdict(int)  # ranks given out, by length
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first sequence, sequences)
    seqs = 0
    large = {n: c for n, c in hist.items() if capacity * small < n < capacity}
    if large:
        grouped = linear_groups(large, groups)
        stock = [list(reversed(members)) for _, members in grouped]  # the longest last, to pop
        found = configurations([g[0] for g in grouped], [sum(c for _, c in g[1]) for g in grouped], capacity)
        for config, times in found:
            slots = [g for g, n in enumerate(config) for _ in range(n)]
            taken = []
            for g in slots:  # actual lengths, as runs, for this place of the configuration
                need, mine = times, []
                while need:
                    length, count = stock[g].pop()
                    n = min(need, count)
                    mine.append((length, n))
                    need -= n
                    if count > n:
                        stock[g].append((length, count - n))
                taken.append(mine)
            cuts = sorted({0, times}.union(*(np.cumsum([n for _, n in mine]).tolist() for mine in taken)))
            at = [0] * len(taken)
            ends = [mine[0][1] for mine in taken]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                offset = 0
                for k, mine in enumerate(taken):
                    while ends[k] <= lo:
                        at[k] += 1
                        ends[k] += mine[at[k]][1]
                    length = mine[at[k]][0]
                    runs.append(Run(length, used[length], hi - lo, 1, seqs + lo, offset))
                    used[length] += hi - lo
                    offset += length
                free[capacity - offset].append((seqs + lo, hi - lo))
            seqs += times
    for length in sorted(hist, reverse=True):  # best fit of the rest
        left = hist[length] - used[length]
        room = length
        while left:
            while room <= capacity and not free[room]:
                room += 1
            if room > capacity:
                n = -(-left // (capacity // length))
                free[capacity].append((seqs, n))
                seqs += n
                room = capacity
            first, n = free[room].pop()
            fit = room // length
            full = min(n, left // fit)
            if full:
                bins, each = full, fit
            else:
                bins, each = 1, left
            runs.append(Run(length, used[length], bins, each, first, capacity - room))
            used[length] += bins * each
            left -= bins * each
            free[room - each * length].append((first, bins))
            if n > bins:
                free[room].append((first + bins, n - bins))
    return runs
