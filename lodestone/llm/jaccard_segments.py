"""Shingle sets, and the keys by which similar ones must meet.

The universe of shingle hashes is cut into segments, more of them for larger
sets (a scheme for each size band). If two sets differ in at most H elements and
one of them has at least H + 1 segments that aren't empty, they agree on one of
these, so a key for each segment's subset finds the pair. A set allocates keys
to its first segments only, as many as its largest possible H asks for and SLACK
times more: the surplus is what a pair must share beyond one key.

A set with too few filled segments (its elements fell together) also allocates
the one-deletion neighbourhoods of its subsets, which make a segment with two and
more elements count twice, and, if that still isn't enough, its first elements
by hash order (a prefix filter). A pair with one set that has enough plain keys is found by these,
so the neighbourhoods only need to meet those of other such sets.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle.
WORDS = 5
#: Links have 100 * intersection >= PERCENT * union. The bounds below hold for 80.
PERCENT = 80
#: Keys that a set allocates, as a multiple of what the pigeonhole asks for.
SLACK = 1.25
#: Elements in a segment of the largest sets of a band, on average, and segments
#: of a scheme at least.
SEGMENT, LEAST = 2, 32

_U = np.uint64
_A, _B = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _A
    x = (x ^ (x >> _U(27))) * _B
    return x ^ (x >> _U(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # both know ASCII only
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = max(len(h) - WORDS + 1, 1)
    out = np.full(n, min(len(h), WORDS), np.uint64)  # fewer words: the whole sequence is one shingle
    for k in range(min(len(h), WORDS)):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set, as signed 64-bit words."""
    words = np.array([mix(s + _U(c)).sum(dtype=np.uint64) + _U(len(s)) for c in (1, 0x51ED270B)], np.uint64)
    return tuple(mix(words).view(np.int64).tolist())


def reach(size: int) -> int:
    """Elements in which a set of this size can differ from a linked one, at most:
    (size + other) / 9 with other <= 5 / 4 * size."""
    return size // 4


def allotment(size: int) -> int:
    """Plain keys that a set of this size allocates in a scheme."""
    need = reach(size) + 1
    return need + -(-need // 4)


assert SLACK == 1.25  # as written out in allotment and, in SQL, in shared_keys


def band(size: int) -> int:
    return int(size).bit_length()


def _segments(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, starts) of the segments with elements, in scheme k."""
    m = max(LEAST, (1 << k) // SEGMENT)
    number = ((s >> _U(32)) * _U(m)) >> _U(32)  # grows with s
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    return number[starts], starts


def allocation(s: np.ndarray) -> np.ndarray:
    """The keys of a set: even if plain, odd if of a neighbourhood or an element.

    Sets of a pair use the scheme of the larger one's band, so each set has keys
    in its own and, where a linked set can be in it, in the next.
    """
    size = len(s)
    if not size:
        return np.empty(0, np.uint64)
    keys = []
    spread = mix(s ^ _A)
    for k in {band(size), band(size * 5 // 4)}:
        numbers, starts = _segments(s, k)
        sums = np.add.reduceat(spread, starts)
        tag = mix(numbers * _U(64) + _U(k))
        keys.append(mix(sums + tag)[: allotment(size)] & ~_U(1))
        if len(starts) < allotment(size):
            sizes = np.diff(np.r_[starts, size])
            many = np.repeat(sizes > 1, sizes)
            where = np.repeat(np.arange(len(starts)), sizes)[many]
            near = np.r_[mix(sums + tag + _U(1)), mix(sums[where] - spread[many] + tag[where] + _U(1))]
            if np.minimum(sizes, 2).sum() <= reach(size):
                near = np.r_[near, mix(s[: size - (PERCENT * size + 99) // 100 + 1] + _U(k))]
            keys.append(np.unique(near | _U(1)))
    return np.concatenate(keys)


def linked(both: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    return 100 * both >= PERCENT * (size + sizes - both)


def spanning_links(sets: list[np.ndarray], known: list | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links among the sets connect, and no more.

    known: a mark for each set; sets of the same mark count as connected. Every
    set that isn't in the largest component is compared with all others over
    postings, so no link between components goes unseen; sets within one need no
    comparison.
    """
    count = len(sets)
    if count < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    _, element, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(count, dtype=np.int32), sizes)
    postings = owner[np.argsort(element, kind="stable")]
    ends = np.cumsum(often)
    begins = ends - often
    own = np.split(element.astype(np.int32), np.cumsum(sizes)[:-1])
    weight = np.array([often[e][often[e] > 1].sum() for e in own])
    component = np.arange(count) if known is None else np.unique(np.array(known), return_inverse=True)[1]
    out = []
    done = np.zeros(count, bool)
    for _ in range(count):
        members = np.bincount(component, minlength=count)
        largest = int(members.argmax())
        if members[largest] == count:
            break
        open_ = ~done & ((component != largest) | (members[largest] * 4 < count))
        if not open_.any():
            break
        p = int(np.where(open_, weight + 1, -1).argmax())  # the one most like the others
        done[p] = True
        mine = own[p][often[own[p]] > 1]
        if not len(mine):
            continue
        both = np.bincount(np.concatenate([postings[begins[e] : ends[e]] for e in mine]), minlength=count)
        hit = np.flatnonzero(linked(both, sizes[p], sizes) & (component != component[p]) & (both > 0))
        if len(hit):
            met, first = np.unique(component[hit], return_index=True)
            out += [(p, q) for q in hit[first].tolist()]
            component[np.isin(component, met)] = component[p]
    return out
