"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Work goes bucket by bucket (first byte), and inside a bucket in waves: all
suffixes that are in place induce their predecessors at once. The number of
numpy calls depends on the alphabet and on runs of one byte, not on the length.
"""

from __future__ import annotations

import numpy as np


def types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (S), else L."""
    n = len(t)
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)  # last position of each run
    up = np.append(t[ends[:-1]] < t[ends[1:]], False)
    return np.repeat(up, np.diff(np.concatenate(([-1], ends))))


def _groups(chars: np.ndarray):
    """Stable order by byte, with each group's byte, start and length."""
    if not len(chars):
        return np.zeros(0, np.intp), [], [], []
    order = np.argsort(chars, kind="stable")
    ranked = chars[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    return order, ranked[first].tolist(), first.tolist(), np.diff(np.append(first, len(ranked))).tolist()


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix array from the leftmost-small positions in sorted order (or, for
    sorting their substrings, in any order)."""
    n = len(t)
    count = np.bincount(t, minlength=256)
    end = np.cumsum(count).tolist()
    start = [e - c for e, c in zip(end, count.tolist())]
    n_large = np.bincount(t[~small], minlength=256).tolist()
    n_lms = np.bincount(t[lms], minlength=256).tolist()
    sa = np.full(n, -1, np.int32)
    order, chars, at, size = _groups(t[lms])
    for c, a, k in zip(chars, at, size):
        sa[end[c] - k : end[c]] = lms[order[a : a + k]]

    fill = list(start)

    def put_large(found: np.ndarray) -> None:
        j = found - 1
        j = j[j >= 0]
        j = j[~small[j]]
        if len(j):
            order, chars, at, size = _groups(t[j])
            j = j[order]
            for c, a, k in zip(chars, at, size):
                sa[fill[c] : fill[c] + k] = j[a : a + k]
                fill[c] += k

    put_large(np.array([n], np.int32))  # the end of the text is the least suffix
    used = np.flatnonzero(count).tolist()
    for c in used:
        low = start[c]
        while low < fill[c]:
            low, high = fill[c], low
            put_large(sa[high:low])
        if n_lms[c]:
            put_large(sa[end[c] - n_lms[c] : end[c]])

    fill = list(end)

    def put_small(found: np.ndarray) -> None:
        j = found - 1
        j = j[j >= 0]
        j = j[small[j]]
        if len(j):
            order, chars, at, size = _groups(t[j])
            j = j[order]
            for c, a, k in zip(chars, at, size):
                sa[fill[c] - k : fill[c]] = j[a : a + k][::-1]
                fill[c] -= k

    for c in reversed(used):
        high = end[c]
        while high > fill[c]:
            high, low = fill[c], high
            put_small(sa[high:low][::-1])
        if n_large[c]:
            put_small(sa[start[c] : start[c] + n_large[c]][::-1])
    return sa


def words_at(t: np.ndarray) -> np.ndarray:
    """The eight bytes from every position (zeros past the end)."""
    padded = np.concatenate((t, np.zeros(8, np.uint8)))
    return np.ndarray((len(t) + 1,), "<u8", padded.data, 0, (1,))


def equal_ranges(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` bytes at a and at b agree."""
    same = np.ones(len(a), bool)
    live = np.arange(len(a))
    done = 0
    last = len(words) - 1
    while len(live):
        left = np.minimum(length[live] - done, 8)
        mask = np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * left.astype(np.uint64) % np.uint64(64))) - np.uint64(1))
        x = words[np.minimum(a[live] + done, last)] ^ words[np.minimum(b[live] + done, last)]
        good = (x & mask) == 0
        same[live[~good]] = False
        live = live[good & (length[live] - done > 8)]
        done += 8
    return same


def rank_names(names: np.ndarray, n_names: int) -> np.ndarray:
    """Order of the suffixes of the reduced text. It has far more names than a
    byte has values, so its recursion is by doubling: groups of equal names are
    split by the rank of what follows, twice as far in each round."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], names[order][1:] != names[order][:-1])))
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    live = order[np.repeat(size, size) > 1]  # members of groups of several, by group
    step = 1
    while len(live):
        after = np.where(live + step < n, rank[np.minimum(live + step, n - 1)] + 1, 0)
        key = rank[live] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        group = rank[live]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head = np.concatenate(([True], group[1:] != group[:-1]))
        at = np.arange(len(live))
        fresh = group + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        rank[live] = fresh
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(live)))
        live = live[np.repeat(sizes, sizes) > 1]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of the bytes t in ascending order."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int32)
    small = types(t)
    is_lms = np.concatenate(([False], small[1:] & ~small[:-1]))
    lms = np.flatnonzero(is_lms).astype(np.int32)
    if len(lms) > 1:
        sa = induce(t, small, lms)
        ranked = sa[is_lms[sa]]  # leftmost-small positions by their substrings
        nth = np.empty(n, np.int32)
        nth[lms] = np.arange(len(lms), dtype=np.int32)
        length = np.append(np.diff(lms) + 1, n - lms[-1] + 1)[nth[ranked]]
        alike = np.zeros(len(ranked), bool)
        # The last one runs into the end of the text and equals no other.
        even = (length[1:] == length[:-1]) & (ranked[1:] != lms[-1]) & (ranked[:-1] != lms[-1])
        at = np.flatnonzero(even)
        alike[at + 1] = equal_ranges(words_at(t), ranked[at + 1].astype(np.int64), ranked[at].astype(np.int64), length[at])
        name = np.cumsum(~alike) - 1
        if name[-1] + 1 < len(lms):
            reduced = np.empty(len(lms), np.int64)
            reduced[nth[ranked]] = name
            lms = lms[rank_names(reduced, int(name[-1]) + 1)]
        else:
            lms = ranked
    return induce(t, small, lms)


def common_prefixes(t: np.ndarray, sa: np.ndarray, must: np.ndarray, cap: int) -> np.ndarray:
    """For every position, the common prefix of its suffix and the one before it
    in the array, up to cap. Only irreducible values (where the bytes before
    differ) and those at ``must`` are compared; all others are one less than at
    the position before. A value is exact if no more than cap."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    left = before - 1
    irreducible = (before <= 0) | must
    irreducible[0] = True
    irreducible[1:] |= t[:-1] != t[np.maximum(left[1:], 0)]
    at = np.flatnonzero(irreducible)
    value = np.zeros(len(at), np.int64)
    live = np.flatnonzero(before[at] >= 0)
    words = words_at(t)
    done = 0
    while len(live) and done < cap:
        i, j = at[live] + done, before[at[live]] + done
        x = words[np.minimum(i, n)] ^ words[np.minimum(j, n)]
        low = x & (~x + np.uint64(1))
        zeros = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        zeros = np.minimum(zeros, np.maximum(n - np.maximum(i, j), 0))
        value[live] += zeros
        live = live[zeros == 8]
        done += 8
    full = np.zeros(n, np.int64)
    nth = np.cumsum(irreducible) - 1
    full[:] = value[nth] - (np.arange(n) - at[nth])
    return np.maximum(full, 0)
