"""Suffix arrays by two-stage sorting, vectorised with numpy.

A suffix is of the small kind if it sorts before its successor (the suffix one byte later). Only the small kind is sorted directly; a scan of the
buckets from the smallest first byte up then puts every other suffix in place: when the scan meets suffix i, suffix i-1, if it is of the large
kind, goes to the next free place of the bucket of its first byte. The scan runs bucket by bucket over whole slices of a bucket.
"""

from __future__ import annotations

import numpy as np


def concatenated(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each behind it a separator below every byte: symbols 1..256 and 0, and where each text starts."""
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes + 1, out=starts[1:])
    t = np.zeros(starts[-1], np.int16)
    if len(texts):
        body = np.ones(len(t), bool)
        body[starts[1:] - 1] = False
        t[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    return t, starts


def _words(t: np.ndarray) -> np.ndarray:
    """For each position, its next six symbols as one integer (nine bits each), zeros from the separator on."""
    n = len(t)
    padded = np.zeros(n + 6, np.int64)
    padded[:n] = t
    w, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(6):
        alive &= padded[k : k + n] > 0
        w = (w << 9) | np.where(alive, padded[k : k + n], 0)
    return w


def _until_separator(t: np.ndarray) -> np.ndarray:
    """Distance from each position to the separator that ends its text."""
    ends = np.flatnonzero(t == 0)
    return np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(t))


def small_kind(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor. Separators are, and are ordered by position."""
    n = len(t)
    differs = np.ones(n, bool)
    differs[:-1] = t[:-1] != t[1:]
    at = np.flatnonzero(differs)
    nxt = np.repeat(at, np.diff(at, prepend=-1))  # the last position of the run of equal symbols
    follow = np.zeros(n, np.int32)
    follow[:-1] = t[1:]
    out = t < follow[nxt]
    out[t == 0] = True
    return out


def _sorted_directly(at: np.ndarray, words: np.ndarray, left: np.ndarray, most: int | None = None) -> np.ndarray:
    """The given suffixes (ascending) in order, refined six symbols at a time up to `most` symbols; where texts end, the earlier one comes first."""
    order = at[np.argsort(words[at], kind="stable")]
    depth, n = 6, len(order)
    if not n:
        return order
    key = words[order]
    first = np.ones(n, bool)
    first[1:] = key[1:] != key[:-1]
    slots = np.arange(n)  # places in order that are still undecided, whole groups of equal prefixes at a time
    while most is None or depth < most:
        # members of a group reach their separators at the same depth, so a group is open or decided as a whole
        new = np.flatnonzero(first)
        size = np.diff(np.append(new, len(slots)))
        open_ = np.repeat((size > 1) & (left[order[slots[new]]] >= depth), size)
        slots, first = slots[open_], first[open_]
        if not len(slots):
            return order
        nxt = words[order[slots] + depth]
        new = np.flatnonzero(first)
        size = np.diff(np.append(new, len(slots)))
        # most groups share their next symbols: only the others are sorted
        uneven = np.repeat(np.logical_or.reduceat(nxt != np.repeat(nxt[new], size), new), size)
        if uneven.any():
            group = np.cumsum(first)
            s, g, w = slots[uneven], group[uneven], nxt[uneven]
            k = np.lexsort((order[s], w, g))
            order[s] = order[s][k]
            nxt[uneven] = w = w[k]
            first[np.flatnonzero(uneven)[1:]] |= (w[1:] != w[:-1])
        depth += 6
    return order


def suffix_array(t: np.ndarray, most: int | None = None, words: np.ndarray | None = None) -> np.ndarray:
    """Positions in the order of their suffixes; t ends with a separator (0).

    With `most`, suffixes are in the order of their first `most` symbols, and those equal in them stand together in any order: where the small kind is ordered so
    far, what the scan puts in place is ordered one symbol further.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    small, words, left = small_kind(t), _words(t) if words is None else words, _until_separator(t)
    counts = np.bincount(t, minlength=257)
    ends = np.cumsum(counts)
    heads = ends - counts
    sa = np.full(n, -1, np.int64)
    direct = _sorted_directly(np.flatnonzero(small), words, left, most)
    per = np.bincount(t[direct], minlength=257)
    at = 0
    for c in np.flatnonzero(per):  # the small kind fills the end of its bucket
        sa[ends[c] - per[c] : ends[c]] = direct[at : at + per[c]]
        at += per[c]
    free = heads.copy()
    for c in np.flatnonzero(counts):
        done = heads[c]
        while done < ends[c]:
            stop = ends[c] if free[c] >= ends[c] - per[c] else free[c]
            if stop <= done:
                stop = ends[c]
            seen = sa[done:stop]
            done = stop
            before = seen[seen > 0] - 1
            before = before[~small[before]]
            if not len(before):
                continue
            symbols = t[before]
            k = np.argsort(symbols, kind="stable")
            symbols, before = symbols[k], before[k]
            first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
            for a, b in zip(first, np.r_[first[1:], len(symbols)]):
                s = symbols[a]
                sa[free[s] : free[s] + b - a] = before[a:b]
                free[s] += b - a
    return sa


def equal_windows(t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, new): positions with `length` symbols before their separator, equal windows of that length side by side, and whether each differs from the one before it."""
    words, left = _words(t), _until_separator(t)
    sa = suffix_array(t, length, words)
    sa = sa[left[sa] >= length]
    before = np.full(len(t), -1)
    before[sa[1:]] = sa[:-1]
    # compared in the order of the text, where neighbours have neighbours before them; the far end first, as near ends mostly agree
    live = np.flatnonzero(before >= 0)
    if length < 6:
        low = 9 * (6 - length)
        live = live[words[live] >> low == words[before[live]] >> low]
    else:
        for depth in (length - 6, *range(0, length - 6, 6)):
            live = live[words[live + depth] == words[before[live] + depth]]
    new = np.ones(len(t), bool)
    new[live] = False
    return sa, new[sa]
