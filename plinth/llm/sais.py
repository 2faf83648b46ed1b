"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The induction scans of the linear algorithm are sequential by entry; here they go by runs of neighbouring buckets. A bucket
with many entries is a run of its own: all its entries that are known are taken at once, and entries that they induce into
it form the next wave. Small buckets share a run: the few entries that induce another one of the same run are taken in the
scan's order from a heap, and then all entries that the run induces elsewhere are placed at once.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np

from .common import ranges

#: A run of buckets has one such share of the entries, or LEAST_RUN, at most, unless it is one bucket.
RUNS, LEAST_RUN = 64, 1024


def _place(sa: np.ndarray, into: np.ndarray, symbols: np.ndarray, entries: np.ndarray, step: int) -> None:
    """Appends entries to the buckets of their symbols in the given order; into: each bucket's next place, which goes by step."""
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    new = np.empty(len(s), bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    counts = np.diff(starts, append=len(s))
    heads = s[starts]
    at = np.repeat(into[heads] - step * starts, counts)
    at += np.arange(0, step * len(s), step)
    sa[at] = entries[order]
    into[heads] += step * counts


class _Buckets:
    """Where the buckets of a string's symbols lie, and which are scanned together: [from, to) in symbols, with the entries' places."""

    def __init__(self, t: np.ndarray, sigma: int) -> None:
        self.count = np.bincount(t, minlength=sigma)
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(self.count, out=self.first[1:])
        most = max(LEAST_RUN, len(t) // RUNS)
        used = np.flatnonzero(self.count)
        large = self.count[used] > most
        # A run ends where its entries fill a share, and on both sides of a large bucket.
        share = self.first[used] // most
        new = np.ones(len(used), bool)
        new[1:] = (share[1:] != share[:-1]) | large[1:] | large[:-1]
        begin = used[new]
        end = np.append(begin[1:], sigma)
        self.runs = list(zip(begin.tolist(), end.tolist(), self.first[begin].tolist(), self.first[end].tolist(), np.add.reduceat(np.ones(len(used), np.int64), np.flatnonzero(new)).tolist() if len(used) else [], strict=True))


def _within(t: np.ndarray, sa: np.ndarray, into: np.ndarray, inside, places: np.ndarray, step: int) -> None:
    """Places the entries that entries of a run induce into it, in the scan's order, which goes by step. inside(symbol, symbol before): whether it does."""
    waiting = (places * step).tolist()
    heapify(waiting)
    while waiting:
        i = int(sa[heappop(waiting) * step]) - 1
        c = int(t[i])
        at = int(into[c])
        sa[at] = i
        into[c] = at + step
        if i and inside(c, int(t[i - 1])):
            heappush(waiting, at * step)


def _induce(t: np.ndarray, buckets: _Buckets, lms: np.ndarray) -> np.ndarray:
    """The order of all suffixes from that of the leftmost-smaller ones (those of equal first symbols in their order)."""
    n = len(t)
    count, first = buckets.count, buckets.first
    sa = np.full(n, -1, np.int32)
    head, tail = first[:-1].copy(), first[1:] - 1
    # For the first scan the leftmost-smaller entries wait at the ends of their buckets.
    ends = first[1:].copy()
    many = np.bincount(t[lms], minlength=len(count))
    ends -= many
    sa[ranges(ends, many)] = lms
    for c, to, lo, hi, number in buckets.runs:
        if number == 1:
            at = lo
            while at < head[c]:
                upto = head[c]
                _larger(t, sa, head, sa[at:upto], c)
                at = upto
            _larger(t, sa, head, sa[ends[c] : hi], c)
            continue
        places = np.flatnonzero(sa[lo:hi] > 0) + lo
        own, before = t[sa[places]], t[sa[places] - 1]
        _within(t, sa, head, lambda own, x, to=to: own <= x < to, places[(before >= own) & (before < to)], 1)
        entries = sa[lo:hi]
        entries = entries[entries > 0] - 1
        beyond = entries[t[entries] >= to]
        if len(beyond):
            _place(sa, head, t[beyond], beyond, 1)
    sa[np.arange(n) >= np.repeat(head, count)] = -1
    for c, _, lo, hi, number in buckets.runs[::-1]:
        if number == 1:
            at = hi - 1
            while at > tail[c]:
                upto = tail[c]
                _smaller(t, sa, tail, sa[upto + 1 : at + 1][::-1], c + 1)
                at = upto
            _smaller(t, sa, tail, sa[lo : head[c]][::-1], c)
            continue
        places = np.flatnonzero(sa[lo:hi] > 0) + lo
        own, before = t[sa[places]], t[sa[places] - 1]
        same = (before == own) & (places >= head[own])
        _within(t, sa, tail, lambda own, x, least=c: least <= x <= own, places[(before >= c) & ((before < own) | same)], -1)
        entries = sa[lo:hi][::-1]
        entries = entries[entries > 0] - 1
        beyond = entries[t[entries] < c]
        if len(beyond):
            _place(sa, tail, t[beyond], beyond, -1)
    sa[0] = n - 1
    return sa


def _larger(t: np.ndarray, sa: np.ndarray, head: np.ndarray, entries: np.ndarray, least: int) -> None:
    """Places what entries induce into buckets of least or larger symbols."""
    before = entries[entries > 0] - 1
    before = before[t[before] >= least]
    if len(before):
        _place(sa, head, t[before], before, 1)


def _smaller(t: np.ndarray, sa: np.ndarray, tail: np.ndarray, entries: np.ndarray, under: int) -> None:
    """Places what entries induce into buckets of symbols under a bound."""
    before = entries[entries > 0] - 1
    before = before[t[before] < under]
    if len(before):
        _place(sa, tail, t[before], before, -1)


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last, of the sentinel, is."""
    n = len(t)
    changes = t[1:] != t[:-1]
    differ = np.flatnonzero(changes)
    smaller = np.zeros(n, bool)
    smaller[differ] = t[differ + 1] > t[differ]
    up_to = np.cumsum(changes) - changes
    smaller[: n - 1] = smaller[differ[np.minimum(up_to, len(differ) - 1)]] if len(differ) else False
    smaller[n - 1] = True
    return smaller


def _names(t: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(number of each substring in their order, how many differ). As many symbols as fit a key are compared at once, first of all substrings, then of those that are equal so far.

    A substring that ends where another goes on is the larger one: there it goes down to a smaller suffix.
    """
    width = max(int(t.max()).bit_length() + 1, 2)
    per = 63 // width
    top = np.uint64((1 << width) - 1)
    padded = np.concatenate([t, np.zeros(per, t.dtype)]).astype(np.uint64)

    def keys(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j in range(per):
            out = (out << np.uint64(width)) | np.where(left > j, padded[np.minimum(at + j, len(padded) - 1)], top)
        return out

    key = keys(starts, lengths)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    done = per
    while True:
        group = np.cumsum(new) - 1
        longest = np.maximum.reduceat(lengths[order], np.flatnonzero(new))
        alone = np.bincount(group) == 1
        places = np.flatnonzero(((longest > done) & ~alone)[group])
        if not len(places):
            break
        entries, own = order[places], group[places]
        key = keys(starts[entries] + done, lengths[entries] - done)
        by = np.lexsort((key, own))
        order[places] = entries[by]
        new[places[1:]] |= (key[by[1:]] != key[by[:-1]]) & (own[1:] == own[:-1])
        done += per
    names = np.empty(len(order), np.int32)
    names[order] = np.cumsum(new) - 1
    return names, int(new.sum())


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """t: symbols from 0 to sigma - 1, the last 0, which is nowhere else. By induced sorting."""
    n = len(t)
    if n <= 2:
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    smaller = _types(t)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    names, many = _names(t, lms, np.diff(lms, append=n) + (lms < n - 1))
    ranked = np.argsort(names, kind="stable") if many == len(lms) else suffix_array(names, many)
    return _induce(t, _Buckets(t, sigma), lms[ranked])


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the length of the prefix common with the suffix before it in sa.

    Where the symbols before both differ the value is compared out ("irreducible"); elsewhere it is one less than that of the position before.
    """
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    at = np.arange(n)
    before = np.where(phi > 0, t[phi - 1], -1)
    own = np.r_[-2, t[:-1].astype(np.int64)]
    irreducible = before != own
    first = np.flatnonzero(irreducible)
    per = 7
    padded = np.r_[t.astype(np.uint64), np.zeros(per, np.uint64)]
    words = np.zeros(n, np.uint64)
    for j in range(per):
        words = (words << np.uint64(9)) | padded[j : j + n]
    value = np.zeros(len(first), np.int64)
    left = np.flatnonzero(phi[first] >= 0)
    k = 0
    while len(left):
        i, j = first[left] + k, phi[first[left]] + k
        inside = (i < n) & (j < n)
        good = np.zeros(len(left), bool)
        good[inside] = words[i[inside]] == words[j[inside]]
        ended = left[~good]
        for step in range(per):
            x, y = first[ended] + k + step, phi[first[ended]] + k + step
            inside = (x < n) & (y < n)
            ended, x, y = ended[inside], x[inside], y[inside]
            equal = t[x] == t[y]
            ended = ended[equal]
            value[ended] += 1
        value[left[good]] += per
        k += per
        left = left[good]
    source = np.maximum.accumulate(np.where(irreducible, at, 0))
    plcp = np.zeros(n, np.int64)
    plcp[first] = value
    return np.maximum(plcp[source] - (at - source), 0)
