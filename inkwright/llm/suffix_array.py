"""Suffix arrays by induced sorting, and permuted common prefixes up to a given length.

Suffixes are classified as smaller or larger than the next one; the substrings between leftmost-smaller places
are sorted and named, the string of names is sorted by the same method, and its order induces that of all
suffixes. Induction goes bucket by bucket: larger suffixes upwards, smaller ones downwards. What a bucket induces goes
to itself or beyond it. So all buckets up to the nearest one that any of them reaches are handled in one step with
numpy, and only a bucket that reaches itself is taken alone, in waves. Every suffix is placed twice, whatever the steps.
"""

from __future__ import annotations

import numpy as np

#: Buckets that a step of induction looks at, at first and at most.
_STEP, _MOST = 64, 1 << 14


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one. The last symbol is a unique smallest one."""
    n = len(s)
    last = np.flatnonzero(np.append(s[:-1] != s[1:], True))  # last place of each run of one symbol
    small = np.zeros(len(last), bool)
    small[:-1] = s[last[:-1]] < s[last[:-1] + 1]
    small[-1] = True
    return np.repeat(small, np.diff(np.append(-1, last)))[:n]


def _place(sa: np.ndarray, at: np.ndarray, symbols: np.ndarray, suffixes: np.ndarray, step: int) -> None:
    """Put suffixes into their buckets in order, each next to the last one, and move the buckets' pointers."""
    if len(suffixes) < 12:
        for c, i in zip(symbols.tolist(), suffixes.tolist()):
            sa[at[c]] = i
            at[c] += step
        return
    order = np.argsort(symbols, kind="stable")  # a radix sort for byte symbols
    ordered = symbols[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    times = np.diff(np.append(starts, len(ordered)))
    bucket = ordered[starts].astype(np.int64)
    sa[np.repeat(at[bucket] - step * starts, times) + step * np.arange(len(ordered))] = suffixes[order]
    at[bucket] += step * times


def _induce(s: np.ndarray, small: np.ndarray, heads: np.ndarray, tails: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n, buckets = len(s), len(heads)
    sa = np.full(n, -1, np.int64)
    at = tails.copy()
    back = lms[::-1]
    _place(sa, at, s[back], back, -1)
    first_lms = at + 1  # what is right of it in a bucket came from lms

    # Places -1 and -2 stand for no suffix: before the first one, and before an empty place.
    is_small = np.append(small, [False, False])
    is_large = np.append(~small, [False, False])

    def larger(found: np.ndarray) -> np.ndarray:
        before = found - 1
        return before[is_large[before]]

    head, c, width = heads.copy(), 0, _STEP
    while c < buckets:
        end = min(c + width, buckets)
        wave = larger(sa[heads[c] : tails[end - 1] + 1])
        symbols = s[wave]
        near = int(symbols.min()) if len(wave) else end
        if near > c:
            if near < end:
                wave = larger(sa[heads[c] : heads[near]])
                symbols = s[wave]
            if len(wave):
                _place(sa, head, symbols, wave, 1)
            width = min(2 * width, _MOST) if near >= end else max(2 * (near - c), 8)
            c = min(near, end)
            continue
        done = heads[c]
        while done < head[c]:
            wave = larger(sa[done : head[c]])
            done = head[c]
            _place(sa, head, s[wave], wave, 1)
        if first_lms[c] <= tails[c]:
            wave = larger(sa[first_lms[c] : tails[c] + 1])
            _place(sa, head, s[wave], wave, 1)
        c += 1

    def smaller(found: np.ndarray) -> np.ndarray:
        before = found - 1
        return before[is_small[before]]

    sa[np.arange(n) >= np.repeat(head, tails - heads + 1)] = -1  # the smaller ones are placed anew
    tail, c, width = tails.copy(), buckets - 1, _STEP
    while c >= 0:
        end = max(c - width, -1)
        wave = smaller(sa[heads[end + 1] : tails[c] + 1][::-1])
        symbols = s[wave]
        near = int(symbols.max()) if len(wave) else end
        if near < c:
            if near > end:
                wave = smaller(sa[heads[near + 1] : tails[c] + 1][::-1])
                symbols = s[wave]
            if len(wave):
                _place(sa, tail, symbols, wave, -1)
            width = min(2 * width, _MOST) if near <= end else max(2 * (c - near), 8)
            c = max(near, end)
            continue
        done = tails[c]
        while done > tail[c]:
            wave = smaller(sa[tail[c] + 1 : done + 1][::-1])
            done = tail[c]
            _place(sa, tail, s[wave], wave, -1)
        if heads[c] < head[c]:
            wave = smaller(sa[heads[c] : head[c]][::-1])
            _place(sa, tail, s[wave], wave, -1)
        c -= 1
    sa[0] = n - 1
    return sa


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of s, whose last symbol is 0 and occurs only there; all are below `symbols`, and all of these occur or are few."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small = suffix_types(s)
    counts = np.bincount(s, minlength=symbols)
    tails = np.cumsum(counts) - 1
    heads = tails - counts + 1
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    # Names: neighbours in the order get one name if their substrings up to the next lms place are equal.
    end_of = np.zeros(n, np.int64)
    end_of[lms] = np.append(lms[1:], n - 1)
    ordered = _induce(s, small, heads, tails, lms)
    ordered = ordered[end_of[ordered] > 0]
    a, b = ordered[:-1], ordered[1:]
    length = end_of[a] - a
    same = length == end_of[b] - b
    live = np.flatnonzero(same)
    a, b, length = a[live], b[live], length[live]
    k = 0
    while len(live):
        equal = s[a + k] == s[b + k]
        same[live[~equal]] = False
        more = equal & (length > k)
        live, a, b, length = live[more], a[more], b[more], length[more]
        k += 1
    names = np.empty(n, np.int64)
    names[ordered] = np.append(0, np.cumsum(~same))
    reduced = names[lms]
    distinct = int(reduced.max()) + 1
    if distinct == len(lms):
        order = np.empty(len(lms), np.int64)
        order[reduced] = np.arange(len(lms))
    else:
        order = suffix_array(reduced, distinct)
    return _induce(s, small, heads, tails, lms[order])


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each suffix of a byte array, in text order, its common prefix with the one before it in the suffix array, up to `most`.

    Eight bytes are compared at a time; what lies beyond the end equals nothing.
    """
    n = len(s)
    word = np.concatenate([s, np.zeros(most + 16, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        word = word[:-k] | (word[k:] << np.uint64(8 * k))
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = sa[0]
    out = np.zeros(n, np.int64)
    live = np.delete(np.arange(n), sa[0])
    far = before[live]
    for k in range(0, most, 8):
        differ = word[live + k] ^ word[far + k]
        equal = differ == 0
        low = differ[~equal]
        out[live[~equal]] = k + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) >> 3)
        live, far = live[equal], far[equal]
        if not len(live):
            break
    out[live] = most
    return np.minimum(out, np.minimum(most, n - np.maximum(np.arange(n), before)))
