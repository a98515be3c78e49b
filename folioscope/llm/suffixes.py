"""Suffix arrays by induced sorting, and permuted common prefixes, in NumPy.

Suffixes are classified as smaller (S) or larger (L) than their successor.  The
leftmost S suffixes are sorted by recursion on the names of the pieces between
them, and the order of all others is induced from theirs, bucket by bucket of the
first symbol: one scan up for L, one scan down for S.  Over a small alphabet a whole
bucket is one array operation; over the names of a recursion the scans are plain loops.
"""

from __future__ import annotations

import numpy as np

# Alphabets up to this many symbols are scanned bucket by bucket.
SMALL = 1024


def _classes(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor; the last one is not."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    step[-1] = -1
    set_at = np.flatnonzero(step)
    # equal neighbours are as their successor
    return step[set_at[np.searchsorted(set_at, np.arange(n))]] > 0


def _pieces(symbols: np.ndarray, items: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    cut = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    return [(int(s), x) for s, x in zip(symbols[np.concatenate([[0], cut])].tolist(), np.split(items[order], cut))] if len(items) else []


def _induce_buckets(text: np.ndarray, small: np.ndarray, size: int, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost S suffixes in order; by whole buckets."""
    none = np.empty(0, np.int64)
    first = dict(_pieces(text[lms], lms))
    come: list[list[np.ndarray]] = [[] for _ in range(size)]
    come[int(text[-1])].append(np.array([len(text) - 1]))
    larger: list[np.ndarray] = [none] * size
    for c in range(size):
        done = []
        batch = np.concatenate(come[c]) if come[c] else none
        while len(batch):
            done.append(batch)
            before = batch[batch > 0] - 1
            before = before[~small[before]]
            batch = none
            for s, items in _pieces(text[before], before):
                if s == c:
                    batch = items
                else:
                    come[s].append(items)
        if done:
            larger[c] = np.concatenate(done)
        if c in first:
            before = first[c][first[c] > 0] - 1
            for s, items in _pieces(text[before], before):
                come[s].append(items)
    come = [[] for _ in range(size)]
    out: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        done = []
        batch = np.concatenate(come[c]) if come[c] else none
        while len(batch):
            done.append(batch)
            before = batch[batch > 0] - 1
            before = before[small[before]]
            batch = none
            for s, items in _pieces(text[before], before):
                if s == c:
                    batch = items
                else:
                    come[s].append(items)
        down = larger[c][::-1]
        before = down[down > 0] - 1
        before = before[small[before]]
        for s, items in _pieces(text[before], before):
            come[s].append(items)
        out.extend(done)
        out.append(down)
    return np.concatenate(out)[::-1]


def _induce_loop(text: np.ndarray, small: np.ndarray, size: int, lms: np.ndarray) -> np.ndarray:
    """The same by single suffixes, for large alphabets."""
    counts = np.bincount(text, minlength=size)
    ends = np.cumsum(counts)
    t, is_small = text.tolist(), small.tolist()
    order = [-1] * len(t)
    tail = ends.tolist()
    for i in reversed(lms.tolist()):
        c = t[i]
        tail[c] -= 1
        order[tail[c]] = i
    head = (ends - counts).tolist()
    c = t[-1]
    order[head[c]] = len(t) - 1
    head[c] += 1
    for i in order:
        if i > 0 and not is_small[i - 1]:
            c = t[i - 1]
            order[head[c]] = i - 1
            head[c] += 1
    tail = ends.tolist()
    for at in range(len(t) - 1, -1, -1):
        i = order[at]
        if i > 0 and is_small[i - 1]:
            c = t[i - 1]
            tail[c] -= 1
            order[tail[c]] = i - 1
    return np.array(order, np.int64)


def _names(text: np.ndarray, starts: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Ranks of the pieces that begin at ``ordered``; equal pieces get equal ranks."""
    length = np.zeros(len(text), np.int64)
    length[starts[:-1]] = np.diff(starts) + 1
    length[starts[-1]] = -1  # runs to the end: equal to no other
    a, b = ordered[:-1], ordered[1:]
    differs = (length[a] != length[b]) | (length[b] < 0)
    left = np.flatnonzero(~differs)
    step = 0
    while len(left):
        odd = text[a[left] + step] != text[b[left] + step]
        differs[left[odd]] = True
        left = left[~odd]
        step += 1
        left = left[length[a[left]] > step]
    return np.concatenate([[0], np.cumsum(differs)])


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` (integers below ``size``) in ascending order."""
    text = np.asarray(text)
    if len(text) < 2:
        return np.arange(len(text))
    small = _classes(text)
    starts = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce_buckets if size <= SMALL else _induce_loop
    if len(starts) < 2:
        return induce(text, small, size, starts)
    leftmost = np.zeros(len(text), bool)
    leftmost[starts] = True
    rough = induce(text, small, size, starts)
    ordered = rough[leftmost[rough]]
    names = _names(text, starts, ordered)
    if names[-1] + 1 < len(starts):
        place = np.empty(len(text), np.int64)
        place[ordered] = names
        ordered = starts[suffix_array(place[starts], int(names[-1]) + 1)]
    return induce(text, small, size, ordered)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each position, the symbols its suffix shares with the one before it in order.

    ``stop`` is, for each position, where its part of the text ends: nothing is shared
    beyond.  Only positions whose left neighbour differs from that of their
    predecessor are compared; from there the length falls by one a position.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    room = np.minimum(stop - np.arange(n), np.where(before < 0, 0, stop[before] - before))
    left = np.where(before > 0, text[np.maximum(before - 1, 0)].astype(np.int64), -1)
    own = np.concatenate([[-2], text[:-1].astype(np.int64)])
    # beyond a part's first position nothing follows from the one before
    fresh = (before < 0) | (left != own) | np.concatenate([[True], stop[1:] != stop[:-1]])
    fresh[1:] |= (before[1:] - 1 != before[:-1]) | (stop[before[1:]] != stop[before[:-1]])
    shared = np.zeros(n, np.int64)
    at = np.flatnonzero(fresh & (before >= 0))
    step = 0
    while len(at):
        at = at[room[at] > step]
        at = at[text[at + step] == text[before[at] + step]]
        step += 1
        shared[at] = step
    begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return np.minimum(np.where(fresh, shared, shared[begin] - (np.arange(n) - begin)), room)
