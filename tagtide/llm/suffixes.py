"""Suffix arrays by induced sorting in numpy, and the common prefixes of neighbours in text order.

A suffix is smaller (S) or larger (L) than the one behind it; an S behind an L is
leftmost-smaller. The strings between such places are named and, where names
repeat, the string of names is sorted recursively. The order of the
leftmost-smaller suffixes induces that of the L suffixes, and that of the S
suffixes. Here all runs of a type are induced at once: a suffix of a run is its
symbols down to the place whose order is known, so runs are ranked by doubling
the number of their symbols that count, with radix sorts of only those not yet apart.
"""

from __future__ import annotations

import numpy as np


def ordered(keys: np.ndarray) -> np.ndarray:
    """Stable order of non-negative integers, by digits of 16 bits from the last to the first."""
    top = int(keys.max()) if len(keys) else 0
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while top >> shift:
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def _ranked(places: np.ndarray, keys: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Ranks (the first place of each class) of the suffixes at ``places`` among themselves.

    ``keys`` orders their first symbols and sets known suffixes apart; ``left`` is
    every place's number of steps to the known suffix that ends its run.
    """
    size = len(left)
    order = ordered(keys)
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.diff(keys[order]) != 0
    first = np.flatnonzero(fresh)
    sizes = np.diff(np.append(first, len(order)))
    rank = np.zeros(size, np.int64)
    rank[places[order]] = np.repeat(first, sizes)
    tied = np.zeros(len(order), bool)
    tied[order] = np.repeat(sizes > 1, sizes)
    known = 1
    active = places[tied]
    active = active[left[active] >= known]
    while len(active):
        keys = rank[active] * size + rank[active + known]
        order = ordered(keys)
        active, keys = active[order], keys[order]
        classes = keys // size
        fresh = np.ones(len(active), bool)
        fresh[1:] = np.diff(keys) != 0
        start = np.ones(len(active), bool)
        start[1:] = np.diff(classes) != 0
        at = np.arange(len(active))
        group = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[active] = classes + group - np.maximum.accumulate(np.where(start, at, 0))
        sizes = np.diff(np.append(np.flatnonzero(fresh), len(active)))
        active = active[np.repeat(sizes > 1, sizes)]
        known *= 2
        active = active[left[active] >= known]
    return rank


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order. The last symbol has to be the only 0."""
    n = len(text)
    if n <= 1:
        return np.arange(n)
    text = text.astype(np.int64)
    # Types, by runs of equal symbols: a run is S if the symbol behind it is larger.
    ends = np.append(np.flatnonzero(np.diff(text)), n - 1)
    rising = np.append(text[ends[:-1] + 1] > text[ends[:-1]], True)
    small = np.repeat(rising, np.diff(ends, prepend=-1))
    turns = np.append(np.flatnonzero(small[1:] != small[:-1]) + 1, n)
    left = np.repeat(turns, np.diff(turns, prepend=0)) - np.arange(n)  # steps to where the type changes
    left[n - 1] = 0
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    symbol = 2 * text + small  # an L goes before an S of the same symbol
    names = _induced(symbol, small, left, leftmost, np.zeros(len(leftmost), np.int64))[leftmost]
    order = ordered(names)
    name = np.zeros(len(order), np.int64)
    name[order] = np.cumsum(np.diff(names[order], prepend=names[order[0]]) != 0)
    if name.max() + 1 < len(name):
        order = suffix_array(name)
        name[order] = np.arange(len(order))
    rank = _induced(symbol, small, left, leftmost, name)
    # Places of a symbol and type stand together; within them by rank.
    out = np.empty(n, np.int64)
    count = np.bincount(symbol)
    begin = np.cumsum(count) - count
    for kind in (~small, small):
        of = np.flatnonzero(kind)
        lowest = np.full(len(count), n, np.int64)
        np.minimum.at(lowest, symbol[of], rank[of])
        out[begin[symbol[of]] + rank[of] - lowest[symbol[of]]] = of
    return out


def _induced(symbol: np.ndarray, small: np.ndarray, left: np.ndarray, leftmost: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Ranks of the L suffixes, from the leftmost-smaller ones' order, and of the S suffixes, from the L ones'.

    Each type has ranks of its own. Where ``known`` has ties, suffixes get the same
    rank up to the next leftmost-smaller place.
    """
    n = len(symbol)
    of = np.zeros(n, np.int64)
    of[leftmost] = known
    places = np.concatenate([np.flatnonzero(~small), leftmost])
    large = _ranked(places, symbol[places] * (known.max() + 1) + of[places], np.where(small, 0, left))
    behind = np.flatnonzero(~small[1:] & small[:-1]) + 1  # an L behind an S
    places = np.concatenate([np.flatnonzero(small), behind])
    keys = symbol[places] * n + np.where(small[places], 0, large[places])
    return np.where(small, _ranked(places, keys, np.where(small, left, 0)), large)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix before each one in order, -1 for the first; symbols shared with it), both by place in the text.

    Shared symbols are permuted common prefixes: a place whose preceding symbol also
    precedes its neighbour shares one symbol less than the place before it, so only
    the others are compared, four symbols at a time.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    words = np.zeros(n + 4, np.uint16)
    words[:n] = text
    words = np.lib.stride_tricks.sliding_window_view(words, 4).copy().view(np.uint64).ravel()
    at = np.arange(n)
    alone = (at == 0) | (before <= 0)
    alone[1:] |= text[:-1] != text[before[1:] - 1]
    heads = np.flatnonzero(alone)
    shared = np.zeros(n, np.int64)
    active = heads[before[heads] >= 0]
    length = np.zeros(len(active), np.int64)
    while len(active):
        differ = words[active + length] ^ words[before[active] + length]
        done = differ != 0
        low = differ[done]
        same = np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) >> 4
        shared[active[done]] = length[done] + same
        active, length = active[~done], length[~done] + 4
    head = heads[np.cumsum(alone) - 1]
    return before, np.maximum(shared[head] - (at - head), 0)
