"""Suffix arrays of many short texts at once, by linear grouping construction.

Phase 1 orders suffixes by their Lyndon prefixes: groups, at first by symbol, are taken in descending order; each suffix i of a group
finds its previous smaller one, prev(i) = max{j < i : group(j) < group(i)}; those found move behind the rest of their own
group, ordered by how many suffixes of the current group point to them. Phase 2 emits the order: each suffix s in
turn puts s - 1, prev(s - 1), ... at the front of what is left of their groups, until one is placed already. Nothing is
renamed or recursed into.

The texts of a batch are worked on in step, each at its own current group, so that one NumPy call serves all of them. Positions take four
bytes where they fit: a batch holds about 40 bytes a symbol at its peak.
"""

from __future__ import annotations

import numpy as np


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + size, of the type of starts."""
    ends = np.cumsum(sizes)
    out = np.arange(int(ends[-1]), dtype=starts.dtype)
    out += np.repeat((starts - (ends - sizes)).astype(starts.dtype), sizes)
    return out


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Suffix arrays of symbols[bounds[k]:bounds[k+1]] for each k, side by side, as positions in ``symbols``.

    Each text must end with a symbol that is its smallest and occurs once in it.
    """
    n = len(symbols)
    place = np.int32 if n < 1 << 31 else np.int64
    if not n:
        return np.zeros(0, dtype=place)
    bounds = bounds.astype(place)
    start = np.repeat(bounds[:-1], np.diff(bounds))
    order = np.lexsort((symbols, start)).astype(place)  # stable: by text, then symbol
    new = np.ones(n, dtype=bool)
    new[1:] = start[order[1:]] != start[order[:-1]]
    new[1:] |= symbols[order[1:]] != symbols[order[:-1]]
    first = np.flatnonzero(new).astype(place)
    sizes = np.diff(np.append(first, place(n)))
    group = np.empty(n, dtype=place)  # of a suffix: where its group starts in order
    group[order] = np.repeat(first, sizes)
    size = np.zeros(n, dtype=place)  # of a group, at its start
    size[first] = sizes
    at = np.empty(n, dtype=place)
    at[order] = np.arange(n, dtype=place)
    prev = np.full(n, -1, dtype=place)
    linked = np.zeros(n, dtype=bool)
    low, cursor = bounds[:-1], bounds[1:].copy()
    live = np.flatnonzero(cursor > low)
    while len(live):
        head = group[order[cursor[live] - 1]]
        members = order[_ragged(head, cursor[live] - head)]
        cursor[live] = head
        live = live[head > low[live]]
        _previous(members, prev, group, start)
        back = prev[members]
        back = np.sort(back[back >= 0])
        if len(back):
            _move(back, order, at, group, size, linked)
    return _emit(order, group, prev, bounds)


def _previous(members: np.ndarray, prev: np.ndarray, group: np.ndarray, start: np.ndarray) -> None:
    """prev of the members of the current groups; -1 where there is none."""
    own, least = group[members], start[members]
    j = members - 1
    todo = np.flatnonzero((j >= least) & (group[np.maximum(j, 0)] > own))
    while len(todo):  # larger ones have been processed: follow their pointers
        to = prev[j[todo]]
        j[todo] = to
        todo = todo[(to >= 0) & (group[to] > own[todo])]
    j[j < least] = -1
    prev[members] = j
    same = np.flatnonzero((j >= 0) & (group[j] == own))
    while len(same):  # a member of the same group: its pointer is also this one's; chains are halved
        to = prev[j[same]]
        j[same] = to
        prev[members[same]] = to
        same = same[(to >= 0) & (group[to] == own[same])]


def _move(back: np.ndarray, order: np.ndarray, at: np.ndarray, group: np.ndarray, size: np.ndarray, linked: np.ndarray) -> None:
    """Moves the suffixes in back (sorted, one entry a pointer) behind the others of their groups, by number of entries."""
    first = np.flatnonzero(np.append(True, back[1:] != back[:-1]))
    moved, times = back[first], np.diff(np.append(first, len(back)))
    old = group[moved]
    by = np.lexsort((times, old))
    moved, times, old = moved[by], times[by], old[by]
    fresh = np.append(True, old[1:] != old[:-1])
    heads = np.flatnonzero(fresh)
    counts = np.diff(np.append(heads, len(old)))
    home = old[heads]
    tail = home + size[home] - counts
    slots = _ragged(tail, counts)
    linked[moved] = True
    there = order[slots]
    out = there[~linked[there]]
    if len(out):
        place = at[moved]
        free = place[place < np.repeat(tail, counts)]
        order[free] = out
        at[out] = free
    linked[moved] = False
    order[slots] = moved
    at[moved] = slots
    size[home] -= counts
    fresh[1:] |= times[1:] != times[:-1]
    run = np.flatnonzero(fresh)
    lengths = np.diff(np.append(run, len(moved)))
    size[slots[run]] = lengths
    group[moved] = np.repeat(slots[run], lengths)


def _emit(order: np.ndarray, group: np.ndarray, prev: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = len(order)
    out, front, placed = np.full(n, -1, dtype=order.dtype), np.arange(n, dtype=order.dtype), np.zeros(n, dtype=bool)
    sizes = np.diff(bounds)
    some = np.flatnonzero(sizes > 0)
    ends = bounds[1:][some] - 1  # the smallest suffix is the last one
    out[bounds[some]] = ends
    front[bounds[some]] += 1
    placed[ends] = True
    step, low, size = 0, bounds[:-1][some], sizes[some]
    while len(low):
        j = out[low + step] - 1
        j, least = j[j >= low], low[j >= low]
        go = ~placed[j]
        j, least = j[go], least[go]
        while len(j):  # one suffix of each text at a time
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = True
            j = prev[j]
            go = j >= 0
            go[go] = ~placed[j[go]]
            j = j[go]
        step += 1
        keep = size > step
        low, size = low[keep], size[keep]
    return out
