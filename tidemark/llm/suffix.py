"""Suffix arrays by Larsson-Sadakane refinement and common prefixes by Kasai's recurrence, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(data: bytes | np.ndarray) -> np.ndarray:
    """Starts of all suffixes in lexicographic order.

    Begins with the order by 8 bytes; each round sorts only the groups still tied,
    by the group of the suffix as many bytes further on as are sorted so far, which doubles that depth.
    """
    a = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    n = len(a)
    if n == 0:
        return np.zeros(0, np.int64)
    # A byte is raised by one within 9 bits, so that the end sorts before byte 0.
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = a
    padded[:n] += np.uint64(1)
    first = np.zeros(n, np.uint64)
    for j in range(7):
        first = first << np.uint64(9) | padded[j : j + n]
    order = np.argsort(first)
    sorted_first = first[order]
    new = np.ones(n, bool)
    new[1:] = sorted_first[1:] != sorted_first[:-1]
    del padded, first, sorted_first
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = group
    rank[n] = -1
    depth = 7
    # Places in ``order`` of suffixes whose group has others.
    alone = new & np.append(new[1:], True)
    live = np.flatnonzero(~alone)
    while live.size:
        starts = order[live]
        ahead = rank[np.minimum(starts + depth, n)] + 1
        own = rank[starts]
        if n < 1 << 21:  # group, next group and start fit into one integer: one sort of plain values
            key = np.sort((own << 42) | (ahead << 21) | starts)
            starts, pair = key & ((1 << 21) - 1), key >> 21
        else:
            pair = (own << 31) | ahead if n < 1 << 31 else None
            by = np.argsort(pair, kind="stable") if pair is not None else np.lexsort((ahead, own))
            starts = starts[by]
            pair = pair[by] if pair is not None else np.cumsum(np.append(True, (np.diff(own[by]) != 0) | (np.diff(ahead[by]) != 0)))
        order[live] = starts
        fresh = np.ones(len(live), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        rank[starts] = np.maximum.accumulate(np.where(fresh, live, 0))
        live = live[~(fresh & np.append(fresh[1:], True))]
        depth *= 2
    return order


def common_prefixes(data: bytes | np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order; 0 for the first.

    Kasai's recurrence says that the suffix one byte on has at least one byte less in
    common with its predecessor, and exactly one less where the bytes before both are equal. So only the
    other ones are compared, eight bytes a step, all at once.
    """
    a = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    n = len(a)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    place = np.arange(n)
    chained = (place > 0) & (before > 0)
    chained[chained] = a[place[chained] - 1] == a[before[chained] - 1]
    i = np.flatnonzero(~chained & (before >= 0))
    j = before[i]
    length = np.zeros(n, np.int64)
    padded = np.concatenate([a, np.zeros(16, np.uint8)])
    words = np.ndarray(shape=(n + 8,), dtype="<u8", buffer=padded.tobytes(), strides=(1,))
    live = np.arange(len(i))
    while live.size:
        x, y = i[live] + length[i[live]], j[live] + length[i[live]]
        apart = words[np.minimum(x, n)] ^ words[np.minimum(y, n)]
        same = np.where(apart == 0, 8, np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
        room = n - np.maximum(x, y)
        length[i[live]] += np.minimum(same, room)
        live = live[(same == 8) & (room > 8)]
    last = np.maximum.accumulate(np.where(chained, -1, place))
    plcp = length[last] - (place - last)
    out = plcp[order]
    out[0] = 0
    return out
