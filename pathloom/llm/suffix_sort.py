"""Suffix sorting by hash comparisons, for many groups of short strings at once.

Prefix polynomial hashes give the hash of any range; a binary search over lengths gives the
longest common extension of two strings, and so their order, in logarithmic time.  A
bottom-up mergesort places all groups' strings in step; common extensions of neighbours are
then verified byte by byte.
"""

from __future__ import annotations

import numpy as np

from . import word_hash


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The longest common prefixes of the strings at ``a`` and ``b``, up to ``most`` bytes, by hashes."""
    low, high = np.zeros(len(a), dtype=np.int64), most.astype(np.int64)
    _, down = word_hash.powers(len(prefix))
    with np.errstate(over="ignore"):
        a_from, b_from, a_down, b_down = prefix[a], prefix[b], down[a], down[b]
        for _ in range(int(most.max()).bit_length() if len(most) else 0):
            middle = (low + high + 1) >> 1
            same = (prefix[a + middle] - a_from) * a_down == (prefix[b + middle] - b_from) * b_down
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def sorted_strings(group: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): strings by group and content, and each one's common bytes with the one before (-1 at a group's first).

    ``group`` must be sorted.
    """
    n = len(group)
    prefix = word_hash.prefix_hashes(data)
    padded = np.append(data, 0)

    def precedes(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        shared = common_extension(prefix, starts[x], starts[y], np.minimum(sizes[x], sizes[y]))
        x_ends, y_ends = shared == sizes[x], shared == sizes[y]
        less = padded[starts[x] + shared] < padded[starts[y] + shared]
        return np.where(x_ends & y_ends, ties, np.where(x_ends, True, np.where(y_ends, False, less)))

    head = np.concatenate(([True], group[1:] != group[:-1])) if n else np.zeros(0, dtype=bool)
    first = np.flatnonzero(head)
    own = np.cumsum(head) - 1
    begin = first[own] if n else first
    size = np.diff(np.append(first, n))[own] if n else first
    order, width = np.arange(n), 1
    while n and width < size.max():
        at = np.flatnonzero(size > width)
        offset = at - begin[at]
        run = offset // width
        other = begin[at] + (run ^ 1) * width
        low, high = np.minimum(other, begin[at] + size[at]), np.minimum(other + width, begin[at] + size[at])
        base, left = low.copy(), run % 2 == 0
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            # how many of the other run come before: those less, and for the right run also equal ones
            before = precedes(order[middle], order[at[open_]], ~left[open_])
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        to = begin[at] + (run // 2) * 2 * width + offset % width + (low - base)
        moved = order.copy()
        moved[to] = order[at]
        order, width = moved, width * 2
    common = np.full(n, -1, dtype=np.int64)
    inner = np.flatnonzero(~head)
    x, y = order[inner - 1], order[inner]
    common[inner] = common_extension(prefix, starts[x], starts[y], np.minimum(sizes[x], sizes[y]))
    if not _verified(padded, starts, sizes, x, y, common[inner]):
        return _by_bytes(group, padded, starts, sizes, head)
    return order, common


def _verified(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, common: np.ndarray) -> bool:
    """Whether neighbours agree in as many bytes as their hashes say, and their next bytes are in order."""
    most = int(common.max()) if len(common) else 0
    for k in range(0, most, 16):
        on = common > k
        if not on.any():
            break
        span = np.arange(k, min(k + 16, most))
        a, b = starts[x[on]][:, None] + span, starts[y[on]][:, None] + span
        wrong = (data[np.minimum(a, len(data) - 1)] != data[np.minimum(b, len(data) - 1)]) & (span < common[on][:, None])
        if wrong.any():
            return False
    return True


def _by_bytes(group: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same result by plain comparison, for the case that two hashes collide."""
    strings = [data[a : a + n].tobytes() for a, n in zip(starts.tolist(), sizes.tolist())]
    order = np.array(sorted(range(len(group)), key=lambda k: (group[k], strings[k])), dtype=np.int64)
    common = np.full(len(group), -1, dtype=np.int64)
    for k in np.flatnonzero(~head).tolist():
        a, b = strings[order[k - 1]], strings[order[k]]
        common[k] = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    return order, common
