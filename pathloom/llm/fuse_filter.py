"""Binary fuse filters (Graf and Lemire 2022): static 3-wise XOR filters of 8 bits a key, in numpy."""

from __future__ import annotations

import math

import numpy as np

MASK32 = np.uint64(0xFFFFFFFF)
HEAD = np.dtype([("seed", "<u8"), ("seg", "<u4"), ("windows", "<u4"), ("keys", "<u8")])


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, seg: int, windows: int) -> np.ndarray:
    """Three slots in three neighbouring segments: (3, n)."""
    span = np.uint64(seg * windows)
    # high 64 bits of h * span, by halves; span < 2^32
    first = (((h & MASK32) * span >> np.uint64(32)) + (h >> np.uint64(32)) * span) >> np.uint64(32)
    step, mask = np.uint64(seg), np.uint64(seg - 1)
    second = (first + step) ^ ((h >> np.uint64(18)) & mask)
    third = (first + step + step) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _print8(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint8)


def _shape(n: int) -> tuple[int, int]:
    if n < 2:
        return 4, 1
    seg = min(1 << 18, max(4, 1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(n))
    return seg, max(1, -(-int(n * factor) // seg) - 2 + 1)


def build(keys: np.ndarray) -> bytes:
    """The filter of 64-bit keys (repeats are fine).  Peels all slots of degree one at a time, in rounds."""
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    n, (seg, windows) = len(keys), _shape(len(keys))
    for attempt in range(200):
        seed = (0x9E3779B97F4A7C15 * (attempt + 1)) & 0xFFFFFFFFFFFFFFFF
        h = _mix(keys, seed)
        slots = _slots(h, seg, windows)
        size = seg * (windows + 2)
        degree = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, dtype=np.int64)
        index = np.arange(n, dtype=np.int64)
        for row in slots:
            np.bitwise_xor.at(owner, row, index)
        rounds, left, alone = [], n, np.flatnonzero(degree == 1)
        while len(alone):
            who, first = np.unique(owner[alone], return_index=True)
            at = alone[first]
            rounds.append((who, at))
            left -= len(who)
            touched = slots[:, who]
            for row in touched:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(owner, row, who)
            near = np.unique(touched)
            alone = near[degree[near] == 1]
        if left == 0:
            prints = np.zeros(size, dtype=np.uint8)
            for who, at in reversed(rounds):
                prints[at] = _print8(h[who]) ^ np.bitwise_xor.reduce(prints[slots[:, who]], axis=0)  # own slot is still 0
            head = np.array([(seed, seg, windows, n)], dtype=HEAD)
            return head.tobytes() + prints.tobytes()
        if attempt % 20 == 19:
            windows += 1 + windows // 8
    raise RuntimeError("no seed peels this key set")


def contains(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key of the set, and for about 1 in 256 others."""
    head = np.frombuffer(filter_bytes, dtype=HEAD, count=1)[0]
    if not head["keys"]:
        return np.zeros(len(keys), dtype=bool)
    prints = np.frombuffer(filter_bytes, dtype=np.uint8, offset=HEAD.itemsize)
    h = _mix(np.asarray(keys, dtype=np.uint64), int(head["seed"]))
    return np.bitwise_xor.reduce(prints[_slots(h, int(head["seg"]), int(head["windows"]))], axis=0) == _print8(h)
