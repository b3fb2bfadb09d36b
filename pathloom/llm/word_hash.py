"""64-bit hashes of all words of many texts at once, in numpy.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r.  Its hash sums a keyed
random value of every (place, byte) and is mixed, so no structure of a word makes collisions.
Hashes of ranges weight a random value per byte by powers of an odd base.  These can
collide on periodic patterns by structure, so what rests on them is checked by bytes.
Arithmetic wraps at 2^64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_random = np.random.Generator(np.random.PCG64(20240101))
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(size, BASE), np.full(size, BASE_INVERSE)
        up[0] = down[0] = 1
        return np.cumprod(up, out=up), np.cumprod(down, out=down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, (size - 1).bit_length() if size else 0))


def forget() -> None:
    """Clears the powers; those for a long text are many times its size."""
    _powers.cache_clear()
    _prime_powers.cache_clear()


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] the weighted values of data[i:j]; one longer than ``data``."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUES[data] * up[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges, independent of where they stand."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Primes and bases of range hashes that no pattern of bytes collides by structure.
PRIMES = ((2**31 - 1, 1_181_783_497), (2**31 - 19, 1_276_586_813))


@lru_cache(2)
def _prime_powers(size: int, which: int) -> np.ndarray:
    prime, base = PRIMES[which]
    out = np.ones(1, dtype=np.uint64)
    step = base
    while len(out) < size:  # doubled: B^(n + k) = B^n B^k
        out = np.concatenate((out, out * np.uint64(step) % np.uint64(prime)))
        step = step * step % prime
    return out


def prime_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62-bit hashes of the ranges by polynomials modulo two primes; range ends are brought to one power."""
    size = 1 << max(16, len(data).bit_length())
    out = np.zeros(len(starts), dtype=np.uint64)
    for which, (prime, _) in enumerate(PRIMES):
        powers_ = _prime_powers(size, which)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers_[: len(data)] % np.uint64(prime), out=sums[1:])
        part = (sums[ends] - sums[starts]) % np.uint64(prime) * powers_[size - 1 - starts] % np.uint64(prime)
        out = out << np.uint64(31) | part
    return out


#: Places whose values are looked up; those of later ones are computed.
PLACES = 64
_KEY = _random.integers(0, 1 << 63, dtype=np.uint64)


def _values(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((place.astype(np.uint64) << np.uint64(8) | byte) * BASE + _KEY)


TABLE = _values(np.repeat(np.arange(PLACES), 256), np.tile(np.arange(256, dtype=np.uint8), PLACES))


def words(data: np.ndarray, *, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of a byte array."""
    space = IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, dtype=np.uint64)
    body = (LOWER[data] if lower else data)[~space]
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(body)) - np.repeat(first, sizes)
    value = TABLE[np.minimum(place, PLACES - 1) << 8 | body]
    late = np.flatnonzero(place >= PLACES)
    if len(late):
        value[late] = _values(place[late], body[late])
    with np.errstate(over="ignore"):
        return starts, ends, mix(np.add.reduceat(value, first) + sizes.astype(np.uint64))
