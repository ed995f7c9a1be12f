"""Packed exchanges: many small keyed values cross a shuffle as a few binary rows.

A hundred million 8-byte hashes as rows cost tens of bytes each in a shuffle and a sort each; here a task packs those that
go to one bucket into a single binary value. Buckets are ranges of the hash, so a receiver gets all equal hashes together
and sorts them with numpy. A sender never sends a hash twice (it pre-aggregates), so a bucket gets a hash at most once from
each sender, whatever its frequency.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Sums of products by powers of an odd number, modulo 2 ** 64: the hash of a range is a difference of two running sums,
#: brought back to the range's start by the inverse power. ``SPAN`` values are summed at a time.
BASE, SPAN, LONGEST = 0x9E3779B97F4A7C15, 1 << 16, 512


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, dtype=np.uint64)])


POWERS, INVERSE = _powers(BASE, 2 * SPAN + LONGEST), _powers(pow(BASE, -1, 1 << 64), SPAN)
#: A random odd number for each byte; the same for both cases of a letter in the second row.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * MIX) | np.uint64(1)
BYTES = np.stack([BYTES, BYTES[[ord(chr(b).lower()) if b < 128 else b for b in range(256)]]])
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``text``, which are those of ``text.split()``."""
    inside = ~SPACE[np.frombuffer(text, dtype=np.uint8)]
    at = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside):
        at = np.concatenate([at[:0] if not inside[0] else [0], at, at[:0] if not inside[-1] else [len(inside)]]).astype(np.int64)
    return at[::2], at[1::2]


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word of ``text``, in order; with ``lower``, of its lower-case form (A-Z alone). Words of more
    than LONGEST bytes are hashed one by one, as sums of powers repeat over long regular strings."""
    starts, ends = word_bounds(text)
    data, table = np.frombuffer(text, dtype=np.uint8), BYTES[int(lower)]
    out = np.empty(len(starts), dtype=np.uint64)
    for at in range(0, len(text) if len(starts) else 0, SPAN):
        i, j = np.searchsorted(starts, [at, at + SPAN])
        if i == j:
            continue
        values = table[data[at : at + SPAN + LONGEST]]
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * POWERS[: len(values)], out=sums[1:])
        a = starts[i:j] - at
        out[i:j] = mix((sums[np.minimum(ends[i:j] - at, len(values))] - sums[a]) * INVERSE[a])
    for k in np.flatnonzero(ends - starts > LONGEST).tolist():
        import xxhash

        word = text[starts[k] : ends[k]]
        out[k] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
    return out


def windows(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every window of ``length`` (at most SPAN) consecutive word hashes. Equal windows have equal hashes
    whatever surrounds them."""
    if length > SPAN:
        raise ValueError(f"a window of more than {SPAN} words")
    n = max(0, len(words) - length + 1)
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, SPAN):
        part = words[at : at + SPAN + length - 1]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * POWERS[: len(part)], out=sums[1:])
        m = len(part) - length + 1
        out[at : at + m] = (sums[length : length + m] - sums[:m]) * INVERSE[:m]
    return mix(out)


@lru_cache(maxsize=1)
def _trim():
    """glibc's malloc_trim, or nothing elsewhere."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def release() -> None:
    """Give freed memory back to the system: workers live on, and a later stage counts what an earlier one has left."""
    _trim()(0)


def bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash: an equal range of its upper 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def split_sorted(hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of every bucket that sorted ``hashes`` have values for."""
    b = bucket(hashes, buckets)
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.empty(0, dtype=np.int64)
    ends = np.r_[cut[1:], len(b)] if len(b) else cut
    return [(int(b[i]), int(i), int(j)) for i, j in zip(cut, ends)]
