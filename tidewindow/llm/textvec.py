"""Word scanning of UTF-8 text on numpy byte arrays, used inside Arrow tasks.

Both word classes of this subpackage are defined on ASCII characters alone, so
they can be found on UTF-8 bytes: every byte of a multi-byte character is 0x80
or more and so belongs to a word.
"""

from __future__ import annotations

import numpy as np

#: A-Z become a-z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower case, and every ASCII character but letters and digits becomes a space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out, x = np.empty(n, dtype=np.uint64), 1
    for i in range(n):
        out[i], x = x, x * base & _MASK
    return out


_POWERS = _powers(0x9E3779B97F4A7C15, 1024)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers_to(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = _powers(0x9E3779B97F4A7C15, 2 * n)
    return _POWERS


def word_hashes(text: str | None, table: bytes = LOWER) -> np.ndarray:
    """64-bit hashes of the lower-cased words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; with ``ALNUM``, of its words of letters, digits and characters beyond ASCII."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(table), dtype=np.uint8)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    chars = _BYTE[raw[inside]]
    first = np.cumsum(lengths) - lengths
    at = np.arange(len(chars)) - np.repeat(first, lengths)
    sums = np.add.reduceat(chars * _powers_to(int(lengths.max()))[at], first)
    return mix64(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles.

    A text of fewer words, but not none, is one shingle; without words the set is empty.
    """
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = mix64(out + words[i : len(words) - size + 1 + i])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def set_id(items: np.ndarray) -> tuple[int, int]:
    """A 128-bit identity of a sorted set of hashes, as two signed longs; (0, 0) for the empty set."""
    if not len(items):
        return 0, 0
    a = np.bitwise_xor.reduce(mix64(items + np.uint64(0x2545F4914F6CDD1D)))
    b = mix64(items).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
