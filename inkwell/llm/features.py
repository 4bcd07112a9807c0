"""Hashed n-gram indicators of whole texts, computed with numpy on UTF-8 bytes.

A text is read in blocks of BLOCK bytes, each with the tail of the one before, so that memory does not follow its length; an
indicator is set once however often its n-gram occurs. Nothing here knows a label, a language, a source or an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BITS = 18
SIZE = 1 << BITS
BLOCK = 1 << 20
#: Odd constants: the base of polynomial word hashes, and the multiplier of the final mix.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: its lower-case value where it is part of a word of letters, else 0; and its class for word shapes."""
    lower, kind = np.zeros(256, np.uint64), np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            lower[b], kind[b] = b + 1, 1
        elif c.isalpha():
            lower[b], kind[b] = ord(c.lower()) + 1, 1 if c.islower() else 2
        elif c.isdigit():
            kind[b] = 4
        elif c in " \t\n\v\f\r":
            kind[b] = 0
        else:
            kind[b] = 8 if c in ".,;:'\"()?-" else 16
    return lower, kind


LOWER, KIND = _classes()


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1, and their inverses, modulo 2^64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * MIX
    return ((h ^ (h >> np.uint64(29))) * BASE >> np.uint64(64 - BITS)).astype(np.int32)


def _hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent polynomial hashes of values[start:end]."""
    n = 1 << max(10, int(len(values)).bit_length())
    up, down = _powers(n)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def _spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def words(block: np.ndarray) -> np.ndarray:
    """Indicators of the lower-case words of letters."""
    values = LOWER[block]
    starts, ends = _spans(values > 0)
    return _mixed(_hashes(values, starts, ends), 1) if len(starts) else np.empty(0, np.int32)


def beginnings(block: np.ndarray) -> np.ndarray:
    """Indicators of the first four, five and six bytes of lower-case words of letters that are longer."""
    values = LOWER[block]
    starts, ends = _spans(values > 0)
    found = [np.empty(0, np.int32)]
    for n in (4, 5, 6):
        own = starts[ends - starts > n]
        if len(own):
            found.append(_mixed(_hashes(values, own, own + n), 10 + n))
    return np.concatenate(found)


def characters(block: np.ndarray) -> np.ndarray:
    """Indicators of one, two and three bytes in a row."""
    b = block.astype(np.uint64)
    one = b + np.uint64(1 << 32)
    two = b[:-1] << np.uint64(8) | b[1:] | np.uint64(2 << 32)
    three = (b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:] | np.uint64(3 << 32)) if len(b) > 2 else b[:0]
    return _mixed(np.concatenate((one, two, three)), 2)


def shapes(block: np.ndarray) -> np.ndarray:
    """Indicators of one, two and three word shapes in a row: which kinds of characters a word has, and whether it repeats the last."""
    kinds = KIND[block]
    starts, ends = _spans(kinds > 0)
    if not len(starts):
        return np.empty(0, np.int32)
    shape = np.bitwise_or.reduceat(np.append(kinds, np.uint8(0)), np.stack((starts, ends), 1).ravel())[::2].astype(np.uint64)
    same = np.zeros(len(starts), np.uint64)
    if len(starts) > 1:
        h = _hashes(block.astype(np.uint64) + np.uint64(1), starts, ends)
        same[1:] = h[1:] == h[:-1]
    s = shape * np.uint64(2) + same
    two = s[:-1] << np.uint64(8) | s[1:] | np.uint64(2 << 32)
    three = (s[:-2] << np.uint64(16) | s[1:-1] << np.uint64(8) | s[2:] | np.uint64(3 << 32)) if len(s) > 2 else s[:0]
    return _mixed(np.concatenate((s + np.uint64(1 << 32), two, three)), 3)


FAMILIES = {"words": words, "beginnings": beginnings, "characters": characters, "shapes": shapes}


def _blocks(data: bytes) -> Iterator[np.ndarray]:
    """Blocks that begin at white space where the text has any in reach."""
    whole, start = np.frombuffer(data, np.uint8), 0
    while start < len(whole):
        end = min(len(whole), start + BLOCK)
        if end < len(whole) and (back := data.rfind(b" ", max(start + 1, end - 4096), end)) > 0:
            end = back
        yield whole[start:end]
        start = end


_last = np.zeros(SIZE, np.int64)


def _distinct(index: np.ndarray) -> np.ndarray:
    """index without repeats: of equal entries the one written last to a table is kept, so nothing is sorted."""
    at = np.arange(len(index))
    _last[index] = at
    return index[_last[index] == at]


def indicators(text: str | None, families: tuple[str, ...]) -> np.ndarray:
    """The sorted indices of the indicators that a text sets; none for a null or empty one."""
    data = (text or "").encode()
    found = [_distinct(FAMILIES[f](block)) for block in _blocks(data) for f in families]
    if not found:
        return np.empty(0, np.int32)
    both = np.concatenate(found)
    return np.sort(_distinct(both))
