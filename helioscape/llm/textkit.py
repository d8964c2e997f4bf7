"""Helpers shared by the corpus operators: word and shingle hashes of whole batches of texts.

Hashes are 64 bit and depend on the bytes alone, so every task and every size of input sees the same value.
"""
from __future__ import annotations

import ctypes
import gc
import sys

import numpy as np

MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
#: Odd multipliers: of the position of a byte in its word, of the position of a word in its shingle.
BYTE_STEP = 0xD1342543DE82EF95
WORD_STEP = 0x9E3779B97F4A7C15
#: Fold of bytes that leaves lower-cased ASCII letters, digits and all letters beyond ASCII; the rest becomes a blank.
LETTERS_ONLY = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def give_back() -> None:
    """Returns what a task no longer holds to the system: a worker lives on, beside others, for the stages that follow."""
    gc.collect()
    if pyarrow := sys.modules.get("pyarrow"):
        pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without this call
        return


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit integers (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def powers(step: int, count: int) -> np.ndarray:
    """step ** 0 .. step ** (count - 1) modulo 2 ** 64."""
    out = np.full(count, np.uint64(step), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[str | None], fold: bytes | None = None, begin: int = 0) -> tuple[np.ndarray, ...]:
    """(hash of every word, number of words per text), words in order; with `begin` also the hash of every word's first bytes.

    A-Z is lower-cased and words are runs without ASCII white space (\\x20, \\x09-\\x0D); null has no words.
    A `fold` table for the bytes of UTF-8 takes the place of lower-casing.
    The hash of a word is the sum of its byte values times powers of an odd number, mixed with its length.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    parts = [p.translate(fold) for p in parts] if fold else [p.lower() for p in parts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    if not len(parts):
        return (np.empty(0, np.uint64), np.empty(0, np.int64), *[np.empty(0, np.uint64)] * bool(begin))
    space = _IS_SPACE[raw]
    before = np.concatenate(([True], space[:-1]))
    start = np.flatnonzero(before & ~space)
    end = np.flatnonzero(space & ~before)
    if not len(start):
        return (np.empty(0, np.uint64), np.zeros(len(parts), np.int64), *[np.empty(0, np.uint64)] * bool(begin))
    length = end - start
    total = np.concatenate(([0], np.cumsum(length)))
    # position of each byte in its word, so that the sum needs no division by a power
    inside = ~space
    place = np.arange(total[-1]) - np.repeat(total[:-1], length)
    step = powers(BYTE_STEP, int(length.max()) + 1)
    value = _BYTE_VALUE[raw[inside]] * step[place]
    hashed = mix(np.add.reduceat(value, total[:-1]) + length.astype(np.uint64) * np.uint64(WORD_STEP))
    text_end = np.cumsum(sizes)
    counts = np.diff(np.concatenate(([0], np.searchsorted(start, text_end))))
    if not begin:
        return hashed, counts
    value[place >= begin] = 0
    return hashed, counts, mix(np.add.reduceat(value, total[:-1]) + np.uint64(begin))


def shingle_sets(hashed: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every text one after the other, size of each set).

    A shingle is a run of `width` words; a text of fewer words is one shingle, a text without words has none.
    """
    size = np.minimum(counts, width)
    number = np.where(counts > 0, counts - size + 1, 0)
    first_word = np.cumsum(counts) - counts
    offset = np.cumsum(number) - number
    at = np.arange(number.sum()) - np.repeat(offset - first_word, number)
    out = np.zeros(len(at), np.uint64)
    long_text = np.repeat(counts >= width, number)
    step = powers(WORD_STEP, width + 1)
    for i in range(width):
        if long_text.all():
            out += hashed[at + i] * step[i]
        else:
            there = long_text | (i < np.repeat(size, number))
            out[there] += hashed[at[there] + i] * step[i]
    out = mix(out + np.repeat(size, number).astype(np.uint64) * step[width])
    for a, b in zip(offset.tolist(), (offset + number).tolist(), strict=True):
        out[a:b].sort()
    if not len(out):
        return out, number
    keep = np.concatenate(([True], out[1:] != out[:-1]))
    keep[offset[number > 0]] = True
    return out[keep], np.add.reduceat(np.concatenate((keep, [False])).astype(np.int64), offset) * (number > 0)
