"""Arrow-side splitting of whole texts into words, and 64-bit word hashes.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``; the six characters left out
are exactly the white space of ASCII, so Arrow's kernel does the splitting.
A null text has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes handled at once; bounds a worker's memory, not the input.
SLICE_BYTES = 3 << 20

MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not glibc
    _TRIM = None


class Words(NamedTuple):
    """Words of a block of texts, one after another."""

    codes: np.ndarray  #: int32, into ``vocab``
    vocab: pa.Array  #: distinct words of the block, large_binary
    offsets: np.ndarray  #: int64, words of text i are offsets[i]:offsets[i+1]

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.lengths)

    def hashes(self) -> np.ndarray:
        """uint64 of each word; equal words have equal hashes on every machine."""
        h = xxhash.xxh3_64_intdigest
        table = np.fromiter((h(w) for w in self.vocab.to_pylist()), np.uint64, len(self.vocab))
        return table[self.codes] if len(table) else np.zeros(0, np.uint64)


def give_back() -> None:
    """Returns freed memory to the system; workers live on between stages and would keep it."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES, row: int = 64) -> Iterator[pa.RecordBatch]:
    """The same rows in blocks of about ``limit`` text bytes (a longer text is a block), a row counting ``row`` bytes more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(size + row) - size - row) // limit
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
        give_back()


def texts_of(column: pa.Array) -> pa.Array:
    """large_string without nulls, in memory of its own.

    Kernels of pyarrow 23 that map bytes, ``ascii_lower`` among them, read from a wrong
    place when they get the cast of a slice that doesn't start at its parent's first row.
    """
    own = pa.concat_arrays([column]) if not column.offset else column.take(pa.array(np.arange(len(column))))
    return pc.fill_null(own.cast(pa.large_string()), "")


def split(column: pa.Array, lower: bool = False) -> Words:
    """Words of every text; ``lower`` turns A-Z to a-z first."""
    text = texts_of(column)
    if lower:
        text = pc.ascii_lower(text)
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full, min_count=0).as_py():  # white space at an end leaves an empty piece
        upto = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
        offsets, flat = upto[offsets], flat.filter(full)
    coded = flat.cast(pa.large_binary()).dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int32), coded.dictionary, offsets)


def windows(h: np.ndarray, k: int, mix: np.uint64 = MIX1) -> np.ndarray:
    """Hash of the k values from each position on; the last k - 1 positions are left out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        # by doubling: the hash of 2j values is that of the first j times mix**j, plus that of the next j
        parts, width, power, out, offset, left = h, 1, mix, None, 0, k
        while left:
            if left & 1:
                part = parts[offset : offset + n]
                out = part.copy() if out is None else out * power + part
                offset += width
            left >>= 1
            if left:
                parts = parts[: len(parts) - width] * power + parts[width:]
                width, power = width * 2, power * power
    return scramble(out)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads its input over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def inside(words: Words, k: int) -> np.ndarray:
    """Whether the k-word window from each position on stays in its text (length: positions - k + 1)."""
    n = max(0, len(words.codes) - k + 1)
    room = np.repeat(words.offsets[1:], words.lengths) - np.arange(len(words.codes))
    return room[:n] >= k


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    delta = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64) - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(delta)[:n] > 0
