"""Words of whole texts as numbers, for many texts at once.

Everything works on the UTF-8 bytes of an Arrow string column, so a batch costs a few passes of numpy over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# White space, and the lower case of A-Z; other bytes are as they are.
WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Texts taken together: bounds the memory of the numbers made of them.
BATCH_BYTES = 1_000_000
# The same where workers share an executor with large joins: what a worker once took it keeps, also while it is idle.
SMALL_BYTES = 250_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
# A fixed random number for each byte, and for each place in a shingle.
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(8).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words(NamedTuple):
    hashes: np.ndarray  # of each word
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i + 1]
    data: np.ndarray  # the bytes, lower-cased if asked for


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with every bit depending on all others."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return data[first : offsets[-1]], offsets - first


def slices(batch: pa.RecordBatch, text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text; a longer text is a piece of its own."""
    if not len(batch):
        return
    _, offsets = bytes_of(batch.column(text))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_ODD), -1, 2**64))
        size = max(n, 1 << 16)
        _POWERS = tuple(
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64))])
            for base in (_ODD, inverse)
        )
    return _POWERS


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    power, inverse = _powers(len(data) + 1)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)])])
    return mixed((upto[ends] - upto[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words_of(texts: pa.Array, lower: bool = True) -> Words:
    """The words (runs without white space) of each text and a 64-bit hash of each."""
    data, offsets = bytes_of(texts)
    if lower:
        data = LOWER[data]
    black = np.concatenate([~WHITE[data], [False]])
    before = np.concatenate([[False], black[:-1]])
    before[offsets[:-1]] = False
    after = np.concatenate([black[1:], [False]])
    cuts = offsets[1:-1]
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(black & ~before)
    ends = np.flatnonzero(black & ~after) + 1
    return Words(hashed(data, starts, ends), starts, ends, np.searchsorted(starts, offsets), data)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its runs of ``n`` words.

    A text of fewer words has one: all its words. A text without words has none.
    """
    words = words_of(texts)
    count = len(words.hashes)
    runs = np.zeros(max(count - n + 1, 0), np.uint64)
    for k in range(n):
        runs += words.hashes[k : k + len(runs)] * _PLACE[k]
    runs = mixed(runs)
    out = []
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            short = (words.hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mixed(short + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
