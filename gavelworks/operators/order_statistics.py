"""Ranks and medians over one chunk of rows, inside a task."""

from __future__ import annotations

import numpy as np

BLOCK = 1024


def earlier_below(values: np.ndarray) -> np.ndarray:
    """For each value: how many values before it are strictly smaller.

    Works block by block: a binary search among all earlier blocks, kept
    sorted, and a comparison of all pairs inside the block.
    """
    out = np.empty(len(values), dtype="int64")
    seen = np.empty(0, dtype=values.dtype)
    for start in range(0, len(values), BLOCK):
        block = values[start : start + BLOCK]
        inside = np.tril(block[None, :] < block[:, None], -1).sum(axis=1)
        out[start : start + BLOCK] = np.searchsorted(seen, block, side="left") + inside
        ordered = np.sort(block)
        seen = np.insert(seen, np.searchsorted(seen, ordered), ordered)
    return out


def running_medians(earlier: np.ndarray, own: np.ndarray, below: int, first: int) -> np.ndarray:
    """Median after each of ``own`` joins the earlier values, of which ``below`` more lie under ``earlier``.

    ``first`` is the number of values there are once the first of ``own`` has
    joined. Goes backwards: all values are sorted once and linked to their
    neighbours, and taking the last one out moves the middle by one step.
    """
    values = np.concatenate([earlier, own])
    order = np.argsort(values, kind="stable")
    place = np.empty(len(values), dtype="int64")
    place[order] = np.arange(len(values))
    ranked = values[order].tolist()
    leaving = place[len(earlier) :].tolist()
    lower = list(range(-1, len(values) - 1))
    upper = list(range(1, len(values) + 1))

    n = first + len(own) - 1
    rank = (n - 1) // 2 - below
    middle = rank
    out = [0.0] * len(own)
    for i in range(len(own) - 1, -1, -1):
        out[i] = ranked[middle] if n % 2 else (ranked[middle] + ranked[upper[middle]]) / 2
        gone = leaving[i]
        before, after = lower[gone], upper[gone]
        if before >= 0:
            upper[before] = after
        if after < len(ranked):
            lower[after] = before
        n -= 1
        stays = (n - 1) // 2 - below == rank
        if gone < middle:
            middle = upper[middle] if stays else middle
        elif gone > middle:
            middle = middle if stays else lower[middle]
        else:
            middle = after if stays else before
        rank = (n - 1) // 2 - below
    return np.array(out)


def standing_so_far(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: how many from its group's start up to itself are not above it, and their median.

    ``starts`` is where each value's group begins. All values take the same
    walk together: places among the distinct values are told apart bit by bit
    from the highest, and at each bit the values are dealt to those without and
    those with it, in order. A run of values, from a group's start to a value,
    stays a run in either half, found from counts alone; following the half
    that holds the wanted value ends at the value of a given rank, and counting
    the lower halves passed by ends at the number of smaller ones. So every
    value costs as many vectorised steps as places have bits.
    """
    n = len(values)
    distinct, place = np.unique(values, return_inverse=True)
    ends = np.arange(n) + 1
    size = ends - starts
    # Walks for the two middle values, and for the value itself.
    low = np.stack([starts, starts, starts])
    high = np.stack([ends, ends, ends])
    rank = np.stack([(size - 1) // 2, size // 2])
    found = np.zeros((2, n), dtype="int64")
    smaller = np.zeros(n, dtype="int64")
    dealt = place
    for bit in range(max(int(len(distinct) - 1).bit_length(), 1) - 1, -1, -1):
        with_bit = (dealt >> bit) & 1
        without = np.concatenate([[0], np.cumsum(1 - with_bit)])
        zeros = without[-1]
        low_0, high_0 = without[low], without[high]
        here = high_0 - low_0
        upper = np.empty((3, n), dtype=bool)
        upper[:2] = rank >= here[:2]
        upper[2] = (place >> bit) & 1
        rank = np.where(upper[:2], rank - here[:2], rank)
        found |= upper[:2].astype("int64") << bit
        smaller += np.where(upper[2], here[2], 0)
        low = np.where(upper, zeros + low - low_0, low_0)
        high = np.where(upper, zeros + high - high_0, high_0)
        dealt = np.concatenate([dealt[with_bit == 0], dealt[with_bit == 1]])
    middle = distinct[found] if n else np.zeros((2, 0))
    # An odd number of values has one middle, and infinities must not be added up.
    median = np.where(found[0] == found[1], middle[0], (middle[0] + middle[1]) / 2)
    return smaller + high[2] - low[2], median
