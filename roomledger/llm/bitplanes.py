"""Hamming distances of many 64-bit values at once, on vertical bit planes.

Plane ``b`` holds bit ``b`` of every value, 64 values to a machine word. A distance is counted for 64
values together: two planes of differences at a time go through a carry-save adder into bitwise
counters. Words whose values all exceed the radius are abandoned before their remaining planes are read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
PLANES_BETWEEN_CHECKS = 16


def lanes(flags: np.ndarray) -> np.ndarray:
    """Booleans as bits of words, the first in the lowest bit."""
    padded = np.zeros(-(-len(flags) // 64) * 64, dtype=bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def flags(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little").view(bool)


def planes(values: np.ndarray) -> np.ndarray:
    """64 rows of words, and one word of padding at the end."""
    padded = np.zeros((-(-len(values) // 64) + 1) * 64, dtype=np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _exceed(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits of the lanes whose counter is larger than the radius."""
    larger, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for bit in reversed(range(len(counters))):
        if radius >> bit & 1:
            equal &= counters[bit]
        else:
            larger |= equal & counters[bit]
            equal &= ~counters[bit]
    return larger


def near(own: np.ndarray, other: Callable[[int, np.ndarray], np.ndarray], taking_part: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the lanes among ``taking_part`` within the radius; ``other(b, words)``: the other side's plane."""
    result = np.zeros_like(taking_part)
    live = np.flatnonzero(taking_part)
    depth = max(2, radius.bit_length())
    counters = [np.zeros(len(live), dtype=np.uint64) for _ in range(depth)]
    over = ~taking_part[live]
    for first in range(0, 64, PLANES_BETWEEN_CHECKS):
        if not len(live):
            return result
        for b in range(first, first + PLANES_BETWEEN_CHECKS, 2):
            x = own[b, live] ^ other(b, live)
            y = own[b + 1, live] ^ other(b + 1, live)
            half = counters[0] ^ x
            carry = counters[0] & x | half & y
            counters[0] = half ^ y
            for k in range(1, depth):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
        over |= _exceed(counters, radius)
        stay = over != ALL
        if not stay.all():
            live, over, counters = live[stay], over[stay], [c[stay] for c in counters]
    result[live] = ~over
    return result


def near_value(own: np.ndarray, value: int, taking_part: np.ndarray, radius: int) -> np.ndarray:
    """Lanes within the radius of one value."""
    constant = [ALL if value >> b & 1 else np.uint64(0) for b in range(64)]
    return near(own, lambda b, _: constant[b], taking_part, radius)


def near_shifted(own: np.ndarray, shift: int, taking_part: np.ndarray, radius: int) -> np.ndarray:
    """Lanes within the radius of the lane ``shift`` (1 to 63) places on."""
    down, up = np.uint64(shift), np.uint64(64 - shift)
    return near(own, lambda b, at: own[b, at] >> down | own[b, at + 1] << up, taking_part, radius)
