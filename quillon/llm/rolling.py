"""Digests of all runs of a fixed length in a sequence, by doubling."""

from __future__ import annotations

import numpy as np


class Rolling:
    """h(2k, i) = h(k, i) * c(k) + h(k, i + k), modulo 2^64, with a factor of its own for each doubling."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.bytes = draw.integers(0, 1 << 64, 256, np.uint64)
        self.factors = draw.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, raw: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
        """Of the runs of bytes of each of `lengths`."""
        return self.runs(self.bytes[raw], lengths)

    def runs(self, values: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
        """Of the runs of 64-bit `values`, which are digests themselves."""
        powers = {1: values}
        k = 1
        while 2 * k <= max(lengths) and len(powers[k]) > k:
            powers[2 * k] = powers[k][:-k] * self.factors[k.bit_length()] + powers[k][k:]
            k *= 2
        found = {}
        for length in lengths:
            n, at, out = len(values) - length + 1, 0, None
            if n <= 0:
                found[length] = np.empty(0, np.uint64)
                continue
            for bit in reversed(range(length.bit_length())):
                if length >> bit & 1:
                    part = powers[1 << bit][at : at + n]
                    out = part.copy() if out is None else out * self.factors[32 + bit] + part
                    at += 1 << bit
            found[length] = _mixed(out)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


FIRST, SECOND = Rolling(1), Rolling(2)
