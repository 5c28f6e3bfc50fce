"""Stretches of a series as arrays: trailing windows, ranks and quantiles."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable

import numpy as np
import pyarrow as pa


def numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns as doubles, null as NaN."""
    return [np.asarray(table[name].cast(pa.float64()).combine_chunks().fill_null(float("nan"))) for name in names]


def trailing_windows(values: np.ndarray, own: int, width: int) -> np.ndarray:
    """For each row from ``own`` on its last ``width`` values, oldest first, NaN where the series has none."""
    padded = np.concatenate([np.full(width - 1, np.nan), values])
    return np.lib.stride_tricks.sliding_window_view(padded, width)[own:]


class SlidingOrder:
    """The values of a sliding window in order: one comes, one goes, whatever the window's width."""

    def __init__(self, values: Iterable[float] = ()):
        self.sorted = sorted(v for v in values if v == v)

    def swap(self, new: float, old: float | None) -> None:
        """Take ``old`` out (if given) and put ``new`` in; NaN stands for no value."""
        if old is not None and old == old:
            del self.sorted[bisect_left(self.sorted, old)]
        if new == new:
            insort(self.sorted, new)

    def share_up_to(self, value: float) -> float:
        """The share of values up to ``value``, 0 without any."""
        return bisect_right(self.sorted, value) / len(self.sorted) if self.sorted else 0.0

    def quantile(self, q: float) -> float:
        """Linearly interpolated, NaN without values."""
        if not self.sorted:
            return math.nan
        at = q * (len(self.sorted) - 1)
        low = int(at)
        a = self.sorted[low]
        # a sum of weighted neighbours, so that equal neighbours give themselves
        return a if low == at else (low + 1 - at) * a + (at - low) * self.sorted[low + 1]


def trailing_quantiles(values: np.ndarray, own: int, width: int, least: int, quantiles: list[float]) -> list[np.ndarray]:
    """Quantiles of the last ``width`` rows for each row from ``own`` on, NaN before ``least`` rows; missing values don't count."""
    x = values.tolist()
    held = SlidingOrder(x[max(0, own - width) : own])
    out = [np.full(len(x) - own, np.nan) for _ in quantiles]
    for at in range(own, len(x)):
        held.swap(x[at], x[at - width] if at >= width else None)
        if at + 1 >= least:
            for q, column in zip(quantiles, out, strict=True):
                column[at - own] = held.quantile(q)
    return out


def trailing_rank(values: np.ndarray, own: int, width: int) -> np.ndarray:
    """For each row from ``own`` on the share of the ``width`` rows before it with values up to its own; 0 without such rows."""
    x = values.tolist()
    held = SlidingOrder(x[max(0, own - width) : own])
    out = np.zeros(len(x) - own)
    for at in range(own, len(x)):
        out[at - own] = held.share_up_to(x[at])
        held.swap(x[at], x[at - width] if at >= width else None)
    return out
