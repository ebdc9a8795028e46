"""Array kernels: transforms, windows, linear prediction, noise, prediction filters.

Kernels without feedback are Arrow UDFs over whole batches of equal lengths (one matrix product or FFT
a batch); recurrences run along the samples and across the rows of a batch at once. The defining sums
as SQL expressions are in operators/spectra.py; tests hold these kernels against them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def kbd_window(n: int, alpha: float) -> np.ndarray:
    """The rising half, n long, of a Kaiser-Bessel-derived window: square roots of the kernel's running sum."""
    kernel = np.kaiser(n + 1, np.pi * alpha)
    return np.sqrt(np.cumsum(kernel[:n]) / kernel.sum())


def sine_window(n: int) -> np.ndarray:
    return np.sin(np.pi / (2 * n) * (np.arange(n) + 0.5))


def mdct(x: np.ndarray) -> np.ndarray:
    """Rows of 2m samples to m coefficients, by one complex FFT of 2m: 2 * sum x cos(pi/m (i + n0)(k + 1/2))."""
    n = x.shape[-1]
    m = n // 2
    i, k, n0 = np.arange(n), np.arange(m), (m + 1) / 2
    turned = np.fft.fft(x * np.exp(-1j * np.pi * i / n), axis=-1)[..., :m]
    return 2 * (turned * np.exp(-1j * np.pi / m * n0 * (k + 0.5))).real


def imdct(y: np.ndarray) -> np.ndarray:
    """Rows of m coefficients to 2m aliased samples: the same sum over k, with 2 / 2m before it."""
    m = y.shape[-1]
    n, n0 = 2 * m, (m + 1) / 2
    k, i = np.arange(m), np.arange(n)
    padded = np.zeros((*y.shape[:-1], n), complex)
    padded[..., :m] = y * np.exp(1j * np.pi / m * n0 * (k + 0.5))
    # exp(j pi/m i (k + 1/2)) = exp(j pi i / n) * exp(2 pi j i k / n)
    return (2 / n) * (np.fft.ifft(padded, axis=-1) * n * np.exp(1j * np.pi * i / n)).real


def overlap_added(blocks: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Aliased blocks of 2m in time order to samples, m a block: the first block's left half is its own."""
    m = blocks.shape[1] // 2
    shaped = blocks * np.concatenate([window, window[::-1]])
    before = np.vstack([np.zeros((1, m)), shaped[:-1, m:]])
    return (before + shaped[:, :m]).ravel()


def autocorrelation(x: np.ndarray, order: int) -> np.ndarray:
    """Lags 0 to order of each row."""
    return np.stack([(x[..., : x.shape[-1] - k] * x[..., k:]).sum(axis=-1) for k in range(order + 1)], axis=-1)


def levinson(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(reflections, gain of the prediction) of each row of lags; silent rows have zeros and gain 1."""
    order = r.shape[-1] - 1
    a, k = np.zeros_like(r, float), np.zeros((*r.shape[:-1], order))
    a[..., 0], left = 1.0, r[..., 0].astype(float)
    for m in range(1, order + 1):
        met = (a[..., :m] * r[..., m:0:-1]).sum(axis=-1)
        step = np.where(left > 0, -met / np.where(left > 0, left, 1), 0.0)
        k[..., m - 1] = step
        a[..., 1 : m + 1] += step[..., None] * a[..., m - 1 :: -1][..., :m] if m > 1 else step[..., None] * a[..., :1]
        left = left * (1 - step * step)
    return k, np.where(left > 0, r[..., 0] / np.where(left > 0, left, 1), 1.0)


def step_up(k: np.ndarray) -> np.ndarray:
    """Reflections to the filter 1, a1, a2, ..."""
    a = np.ones((*k.shape[:-1], 1))
    for m in range(k.shape[-1]):
        longer = np.concatenate([a, np.zeros_like(a[..., :1])], axis=-1)
        a = longer + k[..., m : m + 1] * longer[..., ::-1]
    return a


def all_zero(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The residual: each row through its filter a."""
    out = x * a[..., :1]
    for m in range(1, a.shape[-1]):
        out[..., m:] += a[..., m : m + 1] * x[..., :-m]
    return out


def all_pole(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The inverse of all_zero: a recurrence along the samples, all rows at once."""
    out = np.array(x, float)
    order = a.shape[-1] - 1
    for i in range(out.shape[-1]):
        for m in range(1, min(order, i) + 1):
            out[..., i] -= a[..., m] * out[..., i - m]
    return out


def quantised_reflections(k: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): arcsine steps, finer by half an index on the side of positive ones."""
    up, down = ((1 << (bits - 1)) - 0.5) / (np.pi / 2), ((1 << (bits - 1)) + 0.5) / (np.pi / 2)
    index = np.round(np.arcsin(np.clip(k, -1, 1)) * np.where(k >= 0, up, down)).astype(int)
    return index, np.sin(index / np.where(index >= 0, up, down))


def noise(state: int, n: int, energy: float) -> tuple[np.ndarray, int]:
    """n numbers of a linear congruential generator, signed, scaled to an energy; and the state after."""
    out = np.empty(n)
    for i in range(n):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        out[i] = state - (1 << 32) if state >> 31 else state
    norm = float((out * out).sum())
    return (out * np.sqrt(energy / norm) if norm else out), state


def with_pulses(q: np.ndarray, start: int, offsets: list[int], amounts: list[int]) -> np.ndarray:
    """Integers moved away from zero at running positions; zero counts as negative."""
    out, at = np.array(q), start
    for step, amount in zip(offsets, amounts, strict=True):
        at += step
        if not 0 <= at < len(out):
            raise ValueError("pulse outside the spectrum")
        out[at] += amount if out[at] > 0 else -amount
    return out


def by_rows(of: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A kernel on rows of equal length as a function of array columns.

    Nulls, and arrays with nulls in them or of no elements, give null; lengths may differ from row to row:
    rows of one length go through the kernel together.
    """

    @F.arrow_udf(ArrayType(DoubleType()))
    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in column:
            groups: dict[int, list[int]] = {}
            rows = c.to_pylist()
            for i, x in enumerate(rows):
                if x and None not in x:
                    groups.setdefault(len(x), []).append(i)
            out: list = [None] * len(rows)
            for at in groups.values():
                for i, y in zip(at, of(np.array([rows[i] for i in at], float)), strict=True):
                    out[i] = y.tolist()
            yield pa.array(out, pa.list_(pa.float64()))

    return run


fast_mdct, fast_imdct = by_rows(mdct), by_rows(imdct)


def lags(order: int) -> Callable[[Column], Column]:
    return by_rows(lambda x: autocorrelation(x, min(order, x.shape[-1] - 1)))


def reflections(order: int) -> Callable[[Column], Column]:
    return by_rows(lambda x: levinson(autocorrelation(x, min(order, x.shape[-1] - 1)))[0])


def residual(order: int) -> Callable[[Column], Column]:
    """Each row through the prediction filter of its own lags."""
    return by_rows(lambda x: all_zero(x, step_up(levinson(autocorrelation(x, min(order, x.shape[-1] - 1)))[0])))
