"""Spectra and planes as arrays: band statistics, masking, stereo tools, transforms, overlap-add.

Arrays stay arrays (higher-order functions over fixed lengths), so a row's work needs no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMR = 501.19
UP_DB, DOWN_DB, RANGE = 25.0, 60.0, 8.0


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def bands(spectrum: Column, offsets: Sequence[int]) -> list[Column]:
    return [F.slice(spectrum, a + 1, b - a) for a, b in zip(offsets, offsets[1:], strict=False)]


def band_energy(spectrum: Column, offsets: Sequence[int]) -> Column:
    return F.array(*(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))) for b in bands(spectrum, offsets)))


def band_peaks(spectrum: Column, offsets: Sequence[int]) -> Column:
    return F.array(*(F.array_max(F.transform(b, lambda x: F.abs(x.cast("double")))) for b in bands(spectrum, offsets)))


def band_tonality(spectrum: Column, offsets: Sequence[int]) -> Column:
    """Spectral flatness in dB over -60, held to [0, 1]; a band of one bin is a tone."""

    def one(b: Column, n: int) -> Column:
        if n < 2:
            return F.lit(1.0)
        p = F.transform(b, lambda x: x.cast("double") * x.cast("double") + F.lit(1e-20))
        flat = F.exp(total(F.transform(p, lambda x: F.log(x))) / n) / (total(p) / n)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 10 * F.log10(F.greatest(F.least(flat, F.lit(1.0)), F.lit(1e-12))) / -60.0))

    return F.array(*(one(b, hi - lo) for b, lo, hi in zip(bands(spectrum, offsets), offsets, offsets[1:], strict=False)))


def spreading(centres: Sequence[float]) -> list[list[float]]:
    """How much of band j's energy masks band i, from band centres in Hz."""
    z = [13.0 * math.atan(0.00076 * f) + 3.5 * math.atan((f / 7500.0) ** 2) for f in centres]
    return [[0.0 if abs(a - b) > RANGE else 10 ** (-(UP_DB * (a - b) if a >= b else DOWN_DB * (b - a)) / 10) for b in z] for a in z]


def masked_thresholds(energy: Column, centres: Sequence[float]) -> Column:
    """Per band the spread energy over the signal-to-mask ratio. The matrix is a constant of the rate."""
    rows = F.array(*(F.array(*map(F.lit, r)) for r in spreading(centres)))
    return F.transform(rows, lambda r: total(F.zip_with(energy, r, lambda e, s: e * s)) / SMR)


def noise_targets(noise: Column, width: Column, energy: Column, offset: int) -> Column:
    """Noise each band may get: at an offset over 0 water is filled up from the lowest density."""
    scale = 2.0 ** (offset * 0.25)
    if offset <= 0:
        allowed = F.transform(noise, lambda x: x * scale)
    else:
        density = F.filter(F.zip_with(noise, width, lambda n, w: F.when((n > 0) & (w > 0), n / w)), lambda x: x.isNotNull())
        water = F.coalesce(F.array_min(density), F.lit(0.0)) * scale
        allowed = F.zip_with(noise, width, lambda n, w: F.greatest(n, water * w))
    return F.zip_with(allowed, energy, lambda t, e: F.when(t < e, t).otherwise(0.0))


def mid_side(left: Column, right: Column) -> Column:
    return F.struct(F.zip_with(left, right, lambda a, b: (a.cast("double") + b) / 2).alias("mid"), F.zip_with(left, right, lambda a, b: (a.cast("double") - b) / 2).alias("side"))


def prefers_mid_side(e_left: Column, e_right: Column, e_side: Column) -> Column:
    return 3 * e_side < F.least(e_left, e_right)


def intensity(left: Column, position: Column, sign: int = 1) -> Column:
    """A right spectrum from the left one: 0.5 ** (position / 4)."""
    return F.transform(left, lambda x: sign * x.cast("double") * F.pow(F.lit(0.5), position / 4.0))


def imdct(spectrum: Column, n: int) -> Column:
    """Inverse MDCT of n / 2 coefficients to n samples, by the defining sum."""
    n0 = (n / 2 + 1) / 2
    table = F.array(*(F.array(*(F.lit(2.0 / n * math.cos(2 * math.pi / n * (i + n0) * (k + 0.5))) for k in range(n // 2))) for i in range(n)))
    return F.transform(table, lambda r: total(F.zip_with(spectrum, r, lambda x, c: x.cast("double") * c)))


def mdct(time: Column, n: int) -> Column:
    """MDCT of n samples to n / 2 coefficients, by the defining sum."""
    n0 = (n / 2 + 1) / 2
    table = F.array(*(F.array(*(F.lit(2.0 * math.cos(2 * math.pi / n * (i + n0) * (k + 0.5))) for i in range(n))) for k in range(n // 2)))
    return F.transform(table, lambda r: total(F.zip_with(time, r, lambda x, c: x.cast("double") * c)))


def sine_half(n: int) -> list[float]:
    return [math.sin(math.pi / (2 * n) * (i + 0.5)) for i in range(n)]


def overlap_added(rows: DataFrame, block: str, window) -> DataFrame:
    """Adds pcm: the left half of a block plus the right half of the one before, in the window's order."""
    half = F.size(block) / 2
    left = F.slice(block, F.lit(1), half.cast("int"))
    right = F.slice(block, (half + 1).cast("int"), half.cast("int"))
    rows = rows.withColumn("_tail", F.lag(right).over(window))
    return rows.withColumn("pcm", F.when(F.col("_tail").isNull(), left).otherwise(F.zip_with(left, F.col("_tail"), lambda a, b: a + b))).drop("_tail")


def mono(planes: DataFrame, group: Sequence[str], plane: str, is_lfe: Column) -> DataFrame:
    """group, place, value: the mean of the planes that aren't LFE (of all, if all are), sample by sample."""
    rows = planes.select(*group, is_lfe.alias("lfe"), F.posexplode(plane).alias("place", "x"))
    means = rows.groupBy(*group, "place").agg(F.avg(F.when(~F.col("lfe"), F.col("x").cast("double"))).alias("some"), F.avg(F.col("x").cast("double")).alias("every"))
    return means.select(*group, F.col("place").cast("long").alias("place"), F.coalesce("some", "every").alias("value"))


def in_domain(plane: Column) -> Column:
    """Finite and within [-1, 1] everywhere."""
    return F.forall(plane, lambda x: ~F.isnan(x) & (F.abs(x) <= 1.0))
