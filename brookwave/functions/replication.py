"""Band replication: where bands begin and end, and what scale factors mean, as columns."""

from __future__ import annotations

import math
from itertools import accumulate, pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offsets of the first band by rate and start index.
START_OFFSETS = {
    16000: (-8, -7, -6, -5, -4, -3, -2, -1, 0, 1, 2, 3, 4, 5, 6, 7),
    22050: (-5, -4, -3, -2, -1, 0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 13),
    24000: (-5, -3, -2, -1, 0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 16),
    32000: (-6, -4, -2, -1, 0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 16),
    44100: (-4, -2, -1, 0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 16, 20),
    96000: (-2, -1, 0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 16, 20, 24),
}
#: Rates that share the offsets of another.
SAME_OFFSETS = {48000: 44100, 64000: 44100, 88200: 96000, 128000: 96000, 176400: 96000, 192000: 96000}
#: Bandwidths of the inverse filter by the mode before and the mode now.
BANDWIDTHS = ((0.0, 0.6, 0.9, 0.98), (0.6, 0.75, 0.9, 0.98), (0.0, 0.75, 0.9, 0.98), (0.0, 0.75, 0.9, 0.98))
NOISE_OFFSET, BANDS, STEPS = 6.0, 64, 13


def nearest(x: Column) -> Column:
    """Rounded, halves upward."""
    return F.floor(x + 0.5).cast("int")


def _by_rate(rate: Column, low: float, middle: float, high: float) -> Column:
    return nearest(F.when(rate < 32000, low).when(rate < 64000, middle).otherwise(high) * 128.0 / rate)


def first_band(rate: Column, start: Column) -> Column:
    """The low border; null for rates without offsets or indices over 15."""
    rows = START_OFFSETS | {k: START_OFFSETS[v] for k, v in SAME_OFFSETS.items()}
    known = F.create_map(*(x for k, v in rows.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return _by_rate(rate, 3000.0, 4000.0, 5000.0) + F.get(F.element_at(known, rate.cast("int")), start.cast("int"))


def taken_of(least: int) -> list[int]:
    """Sums of the first 0, 1, ... smallest steps from a lowest border to the last band."""
    borders = [math.floor(least * math.pow(BANDS / least, p / STEPS) + 0.5) for p in range(STEPS + 1)]
    return [0, *accumulate(sorted(b - a for a, b in pairwise(borders)))]


def end_band(rate: Column, stop: Column, first: Column) -> Column:
    """The high border: the smallest of the geometric steps first, or a multiple of the low border; at most 64."""
    least, n = _by_rate(rate, 6000.0, 8000.0, 10000.0), F.least(stop, F.lit(STEPS)).cast("int")
    border = lambda p: nearest(least * F.pow(BANDS / least, p / STEPS))
    steps = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda p: border(p + 1) - border(p)))
    summed = F.aggregate(F.slice(steps, F.lit(1), n), F.lit(0), lambda s, x: s + x)
    known = F.get(F.array(*(F.lit(x) for m in range(1, BANDS + 1) for x in taken_of(m))), (STEPS + 1) * (least - 1) + n)
    taken = F.when(least.between(1, BANDS) & (n >= 0), known).otherwise(summed)  # lower rates than 12 kHz begin above the last band
    return F.when((stop < 0) | (stop > 15), None).otherwise(F.least(F.lit(BANDS), F.when(stop == 14, 2 * first).when(stop == 15, 3 * first).otherwise(least + taken))).cast("int")


def divisor(fine: Column) -> Column:
    """Steps of 3 dB count once, those of 1.5 dB half."""
    return F.when(fine, 1.0).otherwise(2.0)


def envelope_energy(e: Column, fine: Column) -> Column:
    return 64.0 * F.pow(F.lit(2.0), e / divisor(fine))


def noise_energy(q: Column) -> Column:
    return F.pow(F.lit(2.0), NOISE_OFFSET - q)


def _split(total: Column, ratio: Column) -> Column:
    return F.struct((total / (1 + ratio)).alias("left"), (total / (1 + 1 / ratio)).alias("right"))


def coupled_envelope(mean: Column, balance: Column, fine: Column) -> Column:
    """(left, right) energies of a mean and a balance."""
    a = divisor(fine)
    return _split(64.0 * F.pow(F.lit(2.0), mean / a + 1), F.pow(F.lit(2.0), (F.when(fine, 12.0).otherwise(24.0) - balance) / a))


def coupled_noise(mean: Column, balance: Column) -> Column:
    return _split(F.pow(F.lit(2.0), NOISE_OFFSET + 1 - mean), F.pow(F.lit(2.0), 12.0 - balance))


def chirp(mode: Column, mode_before: Column, bandwidth_before: Column) -> Column:
    """The smoothed bandwidth of the inverse filter; a fall is followed faster than a rise, and traces are dropped."""
    table = F.array(*(F.lit(x) for row in BANDWIDTHS for x in row))
    held = lambda m: F.greatest(F.lit(0), F.least(m, F.lit(3)))
    new = F.get(table, (4 * held(mode_before) + held(mode)).cast("int"))
    mixed = F.when(new < bandwidth_before, 0.75 * new + 0.25 * bandwidth_before).otherwise(0.90625 * new + 0.09375 * bandwidth_before)
    return F.when(mixed < 1 / 64, 0.0).otherwise(mixed)


def geometry_changed(now: list[Column], before: list[Column]) -> Column:
    """Whether any of the fields that the bands follow from differs."""
    changed = F.lit(False)
    for a, b in zip(now, before, strict=True):
        changed = changed | ~a.eqNullSafe(b)
    return changed
