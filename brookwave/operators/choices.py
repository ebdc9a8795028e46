"""Serial choices of an encoder and of a study as folds over a row's array, and rule ladders as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States of a block switch: long, start, short, stop.
LONG, START, SHORT, STOP = 0, 1, 2, 3
#: Categories with transients, and tonal ones.
TRANSIENT = ("speech-voiced", "speech-unvoiced", "speech-sibilants", "speech-radio", "percussion-transient")
TONAL = ("tonal-music", "dense-music")


def next_shape(state: Column, attack: Column) -> Column:
    """The block after a state: an attack in a long run starts, a start is always followed by a short one."""
    long = state.isin(LONG, STOP)
    return F.when(long & attack, START).when(long, LONG).when((state == START) | attack, SHORT).otherwise(STOP)


def block_shapes(attacks: Column) -> Column:
    """Shapes of a row's blocks, from a long one on."""
    step = lambda acc, a: F.concat(acc, F.array(next_shape(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(LONG)), a)))
    return F.aggregate(attacks, F.array().cast("array<int>"), step)


def range_cost(sums: Column, lo: Column, hi: Column) -> Column:
    """The cost of [lo, hi) from running sums that begin with 0."""
    return F.get(sums, hi.cast("int")) - F.get(sums, lo.cast("int"))


def smallest_true(fits: Column) -> Column:
    """The first place of a monotone array of verdicts that holds, or its size."""
    place = F.array_position(fits, F.lit(True))
    return F.when(place > 0, place - 1).otherwise(F.size(fits)).cast("long")


def merged_runs(peaks: Column, floor: float, ratio: float) -> Column:
    """Group numbers of neighbours: one begins where two are too unlike and not both quiet."""

    def step(acc, i):
        a, b = F.get(peaks, i - 1), F.get(peaks, i)
        high, low = F.greatest(a, b), F.least(a, b)
        apart = ~((high <= floor) | (high <= ratio * low))
        return F.concat(acc, F.array(F.element_at(acc, -1) + apart.cast("int")))

    return F.when(F.size(peaks) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(peaks) - 1, F.lit(1))), F.array(F.lit(0)), lambda acc, i: F.when(i < F.size(peaks), step(acc, i)).otherwise(acc)))


def listening_method(category: Column, bps: Column, profile: Column) -> Column:
    """Which method a study takes: null where the profile isn't studied."""
    expected = (bps <= 96_000) | category.isin(*TRANSIENT)
    return F.when(profile != "lc", None).when(~expected & (bps >= 128_000) & category.isin(*TONAL), "BS.1116-3").otherwise("MUSHRA")


def score_outcome(rate: Column, planes: Column, other_planes: Column, n: Column, other_n: Column, rms: Column, other_rms: Column, swapped: Column, valid: Column, delay: Column, quiet: float = 1e-4, share: float = 0.5, most_delay: int = 64, delay_allowed: bool = False) -> Column:
    """What a comparison of two clips is: the first diagnosis that applies, else scored."""
    late = F.lit(False) if delay_allowed else F.abs(delay) >= most_delay
    return (
        F.when((rate == 0) | (planes == 0) | (other_planes == 0) | (planes != other_planes) | (n == 0) | (other_n == 0), "unscorable").when((rms < quiet) | (other_rms < quiet), "silent")
        .when((planes == 2) & swapped, "channel swap").when((valid == 0) | (valid < share * n), "truncated").when(late, "delayed").otherwise("scored")
    )


def best_lag(scores: Column, centre: Column, radius: int) -> Column:
    """The lag within a radius of a centre with the highest score, the lowest of equals; scores by lag from 0."""
    near = F.filter(F.transform(scores, lambda x, i: F.struct(x.alias("s"), (-i).alias("i"))), lambda p: F.abs(-p["i"] - centre) <= radius)
    return (-F.array_max(near)["i"]).cast("long")
