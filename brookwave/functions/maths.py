"""Elementary functions as columns, and what hearing makes of them. JVM built-ins: the last bits can differ from host to host."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from brookwave.functions.scalars import absolute_threshold_db

#: Sound pressure of full scale in dB, and the bin that a full-scale sine fills.
FULL_SCALE_DB, FULL_SCALE_BIN = 96.0, 32768.0 * 512.0


def exp2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def exp10(x: Column) -> Column:
    return F.pow(F.lit(10.0), x)


def sine_cosine(angle: Column) -> Column:
    return F.struct(F.sin(angle).alias("sin"), F.cos(angle).alias("cos"))


def three_quarters(x: Column) -> Column:
    """x to the power 3/4 by roots."""
    return F.sqrt(x) * F.sqrt(F.sqrt(x))


def twiddles(n: Column) -> Column:
    """exp(2 pi j k / n) of the lower half of the circle, as an array of (re, im)."""
    return F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1), lambda k: F.struct(F.cos(2 * math.pi * k / n).alias("re"), F.sin(2 * math.pi * k / n).alias("im")))


def reversed_bits(k: Column, n_bits: int) -> Column:
    """The number with its lowest bits in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(k.cast("long")), n_bits, "0")), 2, 10).cast("long")


def absolute_threshold_energy(hertz: Column) -> Column:
    """The hearing threshold as the energy of a band."""
    return F.lit(FULL_SCALE_BIN * FULL_SCALE_BIN) * exp10((absolute_threshold_db(hertz) - FULL_SCALE_DB) / 10)
