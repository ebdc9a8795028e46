"""Streams in time: frames by count, trim windows, completion, locks, caps, tallies.

Every window is partitioned by the stream, so work spreads over streams; running sums replace the
serial loops of a decoder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(stream: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def until(stream: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def whole(stream: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def framed(rows: DataFrame, stream: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Adds frame and place: frames are runs of ``size`` rows."""
    n = F.row_number().over(Window.partitionBy(*stream).orderBy(*order)).cast("long") - 1
    return rows.withColumn("frame", F.floor(n / size).cast("long")).withColumn("place", (n % size).cast("long"))


def trimmed(frames: DataFrame, stream: Sequence[str], order: Sequence[str], n: Column, skip: Column, play: Column) -> DataFrame:
    """Adds lo and hi: what of a frame of n samples is shown after ``skip`` samples, for ``play`` samples (null: to the end)."""
    frames = frames.withColumn("n", n.cast("long")).withColumn("skip", skip.cast("long")).withColumn("play", play.cast("long"))
    frames = frames.withColumn("at", F.coalesce(F.sum("n").over(before(stream, order)), F.lit(0)).cast("long"))
    lo = F.greatest(F.col("skip") - F.col("at"), F.lit(0))
    hi = F.when(F.col("play").isNull(), F.col("n")).otherwise(F.least(F.col("n"), F.col("skip") + F.col("play") - F.col("at")))
    shown = (hi > lo) & (lo < F.col("n"))
    return frames.withColumn("lo", F.when(shown, lo).otherwise(0).cast("long")).withColumn("hi", F.when(shown, hi).otherwise(0).cast("long"))


def completion(skip_left: Column, left: Column, index_end: Column, rounded: Column) -> Column:
    """How a presentation ended: Incomplete, Unbounded, Complete or Rounded."""
    kind = F.when(skip_left != 0, "Incomplete").when(left.isNull(), "Unbounded").when(left == 0, "Complete").when(index_end & rounded, "Rounded").otherwise("Incomplete")
    return F.struct(kind.alias("kind"), F.when(skip_left.isNotNull() & (kind != "Unbounded"), left).cast("long").alias("missing"))


def lock_violations(rows: DataFrame, stream: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value isn't that of the stream's first row."""
    return rows.withColumn("locked", F.first(value).over(whole(stream, order))).where(~F.col(value).eqNullSafe(F.col("locked")))


def first_over_cap(rows: DataFrame, stream: Sequence[str], order: Sequence[str], n: Column, cap: int) -> DataFrame:
    """The row of each stream at which the running sum first exceeds the cap (equal is within)."""
    total = F.sum(n).over(until(stream, order))
    rows = rows.withColumn("total", total.cast("long")).withColumn("over", F.coalesce(F.sum(n).over(before(stream, order)), F.lit(0)))
    return rows.where((F.col("total") > cap) & (F.col("over") <= cap)).drop("over")


def sequence_gaps(rows: DataFrame, stream: Sequence[str], order: Sequence[str], number: Column, step: Column) -> DataFrame:
    """Adds previous and broken: whether a row's number isn't the one before plus the step."""
    w = Window.partitionBy(*stream).orderBy(*order)
    return rows.withColumn("number", number).withColumn("previous", F.lag("number").over(w)).withColumn("broken", F.coalesce(F.col("number") != F.col("previous") + step, F.lit(False)))


def attached(rows: DataFrame, stream: Sequence[str], order: Sequence[str], is_element: Column, element: Column) -> DataFrame:
    """Adds element: the nearest preceding row that is one (null: none yet)."""
    return rows.withColumn("element", F.last(F.when(is_element, element), ignorenulls=True).over(before(stream, order)))


def fenced(rows: DataFrame, stream: Sequence[str], order: Sequence[str], is_open: Column, is_fence: Column, at: Column) -> DataFrame:
    """For each opening row the first fence at or after it: a forward as-of join by one window, not by a range join."""
    ahead = Window.partitionBy(*stream).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("fence", F.first(F.when(is_fence, at), ignorenulls=True).over(ahead)).where(is_open)


def runs(rows: DataFrame, stream: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Gaps and islands: stream, run, value, length of each run of equal values."""
    w = Window.partitionBy(*stream).orderBy(*order)
    edge = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("long")
    marked = rows.withColumn("edge", edge).withColumn("run", F.sum("edge").over(until(stream, order)).cast("long"))
    return marked.groupBy(*stream, "run").agg(F.first(value).alias(value), F.count("*").alias("length"))


def folded_attacks(energies: Column, ratio: float = 8.0, floor: float = 1e-6, decay: float = 0.65, fresh: float = 0.35) -> Column:
    """Places in an ordered array of energies that surge over a leaky reference of what came before."""
    start = F.struct(F.lit(0.0).alias("acc"), F.lit(0.0).alias("prev"), F.lit(0).alias("seen"), F.array().cast("array<int>").alias("found"))

    def step(a, e):
        acc = decay * a["acc"] + fresh * a["prev"]
        surge = (a["seen"] > 0) & (e > floor) & (e > ratio * acc)
        return F.struct(acc.alias("acc"), e.alias("prev"), (a["seen"] + 1).alias("seen"), F.when(surge, F.concat(a["found"], F.array(a["seen"]))).otherwise(a["found"]).alias("found"))

    return F.aggregate(energies, start, step, lambda a: a["found"])


def clamped_steps(values: Column, most: int = 60, low: int = 0, high: int = 255) -> Column:
    """Differential coding with a clamp: each value follows the coded one before it by at most ``most``."""
    start = F.array().cast("array<bigint>")

    def step(a, v):
        last = F.try_element_at(a, F.lit(-1))
        v = F.least(F.greatest(v, F.lit(low)), F.lit(high))
        return F.concat(a, F.array(F.when(last.isNull(), v).otherwise(F.least(F.greatest(v, last - most), last + most)).cast("long")))

    return F.aggregate(values, start, step)
