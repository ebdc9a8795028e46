"""Evaluation: scores of signals, benchmark statistics, study analysis, corpus checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookwave.operators.spectra import total

#: 97.5 % points of Student's t by degrees of freedom.
T975 = ((1, 12.706), (2, 4.303), (3, 3.182), (4, 2.776), (5, 2.571), (6, 2.447), (7, 2.365), (8, 2.306), (9, 2.262), (10, 2.228), (15, 2.131), (20, 2.086), (30, 2.042), (60, 2.000), (120, 1.980))


def snr_db(wanted: Column, got: Column) -> Column:
    """10 log10 of signal over error energy; infinite without an error."""
    signal = total(F.transform(wanted, lambda x: x.cast("double") * x.cast("double")))
    error = total(F.zip_with(wanted, got, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)))
    return F.when(error == 0, F.lit(float("inf"))).when(signal == 0, F.lit(float("-inf"))).otherwise(10 * F.log10(signal / error))


def rms(plane: Column) -> Column:
    return F.sqrt(total(F.transform(plane, lambda x: x.cast("double") * x.cast("double"))) / F.size(plane))


def max_abs_error(wanted: Column, got: Column) -> Column:
    return F.array_max(F.zip_with(wanted, got, lambda a, b: F.abs(a.cast("double") - b)))


def dot(a: Column, b: Column) -> Column:
    """A raw dot product, not Pearson's correlation."""
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def lag_scores(a: Column, b: Column, most: int, size: int) -> Column:
    """Array of (lag, normalised product) of a against b shifted by each lag in [-most, most]."""

    def one(lag: int) -> Column:
        x, y = F.slice(a, max(0, -lag) + 1, size - abs(lag)), F.slice(b, max(0, lag) + 1, size - abs(lag))
        scale = F.sqrt(dot(x, x) * dot(y, y))
        return F.struct(F.lit(lag).cast("long").alias("lag"), F.when(scale > 0, dot(x, y) / scale).otherwise(0.0).alias("c"))

    return F.array(*(one(k) for k in range(-most, most + 1)))


def at_ranks(rows: DataFrame, group: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]], ranges: int = 64) -> DataFrame:
    """The group, the number n of its values, and the element at each rank (from 0, as a function of n), exactly.

    Equal values are counted first. A group's values are cut into ranges by approximate quantiles, the ranges' exact
    counts say which of them holds a rank, and only that one is sorted: a group with most of the rows is spread over
    tasks, and none collects a list. Nulls don't count; a rank outside of the group gives null.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    cuts = counts.groupBy(*group).agg(F.percentile_approx("_v", [k / ranges for k in range(1, ranges)], 100 * ranges).alias("_cuts"), F.sum("_c").alias("n"))

    def matched(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        named = right.select(*(F.col(g).alias(f"_r{k}") for k, g in enumerate([*group, *more])), *(c for c in right.columns if c not in (*group, *more)))
        same = [F.col(g).eqNullSafe(F.col(f"_r{k}")) for k, g in enumerate([*group, *more])]
        return left.join(named, reduce(lambda a, b: a & b, same, F.lit(True))).drop(*(f"_r{k}" for k in range(len(same))))

    placed = matched(counts, cuts).withColumn("_k", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    per = placed.groupBy(*group, "_k").agg(F.sum("_c").alias("_in"), F.max("n").alias("n"))
    per = per.withColumn("_before", F.sum("_in").over(Window.partitionBy(*group).orderBy("_k")) - F.col("_in"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items())))
    wanted = per.withColumn("_q", asked).where((F.col("_q.rank") >= F.col("_before")) & (F.col("_q.rank") < F.col("_before") + F.col("_in"))).drop("n", "_in")
    inside = Window.partitionBy(*group, "_q").orderBy("_v")
    found = matched(placed.drop("n"), wanted, "_k").withColumn("_end", F.col("_before") + F.sum("_c").over(inside))
    held = (F.col("_q.rank") < F.col("_end")) & (F.col("_q.rank") >= F.col("_end") - F.col("_c"))
    values = found.where(held).groupBy(*group).agg(*(F.max(F.when(F.col("_q.name") == name, F.col("_v"))).alias(name) for name in ranks))
    return matched(cuts.drop("_cuts"), values)


def median_and_p95(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean of the middle values, and the element at round((n - 1) * 0.95)."""
    found = at_ranks(rows, group, value, {"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.floor(n / 2), "p95": lambda n: F.round((n - 1) * 0.95)})
    return found.select(*group, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias("median"), "p95")


def nearest_rank(rows: DataFrame, group: Sequence[str], value: str, q: float) -> DataFrame:
    """The element at ceil(n * q): the third of the definitions in use."""
    return at_ranks(rows, group, value, {"value": lambda n: F.greatest(F.lit(1), F.ceil(n * q)) - 1}).select(*group, "value")


def t975(df: Column) -> Column:
    """Piecewise linear in the table; its ends hold beyond it (1.96 above)."""
    out = F.when(df < 1, T975[0][1])
    for (n0, t0), (n1, t1) in zip(T975[:1] + T975, T975, strict=False):
        out = out.when(df <= n1, t1 if n0 == n1 else t0 + (df - n0) / (n1 - n0) * (t1 - t0))
    return out.otherwise(1.96)


def screened(rows: DataFrame, listener: str, item: str, ref_failed: Column, anchor_failed: Column, most: float) -> DataFrame:
    """Per listener the shares of items at which the hidden reference or the anchor failed, and validity."""
    g = rows.groupBy(listener).agg(F.count_distinct(item).alias("n_items"), F.count_if(ref_failed).alias("n_ref"), F.count_if(anchor_failed).alias("n_anchor"))
    share = lambda c: F.when(F.col("n_items") > 0, F.col(c) / F.col("n_items")).otherwise(0.0)
    g = g.withColumn("ref_share", share("n_ref")).withColumn("anchor_share", share("n_anchor"))
    return g.withColumn("valid", (F.col("ref_share") <= most) & (F.col("anchor_share") <= most))


def paired_interval(rows: DataFrame, listener: str, item: str, condition: str, score: str, left: str, right: str) -> DataFrame:
    """Mean over listeners of their mean differences left - right, with a 95 % interval. One aggregation, no self-join."""
    pairs = rows.where(F.col(condition).isin(left, right)).groupBy(listener, item).agg(F.max(F.when(F.col(condition) == left, F.col(score))).alias("a"), F.max(F.when(F.col(condition) == right, F.col(score))).alias("b"))
    per = pairs.where("a is not null and b is not null").groupBy(listener).agg(F.avg(F.col("a") - F.col("b")).alias("x"))
    out = per.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    half = t975(F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    return out.select("n", "mean", "sd", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def sliding_rms(rows: DataFrame, stream: Sequence[str], place: str, value: str, hop: int, size: int) -> DataFrame:
    """RMS of windows of ``size`` places that begin every ``hop``: rows go to the few windows that hold them."""
    first = F.greatest(F.ceil((F.col(place) - (size - 1)) / hop), F.lit(0)).cast("long")
    spread = rows.select(*stream, F.col(value).alias("_v"), F.explode(F.sequence(first, F.floor(F.col(place) / hop).cast("long"))).alias("hop"))
    return spread.groupBy(*stream, "hop").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("_v") * F.col("_v"))).alias("rms"))
