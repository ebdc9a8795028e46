"""Matching of declared and decoded identities: each at most once, nothing left over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matched(declared: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer match: adds status matched, missing (declared only) or extra (found only)."""
    both = declared.withColumn("_d", F.lit(True)).join(found.withColumn("_f", F.lit(True)), list(keys), "full_outer")
    return both.withColumn("status", F.when(F.col("_d") & F.col("_f"), "matched").when(F.col("_d"), "missing").otherwise("extra")).drop("_d", "_f")


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_usable(rows: DataFrame, group: Sequence[str], order: Sequence[str], usable) -> DataFrame:
    """The first row of each group that is usable."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.where(usable).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def kept_states(states: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return states.join(seen.select(*keys).distinct(), list(keys), "left_semi")


def extra_elements(found: DataFrame, declared: DataFrame, keys: Sequence[str]) -> DataFrame:
    return found.join(declared.select(*keys).distinct(), list(keys), "left_anti")
