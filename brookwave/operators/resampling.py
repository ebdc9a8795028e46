"""Bootstrap intervals of medians with draws that are the same on every host."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The generator's start and its step modulo 2 ** 64, resamples, and the order statistics of the interval.
START, FACTOR, ADDEND = 0x9E3779B9, 6364136223846793005, 1
RESAMPLES, LOW, HIGH = 1000, 25, 974
DRAWS = 1 << 20  # held at once


def draws(state: int, n: int) -> np.ndarray:
    """The next n states of the generator: powers and their sums in place of a loop."""
    powers = np.cumprod(np.full(n, FACTOR, np.uint64))
    sums = np.cumsum(np.r_[np.ones(1, np.uint64), powers[:-1]])
    return powers * np.uint64(state) + sums * np.uint64(ADDEND)


def median_interval(samples: np.ndarray) -> tuple[float, float]:
    n = len(samples)
    if not n:
        return float("nan"), float("nan")
    medians, state, each = [], START, max(1, DRAWS // n)
    for at in range(0, RESAMPLES, each):
        found = draws(state, min(each, RESAMPLES - at) * n)
        state = int(found[-1])
        medians.append(np.median(samples[(found % np.uint64(n)).astype(np.int64)].reshape(-1, n), axis=1))
    medians = np.sort(np.concatenate(medians))
    return float(medians[LOW]), float(medians[HIGH])


def bootstrap_medians(rows: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """Per group the interval of its median; nulls are left out, the order of the samples decides which are drawn.

    A group's samples are the repeats of one timing and meet in one task; its resamples never do.
    """

    def run(table: pa.Table) -> pa.Table:
        low, high = median_interval(table.sort_by([(c, "ascending") for c in order])["_value"].to_numpy())
        return pa.table({group: table[group].slice(0, 1), "n": pa.array([table.num_rows], pa.int64()), "lo": [low], "hi": [high]})

    used = rows.where(F.col(value).isNotNull()).select(group, *order, F.col(value).cast("double").alias("_value"))
    kind = rows.schema[group].dataType.simpleString()
    return used.groupBy(group).applyInArrow(run, f"{group} {kind}, n long, lo double, hi double")
