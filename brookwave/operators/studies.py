"""Comparisons of decoders and encoders, and the design of listening studies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookwave.operators.evaluation import at_ranks, dot
from brookwave.operators.spectra import total

#: Letters of blind names (none that look alike), the normal quantiles of 5 % one-sided and of 80 % power.
LETTERS = "23456789ABCDEFGHJKLMNPQRSTUVWXYZ"
Z_ALPHA, Z_BETA = 1.64485, 0.84162


def shape_status(rows: DataFrame, keys: Sequence[str], order: Column, failed: Column, shape: Sequence[str]) -> DataFrame:
    """failed, comparable or non-comparable: the first row of each key sets the shape that others must have.

    A first row that failed sets none, so that whatever follows is comparable.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.first(F.when(~failed, F.struct(*shape))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    status = F.when(failed, "failed").when(first.isNull() | (first == F.struct(*shape)), "comparable").otherwise("non-comparable")
    return rows.withColumn("status", status)


def rate_status(achieved: Column, wanted: Column, tolerance: float = 0.01) -> Column:
    """Whether a rate is close enough to the one asked for to compare what has it."""
    return F.when(F.abs(achieved - wanted) / F.greatest(wanted, F.lit(1)) > tolerance, "non-matched").otherwise("comparable")


def upper_median(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The element at n // 2 of the sorted values."""
    return at_ranks(rows, group, value, {"median": lambda n: F.floor(n / 2)}).select(*group, "median")


def leading_quiet(plane: Column, below: float = 1e-4) -> Column:
    """How many samples precede the first that is loud."""
    loud = F.transform(plane, lambda x: F.abs(x) >= below)
    return F.when(F.exists(loud, lambda x: x), F.array_position(loud, True) - 1).otherwise(F.size(plane)).cast("long")


def overlap(a: Column, b: Column, lag: Column) -> Column:
    """Both planes over what they share once b is moved back by the lag: struct<a, b>."""
    at_a, at_b = F.greatest(-lag, F.lit(0)).cast("int"), F.greatest(lag, F.lit(0)).cast("int")
    n = F.greatest(F.least(F.size(a) - at_a, F.size(b) - at_b), F.lit(0))
    return F.struct(F.slice(a, at_a + 1, n).alias("a"), F.slice(b, at_b + 1, n).alias("b"))


def level_difference_db(left: Column, right: Column) -> Column:
    """10 log10 of the planes' energies; null if the left one is silent."""
    return 10 * F.log10(dot(left, left) / F.greatest(dot(right, right), F.lit(1e-30)))


def coherence(left: Column, right: Column) -> Column:
    """Pearson's correlation of two planes, 1 where one of them is constant."""

    def centred(x: Column) -> Column:
        mean = total(F.transform(x, lambda v: v.cast("double"))) / F.size(x)
        return F.transform(x, lambda v: v.cast("double") - mean)

    l, r = centred(left), centred(right)  # noqa: E741
    scale = dot(l, l) * dot(r, r)
    return F.when(scale == 0, 1.0).otherwise(dot(l, r) / F.sqrt(scale))


def swapped(same: Column, cross: Column) -> Column:
    """Whether channels agree better crosswise."""
    return F.abs(cross) > 1.25 * F.abs(same)


def unanimous(used: Column, quiet: Column) -> Column:
    """Flags of bands after folding: all off without a loud band, all on if each loud band is, else as they are."""
    pairs = F.zip_with(used, quiet, lambda u, q: F.struct(u.alias("u"), q.alias("q")))
    loud = F.filter(pairs, lambda p: ~p["q"])
    same = lambda value: F.transform(used, lambda _: F.lit(value))
    return F.when(F.size(loud) == 0, same(False)).when(F.forall(loud, lambda p: p["u"]), same(True)).otherwise(used)


def downmixed(rows: DataFrame, stream: Sequence[str], plane: str, place: str, value: str) -> DataFrame:
    """The mean of a stream's planes at each place; of six planes the fourth (low frequencies) is left out."""
    sizes = rows.groupBy(*stream).agg((F.max(plane) + 1).alias("_n"))
    used = rows.join(sizes, list(stream)).where((F.col("_n") != 6) | (F.col(plane) != 3))
    return used.groupBy(*stream, place).agg(F.avg(F.col(value).cast("double")).alias("value"))


def reordered(planes: Column, order: Column) -> Column:
    """Planes by the places that an order names; silence where it names none that exists."""
    silence = F.transform(planes[0], lambda x: x * 0)
    return F.transform(order, lambda k: F.coalesce(F.get(planes, k), silence))


def coupled(target: Column, source: Column, gains: Column) -> Column:
    """A spectrum with another added, each bin by its own gain."""
    added = F.zip_with(source, gains, lambda x, g: x.cast("double") * g)
    return F.zip_with(target, added, lambda x, y: x.cast("double") + F.coalesce(y, F.lit(0.0)))


def smallest_fit(rows: DataFrame, group: Sequence[str], offset: str, bits: Column, limit: Column) -> DataFrame:
    """The smallest offset whose bits are within the limit: what a monotonic search ends at, null if none fits."""
    return rows.groupBy(*group).agg(F.min(F.when(bits <= limit, F.col(offset))).alias("offset"))


def plain_words(text: Column) -> Column:
    """Lower-case words with one blank between them, ё as е."""
    lowered = F.regexp_replace(F.lower(text), "ё", "е")
    return F.array_join(F.regexp_extract_all(lowered, F.lit(r"[\p{L}\p{N}_]+"), 0), " ")


def sample_size(sd: Column, margin: Column, z: float = Z_ALPHA + Z_BETA) -> Column:
    """Listeners that a non-inferiority test needs, two at least; null unless both are positive."""
    return F.when((sd > 0) & (margin > 0), F.greatest(F.lit(2).cast("long"), F.ceil(F.pow(F.lit(z) * sd / margin, 2)).cast("long")))


def _digest(seed: str, *parts: Column) -> Column:
    """Hex of the SHA-256 of the seed and the parts, with a zero byte before each."""
    return F.sha2(F.concat(F.lit(seed), *(F.concat(F.lit("\0"), p.cast("string")) for p in parts)), 256)


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def blind_name(seed: str, *parts: Column) -> Column:
    """Eight letters that a seed and parts always give."""
    digest = _digest(seed, F.lit("id"), *parts)
    return F.concat(*(F.substring(F.lit(LETTERS), (_number(F.substring(digest, 2 * k + 1, 2)) % len(LETTERS) + 1).cast("int"), F.lit(1)) for k in range(8)))


def seeded_order(items: Column, seed: str, *parts: Column) -> Column:
    """Items in the order of swaps from the end that a seed and parts always give; for lists of a session's size."""

    draws = F.transform(F.sequence(F.size(items) - 1, F.lit(1), F.lit(-1)), lambda i: F.struct(i.alias("i"), (_number(F.substring(_digest(seed, *parts, i), 1, 8)) % (i + 1)).cast("int").alias("j")))

    def swap(held: Column, d: Column) -> Column:
        i, j = d["i"], d["j"]  # drawn once for a swap, not once for each item it passes
        return F.transform(held, lambda x, k: F.when(k == i, F.get(held, j)).when(k == j, F.get(held, i)).otherwise(x))

    return F.when(F.size(items) < 2, items).otherwise(F.aggregate(draws, items, swap))
