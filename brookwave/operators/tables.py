"""Sample tables and fragments: byte offsets and sizes of access units from compact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_table(runs: DataFrame, chunks: DataFrame, sizes: DataFrame, track: str = "track") -> DataFrame:
    """(track, sample, off, size) of every sample.

    runs: track, first_chunk, per_chunk. chunks: track, chunk (from 1), chunk_off. sizes: track,
    sample (from 0), size. The run of a chunk is the last that begins at or before it (a merge of both by one window);
    chunks are spelt out to their samples, so that sizes join by equality and nothing is a range join.
    """
    marks = runs.select(track, F.col("first_chunk").alias("chunk"), F.lit(None).cast("long").alias("chunk_off"), F.col("per_chunk").cast("long").alias("per"), F.lit(0).alias("kind"))
    both = marks.unionByName(chunks.select(track, "chunk", F.col("chunk_off").cast("long"), F.lit(None).cast("long").alias("per"), F.lit(1).alias("kind")))
    w = Window.partitionBy(track).orderBy("chunk", "kind").rowsBetween(Window.unboundedPreceding, 0)
    of = both.withColumn("per", F.last("per", ignorenulls=True).over(w)).where("kind = 1")
    first = F.coalesce(F.sum("per").over(Window.partitionBy(track).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spelt = of.withColumn("first", first).where("per > 0").select(track, "chunk", "chunk_off", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("per") - 1)).alias("sample"))
    inside = Window.partitionBy(track, "chunk").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    joined = spelt.join(sizes.select(track, F.col("sample").cast("long"), F.col("size").cast("long")), [track, "sample"])
    return joined.select(track, "sample", "chunk", (F.col("chunk_off") + F.coalesce(F.sum("size").over(inside), F.lit(0))).cast("long").alias("off"), "size")


def resolved_fragments(runs: DataFrame, fragments: DataFrame, defaults: DataFrame) -> DataFrame:
    """Samples of fragments: own size and duration, else the fragment's, else the track's.

    runs: track, seq, sample, size, dur. fragments: track, seq, base, moof_pos, def_size, def_dur.
    defaults: track, size0, dur0. Offsets run within a fragment from its base, else from the moof's position.
    """
    rows = runs.join(fragments, ["track", "seq"]).join(defaults, "track", "left")
    rows = rows.withColumn("n", F.coalesce("size", "def_size", "size0").cast("long")).withColumn("d", F.coalesce("dur", "def_dur", "dur0").cast("long"))
    inside = Window.partitionBy("track", "seq").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce("base", "moof_pos").cast("long")
    return rows.select("track", "seq", "sample", (start + F.coalesce(F.sum("n").over(inside), F.lit(0))).cast("long").alias("off"), F.col("n").alias("size"), F.coalesce(F.sum("d").over(inside), F.lit(0)).cast("long").alias("dts"), F.col("d").alias("dur"))


def seek_plan(samples: DataFrame, per_unit: int, start: int, end: int) -> DataFrame:
    """Units that a decode of [start, end) must read: all from the first, as state runs on."""
    return samples.where(F.col("sample") < -(-end // per_unit)).withColumn("shown", (F.col("sample") + 1) * per_unit > start)
