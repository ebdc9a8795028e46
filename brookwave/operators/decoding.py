"""Units of streams to planes, in pieces.

A block depends on what came before by its overlap with the one block before it, and by the state of the noise
generator. The state after n numbers is known without drawing them, so a stream needs no single task: blocks say how
many numbers they take, those are summed by pieces, and each piece of consecutive units decodes by itself from
its state, beginning with the last unit of the piece before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookwave.sources import blocks as B

SCHEMA = "stream_id string, au_idx long, planes array<array<double>>, error string"


def noise_numbers(coding: B.Coding) -> Callable[[Column], Column]:
    """How many noise numbers a block takes; none if it can't be read."""

    @F.arrow_udf("long")
    def run(payloads: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in payloads:
            yield pa.array([_drawn(p, coding) for p in c.to_pylist()], pa.int64())

    return run


def _drawn(payload: bytes | None, coding: B.Coding) -> int:
    try:
        return B.draws_of(B.read_block(payload, coding), coding) if payload else 0
    except ValueError:
        return 0


def decoded(units: DataFrame, coding: B.Coding, per: int = 256) -> DataFrame:
    """Units (stream_id, au_idx, payload) to rows (stream_id string, au_idx, planes, error).

    Planes are in the order of a block's channels, samples at the scale of 16-bit integers. A unit that can't be read, or without payload,
    has an error and no planes; the unit after it, or after a gap in au_idx, begins with silence and a sine window, as
    the first one does. Null streams are one stream; a unit without au_idx has an error. Repeated (stream_id, au_idx) are each decoded, the later of them with
    silence before it. Other columns of the input are not read. ``per`` units make a piece.
    """
    rows = units.select(F.col("stream_id").cast("string"), F.col("au_idx").cast("long"), F.col("payload").cast("binary"))
    placed = rows.where("au_idx is not null")
    home = F.floor(F.col("au_idx") / per)
    counted = placed.select("stream_id", home.alias("piece"), noise_numbers(coding)(F.col("payload")).alias("n")).groupBy("stream_id", "piece").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("stream_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    marks = counted.select("stream_id", "piece", F.lit(None).cast("long").alias("au_idx"), F.lit(None).cast("binary").alias("payload"), F.coalesce(before, F.lit(0)).alias("drawn"))
    pieces = placed.select("stream_id", F.explode(F.array_distinct(F.array(home, F.floor((F.col("au_idx") + 1) / per)))).alias("piece"), "au_idx", "payload", F.lit(None).cast("long").alias("drawn"))
    # the marks travel with the units, so that units are shuffled once and nothing is joined
    ordered = pieces.unionByName(marks).repartition("stream_id", "piece").sortWithinPartitions("stream_id", "piece", F.col("au_idx").asc_nulls_first(), "payload")
    lost = rows.where("au_idx is null").select("stream_id", "au_idx", F.lit(None).cast("array<array<double>>").alias("planes"), F.lit("no place in the stream").alias("error"))
    return ordered.mapInArrow(_walk(coding, per), SCHEMA).unionByName(lost)


def _walk(coding: B.Coding, per: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, drawn, begun, held = None, None, None, False, B.Held()
        out: list[tuple] = []
        for batch in batches:
            for r in batch.to_pylist():
                idx, payload = r["au_idx"], r["payload"]
                if at != (r["stream_id"], r["piece"]):
                    at, last, drawn, begun = (r["stream_id"], r["piece"]), None, None, False
                if idx is None:
                    drawn = r["drawn"]
                    continue
                if drawn is None:  # the piece after a stream's last has no units and no mark
                    continue
                ours = idx // per == r["piece"]
                if not ours:  # the unit before the piece takes its numbers again
                    held = B.Held(noise=B.jumped(B.NOISE_SEED, drawn - _drawn(payload, coding)))
                else:
                    same = last is not None and idx == last + 1
                    noise = held.noise if begun else B.jumped(B.NOISE_SEED, drawn)
                    held, begun = B.Held(held.halves if same else (), held.shapes if same else (), noise), True
                planes, error = None, None
                try:
                    if not payload:
                        raise B.Refused("no payload")
                    planes, held = B.block_planes(payload, coding, held)
                except ValueError as e:
                    error, held = str(e), B.Held(noise=held.noise)
                last = idx
                if ours:
                    out.append((r["stream_id"], idx, None if planes is None else [p.tolist() for p in planes], error))
                if len(out) >= 64:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.list_(pa.list_(pa.float64())), pa.string())
    names = ("stream_id", "au_idx", "planes", "error")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))
