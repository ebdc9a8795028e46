"""Queries on raw data blocks: blocks are written from embeddings, read back, and held against arithmetic.

Codebooks are by rule (sources/blocks.py, ``ruled``), so that what codewords cost is arithmetic, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookwave.operators import decoding as D
from brookwave.plans.shared import read
from brookwave.sources import blocks as B

QUERIES, SQL = {}, {}
CODING = B.ruled()
BANDS = 13  # of the 64 bins of an embedding
BORDERS = B.LONG_44[: BANDS + 1]
# what a band of a vector has for its scale, and how the vector is made integers; in SQL and in Python
FLAT = "SELECT vec_id, label, i, CAST(floor(CAST(x AS DOUBLE) * 40) AS BIGINT) AS q FROM (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings)"
BAND_SQL = "(VALUES " + ", ".join(f"({b}, {lo}, {hi})" for b, (lo, hi) in enumerate(zip(BORDERS, BORDERS[1:], strict=False))) + ") AS b(band, lo, hi)"
SCALED = "sign(q) * pow(abs(q), 4.0 / 3) * pow(2, ({scale} - 100) / 4.0)"
SCALE = "(100 + (vec_id + 3 * band) % 17)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def scales_of(vec: int) -> list[int]:
    return [100 + (vec + 3 * b) % 17 for b in range(BANDS)]


def long_channel(vec: int, values: list[int], books: list[int], scales: list[int]) -> B.Channel:
    quant = np.zeros((1, CODING.frame), int)
    quant[0, : len(values)] = values
    return B.Channel(B.Mode(B.ONLY_LONG, vec % 2, BANDS), 100 + vec % 17, [books], [scales], quant=quant)


def block_of(vec: int, values: list[int]) -> bytes:
    return B.write_block([B.Element(B.SINGLE, 0, [long_channel(vec, values, [11] * BANDS, scales_of(vec))])], CODING)


def pair_of(vec: int, values: list[int]) -> bytes:
    """The vector left and reversed right; bands in turn plain, in the mask, in phase, out of phase, in phase and in the mask."""
    kinds = [(vec + b) % 5 for b in range(BANDS)]
    right = long_channel(vec, values[::-1], [B.IN_PHASE if k in (2, 4) else B.OUT_OF_PHASE if k == 3 else 11 for k in kinds], [b if k >= 2 else s for b, (k, s) in enumerate(zip(kinds, scales_of(vec), strict=True))])
    for b, k in enumerate(kinds):
        if k >= 2:
            right.quant[0, BORDERS[b] : BORDERS[b + 1]] = 0
    left = long_channel(vec, values, [11] * BANDS, scales_of(vec))
    return B.write_block([B.Element(B.PAIR, 0, [left, right], [[k in (1, 4) for k in kinds]], True)], CODING)


def windows_of(vec: int) -> B.Mode:
    """Short windows in groups by the bits of the vector's id."""
    groups = [1]
    for k in range(7):
        if vec >> k & 1:
            groups[-1] += 1
        else:
            groups.append(1)
    return B.Mode(B.SHORT, vec % 2, 1 + vec % 2, tuple(groups))


def short_of(vec: int, values: list[int]) -> bytes:
    """Eight windows of eight bins, or of four when there is one band."""
    mode = windows_of(vec)
    quant = np.zeros((8, 128), int)
    quant[:, :8] = np.reshape(values, (8, 8))
    quant[:, 4 * mode.bands :] = 0
    scales = [[100 + g + b for b in range(mode.bands)] for g in range(len(mode.groups))]
    return B.write_block([B.Element(B.LOW, 0, [B.Channel(mode, 100, [[11] * mode.bands for _ in mode.groups], scales, quant=quant)])], CODING)


def written(spark, d, of) -> DataFrame:
    """(vec_id, label, payload): a block of each embedding."""
    kinds = (pa.int64(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, vectors = (c.to_pylist() for c in b.columns)
            made = [of(i, np.floor(np.array(v, float) * 40).astype(int).tolist()) for i, v in zip(ids, vectors, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, labels, made), kinds, strict=True)], names=["vec_id", "label", "payload"])

    return read(spark, d, "embeddings").select("vec_id", "label", "embedding").mapInArrow(run, "vec_id long, label int, payload binary")


def unpacked(blocks: DataFrame) -> DataFrame:
    """(vec_id, channel, w, i, x): the bins that a block's bands cover, of every window."""
    names = ("vec_id", "channel", "w", "i", "x")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for vec, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                elements = B.read_block(payload, CODING)
                found, _ = B.spectra(elements, CODING)
                rows = []
                for k, (x, c) in enumerate(zip(found, (c for e in elements for c in e.channels), strict=True)):
                    borders = CODING.short if c.mode.sequence == B.SHORT else CODING.long
                    rows += [(vec, k, w, i, float(x[w, i])) for w in range(len(x)) for i in range(borders[c.mode.bands])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    return blocks.select("vec_id", "payload").mapInArrow(run, "vec_id long, channel long, w long, i long, x double")


@query(f"""SELECT vec_id, CAST(i AS BIGINT) AS i, round({SCALED.format(scale=SCALE)}, 6) AS x FROM ({FLAT}) JOIN {BAND_SQL} ON i >= lo AND i < hi""")
def block_spectra(spark, d):
    """Escapes, sections, scales and the power law, from the bits of a block."""
    return unpacked(written(spark, d, block_of)).select("vec_id", "i", F.round("x", 6).alias("x"))


@query(f"""WITH v AS (SELECT vec_id, band, i, (vec_id + band) % 5 AS kind, q, reversed FROM (SELECT f.vec_id, f.i, f.q, r.q AS reversed FROM ({FLAT}) f JOIN ({FLAT}) r ON f.vec_id = r.vec_id AND r.i = 63 - f.i) JOIN {BAND_SQL} ON i >= lo AND i < hi),
x AS (SELECT *, {SCALED.format(scale=SCALE)} AS l, {SCALED.format(scale=SCALE).replace("q", "reversed")} AS r FROM v)
SELECT vec_id, CAST(unnest([0, 1]) AS BIGINT) AS channel, CAST(i AS BIGINT) AS i, unnest([round(CASE WHEN kind = 1 THEN l + r ELSE l END, 6), round(CASE kind WHEN 0 THEN r WHEN 1 THEN l - r WHEN 2 THEN l * pow(0.5, band / 4.0) ELSE -l * pow(0.5, band / 4.0) END, 6)]) AS x FROM x""")
def pair_spectra(spark, d):
    """Sums and differences and the place of intensity, band by band."""
    return unpacked(written(spark, d, pair_of)).select("vec_id", "channel", "i", F.round("x", 6).alias("x"))


@query(f"""WITH v AS (SELECT vec_id, i // 8 AS w, i % 8 AS i, q, 1 + vec_id % 2 AS bands FROM ({FLAT})),
g AS (SELECT *, CAST(list_sum([0] || [1 - ((vec_id >> (k - 1)) & 1) FOR k IN range(1, w + 1)]) AS BIGINT) AS grp FROM v WHERE i < 4 * bands)
SELECT vec_id, CAST(w AS BIGINT) AS w, CAST(i AS BIGINT) AS i, round({SCALED.format(scale="(100 + grp + i // 4)")}, 6) AS x FROM g""")
def short_spectra(spark, d):
    """Short windows in groups: one scale for a group's band, values in the group's order."""
    return unpacked(written(spark, d, short_of)).select("vec_id", "w", "i", F.round("x", 6).alias("x"))


def _costs(values: list[int]) -> list[int | None]:
    return B.band_bits(CODING, values)


LOG = "(2 * CAST(floor(log2({0}) + 1e-9) AS BIGINT) + 1)"


def _cost_sql() -> str:
    """What a band of four bins costs under each book, by the rule of the codes."""
    parts = []
    for book, (d, signed, most) in B.BOOKS.items():
        base = 2 * most + 1 if signed else most + 1
        cost = []
        for k in range(0, 4, d):
            digits = [f"(v[{k + j + 1}] + {most})" if signed else f"least(abs(v[{k + j + 1}]), {16 if book == 11 else 1 << 20})" for j in range(d)]
            cost.append(LOG.format("1 + " + " + ".join(f"{base ** (d - 1 - j)} * {x}" for j, x in enumerate(digits))))
        total = " + ".join(cost)
        if not signed:
            total += " + list_sum([CASE WHEN x = 0 THEN 0 ELSE 1 END FOR x IN v])"
        if book == 11:
            total += " + list_sum([CASE WHEN abs(x) > 15 THEN 2 * (CAST(floor(log2(abs(x)) + 1e-9) AS BIGINT) - 4) + 5 ELSE 0 END FOR x IN v])"
        fits = "TRUE" if book == 11 else f"list_max([abs(x) FOR x IN v]) <= {most}"
        parts.append(f"SELECT vec_id, band, {book} AS book, CASE WHEN {fits} THEN {total} END AS bits FROM v")
    return f"WITH v AS (SELECT vec_id, i // 4 AS band, list(q ORDER BY i) AS v FROM ({FLAT}) GROUP BY ALL) SELECT vec_id, CAST(band AS BIGINT) AS band, CAST(book AS BIGINT) AS book, CAST(bits AS BIGINT) AS bits FROM (" + " UNION ALL ".join(parts) + ")"


@query(_cost_sql())
def book_costs(spark, d):
    """Bits of every four bins of every vector under each of the books that has them."""

    @F.arrow_udf("array<array<long>>")
    def costs(vectors: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in vectors:
            yield pa.array([[_costs(v[k : k + 4]) for k in range(0, len(v), 4)] for v in c.to_pylist()], pa.list_(pa.list_(pa.int64())))

    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 40))
    bands = read(spark, d, "embeddings").select("vec_id", F.posexplode(costs(whole)).alias("band", "b"))
    return bands.select("vec_id", F.col("band").cast("long").alias("band"), F.posexplode("b").alias("k", "bits")).select("vec_id", "band", (F.col("k") + 1).cast("long").alias("book"), "bits")


@query()
def decoded_planes(spark, d):
    """Each label is a stream of its vectors' blocks; what a decoded block holds. Held against a walk in the tests."""
    rows = written(spark, d, block_of)
    units = rows.select(F.col("label").alias("stream_id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("au_idx"), "payload")
    x = F.col("planes")[0]
    return D.decoded(units, CODING).select(
        "stream_id", "au_idx", F.size(x).cast("long").alias("samples"), F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v), 3).alias("energy"), F.round(F.array_max(F.transform(x, F.abs)), 6).alias("peak"), "error",
    )
