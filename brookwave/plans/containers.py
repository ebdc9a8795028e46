"""Queries on media bytes: files are built from orders (streams) and lineitem (units), walked, and held against arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookwave.functions import scalars as S
from brookwave.operators import kernels as K
from brookwave.plans.shared import read, spread
from brookwave.sources import bitio, boxes_write, configs, loas, media, movies

QUERIES, SQL = {}, {}
PLACE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
CORES = (24000, 22050, 16000, 12000, 11025, 8000)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def in_arrow(of, schema: str):
    """Rows through a function of their values, batch by batch."""
    fields = [x.rsplit(" ", 1) for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [of(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [()] * len(fields), fields, strict=True)], names=[n for n, _ in fields])

    return run


def units(spark, d) -> DataFrame:
    """stream_id, au_idx, payload of 1 to 51 bytes, and what their headers say."""
    order = Window.partitionBy("l_orderkey").orderBy(*PLACE)
    rows = read(spark, d, "lineitem").withColumn("au_idx", F.row_number().over(order) - 1)
    return rows.select(
        F.col("l_orderkey").alias("stream_id"), "au_idx", F.unhex(F.repeat(F.lit("A5"), (1 + F.col("l_quantity")).cast("int"))).alias("payload"), (F.col("l_orderkey") % 12).alias("fs_index"), (1 + F.col("l_orderkey") % 7).alias("ch_cfg"),
    )


UNITS = f"SELECT l_orderkey AS stream, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(PLACE)}) - 1 AS au, 1 + CAST(l_quantity AS BIGINT) AS size FROM lineitem"


def adts_files(spark, d) -> DataFrame:
    rows = units(spark, d)
    header = S.adts_bytes(F.lit(1), F.col("fs_index"), F.col("ch_cfg"), F.length("payload") + 7, F.lit(0x7FF), F.lit(1))
    return boxes_write.framed_streams(rows, header, F.col("payload")).select(F.col("stream_id").cast("string").alias("path"), "content", "n")


def m4a_files(spark, d) -> DataFrame:
    return boxes_write.m4a_files(units(spark, d), 24000, 2, priming=1024).select(F.col("stream_id").alias("path"), "content", "error")


def _written(order, line, supplier, quantity):
    w = bitio.BitWriter().write(line, 3).write(supplier, 17).write(quantity - 25, 7)
    data = w.bytes()
    r = bitio.BitReader(data)
    first = r.peek(3)
    got = [r.read(3), r.read(17), r.signed(7)]
    left = r.left
    r.align()
    aligned = r.left
    back = bitio.BitReader(data)
    back.skip(3)
    return order, line, *got, first, back.read(17), len(data), left, aligned


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber % 8 AS BIGINT) AS a, l_suppkey AS b, CAST(l_quantity AS BIGINT) - 25 AS c, CAST(l_linenumber % 8 AS BIGINT) AS peeked, l_suppkey AS skipped_to, 4::BIGINT AS size, 5::BIGINT AS bits_left, 0::BIGINT AS bits_left_aligned FROM lineitem")
def bits_round_trip(spark, d):
    schema = "l_orderkey long, l_linenumber int, a long, b long, c long, peeked long, skipped_to long, size long, bits_left long, bits_left_aligned long"
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("int")).mapInArrow(in_arrow(_written, schema), schema)


def crc_sql(value: str, bits: int, polynomial: int, width: int, start: int) -> str:
    """A checksum bit by bit, as a fold over the bits of an integer."""
    mask, top = (1 << width) - 1, width - 1
    step = f"CASE WHEN ((s >> {top}) & 1) <> b THEN xor((s << 1) & {mask}, {polynomial}) ELSE (s << 1) & {mask} END"
    return f"list_reduce(list_concat([{start}::BIGINT], list_transform(range({bits}), lambda i: ({value} >> CAST({bits - 1} - i AS INTEGER)) & 1)), lambda s, b: {step})"


def _sums(key):
    v = key * 1_000_003
    data = v.to_bytes(8, "big")
    return key, bitio.crc16(data), bitio.crc(v, 64, 0x8005, 16, 0xFFFF), bitio.crc8_bits(v & 0xFFFFFFFF, 32), bitio.crc_of(data[4:], 0x07, 8, 0)


@query(f"""WITH x AS (SELECT c_custkey, c_custkey * 1000003 AS v FROM customer),
c AS (SELECT c_custkey, {crc_sql('v', 64, 0x8005, 16, 0xFFFF)} AS wide, {crc_sql('(v & 4294967295)', 32, 7, 8, 0)} AS narrow FROM x)
SELECT c_custkey, wide AS by_table, wide AS by_bits, narrow AS of_bits, narrow AS of_bytes FROM c""")
def checksums(spark, d):
    schema = "c_custkey long, by_table long, by_bits long, of_bits long, of_bytes long"
    return spread(read(spark, d, "customer").select("c_custkey")).mapInArrow(in_arrow(_sums, schema), schema)


@query(f"""WITH u AS ({UNITS})
SELECT stream, au AS au_idx, CAST(coalesce(sum(size + 7) OVER (PARTITION BY stream ORDER BY au ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off, size + 7 AS frame_len,
[96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000][stream % 12 + 1]::BIGINT AS sample_rate, 1 + stream % 7 AS ch_cfg, size AS payload_size FROM u""")
def frame_walk(spark, d):
    return media.adts_frames(adts_files(spark, d)).where("error is null").select(
        F.col("path").cast("long").alias("stream"), F.col("au_idx").cast("long"), "off", F.col("frame_len").cast("long"), F.col("sample_rate").cast("long"), F.col("ch_cfg").cast("long"), F.length("payload").cast("long").alias("payload_size"),
    )


@query(f"SELECT stream, CASE WHEN stream % 5 = 0 THEN NULL ELSE count(*) END AS frames FROM ({UNITS}) GROUP BY stream")
def tiled_frames(spark, d):
    """Every fifth stream lacks its last byte, so its frames don't tile it."""
    files = adts_files(spark, d)
    cut = F.when(F.col("path").cast("long") % 5 == 0, F.substring("content", F.lit(1), (F.length("content") - 1).cast("int"))).otherwise(F.col("content"))
    return media.exact_frames(files.withColumn("content", cut)).select(F.col("path").cast("long").alias("stream"), "frames")


@query(f"""SELECT l_orderkey, l_linenumber, 2::BIGINT AS object_type, CAST(core AS BIGINT) AS rate, ch AS channels, kind > 0 AS sbr, kind = 2 AS ps, CAST(CASE WHEN kind > 0 THEN 2 * core ELSE core END AS BIGINT) AS output_rate
FROM (SELECT *, {list(CORES)}[l_linenumber % 6 + 1] AS core, [1, 2, 6, 8][l_suppkey % 4 + 1]::BIGINT AS ch, l_partkey % 3 AS kind FROM lineitem)""")
def config_round_trip(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 4).alias("c"), (F.col("l_partkey") % 3).alias("kind"))

    def make(order, line, c, kind):
        return order, line, configs.built(2, CORES[line % 6], (1, 2, 6, 8)[c], kind == 1, kind == 2)

    made = rows.mapInArrow(in_arrow(make, "l_orderkey long, l_linenumber int, data binary"), "l_orderkey long, l_linenumber int, data binary").withColumn("c", configs.configuration(F.col("data")))
    return made.where("c.error is null").select("l_orderkey", "l_linenumber", *(F.col(f"c.{x}").cast("long").alias(x) for x in ("object_type", "rate", "channels")), "c.sbr", "c.ps", F.col("c.output_rate").cast("long").alias("output_rate"))


@query(f"""WITH u AS ({UNITS})
SELECT stream, au // 3 AS packet, au % 3 AS sub_frame, size AS payload_size, 2::BIGINT AS config_size FROM u""")
def packet_walk(spark, d):
    config = configs.built(2, 48000, 2)
    files = boxes_write.files_of(units(spark, d), lambda parts: b"".join(loas.packet(config, 16, parts[k : k + 3]) for k in range(0, len(parts), 3)))
    return loas.loas_units(files).where("error is null").select(F.col("path").cast("long").alias("stream"), F.col("packet").cast("long"), F.col("sub_frame").cast("long"), F.length("payload").cast("long").alias("payload_size"), F.length("config").cast("long").alias("config_size"))


@query(f"""WITH u AS ({UNITS})
SELECT stream, au AS au_idx, CAST(36 + coalesce(sum(size) OVER (PARTITION BY stream ORDER BY au ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", size FROM u""")
def file_units(spark, d):
    """Units of written files by their sample tables."""
    found = movies.first_usable(movies.tracks(m4a_files(spark, d)))
    return movies.units(found).select(F.col("path").cast("long").alias("stream"), F.col("au_idx").cast("long"), F.col("offset").cast("long"), F.col("size").cast("long"))


@query(f"SELECT stream, 1024 * count(*) AS coded, 1024::BIGINT AS priming, 1024 * (count(*) - 1) AS valid FROM ({UNITS}) GROUP BY stream")
def file_timing(spark, d):
    found = movies.first_usable(movies.tracks(m4a_files(spark, d)))
    return movies.presented(found).select(F.col("path").cast("long").alias("stream"), F.col("coded").cast("long"), F.col("priming").cast("long"), F.col("valid").cast("long"))


@query(f"""WITH t AS (SELECT stream, sum(size) AS total FROM ({UNITS}) GROUP BY stream)
SELECT stream, 'ftyp' AS type, 0::BIGINT AS pos, 28::BIGINT AS content_end FROM t
UNION ALL SELECT stream, 'mdat', 28, CAST(36 + total AS BIGINT) FROM t""")
def box_walk(spark, d):
    found = media.boxes(m4a_files(spark, d), deepest=0).where("error is null and depth = 0 and type <> 'moov'")
    return found.select(F.col("path").cast("long").alias("stream"), "type", "pos", (F.col("pos") + F.col("size")).alias("content_end"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'adts' WHEN 1 THEN 'latm' WHEN 2 THEN 'isobmff' END AS kind, o_orderkey % 4 IN (0, 1) AS framed FROM orders")
def sniffed(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey")
    config = configs.built(2, 48000, 2)

    def make(order):
        payload = bytes([order % 251]) * 9
        adts = (0xFFF1 << 40 | 1 << 38 | 3 << 34 | 2 << 30 | 16 << 13 | 0x7FF << 2).to_bytes(7, "big") + payload
        return order, (adts, loas.packet(config, 16, [payload]), boxes_write.m4a([payload], config), payload)[order % 4]

    made = rows.mapInArrow(in_arrow(make, "o_orderkey long, content binary"), "o_orderkey long, content binary")
    return made.select("o_orderkey", media.container(F.col("content")).alias("kind"), (media.is_adts(F.col("content")) | media.is_latm(F.col("content"))).alias("framed"))


FLAT = "SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings"


def _exploded(df, column: str, digits: int):
    return df.select("vec_id", F.posexplode(column).alias("k", "y")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("y", digits).alias("y"))


@query(f"SELECT vec_id, k.k AS k, round(2.0 * sum(CAST(x AS DOUBLE) * cos(2 * pi() / 64 * (i + 16.5) * (k.k + 0.5))), 5) AS y FROM ({FLAT}), range(32) k(k) GROUP BY vec_id, k.k")
def mdct_by_fft(spark, d):
    return _exploded(read(spark, d, "embeddings").select("vec_id", K.fast_mdct(F.col("embedding").cast("array<double>")).alias("y")), "y", 5)


@query(f"SELECT vec_id, i.i AS k, round(2.0 / 128 * sum(CAST(x AS DOUBLE) * cos(2 * pi() / 128 * (i.i + 32.5) * (f.i + 0.5))), 6) AS y FROM ({FLAT}) f, range(128) i(i) GROUP BY vec_id, i.i")
def imdct_by_fft(spark, d):
    return _exploded(read(spark, d, "embeddings").select("vec_id", K.fast_imdct(F.col("embedding").cast("array<double>")).alias("y")), "y", 6)


LAGS = f"SELECT a.vec_id, k.k AS k, sum(CAST(a.x AS DOUBLE) * b.x) AS r FROM ({FLAT}) a JOIN range(3) k(k) ON true JOIN ({FLAT}) b ON a.vec_id = b.vec_id AND b.i = a.i + k.k GROUP BY a.vec_id, k.k"


@query(f"SELECT vec_id, k, round(r, 6) AS y FROM ({LAGS})")
def autocorrelations(spark, d):
    return _exploded(read(spark, d, "embeddings").select("vec_id", K.lags(2)(F.col("embedding").cast("array<double>")).alias("y")), "y", 6)


FIRST = f"WITH l AS ({LAGS}), r AS (SELECT vec_id, max(r) FILTER (k = 0) AS r0, max(r) FILTER (k = 1) AS r1, max(r) FILTER (k = 2) AS r2 FROM l GROUP BY vec_id), k AS (SELECT *, -r1 / r0 AS k1 FROM r)"


@query(f"""{FIRST} SELECT vec_id, 0::BIGINT AS k, round(k1, 6) AS y FROM k UNION ALL SELECT vec_id, 1, round(-(r2 + k1 * r1) / (r0 * (1 - k1 * k1)), 6) FROM k""")
def prediction_reflections(spark, d):
    return _exploded(read(spark, d, "embeddings").select("vec_id", K.reflections(2)(F.col("embedding").cast("array<double>")).alias("y")), "y", 6)


@query(f"""{FIRST} SELECT f.vec_id, i AS k, round(CAST(x AS DOUBLE) + k1 * coalesce(CAST(lag(x) OVER (PARTITION BY f.vec_id ORDER BY i) AS DOUBLE), 0.0), 6) AS y FROM ({FLAT}) f JOIN k ON f.vec_id = k.vec_id""")
def prediction_residual(spark, d):
    return _exploded(read(spark, d, "embeddings").select("vec_id", K.residual(1)(F.col("embedding").cast("array<double>")).alias("y")), "y", 6)


def _inverse(x):
    import numpy as np

    a = K.step_up(K.levinson(K.autocorrelation(x, 2))[0])
    return K.all_pole(K.all_zero(np.array(x), a), a)


@query("SELECT vec_id, i AS k, round(CAST(x AS DOUBLE), 5) AS y FROM (" + FLAT + ")")
def prediction_inverse(spark, d):
    """The residual through the inverse filter is the row again."""
    return _exploded(read(spark, d, "embeddings").select("vec_id", K.by_rows(_inverse)(F.col("embedding").cast("array<double>")).alias("y")), "y", 5)
