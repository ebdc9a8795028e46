"""Queries on fragmented files and probes: bytes are built from lineitem and orders, read back, and held against arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookwave.functions import tags as T
from brookwave.plans.containers import UNITS, adts_files, in_arrow, m4a_files, units
from brookwave.plans.shared import read, spread
from brookwave.sources import boxes_write, configs, fragments, loas, probes

QUERIES, SQL = {}, {}
CONFIG = configs.built(2, 24000, 2)
INIT = fragments.init_bytes(CONFIG, 1024)
#: Bytes of a fragment and its media's header, but for its sizes, media and optional fields.
HEAD = len(fragments.fragment_bytes([b""], 1, 0, 0, None, False)) - 4


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def fragmented(parts: list[bytes], per: int = 3) -> bytes:
    """Fragments of a few units: even ones name their duration, 512, odd ones their base and leave the duration to the index."""
    out, at, time = [INIT], len(INIT), 0
    for n in range(0, len(parts), per):
        some, even = parts[n : n + per], n // per % 2 == 0
        out.append(fragments.fragment_bytes(some, n // per + 1, at, time, 512 if even else None, not even))
        at += len(out[-1])
        time += len(some) * (512 if even else 1024)
    return b"".join(out)


def fragmented_files(spark, d):
    return boxes_write.files_of(units(spark, d), fragmented)


@query(f"""WITH u AS ({UNITS}), x AS (SELECT *, au // 3 AS f, count(*) OVER (PARTITION BY stream) AS n, coalesce(sum(size) OVER w, 0) AS ahead, coalesce(sum(CASE WHEN au // 3 % 2 = 0 THEN 512 ELSE 1024 END) OVER w, 0) AS dts
FROM u WINDOW w AS (PARTITION BY stream ORDER BY au ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT stream, CAST(f AS BIGINT) AS fragment, CAST(au - 3 * f AS BIGINT) AS sample, CAST({len(INIT)} + (f + 1) * {HEAD} + 4 * ((f + 2) // 2) + 8 * ((f + 1) // 2) + 4 * least(n, 3 * (f + 1)) + ahead AS BIGINT) AS off,
size, CAST(dts AS BIGINT) AS dts, CAST(CASE WHEN f % 2 = 0 THEN 512 ELSE 1024 END AS BIGINT) AS dur FROM x""")
def fragment_walk(spark, d):
    found = fragments.fragment_samples(fragmented_files(spark, d)).where("error is null")
    return found.select(F.col("path").cast("long").alias("stream"), *(F.col(c).cast("long").alias(c) for c in ("fragment", "sample", "off", "size", "dts", "dur")))


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AS fragmented, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 2 END::BIGINT AS channels FROM orders""")
def fragmented_kinds(spark, d):
    """A third of the files is fragmented, a third flat, a third no file of boxes."""

    def make(order):
        part = bytes([order % 251]) * 9
        data = (fragmented([part]), boxes_write.m4a([part], CONFIG), part)[order % 3]
        facts = configs.parsed(fragments.init_of(data)["config"] if order % 3 == 0 else CONFIG) if order % 3 < 2 else {"channels": None}
        return order, fragments.is_fragmented(data), facts["channels"]

    return read(spark, d, "orders").select("o_orderkey").mapInArrow(in_arrow(make, "o_orderkey long, fragmented boolean, channels long"), "o_orderkey long, fragmented boolean, channels long")


FACTS = ("container", "profile", "rate", "output_rate", "channels", "duration", "samples", "trim", "priming", "remainder", "error")


def _probed(files):
    numbers = {"rate", "output_rate", "channels"}
    return probes.probes(files).select(F.col("path").cast("long").alias("stream"), *(F.col(c).cast("long").alias(c) if c in numbers else F.col(c) for c in FACTS))


@query(f"""WITH t AS (SELECT stream, count(*) AS n FROM ({UNITS}) GROUP BY stream)
SELECT stream, 'adts' AS container, 'lc' AS profile, [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000][stream % 12 + 1]::BIGINT AS rate, rate AS output_rate, [1, 2, 3, 4, 5, 6, 8][stream % 7 + 1]::BIGINT AS channels,
CASE WHEN good THEN 'exact' ELSE 'unknown' END AS duration, CASE WHEN good THEN 1024 * n - 600 END AS samples, CASE WHEN good THEN 'exact' ELSE 'unknown' END AS trim, CASE WHEN good THEN 500::BIGINT END AS priming, CASE WHEN good THEN 100::BIGINT END AS remainder, NULL::VARCHAR AS error
FROM (SELECT *, stream % 3 = 0 AS good FROM t)""")
def probe_framed(spark, d):
    """A third has a tag that fits its frames, a third one that doesn't, a third none."""
    files, k = adts_files(spark, d), F.col("path").cast("long") % 3
    tag = T.tag_bytes(F.lit(500), F.lit(100), F.col("n") * 1024 - 600 + F.when(k == 1, 1).otherwise(0))
    return _probed(files.withColumn("content", F.when(k == 2, F.col("content")).otherwise(F.concat(tag, "content"))))


@query(f"""SELECT stream, 'm4a' AS container, 'lc' AS profile, 24000::BIGINT AS rate, 24000::BIGINT AS output_rate, 2::BIGINT AS channels, 'exact' AS duration, 1024 * (count(*) - 1) AS samples, 'exact' AS trim, 1024::BIGINT AS priming, 0::BIGINT AS remainder, NULL::VARCHAR AS error
FROM ({UNITS}) GROUP BY stream""")
def probe_files(spark, d):
    return _probed(m4a_files(spark, d))


@query(f"""SELECT DISTINCT stream, 'm4a' AS container, 'lc' AS profile, 24000::BIGINT AS rate, 24000::BIGINT AS output_rate, 2::BIGINT AS channels, 'unknown' AS duration, NULL::BIGINT AS samples, 'exact' AS trim, 0::BIGINT AS priming, 0::BIGINT AS remainder, NULL::VARCHAR AS error FROM ({UNITS})""")
def probe_fragmented(spark, d):
    return _probed(fragmented_files(spark, d))


@query("""SELECT o_orderkey AS stream, CASE k WHEN 0 THEN 'latm' WHEN 1 THEN 'latm' END AS container, CASE k WHEN 0 THEN 'lc' WHEN 1 THEN 'he-aac' END AS profile, CASE WHEN k < 2 THEN 24000::BIGINT END AS rate,
CASE k WHEN 0 THEN 24000::BIGINT WHEN 1 THEN 48000 END AS output_rate, CASE WHEN k < 2 THEN 1::BIGINT END AS channels, CASE WHEN k < 2 THEN 'unknown' END AS duration, NULL::BIGINT AS samples, CASE WHEN k < 2 THEN 'unknown' END AS trim, NULL::BIGINT AS priming, NULL::BIGINT AS remainder,
CASE k WHEN 2 THEN 'need more' WHEN 3 THEN 'not audio' WHEN 4 THEN 'object type' END AS error FROM (SELECT *, o_orderkey % 5 AS k FROM orders)""")
def probe_packets(spark, d):
    """Packets of both profiles, packets cut short, other bytes, and frames of another object type."""
    plain, doubled = configs.built(2, 24000, 1), configs.built(2, 24000, 1, True)

    def make(order):
        packet = loas.packet(*((doubled, 25) if order % 5 == 1 else (plain, 16)), [bytes([order % 251]) * 9])
        other = (0xFFF1 << 40 | 3 << 34 | 2 << 30 | 16 << 13 | 0x7FF << 2).to_bytes(7, "big") + bytes(9)
        return str(order), (packet, packet, packet[:-1], b"no audio at all", other)[order % 5]

    made = spread(read(spark, d, "orders").select("o_orderkey")).mapInArrow(in_arrow(make, "path string, content binary"), "path string, content binary")
    return _probed(made)
