"""Queries on budgets, comparisons and studies: orders stand for jobs, events for runs, embeddings for planes."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookwave.functions import limits as L
from brookwave.operators import evaluation as E
from brookwave.operators import resampling
from brookwave.operators import studies as T
from brookwave.plans.shared import read, spread
from brookwave.plans.signals import PAIR_FLAT, PAIRS, _pairs

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 10 AS channels, CASE WHEN o_orderkey % 5 = 0 THEN 4000000000000000000 + CAST(o_custkey AS HUGEINT) ELSE o_custkey * 40000 END AS samples FROM orders)
SELECT o_orderkey, CASE WHEN channels > 8 THEN 'channels' WHEN channels * samples * 4 > 1073741824 THEN 'output' ELSE 'ok' END AS verdict FROM o""")
def output_budget(spark, d):
    samples = F.when(F.col("o_orderkey") % 5 == 0, F.lit(4 * 10**18) + F.col("o_custkey")).otherwise(F.col("o_custkey") * 40_000)
    return read(spark, d, "orders").select("o_orderkey", L.output_verdict(F.col("o_orderkey") % 10, samples, 8, 1 << 30).alias("verdict"))


@query("""SELECT l_orderkey, n, CASE WHEN n > 5 THEN 'entries' WHEN n * each > 40 THEN 'bytes' ELSE 'ok' END AS verdict FROM (SELECT l_orderkey, count(*) AS n, CAST(max(l_quantity) AS BIGINT) AS each FROM lineitem GROUP BY l_orderkey)""")
def index_budget(spark, d):
    g = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_quantity").cast("long").alias("each"))
    return g.select("l_orderkey", "n", L.index_verdict(F.col("n"), F.col("each"), 5, 40).alias("verdict"))


@query("""SELECT o_orderkey, CASE WHEN seconds <= 0 THEN 0 ELSE CAST(floor(seconds * least(rate, 48000)) AS BIGINT) END AS frames
FROM (SELECT o_orderkey, o_orderkey % 90 / 8.0 - 1 AS seconds, CASE WHEN o_custkey % 2 = 0 THEN 44100 ELSE 96000 END AS rate FROM orders)""")
def duration_frames(spark, d):
    rate = F.when(F.col("o_custkey") % 2 == 0, 44_100).otherwise(96_000)
    return read(spark, d, "orders").select("o_orderkey", L.max_frames(F.col("o_orderkey") % 90 / 8.0 - 1, rate, 48_000).alias("frames"))


@query("""SELECT p_partkey, CAST(6144 * channels * rate // 1024 AS BIGINT) AS most, CAST(least(saved // channels // 32, 2046) AS BIGINT) AS fullness, CASE WHEN rate IN (16000, 22050, 24000, 32000, 44100, 48000) THEN CAST(rate // 2 AS BIGINT) END AS core
FROM (SELECT p_partkey, 1 + p_partkey % 8 AS channels, p_partkey * 97 AS saved, [8000, 11025, 16000, 22050, 24000, 32000, 44100, 48000, 96000][1 + p_size % 9] AS rate FROM part)""")
def encoder_rates(spark, d):
    rates = F.array(*map(F.lit, (8000, 11025, 16000, 22050, 24000, 32000, 44100, 48000, 96000)))
    p = read(spark, d, "part").select("p_partkey", (1 + F.col("p_partkey") % 8).alias("channels"), (F.col("p_partkey") * 97).alias("saved"), F.get(rates, F.col("p_size") % 9).alias("rate"))
    return p.select("p_partkey", L.max_bitrate_bps(F.col("rate"), F.col("channels")).alias("most"), L.fullness_words(F.col("saved"), F.col("channels")).alias("fullness"), L.core_rate(F.col("rate")).alias("core"))


@query("""WITH e AS (SELECT *, event_type = 'error' AS failed, event_id % 3 AS channels, CASE WHEN value > 50 THEN 1 ELSE 0 END AS rate FROM events),
f AS (SELECT *, first_value(CASE WHEN NOT failed THEN channels * 2 + rate END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS shape FROM e)
SELECT user_id, event_id, CASE WHEN failed THEN 'failed' WHEN shape IS NULL OR channels * 2 + rate = shape THEN 'comparable' ELSE 'non-comparable' END AS status FROM f""")
def comparable_shapes(spark, d):
    e = read(spark, d, "events").withColumn("channels", F.col("event_id") % 3).withColumn("rate", (F.col("value") > 50).cast("int"))
    return T.shape_status(e, ["user_id"], F.struct("ts", "event_id"), F.col("event_type") == "error", ["channels", "rate"]).select("user_id", "event_id", "status")


@query("""SELECT o_orderkey, CASE WHEN abs(got - want) / greatest(want, 1) > 0.01 THEN 'non-matched' ELSE 'comparable' END AS status FROM (SELECT o_orderkey, o_totalprice AS want, o_totalprice * (1 + (o_orderkey % 9 - 4) / 256.0) AS got FROM orders)""")
def matched_rates(spark, d):
    want = F.col("o_totalprice")
    return read(spark, d, "orders").select("o_orderkey", T.rate_status(want * (1 + (F.col("o_orderkey") % 9 - 4) / 256.0), want).alias("status"))


@query("SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY event_type")
def upper_medians(spark, d):
    return T.upper_median(read(spark, d, "events"), ["event_type"], "value")


@query("SELECT vec_id, CAST(coalesce(list_position(list_transform(embedding, lambda x: abs(x) >= 0.1::FLOAT), true) - 1, len(embedding)) AS BIGINT) AS n FROM embeddings")
def leading_silence(spark, d):
    return read(spark, d, "embeddings").select("vec_id", T.leading_quiet(F.col("embedding"), F.lit(0.1).cast("float")).alias("n"))


@query(f"SELECT vec_id, lag, len(l[greatest(-lag, 0) + 1 : 64 - greatest(lag, 0)]) AS n, round(list_sum(list_transform(list_zip(l[greatest(-lag, 0) + 1 : 64 - greatest(lag, 0)], r[greatest(lag, 0) + 1 : 64 - greatest(-lag, 0)]), lambda z: z[1]::DOUBLE * z[2])), 6) AS product FROM (SELECT *, CAST(vec_id % 11 - 5 AS BIGINT) AS lag FROM {PAIRS})")
def lag_overlap(spark, d):
    x = _pairs(spark, d).withColumn("lag", F.col("vec_id") % 11 - 5).withColumn("o", T.overlap(F.col("l"), F.col("r"), F.col("lag")))
    return x.select("vec_id", "lag", F.size("o.a").cast("long").alias("n"), F.round(E.dot(F.col("o.a"), F.col("o.b")), 6).alias("product"))


@query(f"SELECT vec_id, round(10 * log10(sum(x::DOUBLE * x) / greatest(sum(y::DOUBLE * y), 1e-30)), 6) AS level, round(corr(x::DOUBLE, y::DOUBLE), 6) AS coherence FROM ({PAIR_FLAT}) GROUP BY vec_id")
def spatial_measures(spark, d):
    left, right = F.col("l"), F.col("r")
    return _pairs(spark, d).select("vec_id", F.round(T.level_difference_db(left, right), 6).alias("level"), F.round(T.coherence(left, right), 6).alias("coherence"))


@query(f"SELECT vec_id, abs(sum(x::DOUBLE * y) FILTER (i >= 32)) > 1.25 * abs(sum(x::DOUBLE * y) FILTER (i < 32)) AS swapped FROM ({PAIR_FLAT}) GROUP BY vec_id")
def channel_swap(spark, d):
    half = lambda at: E.dot(F.slice("l", at, 32), F.slice("r", at, 32))
    return _pairs(spark, d).select("vec_id", T.swapped(half(1), half(33)).alias("swapped"))


@query("""WITH b AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: x > 0) AS used, list_transform(embedding[5:8], lambda x: x > 0) AS quiet FROM embeddings),
c AS (SELECT *, len(list_filter(list_zip(used, quiet), lambda z: NOT z[2])) AS loud, len(list_filter(list_zip(used, quiet), lambda z: NOT z[2] AND z[1])) AS loud_on, len(list_filter(used, lambda u: u)) AS n_on FROM b)
SELECT vec_id, CAST(CASE WHEN loud = 0 THEN 0 WHEN loud = loud_on THEN 4 ELSE n_on END AS BIGINT) AS n_on FROM c""")
def unanimous_bands(spark, d):
    flags = lambda at: F.transform(F.slice("embedding", at, 4), lambda x: x > 0)
    return read(spark, d, "embeddings").select("vec_id", F.size(F.filter(T.unanimous(flags(1), flags(5)), lambda u: u)).cast("long").alias("n_on"))


@query("""WITH f AS (SELECT vec_id // 6 AS clip, vec_id % 6 AS plane, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings WHERE vec_id // 6 % 2 = 0 OR vec_id % 6 < 4), n AS (SELECT clip, max(plane) + 1 AS n FROM f GROUP BY clip)
SELECT f.clip, i AS place, round(avg(x::DOUBLE), 6) AS value FROM f JOIN n ON f.clip = n.clip WHERE n <> 6 OR plane <> 3 GROUP BY f.clip, i""")
def speech_downmix(spark, d):
    clip, plane = F.floor(F.col("vec_id") / 6).cast("long"), F.col("vec_id") % 6
    e = read(spark, d, "embeddings").select(clip.alias("clip"), plane.alias("plane"), "embedding").where("clip % 2 = 0 or plane < 4")
    rows = e.select("clip", "plane", F.posexplode("embedding").alias("place", "x"))
    return T.downmixed(rows, ["clip"], "plane", "place", "x").select("clip", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@query("SELECT vec_id, i, [embedding[33:48], list_transform(embedding[1:16], lambda x: x * 0), embedding[1:16]][i + 1][1] + 0 AS first FROM embeddings, range(3) t(i)")
def plane_order(spark, d):
    planes = F.array(*(F.slice("embedding", at, 16) for at in (1, 17, 33)))
    x = read(spark, d, "embeddings").select("vec_id", F.posexplode(T.reordered(planes, F.array(F.lit(2), F.lit(9), F.lit(0)))).alias("i", "p"))
    return x.select("vec_id", F.col("i").cast("long").alias("i"), (F.get("p", F.lit(0)) + F.lit(0).cast("float")).alias("first"))


@query(f"SELECT vec_id, i, round(x::DOUBLE + y * pow(2, -(i // 8) / 4.0), 6) AS x FROM ({PAIR_FLAT})")
def dependent_coupling(spark, d):
    gains = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.pow(F.lit(2.0), -F.floor(i / 8) / 4.0))
    x = _pairs(spark, d).select("vec_id", F.posexplode(T.coupled(F.col("l"), F.col("r"), gains)).alias("i", "x"))
    return x.select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query('SELECT l_orderkey, min(l_linenumber) FILTER (l_quantity <= 20 + l_orderkey % 10) AS "offset" FROM lineitem GROUP BY l_orderkey')
def smallest_offset(spark, d):
    return T.smallest_fit(read(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", F.col("l_quantity"), 20 + F.col("l_orderkey") % 10)


@query(r"SELECT doc_id, md5(array_to_string(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[\p{L}\p{N}_]+'), ' ')) AS words_md5 FROM documents")
def plain_words(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.plain_words(F.col("text"))).alias("words_md5"))


@query("SELECT user_id, CASE WHEN sd > 0 THEN CAST(greatest(2, ceil(pow((1.64485 + 0.84162) * sd / 5, 2))) AS BIGINT) END AS n FROM (SELECT user_id, stddev_samp(value) AS sd FROM events GROUP BY user_id)")
def study_sample_size(spark, d):
    g = read(spark, d, "events").groupBy("user_id").agg(F.stddev_samp("value").alias("sd"))
    return g.select("user_id", T.sample_size(F.col("sd"), F.lit(5.0)).alias("n"))


_LETTER = f"substr('{T.LETTERS}', CAST(('0x' || substr(h, {{}}, 2)) AS INTEGER) % 32 + 1, 1)"


@query(f"SELECT c_custkey, {' || '.join(_LETTER.format(2 * k + 1) for k in range(8))} AS name FROM (SELECT c_custkey, sha256('study' || chr(0) || 'id' || chr(0) || c_custkey || chr(0) || c_mktsegment) AS h FROM customer)")
def blind_names(spark, d):
    return read(spark, d, "customer").select("c_custkey", T.blind_name("study", F.col("c_custkey"), F.col("c_mktsegment")).alias("name"))


@query()
def session_orders(spark, d):
    """Each listener's own order of twelve items; the swaps are beyond SQL and tested against a loop."""
    items = F.sequence(F.lit(0), F.lit(11))
    return spread(read(spark, d, "customer").select("c_custkey")).select("c_custkey", T.seeded_order(items, "study", F.col("c_custkey")).alias("items"))


@query()
def bootstrap_medians(spark, d):
    """Intervals from a generator's draws; beyond SQL and tested against a loop."""
    return resampling.bootstrap_medians(read(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
