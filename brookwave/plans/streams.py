"""Queries on ordered streams: events by user stand for frames by stream."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from brookwave.functions import scalars as S
from brookwave.operators import identity, tables, timeline
from brookwave.plans.shared import read

KEY, ORDER = ["user_id"], ["ts", "event_id"]
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT user_id, event_id, (row_number() OVER w - 1) // 8 AS frame, (row_number() OVER w - 1) % 8 AS place
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def frame_index(spark, d):
    return timeline.framed(read(spark, d, "events"), KEY, ORDER, 8).select("user_id", "event_id", "frame", "place")


TRIM_SQL = """WITH e AS (SELECT user_id, event_id, ts, 64 + event_id % 7 AS n, 100 + user_id % 50 AS skip, CASE WHEN user_id % 3 <> 0 THEN 1500 + user_id END AS play FROM events),
a AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sofar FROM e),
b AS (SELECT *, greatest(skip - sofar, 0) AS l, CASE WHEN play IS NULL THEN n ELSE least(n, skip + play - sofar) END AS h FROM a)
SELECT user_id, event_id, CAST(sofar AS BIGINT) AS sofar, CAST(CASE WHEN h > l AND l < n THEN l ELSE 0 END AS BIGINT) AS lo, CAST(CASE WHEN h > l AND l < n THEN h ELSE 0 END AS BIGINT) AS hi FROM b"""


def _trimmed(spark, d):
    play = F.when(F.col("user_id") % 3 != 0, 1500 + F.col("user_id"))
    return timeline.trimmed(read(spark, d, "events"), KEY, ORDER, 64 + F.col("event_id") % 7, 100 + F.col("user_id") % 50, play)


@query(TRIM_SQL)
def trim_window(spark, d):
    return _trimmed(spark, d).select("user_id", "event_id", F.col("at").alias("sofar"), "lo", "hi")


@query(f"""WITH t AS ({TRIM_SQL}), g AS (SELECT user_id, sum(hi - lo) AS shown FROM t GROUP BY user_id),
x AS (SELECT user_id, shown, CASE WHEN user_id % 3 <> 0 THEN greatest(1500 + user_id - shown, 0) END AS missing FROM g)
SELECT user_id, CAST(shown AS BIGINT) AS shown, CASE WHEN missing IS NULL THEN 'Unbounded' WHEN missing = 0 THEN 'Complete' WHEN missing < 10 THEN 'Rounded' ELSE 'Incomplete' END AS kind,
CAST(missing AS BIGINT) AS missing FROM x""")
def presentation_completion(spark, d):
    g = _trimmed(spark, d).groupBy("user_id").agg(F.sum(F.col("hi") - F.col("lo")).cast("long").alias("shown"), F.first("play").alias("play"))
    g = g.withColumn("left", F.when(F.col("play").isNotNull(), F.greatest(F.col("play") - F.col("shown"), F.lit(0))))
    c = timeline.completion(F.lit(0), F.col("left"), F.lit(True), F.col("left") < 10)
    return g.select("user_id", "shown", c["kind"].alias("kind"), c["missing"].alias("missing"))


@query("""SELECT * FROM (SELECT user_id, event_id, event_type, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS locked FROM events) WHERE event_type <> locked""")
def rate_lock_violations(spark, d):
    return timeline.lock_violations(read(spark, d, "events"), KEY, ORDER, "event_type").select("user_id", "event_id", "event_type", "locked")


@query("""WITH a AS (SELECT user_id, event_id, sum(64 + event_id % 7) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS total, 64 + event_id % 7 AS n FROM events)
SELECT user_id, event_id, CAST(total AS BIGINT) AS total FROM a WHERE total > 2000 AND total - n <= 2000""")
def duration_cap_first_violation(spark, d):
    return timeline.first_over_cap(read(spark, d, "events"), KEY, ORDER, 64 + F.col("event_id") % 7, 2000).select("user_id", "event_id", "total")


@query("""SELECT user_id, count(*) AS frames, CAST(sum(64 + event_id % 7) AS BIGINT) AS samples, count(DISTINCT event_type) AS kinds, arg_min(event_type, event_id) AS first_kind FROM events GROUP BY user_id""")
def stream_tallies(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("frames"), F.sum(64 + F.col("event_id") % 7).cast("long").alias("samples"), F.count_distinct("event_type").alias("kinds"), F.min_by("event_type", "event_id").alias("first_kind"))


@query("""SELECT user_id, event_id, number, previous, coalesce(number <> previous + 1, false) AS broken FROM
(SELECT user_id, event_id, n AS number, lag(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM
(SELECT *, event_id % 11 AS n FROM events))""")
def sequence_continuity(spark, d):
    return timeline.sequence_gaps(read(spark, d, "events"), KEY, ORDER, F.col("event_id") % 11, F.lit(1)).select("user_id", "event_id", "number", "previous", "broken")


@query("""SELECT user_id, event_id, event_type, last_value(CASE WHEN event_type IN ('view', 'click') THEN event_id END IGNORE NULLS) OVER
(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS element FROM events""")
def attach_preceding(spark, d):
    return timeline.attached(read(spark, d, "events"), KEY, ORDER, F.col("event_type").isin("view", "click"), F.col("event_id")).select("user_id", "event_id", "event_type", "element")


@query("""SELECT m.user_id, m.event_id, (SELECT min(e.event_id) FROM events e WHERE e.user_id = m.user_id AND e.event_type = 'purchase' AND (e.ts, e.event_id) >= (m.ts, m.event_id)) AS fence
FROM events m WHERE m.event_type = 'signup'""")
def mdat_fence_asof(spark, d):
    e = read(spark, d, "events")
    return timeline.fenced(e, KEY, ORDER, F.col("event_type") == "signup", F.col("event_type") == "purchase", F.col("event_id")).select("user_id", "event_id", "fence")


@query("""WITH a AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS edge FROM events),
b AS (SELECT *, sum(edge) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS length FROM b GROUP BY user_id, run""")
def section_runs(spark, d):
    return timeline.runs(read(spark, d, "events"), KEY, ORDER, "event_type")


@query("""WITH a AS (SELECT user_id, event_id, CASE WHEN (event_id >> 1) % 2 = 1 THEN 1 ELSE 0 END AS joined, ts FROM events),
b AS (SELECT *, sum(1 - joined) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM a) SELECT user_id, CAST(grp AS BIGINT) AS grp, count(*) AS length FROM b GROUP BY user_id, grp""")
def window_groups(spark, d):
    rows = read(spark, d, "events").withColumn("joined", S.bits(F.col("event_id"), 1, 1))
    return rows.withColumn("grp", F.sum(1 - F.col("joined")).over(timeline.until(KEY, ORDER)).cast("long")).groupBy("user_id", "grp").agg(F.count("*").alias("length"))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, CAST(sum(l_suppkey % 121 - 60) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS level FROM lineitem""")
def dpcm_running_sum(spark, d):
    rows = read(spark, d, "lineitem")
    level = F.sum(F.col("l_suppkey") % 121 - 60).over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_returnflag", level.cast("long").alias("level"))


def _values(spark, d):
    e = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"])
    return read(spark, d, "events").groupBy("user_id").agg(e.alias("values"))


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
r AS (SELECT user_id, i, value, CAST(0.65 * 0.0 + 0.35 * 0.0 AS DOUBLE) AS acc FROM e WHERE i = 0
UNION ALL SELECT e.user_id, e.i, e.value, CAST(0.65 * r.acc + 0.35 * r.value AS DOUBLE) FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, count(*) FILTER (i > 0 AND value > 1e-6 AND value > 8.0 * acc) AS attacks, CAST(min(i) FILTER (i > 0 AND value > 1e-6 AND value > 8.0 * acc) AS BIGINT) AS first_at FROM r GROUP BY user_id""")
def attack_detector(spark, d):
    found = timeline.folded_attacks(F.col("values"))
    return _values(spark, d).select("user_id", found.alias("f")).select("user_id", F.size("f").cast("long").alias("attacks"), F.array_min("f").cast("long").alias("first_at"))


@query("""WITH RECURSIVE e AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, least(greatest(v, 0), 255) AS x FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.i, least(greatest(least(greatest(e.v, 0), 255), r.x - 60), r.x + 60) FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, CAST(i AS BIGINT) AS i, CAST(x AS BIGINT) AS x FROM r""")
def clamped_dpcm(spark, d):
    whole = F.transform("values", lambda v: F.floor(v).cast("long"))
    return _values(spark, d).select("user_id", F.posexplode(timeline.clamped_steps(whole)).alias("p", "x")).select("user_id", (F.col("p") + 1).cast("long").alias("i"), F.col("x").cast("long").alias("x"))


@query("""WITH o AS (SELECT o_custkey AS track, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS chunk, o_orderkey * 1000 AS chunk_off FROM orders),
c AS (SELECT *, CASE WHEN chunk >= 5 THEN 1 WHEN chunk >= 3 THEN 4 ELSE 2 END AS per FROM o),
f AS (SELECT *, coalesce(sum(per) OVER (PARTITION BY track ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM c),
s AS (SELECT o_custkey AS track, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS sample, CAST(l_quantity AS BIGINT) AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT f.track, s.sample, f.chunk, CAST(f.chunk_off + coalesce(sum(s.size) OVER (PARTITION BY f.track, f.chunk ORDER BY s.sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off, s.size
FROM f JOIN s ON s.track = f.track AND s.sample >= f.first AND s.sample < f.first + f.per""")
def sample_table_offsets(spark, d):
    orders, items = read(spark, d, "orders"), read(spark, d, "lineitem")
    w = Window.partitionBy("track")
    chunks = orders.select(F.col("o_custkey").alias("track"), "o_orderkey").select("track", F.row_number().over(w.orderBy("o_orderkey")).cast("long").alias("chunk"), (F.col("o_orderkey") * 1000).alias("chunk_off"))
    runs = orders.select(F.col("o_custkey").alias("track")).distinct().select("track", F.explode(F.array(*(F.struct(F.lit(a).cast("long").alias("first_chunk"), F.lit(b).alias("per_chunk")) for a, b in ((1, 2), (3, 4), (5, 1))))).alias("r")).select("track", "r.*")
    sizes = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("track"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("size"))
    sizes = sizes.select("track", (F.row_number().over(w.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")) - 1).cast("long").alias("sample"), "size")
    return tables.sample_table(runs, chunks, sizes)


FRAGMENT_SQL = """WITH r AS (SELECT l_orderkey % 25 AS track, l_orderkey AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS sample,
CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_quantity AS BIGINT) END AS size, CASE WHEN l_linenumber % 3 = 0 THEN 512 END AS dur FROM lineitem),
j AS (SELECT r.*, coalesce(r.size, CASE WHEN o_orderkey % 3 <> 0 THEN 100 + o_orderkey % 10 END, 7 + n_regionkey) AS n, coalesce(r.dur, CASE WHEN o_orderkey % 2 = 0 THEN 1000 END, 1024) AS d,
CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey * 10 ELSE o_orderkey * 100 END AS start FROM r JOIN orders ON o_orderkey = r.seq JOIN nation ON n_nationkey = track)
SELECT track, seq, CAST(sample AS BIGINT) AS sample, CAST(start + coalesce(sum(n) OVER w, 0) AS BIGINT) AS off, CAST(n AS BIGINT) AS size, CAST(coalesce(sum(d) OVER w, 0) AS BIGINT) AS dts, CAST(d AS BIGINT) AS dur
FROM j WINDOW w AS (PARTITION BY track, seq ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query(FRAGMENT_SQL)
def fragment_defaults(spark, d):
    """Orders are fragments of 25 tracks, and their lines the samples: one shuffle by fragment serves numbering, join and sums."""
    n = F.row_number().over(Window.partitionBy("track", "seq").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    items = read(spark, d, "lineitem").withColumn("track", F.col("l_orderkey") % 25).withColumn("seq", F.col("l_orderkey"))
    runs = items.select("track", "seq", n.cast("long").alias("sample"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity").cast("long")).alias("size"), F.when(F.col("l_linenumber") % 3 == 0, 512).alias("dur"))
    k = F.col("o_orderkey")
    fragments = read(spark, d, "orders").select((k % 25).alias("track"), k.alias("seq"), F.when(k % 4 == 0, k * 10).alias("base"), (k * 100).alias("moof_pos"), F.when(k % 3 != 0, 100 + k % 10).alias("def_size"), F.when(k % 2 == 0, 1000).alias("def_dur"))
    defaults = read(spark, d, "nation").select(F.col("n_nationkey").alias("track"), (7 + F.col("n_regionkey")).alias("size0"), F.lit(1024).alias("dur0"))
    return tables.resolved_fragments(runs, fragments, defaults)


@query(f"""SELECT track, seq, sample, off, size, (sample + 1) * 2 > 3 AS shown FROM ({FRAGMENT_SQL}) WHERE sample < 3""")
def exact_seek_plan(spark, d):
    return tables.seek_plan(fragment_defaults(spark, d), 2, 3, 5).select("track", "seq", "sample", "off", "size", "shown")


@query("""SELECT coalesce(c_custkey, o_custkey) AS c_custkey, CASE WHEN c_custkey IS NULL THEN 'extra' WHEN o_custkey IS NULL THEN 'missing' ELSE 'matched' END AS status
FROM customer FULL OUTER JOIN (SELECT DISTINCT l_partkey AS o_custkey FROM lineitem WHERE l_quantity = 50) ON c_custkey = o_custkey""")
def identity_match_outer(spark, d):
    found = read(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("c_custkey")).distinct()
    return identity.matched(read(spark, d, "customer").select("c_custkey"), found, ["c_custkey"]).select("c_custkey", "status")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_identity(spark, d):
    return identity.duplicates(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def retain_seen_semi(spark, d):
    return identity.kept_states(read(spark, d, "customer").select("c_custkey", "c_nationkey"), read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def extra_element_anti(spark, d):
    return identity.extra_elements(read(spark, d, "customer").select("c_custkey", "c_nationkey"), read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'P') WHERE n = 1""")
def first_usable_track(spark, d):
    return identity.first_usable(read(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") != "P").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""SELECT l_orderkey, l_linenumber, CAST(l_partkey * 48000 // 44100 AS BIGINT) AS scaled, CASE WHEN l_partkey * 48000 % 44100 = 0 THEN l_partkey * 48000 // 44100 END AS exact FROM lineitem""")
def rescale_clock(spark, d):
    n, a, b = F.col("l_partkey"), F.lit(48000), F.lit(44100)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.rescaled(n, a, b).alias("scaled"), S.converted(n, a, b).alias("exact"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey * 480 > l_suppkey * 441 AND l_partkey * 480 - l_suppkey * 441 < 480 AND (l_partkey * 480 - l_suppkey * 441) * 1000 < 480 * 441 AS rounded FROM lineitem""")
def rounded_duration_tail(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.rounded_tail(F.col("l_partkey"), F.lit(480), F.lit(441), F.col("l_suppkey")).alias("rounded"))


@query("""SELECT o_orderkey, CAST(1024 AS BIGINT) AS priming, (1024 - o_orderkey % 1024) % 1024 AS remainder, o_orderkey AS source FROM orders""")
def lc_delay(spark, d):
    return read(spark, d, "orders").select("o_orderkey", S.delay_lc(F.col("o_orderkey")).alias("d")).select("o_orderkey", "d.*")


@query("""SELECT o_orderkey, round(CASE WHEN o_custkey % 10 = 0 THEN 0 ELSE 8.0 * o_orderkey * 48000 / (o_custkey % 10) END, 4) AS bps FROM orders""")
def achieved_rate(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.round(S.achieved_bps(F.col("o_orderkey"), F.col("o_custkey") % 10, F.lit(48000)), 4).alias("bps"))


@query("""SELECT l_orderkey, l_linenumber, round(sign(q) * pow(abs(q), 4.0 / 3), 6) AS invquant, round(pow(2.0, 0.25 * (sf - 100)), 6) AS gain, round(pow(2.0, -0.1875 * (sf - 100)), 6) AS qgain,
CASE WHEN l_discount <= 1e-20 THEN 0 ELSE CAST(round(2 * log2(l_discount)) AS BIGINT) END AS noise FROM (SELECT *, l_suppkey % 41 - 20 AS q, l_partkey % 160 AS sf FROM lineitem)""")
def quantiser_scales(spark, d):
    q, sf = F.col("l_suppkey") % 41 - 20, F.col("l_partkey") % 160
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.inverse_quantised(q), 6).alias("invquant"), F.round(S.scale_gain(sf), 6).alias("gain"), F.round(S.quantiser_gain(sf), 6).alias("qgain"), S.noise_index(F.col("l_discount")).alias("noise"))


@query("""SELECT o_orderkey, round(13.0 * atan(0.00076 * f) + 3.5 * atan(pow(f / 7500.0, 2)), 6) AS bark,
round(3.64 * pow(k, -0.8) - 6.5 * exp(-0.6 * pow(k - 3.3, 2)) + 0.001 * pow(k, 4), 4) AS ath FROM (SELECT o_orderkey, f, greatest(least(f / 1000.0, 24.0), 0.02) AS k FROM (SELECT o_orderkey, CAST(o_orderkey % 24000 + 20 AS DOUBLE) AS f FROM orders))""")
def hearing_scales(spark, d):
    f = (F.col("o_orderkey") % 24000 + 20).cast("double")
    return read(spark, d, "orders").select("o_orderkey", F.round(S.bark(f), 6).alias("bark"), F.round(S.absolute_threshold_db(f), 4).alias("ath"))


@query("""SELECT o_orderkey, (o_orderkey * 1664525 + 1013904223) & 4294967295 AS next FROM orders""")
def lcg_noise(spark, d):
    return read(spark, d, "orders").select("o_orderkey", S.lcg(F.col("o_orderkey")).alias("next"))


@query("""SELECT o_orderkey, (n & 127) | ((n >> 7 & 127) << 8) | ((n >> 14 & 127) << 16) | ((n >> 21 & 127) << 24) AS safe, n AS back FROM (SELECT o_orderkey, o_orderkey * 7919 % 268435456 AS n FROM orders)""")
def syncsafe_numbers(spark, d):
    n = F.col("o_orderkey") * 7919 % 268435456
    return read(spark, d, "orders").select("o_orderkey", S.syncsafe(n).alias("safe")).withColumn("back", S.unsyncsafe(F.col("safe")))


HEADS = "l_orderkey, l_linenumber, l_suppkey % 4 AS profile, l_partkey % 13 AS fs_index, l_linenumber % 8 AS ch_cfg, l_partkey % 8185 + 7 AS frame_len, 2047 AS fullness, l_linenumber % 4 + 1 AS n_rdb, l_suppkey % 3 > 0 AS bare"


@query(f"""WITH h AS (SELECT {HEADS} FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(profile AS BIGINT) AS profile, CAST(fs_index AS BIGINT) AS fs_index, CAST(ch_cfg AS BIGINT) AS ch_cfg, CAST(frame_len AS BIGINT) AS frame_len,
CAST(fullness AS BIGINT) AS fullness, CAST(n_rdb AS BIGINT) AS n_rdb, CAST(CASE WHEN bare THEN 7 WHEN n_rdb = 1 THEN 9 ELSE 7 + 2 * n_rdb END AS BIGINT) AS payload_offset, upper(printf('%014x', (CAST(CASE WHEN bare THEN 65521 ELSE 65520 END AS BIGINT) << 40) | (CAST(profile AS BIGINT) << 38) | (CAST(fs_index AS BIGINT) << 34) | (CAST(ch_cfg AS BIGINT) << 30) | (CAST(frame_len AS BIGINT) << 13) | (2047 << 2) | (n_rdb - 1))) AS bytes FROM h""")
def header_round_trip(spark, d):
    h = read(spark, d, "lineitem").selectExpr(*HEADS.split(", "))
    h = h.withColumn("b", S.adts_bytes(*(F.col(c) for c in ("profile", "fs_index", "ch_cfg", "frame_len", "fullness", "n_rdb", "bare"))))
    f = S.adts_header(F.col("b"))
    return h.select("l_orderkey", "l_linenumber", *(f[c].cast("long").alias(c) for c in ("profile", "fs_index", "ch_cfg", "frame_len", "fullness", "n_rdb", "payload_offset")), F.hex("b").alias("bytes"))


@query()
def fnv1a_texts(spark, d):
    return read(spark, d, "benchmark").select("item_id", S.fnv1a(F.col("text").cast("binary")).alias("hash"))


@query("""SELECT o_orderkey, o_custkey AS priming, o_orderkey % 1024 AS remainder, o_orderkey AS source FROM orders""")
def tag_hex_fields(spark, d):
    text = S.gapless_comment(F.col("o_custkey"), F.col("o_orderkey") % 1024, F.col("o_orderkey"))
    return read(spark, d, "orders").select("o_orderkey", S.gapless_fields(text).alias("g")).select("o_orderkey", "g.*")
