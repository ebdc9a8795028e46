"""Queries on options, limits, tags, band borders and choices: columns of the driver tables stand for what streams declare."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brookwave.functions import maths as M
from brookwave.functions import options as O
from brookwave.functions import replication as R
from brookwave.functions import tags as T
from brookwave.operators import choices as C
from brookwave.plans.shared import read

QUERIES, SQL = {}, {}
LINE = ["l_orderkey", "l_linenumber"]
DELAY = 2 * (1024 + 8 // 2) + 962


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 9) AS s, round(cos(l_quantity), 9) AS c, round(atan(l_quantity / 7), 9) AS a, round(atan2(l_discount, l_quantity), 9) AS a2,
round(acos(l_discount), 9) AS ac, round(pow(2, l_quantity / 8), 6) AS e2, round(pow(10, l_tax), 9) AS e10, round(log2(l_quantity), 9) AS l2, round(pow(l_quantity, 0.75), 9) AS q34 FROM lineitem""")
def elementary(spark, d):
    q, r = F.col("l_quantity"), lambda c, n=9: F.round(c, n)
    sc = M.sine_cosine(q)
    return read(spark, d, "lineitem").select(
        *LINE, r(sc["sin"]).alias("s"), r(sc["cos"]).alias("c"), r(F.atan(q / 7)).alias("a"), r(F.atan2(F.col("l_discount"), q)).alias("a2"), r(F.acos("l_discount")).alias("ac"),
        r(M.exp2(q / 8), 6).alias("e2"), r(M.exp10(F.col("l_tax"))).alias("e10"), r(F.log2(q)).alias("l2"), r(M.three_quarters(q)).alias("q34"),
    )


@query("""SELECT n, k, round(cos(2 * pi() * k / n), 9) AS re, round(sin(2 * pi() * k / n), 9) AS im,
CAST(list_sum([((k >> i) & 1) << (5 - i) for i in range(6)]) AS BIGINT) AS reversed FROM (SELECT 64 AS n, unnest(range(32)) AS k)""")
def twiddle_table(spark, d):
    t = spark.range(1).select(F.lit(64).alias("n")).select("n", F.posexplode(M.twiddles(F.col("n"))).alias("k", "t"))
    return t.select("n", F.col("k").cast("long").alias("k"), F.round("t.re", 9).alias("re"), F.round("t.im", 9).alias("im"), M.reversed_bits(F.col("k"), 6).alias("reversed"))


ATH = "(3.64 * pow(k, -0.8) - 6.5 * exp(-0.6 * pow(k - 3.3, 2)) + 0.001 * pow(k, 4))"


@query(f"""SELECT p_partkey, round(log10(32768.0 * 512 * 32768 * 512 * pow(10, ({ATH} - 96) / 10)), 6) AS level FROM (SELECT p_partkey, greatest(least(p_size * 400 / 1000.0, 24.0), 0.02) AS k FROM part)""")
def threshold_energy(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(F.log10(M.absolute_threshold_energy((F.col("p_size") * 400).cast("double"))), 6).alias("level"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN s < 0 THEN 'seconds' WHEN r <= 0 THEN 'rate' WHEN c <= 0 AND s <> 'Infinity'::DOUBLE THEN 'counted rate' WHEN b <= 0 THEN 'budget' ELSE 'ok' END AS verdict
FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN 'Infinity'::DOUBLE ELSE l_quantity - 3 END AS s, l_partkey % 5 AS r, l_suppkey % 4 AS c, l_orderkey % 6 AS b FROM lineitem)""")
def limit_verdicts(spark, d):
    s = F.when(F.col("l_linenumber") == 7, float("inf")).otherwise(F.col("l_quantity") - 3)
    return read(spark, d, "lineitem").select(*LINE, O.limits_verdict(s, F.col("l_partkey") % 5, F.col("l_suppkey") % 4, F.col("l_orderkey") % 6).alias("verdict"))


FLAGS = "l_partkey % 2 = 1 AS he, l_partkey % 3 = 1 AS ps, l_partkey % 5 = 1 AS ld, l_partkey % 7 = 1 AS cbr, l_suppkey % 3 = 1 AS look, CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey % 13 END AS quality, l_suppkey % 2 = 0 AS adts, l_orderkey % 3 = 0 AS tools, 1 + l_orderkey % 9 AS planes"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN cbr AND (he OR ps OR ld OR quality IS NOT NULL) THEN 'cbr' WHEN quality > 10 THEN 'quality' WHEN quality IS NOT NULL AND he THEN 'quality he' WHEN ps AND NOT he THEN 'ps'
WHEN ld AND adts THEN 'ld adts' WHEN ld AND (he OR ps OR look OR quality IS NOT NULL) THEN 'ld mode' WHEN ld AND tools THEN 'ld tools' ELSE 'ok' END AS mode,
CASE WHEN cbr AND planes > 2 THEN 'cbr' WHEN ld AND planes > 2 THEN 'ld' WHEN planes <= 2 THEN 'ok' WHEN planes IN (7, 9) THEN 'count' WHEN he OR look THEN 'mode' ELSE 'ok' END AS shape,
CASE planes WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 WHEN 6 THEN 6 WHEN 8 THEN 7 END AS config FROM (SELECT *, {FLAGS} FROM lineitem)""")
def encoder_modes(spark, d):
    k, s, o = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    he, ps, ld, cbr, look, planes = k % 2 == 1, k % 3 == 1, k % 5 == 1, k % 7 == 1, s % 3 == 1, 1 + o % 9
    mode = O.mode_verdict(he, ps, ld, cbr, look, F.when(o % 4 == 0, o % 13), s % 2 == 0, o % 3 == 0)
    return read(spark, d, "lineitem").select(*LINE, mode.alias("mode"), O.planes_verdict(planes, cbr, ld, he, look).alias("shape"), O.config_for(planes).alias("config"))


STATE = "320 * 8 + 32 * 64 * 16 + 1280 * 8 + 128 * 64 * 16 + 8 * 32 * 16 + 40 * 64 * 16"


@query(f"""SELECT o_orderkey, o_orderkey % 9 AS channels, (o_orderkey % 9) * (12288 + CASE WHEN he THEN {STATE} ELSE 0 END) + CASE WHEN ps THEN 65536 ELSE 0 END AS workspace, CASE WHEN he THEN 0 ELSE 2 END::BIGINT AS warm_up,
core = out OR 2 * core = out AS agree, aot IN (1, 2, 3, 4, 5, 23, 29) AND o_orderkey % 9 <= 7 AS known, CASE WHEN core = 0 OR 1024 * out % core <> 0 THEN 0 ELSE 1024 * out // core END AS samples,
1024 + o_custkey + aot = (o_custkey % 3 + 2) * 1024 AS armed
FROM (SELECT *, o_orderkey % 2 = 0 AS he, o_orderkey % 3 = 0 AS ps, (o_custkey % 3) * 12000 AS core, (o_orderkey % 5) * 12000 AS out, o_custkey % 31 AS aot FROM orders)""")
def declared_streams(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    core, out, aot = (c % 3) * 12000, (o % 5) * 12000, c % 31
    return read(spark, d, "orders").select(
        "o_orderkey", (o % 9).alias("channels"), O.workspace_bytes(o % 9, o % 2 == 0, o % 3 == 0).cast("long").alias("workspace"), O.warm_up_units(o % 2 == 0).alias("warm_up"), O.rates_agree(core, out).alias("agree"),
        O.supported(aot, o % 9).alias("known"), O.frame_samples(F.lit(1024), core, out).alias("samples"), O.armed(F.lit(1024), c, aot, c % 3 + 2, F.lit(1024)).alias("armed"),
    )


@query("""SELECT c, CAST(i AS BIGINT) AS place, label FROM (VALUES """ + ", ".join(f"({k}, {i}, '{x}')" for k, v in O.LABELS.items() for i, x in enumerate(v)) + """) t(c, i, label) JOIN (SELECT DISTINCT l_linenumber FROM lineitem) ON c = l_linenumber""")
def default_labels(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("c")).distinct()
    return rows.select("c", F.posexplode(O.labels_of(F.col("c"))).alias("place", "label")).select("c", F.col("place").cast("long").alias("place"), "label")


@query("""SELECT event_id, kind IN ('not_aac', 'format') AS format_class, kind, CASE WHEN kind = 'truncated' THEN coalesce(CASE WHEN user_id % 2 = 0 THEN user_id END, event_id) WHEN user_id % 2 = 0 THEN user_id END AS "at"
FROM (SELECT *, ['not_aac', 'format', 'truncated', 'limit'][event_id % 4 + 1] AS kind FROM events)""")
def error_kinds(spark, d):
    kind = F.get(F.array(*map(F.lit, ("not_aac", "format", "truncated", "limit"))), (F.col("event_id") % 4).cast("int"))
    error = O.truncated_at(F.struct(kind.alias("kind"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("at")), F.col("event_id"))
    return read(spark, d, "events").select("event_id", O.is_format_class(kind).alias("format_class"), error["kind"].alias("kind"), error["at"].alias("at"))


@query("""SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'lengths' WHEN 2 THEN 'not finite' ELSE 'ok' END AS verdict FROM embeddings""")
def plane_verdicts(spark, d):
    e, k = F.col("embedding").cast("array<double>"), F.col("vec_id") % 5
    planes = F.when(k == 0, F.array().cast("array<array<double>>")).when(k == 1, F.array(e, F.slice(e, 1, 3))).when(k == 2, F.array(e, F.transform(e, lambda x: x * F.lit(float("nan"))))).otherwise(F.array(e, e))
    return read(spark, d, "embeddings").select("vec_id", O.plane_verdict(planes).alias("verdict"))


TAG = "1024 + l_suppkey AS priming, l_partkey AS remainder, l_orderkey * 1000 + l_linenumber AS source"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN 'need' WHEN l_linenumber = 3 THEN 'absent' ELSE 'ready' END AS kind, CASE WHEN l_linenumber NOT IN (2, 3) THEN 146::BIGINT END AS size,
CASE WHEN l_linenumber NOT IN (2, 3) THEN priming END AS priming, CASE WHEN l_linenumber NOT IN (2, 3) THEN remainder END AS remainder, CASE WHEN l_linenumber NOT IN (2, 3) THEN source END AS source,
CASE l_linenumber WHEN 2 THEN 100 WHEN 3 THEN 150 ELSE 4 END::BIGINT AS rest FROM (SELECT *, {TAG} FROM lineitem)""")
def tags_read(spark, d):
    line = F.col("l_linenumber")
    tag = T.tag_bytes(1024 + F.col("l_suppkey"), F.col("l_partkey"), F.col("l_orderkey") * 1000 + line)
    whole = F.concat(tag, F.unhex(F.lit("FFF15080")))
    rows = read(spark, d, "lineitem").select(*LINE, F.when(line == 2, F.substring(whole, 1, 100)).when(line == 3, F.concat(F.unhex(F.lit("494432")), F.substring(whole, 4, 1000))).otherwise(whole).alias("content"))
    content, state = F.col("content"), F.col("state")
    known = rows.select(*LINE, "content", T.tag_state(content).alias("state")).select(*LINE, "content", "state", T.first_comment(content, state).alias("comment"))
    return known.select(*LINE, "state.kind", "state.size", "comment.priming", "comment.remainder", "comment.source", F.length(T.peeled(content, state)).cast("long").alias("rest"))


@query("""SELECT o_custkey, CASE count(*) WHEN 0 THEN 'missing' WHEN 1 THEN 'single' ELSE 'ambiguous' END AS kind, CASE WHEN count(*) = 1 THEN min(o_orderkey) END AS value FROM orders GROUP BY o_custkey""")
def tags_met(spark, d):
    g = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    met = T.of_several(F.col("n"), F.col("first"))
    return g.select("o_custkey", met["kind"].alias("kind"), met["value"].alias("value"))


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_orderkey * 10 AS n, l_partkey * 100 AS duration, l_suppkey * 90 AS start FROM lineitem),
a AS (SELECT *, CASE WHEN duration > 0 AND start <= duration THEN (duration - start) * 48000 // 44100 END AS available, greatest(ceil(ceil((n + 8) / 2.0) / 1024) + 1, ceil(({DELAY} + n) / 2048.0)) AS units FROM x)
SELECT l_orderkey, l_linenumber, available, CASE WHEN available < n AND l_linenumber % 2 = 0 THEN available ELSE n END AS samples, CAST(units * 2048 - {DELAY} - n AS BIGINT) AS remainder FROM a""")
def declared_lengths(spark, d):
    n, line = F.col("l_orderkey") * 10, F.col("l_linenumber")
    available = T.available_samples(F.col("l_partkey") * 100, F.col("l_suppkey") * 90, F.lit(48000), F.lit(44100))
    return read(spark, d, "lineitem").select(*LINE, available.alias("available"), T.capped_samples(n, available, line % 2 == 0).alias("samples"), T.delay_doubled(n, DELAY)["remainder"].alias("remainder"))


OFFSETS = "(VALUES " + ", ".join(f"({r}, {i}, {x})" for r, row in (R.START_OFFSETS | {k: R.START_OFFSETS[v] for k, v in R.SAME_OFFSETS.items()}).items() for i, x in enumerate(row)) + ") AS o(rate, start, off)"
RATES = [16000, 22050, 24000, 32000, 44100, 48000, 96000]
NEAR = "CAST(floor({} + 0.5) AS INTEGER)"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, {RATES}[l_linenumber] AS rate, l_partkey % 16 AS start, l_suppkey % 16 AS stop FROM lineitem),
s AS (SELECT DISTINCT rate, {NEAR.format('CASE WHEN rate < 32000 THEN 6000.0 WHEN rate < 64000 THEN 8000.0 ELSE 10000.0 END * 128.0 / rate')} AS least, {NEAR.format('CASE WHEN rate < 32000 THEN 3000.0 WHEN rate < 64000 THEN 4000.0 ELSE 5000.0 END * 128.0 / rate')} AS low FROM x),
b AS (SELECT rate, p, {NEAR.format('least * pow(64.0 / least, (p + 1) / 13.0)')} - {NEAR.format('least * pow(64.0 / least, p / 13.0)')} AS step FROM s, range(13) t(p)),
r AS (SELECT rate, step, row_number() OVER (PARTITION BY rate ORDER BY step) AS k FROM b),
c AS (SELECT s.rate, n.n AS n, coalesce(sum(step) FILTER (k <= n.n), 0) AS taken FROM s, range(14) n(n), r WHERE r.rate = s.rate GROUP BY s.rate, n.n)
SELECT l_orderkey, l_linenumber, CAST(low + off AS INTEGER) AS first, CAST(least(64, CASE stop WHEN 14 THEN 2 * (low + off) WHEN 15 THEN 3 * (low + off) ELSE s.least + taken END) AS INTEGER) AS last
FROM x JOIN s USING (rate) JOIN {OFFSETS} ON o.rate = x.rate AND o.start = x.start LEFT JOIN c ON c.rate = x.rate AND c.n = x.stop""")
def band_borders(spark, d):
    rate = F.get(F.array(*map(F.lit, RATES)), F.col("l_linenumber") - 1)
    first = R.first_band(rate, F.col("l_partkey") % 16)
    return read(spark, d, "lineitem").select(*LINE, first.cast("int").alias("first"), R.end_band(rate, F.col("l_suppkey") % 16, first).alias("last"))


@query("""WITH x AS (SELECT *, l_linenumber % 2 = 0 AS fine, l_quantity / 4 AS e, l_suppkey % 13 AS q, CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE 2.0 END AS a, CASE WHEN l_linenumber % 2 = 0 THEN 12.0 ELSE 24.0 END AS pan FROM lineitem)
SELECT l_orderkey, l_linenumber, round(64 * pow(2, e / a), 6) AS energy, round(pow(2, 6.0 - q), 9) AS noise, round(64 * pow(2, e / a + 1) / (1 + pow(2, (pan - q) / a)), 6) AS "left", round(64 * pow(2, e / a + 1) / (1 + 1 / pow(2, (pan - q) / a)), 6) AS "right",
round(pow(2, 7.0 - q) / (1 + pow(2, 12.0 - q)), 9) AS noise_left FROM x""")
def scale_energies(spark, d):
    fine, e, q = F.col("l_linenumber") % 2 == 0, F.col("l_quantity") / 4, F.col("l_suppkey") % 13
    both, noise = R.coupled_envelope(e, q, fine), R.coupled_noise(q, q)
    return read(spark, d, "lineitem").select(*LINE, F.round(R.envelope_energy(e, fine), 6).alias("energy"), F.round(R.noise_energy(q), 9).alias("noise"), F.round(both["left"], 6).alias("left"), F.round(both["right"], 6).alias("right"), F.round(noise["left"], 9).alias("noise_left"))


TABLE = [x for row in R.BANDWIDTHS for x in row]


@query(f"""WITH x AS (SELECT event_id, user_id, CAST(event_id % 4 AS INTEGER) AS mode, lag(CAST(event_id % 4 AS INTEGER), 1, 0) OVER w AS was, lag(event_id % 3) OVER w AS geo_was, event_id % 3 AS geo, (event_id % 100) / 100.0 AS bw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, {TABLE}[4 * was + mode + 1]::DOUBLE AS new FROM x), m AS (SELECT *, CASE WHEN new < bw THEN 0.75 * new + 0.25 * bw ELSE 0.90625 * new + 0.09375 * bw END AS mixed FROM n)
SELECT event_id, round(CASE WHEN mixed < 0.015625 THEN 0.0 ELSE mixed END, 9) AS bandwidth, geo IS DISTINCT FROM geo_was AS reset FROM m""")
def chirp_factors(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = read(spark, d, "events").select("event_id", (F.col("event_id") % 4).alias("mode"), (F.col("event_id") % 3).alias("geo"), "user_id", "ts", ((F.col("event_id") % 100) / 100.0).alias("bw"))
    x = x.withColumn("was", F.lag("mode", 1, 0).over(w)).withColumn("geo_was", F.lag("geo").over(w))
    return x.select("event_id", F.round(R.chirp(F.col("mode"), F.col("was"), F.col("bw")), 9).alias("bandwidth"), R.geometry_changed([F.col("geo")], [F.col("geo_was")]).alias("reset"))


@query("""WITH RECURSIVE a AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) > 0.15 AS attack FROM embeddings),
s AS (SELECT vec_id, -1::BIGINT AS i, 0 AS state FROM embeddings UNION ALL
SELECT s.vec_id, a.i, CASE WHEN state IN (0, 3) THEN CASE WHEN attack THEN 1 ELSE 0 END WHEN state = 1 OR attack THEN 2 ELSE 3 END FROM s JOIN a ON a.vec_id = s.vec_id AND a.i = s.i + 1)
SELECT vec_id, i AS block, state AS shape FROM s WHERE i >= 0""")
def block_switching(spark, d):
    shapes = C.block_shapes(F.transform("embedding", lambda x: x > F.lit(0.15).cast("float")))
    return read(spark, d, "embeddings").select("vec_id", F.posexplode(shapes).alias("block", "shape")).select("vec_id", F.col("block").cast("long").alias("block"), "shape")


@query("""WITH g AS (SELECT l_orderkey, list(c ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS c FROM (SELECT *, l_suppkey % 17 AS c FROM lineitem) GROUP BY l_orderkey)
SELECT l_orderkey, CAST(list_sum(c) - c[1] AS BIGINT) AS rest, CAST(coalesce(list_position([list_sum(c[1:k]) >= 20 for k in range(1, len(c) + 1)], true) - 1, len(c)) AS BIGINT) AS fits FROM g""")
def cost_ranges(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    g = read(spark, d, "lineitem").groupBy("l_orderkey").agg(parts.alias("p")).select("l_orderkey", F.transform("p", lambda x: x["l_suppkey"] % 17).alias("c"))
    g = g.withColumn("sums", F.aggregate("c", F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))))
    return g.select("l_orderkey", C.range_cost(F.col("sums"), F.lit(1), F.size("c")).alias("rest"), C.smallest_true(F.transform(F.slice("sums", F.lit(2), F.size("c")), lambda s: s >= 20)).alias("fits"))


@query("""WITH x AS (SELECT vec_id, i, abs(CAST(v AS DOUBLE)) AS p, lag(abs(CAST(v AS DOUBLE))) OVER (PARTITION BY vec_id ORDER BY i) AS was FROM (SELECT vec_id, unnest(embedding[1:8]) AS v, unnest(range(8)) AS i FROM embeddings))
SELECT vec_id, i, CAST(sum(CASE WHEN was IS NULL OR greatest(p, was) <= 0.05 OR greatest(p, was) <= 2.0 * least(p, was) THEN 0 ELSE 1 END) OVER (PARTITION BY vec_id ORDER BY i) AS INTEGER) AS run FROM x""")
def window_merging(spark, d):
    """Eight short windows of a frame."""
    runs = C.merged_runs(F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double"))), 0.05, 2.0)
    return read(spark, d, "embeddings").select("vec_id", F.posexplode(runs).alias("i", "run")).select("vec_id", F.col("i").cast("long").alias("i"), "run")


CATEGORIES = ["speech-voiced", "tonal-music", "dense-music", "ambient", "percussion-transient"]


@query(f"""SELECT event_id, CASE WHEN profile <> 'lc' THEN NULL WHEN bps > 96000 AND category NOT IN ('speech-voiced', 'percussion-transient') AND bps >= 128000 AND category IN ('tonal-music', 'dense-music') THEN 'BS.1116-3' ELSE 'MUSHRA' END AS method,
CASE WHEN rate = 0 OR planes = 0 OR planes <> 1 + user_id % 2 OR n = 0 THEN 'unscorable' WHEN value < 5 THEN 'silent' WHEN planes = 2 AND event_id % 7 = 0 THEN 'channel swap' WHEN valid = 0 OR valid < 0.5 * n THEN 'truncated' WHEN delay >= 64 THEN 'delayed' ELSE 'scored' END AS outcome,
CASE WHEN rate = 0 OR planes = 0 OR planes <> 1 + user_id % 2 OR n = 0 THEN 'unscorable' WHEN value < 5 THEN 'silent' WHEN planes = 2 AND event_id % 7 = 0 THEN 'channel swap' WHEN valid = 0 OR valid < 0.5 * n THEN 'truncated' ELSE 'scored' END AS encoded
FROM (SELECT *, {CATEGORIES}[event_id % 5 + 1] AS category, CASE WHEN event_id % 11 = 0 THEN 'he' ELSE 'lc' END AS profile, (event_id % 9) * 32000 AS bps, event_id % 13 AS rate, event_id % 3 AS planes, event_id % 50 AS n, event_id % 37 AS valid, event_id % 128 AS delay FROM events)""")
def study_ladders(spark, d):
    e = F.col("event_id")
    category = F.get(F.array(*map(F.lit, CATEGORIES)), (e % 5).cast("int"))
    method = C.listening_method(category, (e % 9) * 32000, F.when(e % 11 == 0, "he").otherwise("lc"))
    args = (e % 13, e % 3, 1 + F.col("user_id") % 2, e % 50, F.lit(1), F.col("value"), F.lit(9.0), e % 7 == 0, e % 37, e % 128, 5.0)
    return read(spark, d, "events").select("event_id", method.alias("method"), C.score_outcome(*args).alias("outcome"), C.score_outcome(*args, delay_allowed=True).alias("encoded"))


@query("""SELECT vec_id, arg_max(i, (v, -i)) AS lag FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings) WHERE abs(i - (20 + label)) <= 6 GROUP BY vec_id""")
def refined_lags(spark, d):
    return read(spark, d, "embeddings").select("vec_id", C.best_lag(F.col("embedding"), 20 + F.col("label"), 6).alias("lag"))
