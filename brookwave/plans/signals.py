"""Queries on arrays and evaluations: embeddings stand for planes and spectra, events for timings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import Window

from brookwave.operators import evaluation as E
from brookwave.operators import spectra as P
from brookwave.plans.shared import read

QUERIES, SQL = {}, {}
OFFSETS = [0, 4, 8, 16, 24, 32, 48, 63, 64]
CENTRES = [(a + b) / 2 * 375.0 for a, b in zip(OFFSETS, OFFSETS[1:], strict=False)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BANDS = "(VALUES " + ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(zip(OFFSETS, OFFSETS[1:], strict=False))) + ") AS b(band, lo, hi)"
FLAT = "SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings"
BAND_SQL = f"SELECT vec_id, CAST(band AS BIGINT) AS band, sum(CAST(x AS DOUBLE) * x) AS energy, max(abs(CAST(x AS DOUBLE))) AS peak, any_value(hi - lo) AS width FROM ({FLAT}) JOIN {BANDS} ON i >= lo AND i < hi GROUP BY vec_id, band"


def _by_band(df, *columns):
    """Arrays by band as rows."""
    zipped = F.arrays_zip(*columns)
    return df.select("vec_id", F.posexplode(zipped).alias("band", "z")).select("vec_id", F.col("band").cast("long").alias("band"), *(F.col(f"z.{c}") for c in columns))


@query(f"SELECT vec_id, band, round(energy, 6) AS energy, round(peak, 6) AS peak FROM ({BAND_SQL})")
def band_energy(spark, d):
    x = read(spark, d, "embeddings").withColumn("energy", P.band_energy(F.col("embedding"), OFFSETS)).withColumn("peak", P.band_peaks(F.col("embedding"), OFFSETS))
    return _by_band(x, "energy", "peak").select("vec_id", "band", F.round("energy", 6).alias("energy"), F.round("peak", 6).alias("peak"))


@query(f"""SELECT vec_id, CAST(band AS BIGINT) AS band, round(CASE WHEN n < 2 THEN 1.0 ELSE greatest(0.0, least(1.0, 10 * log10(greatest(least(gm / am, 1.0), 1e-12)) / -60.0)) END, 6) AS tonality
FROM (SELECT vec_id, band, count(*) AS n, exp(avg(ln(CAST(x AS DOUBLE) * x + 1e-20))) AS gm, avg(CAST(x AS DOUBLE) * x + 1e-20) AS am FROM ({FLAT}) JOIN {BANDS} ON i >= lo AND i < hi GROUP BY vec_id, band)""")
def band_tonality(spark, d):
    x = read(spark, d, "embeddings").withColumn("tonality", P.band_tonality(F.col("embedding"), OFFSETS))
    return _by_band(x, "tonality").select("vec_id", "band", F.round("tonality", 6).alias("tonality"))


SPREAD = ", ".join(f"({i}, {j}, {s!r}::DOUBLE)" for i, row in enumerate(P.spreading(CENTRES)) for j, s in enumerate(row))


@query(f"""SELECT vec_id, CAST(i AS BIGINT) AS band, round(sum(energy * s) / 501.19, 9) AS threshold FROM ({BAND_SQL}) JOIN (VALUES {SPREAD}) AS m(i, j, s) ON band = j GROUP BY vec_id, i""")
def masked_threshold(spark, d):
    x = read(spark, d, "embeddings").withColumn("threshold", P.masked_thresholds(P.band_energy(F.col("embedding"), OFFSETS), CENTRES))
    return _by_band(x, "threshold").select("vec_id", "band", F.round("threshold", 9).alias("threshold"))


@query(f"""WITH b AS (SELECT *, energy / 100 AS noise FROM ({BAND_SQL})), w AS (SELECT *, min(CASE WHEN noise > 0 THEN noise / width END) OVER (PARTITION BY vec_id) * 4.0 AS water FROM b)
SELECT vec_id, band, round(CASE WHEN greatest(noise, water * width) < energy THEN greatest(noise, water * width) ELSE 0.0 END, 8) AS target FROM w""")
def noise_targets(spark, d):
    x = read(spark, d, "embeddings").withColumn("energy", P.band_energy(F.col("embedding"), OFFSETS)).withColumn("noise", F.transform("energy", lambda e: e / 100))
    width = F.array(*(F.lit(float(b - a)) for a, b in zip(OFFSETS, OFFSETS[1:], strict=False)))
    return _by_band(x.withColumn("target", P.noise_targets(F.col("noise"), width, F.col("energy"), 8)), "target").select("vec_id", "band", F.round("target", 8).alias("target"))


PAIRS = "(SELECT a.vec_id, a.embedding AS l, b.embedding AS r FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"


def _pairs(spark, d):
    """Neighbours as left and right planes: one aggregation on the pair's number in place of a self-join."""
    e = read(spark, d, "embeddings")
    half = F.floor(F.col("vec_id") / 2).cast("long")
    g = e.groupBy((half * 2).alias("vec_id")).agg(F.max(F.when(F.col("vec_id") % 2 == 0, F.col("embedding"))).alias("l"), F.max(F.when(F.col("vec_id") % 2 == 1, F.col("embedding"))).alias("r"))
    return g.where("l is not null and r is not null")


PAIR_FLAT = f"SELECT vec_id, unnest(l) AS x, unnest(r) AS y, unnest(range(64)) AS i FROM {PAIRS}"


@query(f"""SELECT vec_id, CAST(band AS BIGINT) AS band, 3 * sum(pow((CAST(x AS DOUBLE) - y) / 2, 2)) < least(sum(CAST(x AS DOUBLE) * x), sum(CAST(y AS DOUBLE) * y)) AS ms FROM ({PAIR_FLAT}) JOIN {BANDS} ON i >= lo AND i < hi GROUP BY vec_id, band""")
def ms_decision(spark, d):
    x = _pairs(spark, d).withColumn("s", P.mid_side(F.col("l"), F.col("r"))["side"])
    x = x.withColumn("el", P.band_energy(F.col("l"), OFFSETS)).withColumn("er", P.band_energy(F.col("r"), OFFSETS)).withColumn("es", P.band_energy(F.col("s"), OFFSETS))
    return _by_band(x, "el", "er", "es").select("vec_id", "band", P.prefers_mid_side(F.col("el"), F.col("er"), F.col("es")).alias("ms"))


@query(f"SELECT vec_id, i, round((CAST(x AS DOUBLE) + y) / 2, 6) AS mid, round((CAST(x AS DOUBLE) - y) / 2, 6) AS side, round(CAST(x AS DOUBLE) * pow(0.5, (vec_id % 16) / 4.0), 6) AS right_is FROM ({PAIR_FLAT})")
def stereo_transform(spark, d):
    x = _pairs(spark, d).withColumn("m", P.mid_side(F.col("l"), F.col("r"))).withColumn("p", P.intensity(F.col("l"), F.col("vec_id") % 16))
    z = x.select("vec_id", F.posexplode(F.arrays_zip(F.col("m.mid").alias("mid"), F.col("m.side").alias("side"), F.col("p").alias("p"))).alias("i", "z"))
    return z.select("vec_id", F.col("i").cast("long").alias("i"), F.round("z.mid", 6).alias("mid"), F.round("z.side", 6).alias("side"), F.round("z.p", 6).alias("right_is"))


@query(f"SELECT vec_id // 10 AS clip, i AS place, round(coalesce(avg(CAST(x AS DOUBLE)) FILTER (label <> 3), avg(CAST(x AS DOUBLE))), 6) AS value FROM ({FLAT}) GROUP BY vec_id // 10, i")
def mono_mix_non_lfe(spark, d):
    e = read(spark, d, "embeddings").withColumn("clip", F.floor(F.col("vec_id") / 10).cast("long"))
    return P.mono(e, ["clip"], "embedding", F.col("label") == 3).select("clip", "place", F.round("value", 6).alias("value"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: isnan(x) OR abs(x) > 0.4)) = 0 AS ok FROM embeddings")
def pcm_domain_reject(spark, d):
    return read(spark, d, "embeddings").select("vec_id", P.in_domain(F.transform("embedding", lambda x: (x.cast("double") / 0.4))).alias("ok"))


IMDCT_SQL = f"SELECT vec_id, n.n AS i, round(2.0 / 32 * sum(CAST(x AS DOUBLE) * cos(2 * pi() / 32 * (n.n + 8.5) * (i + 0.5))), 6) AS y FROM ({FLAT}), range(32) n(n) WHERE i < 16 GROUP BY vec_id, n.n"


@query(IMDCT_SQL)
def imdct_naive(spark, d):
    y = P.imdct(F.slice("embedding", 1, 16), 32)
    return read(spark, d, "embeddings").select("vec_id", F.posexplode(y).alias("i", "y")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("y", 6).alias("y"))


@query(f"SELECT vec_id, k.k AS k, round(2.0 * sum(CAST(x AS DOUBLE) * cos(2 * pi() / 64 * (i + 16.5) * (k.k + 0.5))), 5) AS y FROM ({FLAT}), range(32) k(k) GROUP BY vec_id, k.k")
def mdct_naive(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.posexplode(P.mdct(F.col("embedding"), 64)).alias("k", "y")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("y", 5).alias("y"))


@query(f"""WITH f AS ({FLAT}) SELECT a.vec_id, a.i, round(CAST(a.x AS DOUBLE) + coalesce(CAST(b.x AS DOUBLE), 0), 6) AS pcm FROM f a LEFT JOIN f b ON b.label = a.label AND b.i = a.i + 32
AND b.vec_id = (SELECT max(p.vec_id) FROM embeddings p WHERE p.label = a.label AND p.vec_id < a.vec_id) WHERE a.i < 32""")
def overlap_add(spark, d):
    e = read(spark, d, "embeddings").withColumn("block", F.transform("embedding", lambda x: x.cast("double")))
    y = P.overlap_added(e, "block", Window.partitionBy("label").orderBy("vec_id"))
    return y.select("vec_id", F.posexplode("pcm").alias("i", "pcm")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("pcm", 6).alias("pcm"))


@query(f"""SELECT vec_id, round(10 * log10(sum(CAST(x AS DOUBLE) * x) / sum(pow(CAST(x AS DOUBLE) - y, 2))), 6) AS snr, round(sqrt(avg(CAST(x AS DOUBLE) * x)), 6) AS rms, round(max(abs(CAST(x AS DOUBLE) - y)), 6) AS max_error, round(sum(CAST(x AS DOUBLE) * y), 6) AS dot FROM ({PAIR_FLAT}) GROUP BY vec_id""")
def snr_score(spark, d):
    l, r = F.col("l"), F.col("r")  # noqa: E741
    return _pairs(spark, d).select("vec_id", F.round(E.snr_db(l, r), 6).alias("snr"), F.round(E.rms(l), 6).alias("rms"), F.round(E.max_abs_error(l, r), 6).alias("max_error"), F.round(E.dot(l, r), 6).alias("dot"))


@query(f"""WITH f AS ({PAIR_FLAT}), s AS (SELECT a.vec_id, k.k AS lag, sum(CAST(a.x AS DOUBLE) * b.y) / sqrt(sum(CAST(a.x AS DOUBLE) * a.x) * sum(CAST(b.y AS DOUBLE) * b.y)) AS c FROM f a, range(-8, 9) k(k), f b WHERE b.vec_id = a.vec_id AND b.i = a.i + k.k GROUP BY a.vec_id, k.k)
SELECT vec_id, lag, round(c, 6) AS c FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 9) DESC, abs(lag), lag) AS n FROM s) WHERE n = 1""")
def estimate_delay_topk(spark, d):
    s = _pairs(spark, d).select("vec_id", E.lag_scores(F.col("l"), F.col("r"), 8, 64).alias("s"))
    best = F.array_max(F.transform("s", lambda x: F.struct(F.round(x["c"], 9).alias("r"), (-F.abs(x["lag"])).alias("n"), (-x["lag"]).alias("m"), x["c"].alias("c"))))
    return s.select("vec_id", best.alias("b")).select("vec_id", (-F.col("b.m")).alias("lag"), F.round("b.c", 6).alias("c"))


@query("""WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events), m AS (SELECT user_id, max(p) AS last FROM e GROUP BY user_id),
h AS (SELECT user_id, unnest(range(0, last // 4 + 1)) AS hop FROM m) SELECT h.user_id, h.hop, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rms FROM h JOIN e ON e.user_id = h.user_id AND p >= hop * 4 AND p < hop * 4 + 16 GROUP BY h.user_id, h.hop""")
def envelope_sliding(spark, d):
    e = read(spark, d, "events").withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1)
    return E.sliding_rms(e, ["user_id"], "p", "value", 4, 16).select("user_id", "hop", "n", F.round("rms", 6).alias("rms"))


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type) SELECT event_type, len(v) AS n, round((v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) / 2, 6) AS median, v[CAST(round((len(v) - 1) * 0.95) AS BIGINT) + 1] AS p95 FROM s""")
def bench_median_p95(spark, d):
    return E.median_and_p95(read(spark, d, "events"), ["event_type"], "value").select("event_type", "n", F.round("median", 6).alias("median"), "p95")


@query("""SELECT event_type, list_sort(list(value))[CAST(greatest(1, ceil(count(*) * 0.9)) AS BIGINT)] AS value FROM events GROUP BY event_type""")
def nearest_rank_p90(spark, d):
    return E.nearest_rank(read(spark, d, "events"), ["event_type"], "value", 0.9)


@query("""SELECT user_id, round(avg(value) FILTER (event_id % 2 = 1) / avg(value) FILTER (event_id % 2 = 0), 6) AS ratio, count(*) FILTER (event_id % 2 = 0) = count(*) FILTER (event_id % 2 = 1) AS same FROM events GROUP BY user_id""")
def ratio_join_hash_check(spark, d):
    odd = F.col("event_id") % 2 == 1
    return read(spark, d, "events").groupBy("user_id").agg(F.round(F.avg(F.when(odd, F.col("value"))) / F.avg(F.when(~odd, F.col("value"))), 6).alias("ratio"), (F.count_if(odd) == F.count_if(~odd)).alias("same"))


T_SQL = "CASE WHEN df < 1 THEN 12.706 " + " ".join(f"WHEN df <= {n1} THEN {t1 if n0 == n1 else f'{t0} + (df - {n0}) / ({n1} - {n0}.0) * ({t1} - {t0})'}" for (n0, t0), (n1, t1) in zip(E.T975[:1] + E.T975, E.T975, strict=False)) + " ELSE 1.96 END"


@query(f"SELECT user_id, df, round({T_SQL}, 6) AS t FROM (SELECT user_id, count(*) - 1 AS df FROM events GROUP BY user_id)")
def t_interp(spark, d):
    g = read(spark, d, "events").groupBy("user_id").agg((F.count("*") - 1).alias("df"))
    return g.select("user_id", "df", F.round(E.t975(F.col("df")), 6).alias("t"))


@query("""SELECT user_id, n_items, n_ref, n_anchor, n_ref / n_items <= 0.3 AND n_anchor / n_items <= 0.3 AS valid FROM (SELECT user_id, count(DISTINCT event_id % 12) AS n_items,
count(*) FILTER (event_type = 'view' AND value < 20) AS n_ref, count(*) FILTER (event_type = 'error' AND value > 150) AS n_anchor FROM events GROUP BY user_id)""")
def listener_screen(spark, d):
    e = read(spark, d, "events").withColumn("item", F.col("event_id") % 12)
    s = E.screened(e, "user_id", "item", (F.col("event_type") == "view") & (F.col("value") < 20), (F.col("event_type") == "error") & (F.col("value") > 150), 0.3)
    return s.select("user_id", "n_items", "n_ref", "n_anchor", "valid")


@query(f"""WITH p AS (SELECT user_id, event_id % 12 AS item, max(value) FILTER (event_type = 'view') AS a, max(value) FILTER (event_type = 'click') AS b FROM events GROUP BY user_id, event_id % 12),
l AS (SELECT user_id, avg(a - b) AS x FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY user_id), g AS (SELECT count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd FROM l),
t AS (SELECT *, n - 1 AS df FROM g), u AS (SELECT *, {T_SQL} * sd / sqrt(n) AS half FROM t) SELECT n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - half, 6) AS lo, round(mean + half, 6) AS hi FROM u""")
def paired_diff_ci(spark, d):
    e = read(spark, d, "events").withColumn("item", F.col("event_id") % 12)
    r = E.paired_interval(e, "user_id", "item", "event_type", "value", "view", "click")
    return r.select("n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "lo", "hi")))


@query("""SELECT d.source, count(*) AS n, count(*) = count(DISTINCT d.doc_id) AS ids_unique, count(l.doc_id) AS labelled, count(*) FILTER (d.lang NOT IN ('en', 'de', 'fr', 'es')) AS bad_lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source""")
def corpus_validate(spark, d):
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels").select(F.col("doc_id").alias("l_id"))
    j = docs.join(labels, docs["doc_id"] == labels["l_id"], "left")
    return j.groupBy("source").agg(F.count("*").alias("n"), (F.count("*") == F.count_distinct("doc_id")).alias("ids_unique"), F.count("l_id").alias("labelled"), F.count_if(~F.col("lang").isin("en", "de", "fr", "es")).alias("bad_lang"))


@query("""SELECT source FROM documents WHERE doc_id % 3 = 0 INTERSECT SELECT source FROM documents WHERE doc_id % 3 <> 0""")
def split_overlap_intersect(spark, d):
    docs = read(spark, d, "documents")
    return docs.where("doc_id % 3 = 0").select("source").intersect(docs.where("doc_id % 3 <> 0").select("source"))


@query("""SELECT l_orderkey, arg_min(book, (cost, book)) AS book, min(cost) AS cost FROM (SELECT l_orderkey, l_linenumber AS book, CAST(sum(l_suppkey % 16) AS BIGINT) AS cost FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY l_orderkey""")
def best_book(spark, d):
    cost = read(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("book")).agg(F.sum(F.col("l_suppkey") % 16).cast("long").alias("cost"))
    return cost.groupBy("l_orderkey").agg(F.min_by("book", F.struct("cost", "book")).alias("book"), F.min("cost").alias("cost"))


@query("""SELECT i, round(sin(pi() / 64 * (i + 0.5)), 9) AS w FROM range(32) t(i)""")
def sine_window(spark, d):
    return spark.range(32).select(F.col("id").alias("i"), F.round(F.sin(F.lit(math.pi / 64) * (F.col("id") + 0.5)), 9).alias("w"))
