import hashlib
import statistics

from pyspark.sql import functions as F

from brookwave.functions import limits as L
from brookwave.operators import studies as T
from brookwave.plans import studies
from tests.comparing import SF


def digest(seed, *parts):
    return hashlib.sha256("\0".join([seed, *map(str, parts)]).encode()).digest()


def test_session_orders_equal_the_loop(spark):
    for r in studies.session_orders(spark, SF).limit(40).collect():
        items = list(range(12))
        for i in range(11, 0, -1):
            j = int.from_bytes(digest("study", r.c_custkey, i)[:4], "big") % (i + 1)
            items[i], items[j] = items[j], items[i]
        assert r["items"] == items


def test_session_orders_draw_once_a_swap(spark):
    orders = studies.session_orders(spark, SF)
    assert orders._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    assert orders.rdd.getNumPartitions() > 1  # a small file is one task


def test_short_lists_stay(spark):
    x = spark.createDataFrame([([],), ([7],), (None,)], "items array<int>")
    assert [r[0] for r in x.select(T.seeded_order(F.col("items"), "s")).collect()] == [[], [7], None]


def test_budgets_at_their_bounds(spark):
    one = spark.range(1)
    verdict = lambda c, s: one.select(L.output_verdict(F.lit(c), F.lit(s), 8, 64)).first()[0]
    assert [verdict(2, 8), verdict(2, 9), verdict(9, 1), verdict(8, 1 << 62), verdict(None, 1)] == ["ok", "output", "channels", "output", "channels"]
    frames = lambda s: one.select(L.max_frames(F.lit(s), F.lit(48_000), 44_100)).first()[0]
    assert [frames(0.5), frames(-1.0), frames(float("nan")), frames(float("inf"))] == [22_050, 0, 0, (1 << 63) - 1]


def test_planes_at_their_edges(spark):
    one = spark.range(1).select(F.expr("array(0f, 0f, 0f)").alias("z"), F.expr("array(1f, 2f, 4f)").alias("x"))
    got = one.select(T.leading_quiet(F.col("z")), T.leading_quiet(F.col("x")), T.coherence(F.col("z"), F.col("x")), T.overlap(F.col("x"), F.col("x"), F.lit(5)).alias("o"), T.coupled(F.col("x"), F.expr("array(1f)"), F.expr("array(0.5d)"))).first()
    assert tuple(got)[:3] == (3, 0, 1.0) and got.o.a == [] and got[4] == [1.5, 2.0, 4.0]


def test_bootstrap_medians_equal_the_loop(spark):
    runs = {}
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        if r.value is not None:
            runs.setdefault(r.user_id, []).append(r.value)
    got = {r.user_id: r for r in studies.bootstrap_medians(spark, SF).collect()}
    assert got.keys() == runs.keys()
    for user in sorted(runs, key=lambda u: len(runs[u]))[:6]:
        x, state, medians = runs[user], 0x9E3779B9, []
        for _ in range(1000):
            drawn = []
            for _ in x:
                state = (state * 6364136223846793005 + 1) % (1 << 64)
                drawn.append(x[state % len(x)])
            medians.append(statistics.median(drawn))
        medians.sort()
        assert (got[user].n, got[user].lo, got[user].hi) == (len(x), medians[25], medians[974])


def test_resamples_do_not_depend_on_how_many_are_held(monkeypatch):
    import numpy as np

    from brookwave.operators import resampling

    x = np.random.default_rng(5).normal(size=37)
    whole = resampling.median_interval(x)
    monkeypatch.setattr(resampling, "DRAWS", 100)
    assert resampling.median_interval(x) == whole
    assert all(np.isnan(resampling.median_interval(x[:0])))
