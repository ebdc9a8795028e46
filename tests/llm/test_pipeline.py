import zlib

from tests.comparing import SF
from tests.llm.test_operators import brute_components, brute_hits


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from brookwave.llm.shared import read, stored

    docs = read(spark, SF, "documents")
    labels = {r.doc_id: r for r in read(spark, SF, "labels").collect()}
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for name, stage in cp.STAGES[:-1]:
        columns = docs.columns
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        assert after.items() <= before.items() and after
        if name == "near_dedup":
            component = {i: c for i, (_, c) in brute_components(before).items()}
            assert sorted(component[i] for i in after) == sorted(set(component.values()))
        elif name == "decontamination":
            assert set(after) == {i for i, t in before.items() if not brute_hits(t, items)[2]}
        else:
            good = {i for i in before if i in labels and (labels[i].toxic == 0 if name == "toxicity" else labels[i].quality == 1)}
            assert len(good & set(after)) >= 0.95 * len(good)
        before = after
    pieces = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(before)
    assert all(0 <= r.ids_crc32 < 1 << 32 for r in pieces) and zlib.crc32(b"") == 0
    assert cp.run(spark, SF).count() == len(pieces)


ODD = [(3, "a"), (7, "a"), (7, "b"), (9, "b+"), (11, "c"), (11, "c"), (None, "a"), (None, "d"), (13, None), (13, None), (14, "")]


def odd_docs(spark):
    base = {x: " ".join(f"{x}{k}" for k in range(60)) for x in "abcd"}
    text = lambda x: base["b"] + " more" if x == "b+" else base.get(x, x)
    rows = [(i, text(x), None, None, None, k, "clash") for k, (i, x) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_0 int, set_id string")


def test_near_dedup_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as cp

    docs = odd_docs(spark)
    got = cp.near_dedup_stage(spark, docs, SF)
    assert got.columns == docs.columns
    kinds = sorted((r.text or "-")[:1] + ("+" if (r.text or "").endswith("more") else "") for r in got.collect())
    assert [k.rstrip("+") for k in kinds] == ["-", "-", "-", "a", "b", "c", "d"]
    assert cp.near_dedup_stage(spark, docs.limit(0), SF).count() == 0


def test_rows_of_files_have_numbers_without_a_copy(spark, tmp_path):
    from brookwave.llm.near_duplicates import numbered, one_of_each

    odd_docs(spark).repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    rows = numbered(docs, "n")
    assert rows.select("n").distinct().count() == len(ODD) and "Join" in rows._jdf.queryExecution().analyzed().toString()
    assert sorted((r.text or "-")[:1] for r in one_of_each(docs).collect()) == ["-", "-", "-", "a", "b", "c", "d"]


def test_stages_with_odd_rows(spark):
    import corpus_pipeline as cp

    docs = odd_docs(spark)
    for name, stage in cp.STAGES:
        got = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name != "packing":
            assert got.columns == docs.columns and got.count() <= len(ODD)
            if name in ("toxicity", "decontamination"):
                assert got.count() == len(ODD)
        else:
            assert got.count() == len(ODD)
