"""Joins, de-duplication and batches on the FIXTURES.md edge rows."""

import pytest

from vetta.operators import tables as TB
from vetta.operators import ordering as O


def test_keep_first_nulls_equal(spark):
    df = spark.createDataFrame(
        [(1, "u1", "t", "g"), (2, "u1", "t", "g"), (3, "u2", "t", "g"),
         (4, None, "t", None), (5, None, "t", None)], "id long, name string, text string, gmap_id string")
    got = sorted(r.id for r in TB.keep_first(df, ["name", "text", "gmap_id"], "id").collect())
    assert got == [1, 3, 4]


def test_join_business_fanout_and_null_safe(spark):
    rev = spark.createDataFrame([(1, "g1", "a"), (2, "gX", "b"), (3, None, "c")],
                                "id long, gmap_id string, name string")
    meta = spark.createDataFrame([("g1", "B1"), ("g1", "B1 again"), (None, "Bnull")],
                                 "gmap_id string, name string")
    j = TB.join_business(rev, meta, null_safe=True)
    assert set(j.columns) == {"id", "gmap_id", "name_x", "name_y"}
    assert sorted((r.id, r.name_y) for r in j.collect()) == [(1, "B1"), (1, "B1 again"), (3, "Bnull")]
    assert TB.join_business(rev, meta).count() == 2


def test_prompt_pairs_last_wins(spark):
    rev = spark.createDataFrame([(1, "m1"), (2, "m2")], "id long, user_message string")
    lab = spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "job_id long, seq int, toxicity int")
    got = TB.prompt_pairs(rev, lab, ["toxicity"]).collect()
    assert [(r.id, r.toxicity) for r in got] == [(1, 1)]


def test_attach_ids_mismatch(spark):
    b = spark.createDataFrame([(0, [10, 11, 12]), (1, [13, 14])], "batch_no long, ids array<long>")
    o = spark.createDataFrame([(0, [("1",), ("0",)]), (1, [("1",), ("1",)])],
                              "batch_no long, items array<struct<spam:string>>")
    good, bad = TB.attach_ids(b, o)
    assert sorted((r.job_id, r.spam) for r in good.collect()) == [(13, "1"), (14, "1")]
    assert [(r.batch_no, r.n_ids, r.n_outputs) for r in bad.collect()] == [(0, 3, 2)]


def test_distinct_keeps_opposite_labels(spark):
    df = spark.createDataFrame([("t", 0), ("t", 1), ("t", 1)], "text string, unsafe_label int")
    assert df.distinct().count() == 2


def test_batches_and_pending(spark):
    df = spark.createDataFrame([(i, f"msg {i}") for i in range(45)], "id long, user_message string")
    b = O.assemble_batches(df, size=20, seed=42).orderBy("batch_no").collect()
    assert [r.n for r in b] == [20, 20, 5]
    assert b[0].prompt.startswith("<Job 1>\nmsg ") and "</Job 20>" in b[0].prompt
    ids = [int(x) for r in b for x in r.ids.split(",")]
    assert sorted(ids) == list(range(45))
    assert [r.next_checkpoint for r in b] == [20, 40, 45]
    batches = O.assemble_batches(df, size=20, seed=42)
    done = batches.filter("batch_no = 0").select("batch_no")
    assert sorted(r.batch_no for r in O.pending_batches(batches, done).collect()) == [1, 2]


def test_bounded_broadcast_falls_back(spark):
    small = spark.range(5)
    big = spark.range(1000)
    assert TB.bounded_broadcast(small, 10).count() == 5
    assert TB.bounded_broadcast(big, 10).count() == 1000


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_dense_index_equals_row_number(spark, parts):
    from pyspark.sql import functions as F, Window
    df = spark.range(0, 2000).select(F.col("id"), (F.col("id") * 7919 % 13).alias("g"),
                                     (F.col("id") * 104729 % 1000).alias("v"))
    got = O.dense_index(df, ["v", "id"], by=["g"], out="i", group_size="n", partitions=parts)
    exp = df.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")) - 1)
    a = {(r.id, r.i) for r in got.collect()}
    b = {(r.id, r.i) for r in exp.collect()}
    assert a == b
    sizes = {(r.g, r.n) for r in got.select("g", "n").distinct().collect()}
    assert sizes == {(r.g, r["count"]) for r in df.groupBy("g").count().collect()}


def test_null_strata_stay(spark):
    df = spark.createDataFrame([(i, [None, "a", "b"][i % 3], f"text {i}") for i in range(30)], "id long, g string, t string")
    parts = O.split(df, "id", 0.7, 1, stratify="g")
    counts = {(r.g, r.split): r["count"] for r in parts.groupBy("g", "split").count().collect()}
    assert counts == {(g, s): n for g in (None, "a", "b") for s, n in (("train", 7), ("test", 3))}
    folded = O.folds(df, "id", 5, 1, stratify="g")
    assert folded.count() == 30 and {r["count"] for r in folded.groupBy("g", "fold").count().collect()} == {2}
    assert O.split(df, "id", 1.0).filter("split = 'train'").count() == 30
    assert O.split(df, "id", 0.0).filter("split = 'test'").count() == 30


def test_prepare_reviews_is_one_row_a_review_on_any_partitioning(spark):
    from vetta.plans import jobs as J
    rev = spark.createDataFrame([(1, "g", "ann", "fine", 4.0, None), (2, "g", "bob", "ok", 3.0, None)],
                                "id long, gmap_id string, name string, text string, rating double, resp string")
    meta = [("g", "B", ["x"], "d"), ("g", "A", ["y"], "d"), ("g", "A", ["y"], "d")]
    for n in (1, 2, 3):
        m = spark.createDataFrame(meta, "gmap_id string, name string, category array<string>, description string").repartition(n)
        got = J.prepare_reviews(rev, m).orderBy("id").collect()
        assert [(r.id, r.business_name) for r in got] == [(0, "A"), (1, "A")]


def test_prepare_reviews_moves_the_text_to_the_rows_that_stay_only(spark, monkeypatch):
    from vetta.plans import jobs as J
    rows = [(7, "g", "ann", "fine", 4.0, None), (7, "g", "ann", "fine", 4.0, None), (7, "g", "bob", "fine", 4.0, None),
            (9, "g", "ann", "fine", 2.0, None), (9, "h", "ann", "other", 2.0, None), (None, "g", "eve", "null id", 1.0, None),
            (5, "g", "ann", None, 2.0, None), (11, "x", "ann", "no such business", 2.0, None)]
    rev = spark.createDataFrame(rows, "id long, gmap_id string, name string, text string, rating double, resp string")
    meta = spark.createDataFrame([("g", "G", ["x", "y"], "d"), ("h", "H", [], None)],
                                 "gmap_id string, name string, category array<string>, description string")
    seen = []
    for name in ("join_business", "keep_first", "dense_index"):
        own = getattr(J, name)
        monkeypatch.setattr(J, name, lambda df, *a, _own=own, **k: seen.append(dict(df.dtypes)) or _own(df, *a, **k))
    got = J.prepare_reviews(rev, meta).orderBy("id").collect()
    assert [r.id for r in got] == [0, 1, 2, 3] and got[0].review == "null id"
    assert sorted((r.business_name, r.review) for r in got) == [("G", "fine"), ("G", "fine"), ("G", "null id"), ("H", "other")]
    assert all(r.review in r.user_message for r in got)
    assert [t.get("text", t.get("review")) for t in seen] == ["binary"] * 3


def test_blank_rows_leave_the_head_table(spark):
    from vetta.plans import jobs as J
    rows = [(1, "1", "0", "some text"), (2, " ", None, "\t"), (3, "x", "0", "text")]
    lines, bad = J.head_training_table(spark.createDataFrame(rows, "doc_id long, spam string, ad string, text string"),
                                       categories=["spam", "ad"])
    assert {r.doc_id for r in lines.collect()} == {1} and [r.doc_id for r in bad.collect()] == [3]
