"""Numbering, shuffles, folds, caps and batches where order keys repeat or are null."""

from collections import Counter

from pyspark.sql import functions as F

from vetta.operators import ordering as O

ROWS = [(1, "a", None), (1, "a", None), (1, "b", None), (2, "c", 3), (None, "d", 3), (None, "d", 3), (None, None, 3)]
SCHEMA = "id long, t string, g long"


def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def content(rows):
    return Counter((r.id, r.t, r.g) for r in rows)


def test_each_row_gets_one_position(spark):
    got = O.dense_index(table(spark), ["id"]).collect()
    assert content(got) == Counter(ROWS)
    assert sorted(r.idx for r in got) == list(range(7))
    ids = [r.id for r in sorted(got, key=lambda r: r.idx)]
    assert ids == [None, None, None, 1, 1, 1, 2]
    down = [r.id for r in sorted(O.dense_index(table(spark), ["-id"]).collect(), key=lambda r: r.idx)]
    assert down == [2, 1, 1, 1, None, None, None]


def test_positions_restart_in_groups(spark):
    got = O.dense_index(table(spark), ["id"], by=["g"], group_size="n").collect()
    assert content(got) == Counter(ROWS)
    for g, n in ((None, 3), (3, 4)):
        assert sorted(r.idx for r in got if r.g == g) == list(range(n)) and {r.n for r in got if r.g == g} == {n}


def test_positions_do_not_depend_on_the_partitions(spark):
    a = O.dense_index(table(spark).repartition(5), ["id"], partitions=3).collect()
    b = O.dense_index(table(spark).coalesce(1), ["id"], partitions=1).collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))


def test_only_key_columns(spark):
    got = O.dense_index(table(spark).select("id"), ["id"]).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.idx)] == [None, None, None, 1, 1, 1, 2]


def test_users_keep_their_rows(spark):
    df = table(spark)
    assert O.head_rows(df, ["id"], 2).count() == 2 and O.head_rows(df, ["id"], 99).count() == 7
    assert content(O.shuffle_order(df, "id").collect()) == Counter(ROWS)
    got = O.folds(df, "id", 3)
    assert content(got.collect()) == Counter(ROWS)
    assert sorted(r["count"] for r in got.groupBy("fold").count().collect()) == [2, 2, 3]
    by = O.folds(df, "id", 2, stratify="g").groupBy("g", "fold").count().collect()
    assert Counter({(r.g, r.fold): r["count"] for r in by}) == {(None, 0): 2, (None, 1): 1, (3, 0): 2, (3, 1): 2}
    batches = O.assemble_batches(df.fillna({"t": ""}), "id", "t", size=3).orderBy("batch_no").collect()
    assert [r.n for r in batches] == [3, 3, 1] and batches[-1].next_checkpoint == 7


def test_a_frequent_row_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(O, "COPIES", 10)
    df = spark.range(2000).select(F.lit(1).alias("id"), F.lit("x").alias("t"), F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    got = O.dense_index(df, ["id"])
    assert sorted(r.idx for r in got.select("idx").collect()) == list(range(2000))
    assert sorted(r["count"] for r in O.folds(df, "id", 3).groupBy("fold").count().collect()) == [666, 667, 667]


def test_records_attach_to_repeated_batches(spark):
    recs = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z")], "batch_no long, v string")
    got = O.dense_index(recs, ["batch_no"], by=["batch_no"], out="pos").collect()
    assert Counter((r.batch_no, r.pos) for r in got) == Counter([(1, 0), (1, 1), (1, 2), (2, 0)])
