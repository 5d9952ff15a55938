"""Splits and folds are exact and disjoint; metrics match brute force."""

from pyspark.sql import functions as F

from vetta.operators import metrics as MX
from vetta.operators import ordering as O


def test_stratified_split_exact(spark):
    df = spark.range(0, 103).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    df = df.union(spark.createDataFrame([(1000, 2)], "id long, y int"))  # a label with one row
    s = O.split(df, "id", 0.75, 42, stratify="y").collect()
    assert len(s) == 104
    by = {}
    for r in s:
        by.setdefault(r.y, []).append(r.split)
    for y, parts in by.items():
        assert parts.count("train") == int(len(parts) * 0.75)


def test_split_cut_is_floor(spark):
    df = spark.range(0, 11)
    s = O.split(df, "id", 0.9, 1, first="train", second="eval")
    assert s.filter("split = 'train'").count() == 9  # int(11 * 0.9)


def test_folds_balanced(spark):
    df = spark.range(0, 30).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    f = O.folds(df, "id", 3, 42, "y").groupBy("fold", "y").count().collect()
    sizes = {}
    for r in f:
        sizes.setdefault(r.y, []).append(r["count"])
    assert sorted(sizes[1]) == [3, 3, 4] and sorted(sizes[0]) == [6, 7, 7]


def test_seeded_shuffle_reproducible(spark):
    df = spark.range(0, 50)
    a = [r.id for r in O.shuffle_order(df, "id", 42).orderBy("idx").collect()]
    b = [r.id for r in O.shuffle_order(df, "id", 42).orderBy("idx").collect()]
    c = [r.id for r in O.shuffle_order(df, "id", 7).orderBy("idx").collect()]
    assert a == b and a != c and sorted(a) == list(range(50))


def test_binary_report_warnings(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 0)], "truth int, pred int")
    r = MX.binary_report(df).first()
    assert (r.tp, r.fn, r.fp, r.tn) == (0, 0, 1, 2)
    assert r.precision == 0.0 and r.recall == 0.0 and r.no_positive_truth and not r.no_negative_truth


def test_multilabel_report_omits_label(spark):
    df = spark.createDataFrame([(1, 1, 0, 0), (0, 0, 0, 1)], "a int, a_pred int, b int, b_pred int")
    r = MX.multilabel_report(df, ["a", "b"]).first()
    assert r.a_accuracy == 1.0 and r.a_f1 == 1.0
    assert r.b_accuracy is None and r.b_f1 is None
    assert r.overall_accuracy == 0.5


def test_classification_report_brute_force(spark):
    import random
    random.seed(3)
    rows = [(random.randint(0, 1), random.random()) for _ in range(200)]
    df = spark.createDataFrame(rows, "truth int, prob double")
    rep = {r["class"]: r for r in MX.classification_report(df, "truth", "prob", 0.5).collect()}
    pred = [int(p >= 0.5) for _, p in rows]
    truth = [t for t, _ in rows]
    tp = sum(1 for t, p in zip(truth, pred) if t == 1 and p == 1)
    fp = sum(1 for t, p in zip(truth, pred) if t == 0 and p == 1)
    fn = sum(1 for t, p in zip(truth, pred) if t == 1 and p == 0)
    tn = len(rows) - tp - fp - fn
    assert rep["1"].precision == round(tp / (tp + fp), 6)
    assert rep["0"].recall == round(tn / (tn + fp), 6)
    assert rep["accuracy"].f1 == round((tp + tn) / len(rows), 6)
    assert rep["1"].support == tp + fn


def test_bce_loss(spark):
    import math
    df = spark.createDataFrame([(1, 0.9, 0, 0.2)], "a int, a_prob double, b int, b_prob double")
    got = MX.bce_loss(df, ["a", "b"]).first()[0]
    assert abs(got - (-(math.log(0.9)) - math.log(0.8)) / 2) < 1e-6
