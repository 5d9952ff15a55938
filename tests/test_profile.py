"""Profiles: any column name, order, top values, sketches, roll-ups with null groups."""

from pyspark.sql import functions as F

from vetta.operators import profile as PF


def odd(spark):
    return spark.createDataFrame([("x", 1, None), ("y", 1, 2.0), ("x", None, 2.0)], "`it's` string, `a.b` int, `c``d` double")


def test_any_column_name(spark):
    got = {tuple(r) for r in PF.value_counts(odd(spark)).collect()}
    assert got == {("it's", "x", 2), ("it's", "y", 1), ("a.b", "1", 2), ("c`d", "2.0", 2)}
    assert {tuple(r) for r in PF.null_summary(odd(spark)).collect()} == {("it's", 0), ("a.b", 1), ("c`d", 1)}
    assert [tuple(r) for r in PF.label_distribution(odd(spark), ["a.b"]).collect()] == [("a.b", 2, 3, 66.666667)]
    assert {(r.column, r.distinct, r.nulls) for r in PF.distinct_estimates(PF.value_sketches(odd(spark))).collect()} \
        == {("it's", 2, 0), ("a.b", 1, 1), ("c`d", 1, 1)}


def test_order_and_top_values(spark):
    df = spark.range(5000).select((F.col("id") % 70).cast("string").alias("v"), F.lit(None).cast("int").alias("none"))
    rows = PF.value_counts(df, ordered=True).collect()
    assert [r["count"] for r in rows] == sorted((r["count"] for r in rows), reverse=True) and len(rows) == 70
    top = PF.top_values(df, 5).orderBy("rank").collect()
    assert [(r["rank"], r.value, r["count"]) for r in top] == [(k + 1, r.value, r["count"]) for k, r in enumerate(rows[:5])]


def test_sketches_merge(spark):
    a, b = spark.range(0, 3000).select(F.col("id").alias("v")), spark.range(2000, 5000).select(F.col("id").alias("v"))
    both = PF.merge_sketches(PF.value_sketches(a).unionByName(PF.value_sketches(b)))
    row = PF.distinct_estimates(both).first()
    assert row.rows == 6000 and abs(row.distinct - 5000) < 250
    assert PF.distinct_estimates(PF.value_sketches(a.limit(0))).first().distinct == 0


def test_rollup_keeps_null_groups_apart_from_totals(spark):
    df = spark.createDataFrame([("s", 1, 1), ("s", None, 0), (None, 1, 1), (None, 1, None)], "src string, cls int, spam int")
    got = {(r.level, r.src, r.cls): (r.positives, r.rows, r.pct) for r in PF.label_rollup(df, ["spam"], ["src", "cls"]).collect()}
    assert got == {("src,cls", "s", 1): (1, 1, 100.0), ("src,cls", "s", None): (0, 1, 0.0), ("src,cls", None, 1): (1, 2, 50.0),
                   ("src", "s", None): (1, 2, 50.0), ("src", None, None): (1, 2, 50.0), ("cls", None, 1): (2, 3, 66.666667),
                   ("cls", None, None): (0, 1, 0.0), ("", None, None): (2, 4, 50.0)}


def test_a_score_that_is_no_number_is_quarantined(spark):
    from vetta.operators.cascade import STAGE2_HEADS, STAGE3_LABELS, cascade_rules
    cols = ["safety_prob", *[f"{h}_prob" for h in STAGE2_HEADS], *[f"{x}_prob" for x in STAGE3_LABELS]]
    nan = float("nan")
    rows = [(k, *[nan if j == k else 0.1 for j in range(len(cols))]) for k in range(len(cols) + 1)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in cols))
    got = {r.id: r for r in cascade_rules(df).collect()}
    for k, c in enumerate(cols):
        assert (got[k].decision, got[k].reasons) == ("quarantine", [f"no {c}"]), c
        assert got[k].stage == (1 if k == 0 else 2 if k <= len(STAGE2_HEADS) else 3)
    assert got[len(cols)].decision == "accept"
