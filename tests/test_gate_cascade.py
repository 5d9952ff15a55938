"""Head decisions, OR gate and cascade rules; stream equals batch."""

import pytest
from pyspark.sql import functions as F

from vetta.operators.cascade import cascade, cascade_rules, verdict_summary
from vetta.operators.gate import fire_top1, or_gate, or_gate_wide


def test_head_fire_truth_table(spark):
    df = spark.createDataFrame([("__label__pos", 0.51), ("__label__pos", 0.70),
                                ("__label__pos", 0.69), ("__label__neg", 0.9)], "label string, prob double")
    none = [r[0] for r in df.select(fire_top1("label", "prob")).collect()]
    t07 = [r[0] for r in df.select(fire_top1("label", "prob", 0.7)).collect()]
    assert none == [True, True, True, False]
    assert t07 == [False, True, False, False]


def scores(spark):
    rows = [(1, "ad", "__label__neg", 0.9), (1, "rant", "__label__neg", 0.8),
            (2, "ad", "__label__pos", 0.9), (2, "rant", "__label__pos", 0.8),
            (3, "ad", "__label__pos", 0.65), (3, "rant", "__label__neg", 0.6),
            (4, "spam", "__label__pos", 0.99), (4, "ad", "__label__neg", 0.7)]
    return spark.createDataFrame(rows, "id long, head string, label string, prob double")


def test_or_gate_settings(spark):
    settings = spark.createDataFrame([("ad", 0.6, True), ("spam", None, False)],
                                     "head string, threshold double, enabled boolean")
    g = {r.id: (r.decision, r.fired) for r in
         or_gate(scores(spark), ["spam", "ad", "rant"], settings, 0.7).collect()}
    assert g[1] == ("good", [])
    assert g[2] == ("bad", ["ad", "rant"])
    assert g[3] == ("bad", ["ad"])        # per-head threshold 0.6 wins over default 0.7
    assert g[4] == ("good", [])           # the firing head is disabled


def test_or_gate_all_disabled(spark):
    settings = spark.createDataFrame([("ad", None, False), ("rant", None, False)],
                                     "head string, threshold double, enabled boolean")
    with pytest.raises(ValueError):
        or_gate(scores(spark), ["ad", "rant"], settings, 0.7)
    with pytest.raises(ValueError):
        or_gate_wide(spark.range(1), ["ad"], disabled=["ad"])


def _probs(spark):
    cols = "id long, safety_prob double, ad_prob double, irrelevant_prob double, rant_prob double, " \
           "unsafe_prob double, advertisement_prob double, irrelevant_content_prob double, " \
           "non_visitor_rant_prob double, toxicity_prob double"
    rows = [(1, 0.9, 0, 0, 0, 0, 0, 0, 0, 0),
            (2, 0.1, 0.8, 0, 0, 0, 0, 0, 0, 0),
            (3, 0.1, 0.6, 0, 0, 0, 0.7, 0, 0, 0),
            (4, 0.5, 0.69, 0, 0, 0, 0.5, 0, 0, 0)]
    rows = [tuple([r[0]] + [float(x) for x in r[1:]]) for r in rows]
    return spark.createDataFrame(rows, cols)


def test_cascade_rules_fixture(spark):
    v = {r.id: (r.stage, r.decision) for r in cascade_rules(_probs(spark)).collect()}
    assert v == {1: (1, "reject"), 2: (2, "reject"), 3: (3, "reject"), 4: (3, "accept")}


def test_model_cascade_scores_survivors_only(spark):
    probs = _probs(spark)
    seen = {}

    def stage(cols, name):
        def run(df):
            seen[name] = df
            return df.join(probs.select("id", *cols), "id")
        return run

    v = cascade(probs.select("id", F.lit("words").alias("text")), stage(["safety_prob"], 1),
                stage(["ad_prob", "irrelevant_prob", "rant_prob", "unsafe_prob"], 2),
                stage(["advertisement_prob", "irrelevant_content_prob", "non_visitor_rant_prob",
                       "toxicity_prob"], 3))
    got = {r.id: (r.stage, r.decision) for r in v.collect()}
    assert got == {1: (1, "reject"), 2: (2, "reject"), 3: (3, "reject"), 4: (3, "accept")}
    assert sorted(r.id for r in seen[3].filter("text <> ''").collect()) == [3, 4]
    counts = verdict_summary(v).agg(F.sum("reviews")).first()[0]
    assert counts == 4


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    d = "/root/testdata/sf0.001"
    a = sorted(tuple(r) for r in q["t1_stream_moderation"](spark, d).select(
        "id", "stage", "decision", "safety_prob", "fired_heads", "reasons").collect())
    b = sorted(tuple(r) for r in q["c1_cascade_rules"](spark, d).select(
        "id", "stage", "decision", "safety_prob", "fired_heads", "reasons").collect())
    assert a == b and len(a) == 200


def test_missing_scores_are_quarantined(spark):
    probs = _probs(spark)
    one = probs.filter("id = 4")
    cases = [one.withColumn("id", F.lit(10)).withColumn("safety_prob", F.lit(None).cast("double")),
             one.withColumn("id", F.lit(11)).withColumn("rant_prob", F.lit(None).cast("double")),
             one.withColumn("id", F.lit(12)).withColumn("toxicity_prob", F.lit(None).cast("double"))]
    df = probs
    for c in cases:
        df = df.unionByName(c)
    got = {r.id: (r.stage, r.decision, r.reasons) for r in cascade_rules(df).collect()}
    assert got[10] == (1, "quarantine", ["no safety_prob"])
    assert got[11] == (2, "quarantine", ["no rant_prob"])
    assert got[12] == (3, "quarantine", ["no toxicity_prob"])
    assert len(got) == 7


def test_settings_of_the_gate(spark):
    scores = spark.createDataFrame([(1, "ad", "__label__pos", 0.9), (2, "other", "__label__pos", 0.9)],
                                   "id int, head string, label string, prob double")
    twice = spark.createDataFrame([("ad", 0.5, True), ("ad", 0.6, True)], "head string, threshold double, enabled boolean")
    with pytest.raises(ValueError):
        or_gate(scores, ["ad"], twice)
    off = spark.createDataFrame([("ad", None, False)], "head string, threshold double, enabled boolean")
    with pytest.raises(ValueError):
        or_gate(scores, ["ad"], off)
    got = {r.id: (r.decision, r.fired) for r in or_gate(scores, ["ad"]).collect()}
    assert got == {1: ("bad", ["ad"]), 2: ("good", [])}
