"""TF-IDF in relational form equals the spark.ml stages; models beat trivial baselines."""

import math

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from vetta.operators import features as FT
from vetta.operators import models as MD
from vetta.operators import ordering as O

DOCS = [(1, "The cat sat on the mat. The cat!"), (2, "A dog and a cat"), (3, "dogs bark; cats nap"),
        (4, "Ünïcode wörds and the cat"), (5, "x y z")]


def test_tfidf_relational_equals_ml(spark):
    df = spark.createDataFrame(DOCS, "id long, text string")
    rel = {(r.id, r.term): r.weight for r in
           FT.tfidf_relational(df, "id", "text", (1, 2), 1).collect()}
    model = Pipeline(stages=FT.tfidf_stages("text", "tfidf", (1, 2), 1.0, 1 << 18)).fit(df)
    vocab = model.stages[3].vocabulary
    ml = {}
    for r in model.transform(df).select("id", "tfidf").collect():
        v = r.tfidf
        for i, w in zip(v.indices, v.values):
            ml[(r.id, vocab[i])] = round(float(w), 6)
    assert rel.keys() == ml.keys()
    assert all(abs(rel[k] - ml[k]) < 1e-6 for k in rel)


def test_tfidf_manual_weights(spark):
    df = spark.createDataFrame(DOCS[:2], "id long, text string")
    rel = {(r.id, r.term): r.weight for r in FT.tfidf_relational(df, "id", "text").collect()}
    # doc 2: a(2), dog(1), and(1), cat(1); n=2; df(cat)=2 -> idf 1, others df=1 -> ln(3/2)+1
    hi = math.log(3 / 2) + 1
    raw = {"dog": hi, "and": hi, "cat": 1.0}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert rel[(2, "cat")] == round(1.0 / norm, 6)
    assert (2, "a") not in rel  # one-character tokens are not terms


def test_char_ngrams(spark):
    df = spark.createDataFrame([("ab",)], "t string")
    got = df.select(FT.char_ngrams(FT.tokens("t"), 2, 3)).first()[0]
    assert got == ["<a", "ab", "b>", "<ab", "ab>"]


def test_safety_model_beats_majority(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/labels.parquet").join(
        spark.read.parquet(f"{d}/documents.parquet"), "doc_id").select("doc_id", "text",
                                                                       F.col("toxic").alias("label"))
    parts = O.split(docs, "doc_id", 0.75, 42, stratify="label")
    words = ["trash", "idiot", "clown", "scum", "worthless", "moron", "pathetic", "loser",
             "disgusting", "stupid"]
    params = dict(MD.SAFETY_BEST, class_weight="balanced", min_df=2)
    model = MD.fit_safety(parts.filter("split = 'train'"), words, params=params, c=10.0)
    test = MD.score_safety(model, parts.filter("split = 'test'").select("text", "label"))
    acc = test.select(F.avg(((F.col("safety_prob") >= 0.5).cast("int") == F.col("label"))
                            .cast("double"))).first()[0]
    base = test.select(F.avg((F.col("label") == 0).cast("double"))).first()[0]
    assert acc >= base


def test_grid_search_small(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/labels.parquet").join(
        spark.read.parquet(f"{d}/documents.parquet"), "doc_id").select("doc_id", "text",
                                                                       F.col("toxic").alias("label"))
    folded = O.folds(docs, "doc_id", 3, 42, stratify="label")
    grid = {"min_df": [1], "max_features": [1000], "ngram": [(1, 1), (1, 2)], "max_iter": [20],
            "class_weight": ["balanced"]}
    best, scores = MD.search_safety(folded, ["trash", "idiot"], grid=grid)
    assert len(scores) == 2 and best is not None
    # the refit point is regularised by all rows, not by the rows of a fold
    wsum = float(docs.count())
    assert best.stages[-1].getRegParam() == pytest.approx(MD.reg_param(1.0, wsum))


def test_heads_and_multilabel_fit(spark):
    rows = [(i, ("buy now cheap deals " if i % 3 == 0 else "lovely quiet park ") + str(i),
             int(i % 3 == 0), int(i % 5 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, ad int, rant int")
    models = MD.fit_heads(df, ["ad", "rant"], max_iter=30)
    s = MD.score_heads(models, df).select("id", "ad", "ad_prob").collect()
    acc = sum(int((r.ad_prob > 0.5) == bool(r.ad)) for r in s) / len(s)
    assert acc > 0.9
    feats, ml, loss = MD.fit_multilabel(df, ["ad", "rant"], val=df, max_iters=(5, 20))
    assert loss is not None
    out = MD.score_multilabel(feats, ml, df)
    assert {"ad_prob", "ad_pred", "rant_prob", "rant_pred"} <= set(out.columns)


def test_save_load_and_best_params(spark):
    import os
    import tempfile
    rows = [(i, ("idiot trash " if i % 4 == 0 else "nice place ") + str(i), int(i % 4 == 0))
            for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    params = dict(MD.SAFETY_BEST, min_df=1, max_iter=20, class_weight="balanced")
    model = MD.fit_safety(df, ["idiot"], params=params)
    path = tempfile.mkdtemp(prefix="vetta-model-")
    MD.save_safety(model, path, params)
    back = MD.load_safety(path)
    a = [round(r.safety_prob, 9) for r in MD.score_safety(model, df).orderBy("id").collect()]
    b = [round(r.safety_prob, 9) for r in MD.score_safety(back, df).orderBy("id").collect()]
    assert a == b
    assert MD.load_params(path) == params


def test_heads_tuned_on_validation(spark):
    rows = [(i, ("buy now cheap deals " if i % 3 == 0 else "lovely quiet park ") + str(i),
             int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, ad int")
    grid = [{"max_iter": 5, "reg": 1000.0}, {"max_iter": 30, "reg": 1e-4}]
    models = MD.fit_heads(df, ["ad"], val=df, grid=grid)
    assert models["ad"].getMaxIter() == 30


def test_run_heads_from_lines(spark):
    from vetta.plans import jobs as J
    rows = []
    for i in range(80):
        text = ("buy now cheap deals" if i % 3 == 0 else "lovely quiet park") + f" {i}"
        split = "eval" if i % 10 == 0 else "train"
        for cat in ["ad", "rant"]:
            pos = (cat == "ad" and i % 3 == 0) or (cat == "rant" and i % 2 == 0)
            rows.append((split, cat, i, ("__label__pos " if pos else "__label__neg ") + text))
    lines = spark.createDataFrame(rows, "split string, category string, doc_id long, line string")
    wide = J.lines_to_wide(lines, ["ad", "rant"]).collect()
    assert len(wide) == 80 and {r.ad for r in wide} == {0, 1}
    _, report = J.run_heads(lines, ["ad", "rant"])
    rep = {r.head: r for r in report.collect()}
    assert rep["ad"].tp + rep["ad"].fn == 3 and rep["ad"].recall == 1.0


def test_moderate_rejects_incomplete(spark):
    from vetta.plans import jobs as J
    req = spark.createDataFrame(
        [(1, "B", "c", "d", "fine", 4.0), (2, "B", "c", "d", None, 1.0),
         (3, "B", "c", "d", "you idiot", 1.0)],
        "id long, name string, category string, description string, review string, rating double")

    def s1(df):
        return df.withColumn("safety_prob", F.when(F.col("text").contains("idiot"), 0.9).otherwise(0.1))

    def s2(df):
        return df.withColumns({f"{h}_prob": F.lit(0.0) for h in ["ad", "rant"]})

    def s3(df):
        return df.withColumns({f"{lab}_prob": F.lit(0.0) for lab in
                               ["advertisement", "irrelevant_content", "non_visitor_rant", "toxicity"]})
    v = J.moderate(req, s1, s2, s3, ["ad", "rant"])
    got = {r.id: (r.stage, r.decision, r.reasons) for r in v.collect()}
    assert got == {1: (3, "accept", []), 3: (1, "reject", ["safety"]), 2: (0, "quarantine", ["missing review"])}


def test_run_safety_with_grid_and_profile(spark):
    import tempfile
    from vetta.plans import jobs as J
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/labels.parquet").join(
        spark.read.parquet(f"{d}/documents.parquet"), "doc_id").select(
        F.col("doc_id").alias("id"), "text", F.col("toxic").alias("unsafe_label"))
    grid = {"min_df": [1], "max_features": [500], "ngram": [(1, 1)], "max_iter": [10],
            "class_weight": ["balanced", {0: 1.0, 1: 2.5}]}
    path = tempfile.mkdtemp(prefix="vetta-run-")
    model, scored, report, scores = J.run_safety(docs, ["trash"], grid=grid, save_to=path)
    assert len(scores) == 2 and report.count() == 5
    assert scored.count() + 0 > 0
    vc, nulls, dups = J.profile_table(docs, ["unsafe_label"])
    assert vc.count() == 2 and nulls.count() == 3 and dups.first().duplicates >= 0


def test_model_stream_equals_batch(spark):
    import json as _json
    import os
    import tempfile
    from pyspark.sql import types as T
    from vetta.plans import jobs as J
    from vetta.sources.readers import REQUEST_SCHEMA
    train = spark.createDataFrame(
        [(i, ("you idiot trash " if i % 4 == 0 else "great coffee here ") + str(i), int(i % 4 == 0),
          int(i % 3 == 0), int(i % 5 == 0)) for i in range(60)],
        "id long, text string, label int, ad int, toxicity int")
    safety = MD.fit_safety(train, ["idiot"], params=dict(MD.SAFETY_BEST, min_df=1, max_iter=20,
                                                          class_weight="balanced"))
    heads = MD.fit_heads(train, ["ad"], max_iter=10)
    feats, ml, _ = MD.fit_multilabel(train, ["toxicity"], max_iters=(5,))
    models = (safety, heads, (feats, ml))
    src = tempfile.mkdtemp(prefix="vetta-req-")
    reqs = [{"id": i, "name": "B", "category": "c", "description": "d",
             "review": ("you idiot" if i == 0 else f"nice place {i}"), "rating": 4.0}
            for i in range(3)]
    for r in reqs:
        with open(os.path.join(src, f"r{r['id']}.json"), "w") as f:
            _json.dump(r, f, indent=2)
    schema = T.StructType([T.StructField("id", T.LongType())] + list(REQUEST_SCHEMA.fields))
    batch_df = spark.read.schema(schema).json(src, multiLine=True)
    saved = tempfile.mkdtemp(prefix="vetta-cascade-")
    MD.save_cascade(models, saved)
    v_batch = J.moderate_with(batch_df, MD.load_cascade(saved))
    out, ck = tempfile.mkdtemp(prefix="vetta-out-"), tempfile.mkdtemp(prefix="vetta-ck-")
    stream = spark.readStream.schema(schema).option("multiLine", True) \
        .option("maxFilesPerTrigger", 1).json(src)
    q = J.moderate_model_stream(stream, models, out, ck, available_now=True)
    q.awaitTermination()
    cols = ["id", "stage", "decision"]
    a = sorted(tuple(r) for r in spark.read.parquet(out).select(*cols).collect())
    b = sorted(tuple(r) for r in v_batch.select(*cols).collect())
    assert a == b and len(a) == 3
    assert len([p for p in os.listdir(out) if p.startswith("batch_id=")]) == 3


def test_missing_model_is_an_error(spark):
    import tempfile
    with pytest.raises(Exception):
        MD.load_cascade(tempfile.mkdtemp(prefix="vetta-none-"))


def test_each_head_beats_the_majority(spark):
    """Heads trained on the label lines of the test tables: F1 above always saying no (0),
    and far above it where the text decides the label."""
    from vetta.plans import catalog as K
    from vetta.plans import jobs as J
    from vetta.plans import roles as R
    lines, _ = J.head_training_table(R.head_samples(spark, "/root/testdata/sf0.01"), key="doc_id")
    _, report = J.run_heads(lines, ["ad", "irrelevant", "rant"])
    f1 = {r.head: 2 * r.tp / max(1, 2 * r.tp + r.fp + r.fn) for r in report.collect()}
    assert f1["irrelevant"] > 0.9 and f1["ad"] > 0.1 and f1["rant"] > 0.5, f1
    assert K._HEAD_CATS
