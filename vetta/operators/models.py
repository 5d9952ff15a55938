"""Training and scoring: safety model (M3-M6), n-gram heads (M7-M10), multi-label third
stage (M13-M14). All fits are spark.ml jobs; only bounded scalars (class counts, weight
sums, per-model metrics) reach the driver."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetta.operators.features import head_feature_stages, safety_feature_stages, tfidf_stages
from vetta.operators.metrics import bce_terms
from vetta.session import scratch_path

# The published search space of the safety model and its best point.
SAFETY_GRID = {
    "min_df": [5, 10],
    "max_features": [50000, 75000],
    "ngram": [(1, 1), (1, 2)],
    "max_iter": [1000, 2000],
    "class_weight": ["balanced", {0: 1.0, 1: 1.5}, {0: 1.0, 1: 2.5}],
}
SAFETY_BEST = {"min_df": 5, "max_features": 75000, "ngram": (1, 2), "max_iter": 1000,
               "class_weight": {0: 1.0, 1: 1.5}}


def prob1(col: str = "probability"):
    """Probability of class 1 out of a probability vector."""
    return vector_to_array(F.col(col))[1]


# ------------------------------------------------------------------ class weights (M3)
def class_weight_col(df: DataFrame, label: str, weight, out: str = "weight"
                     ) -> tuple[DataFrame, float, int]:
    """Add a per-row weight column; ``weight`` is ``"balanced"`` (n / (2 n_c)) or a map.
    Returns the frame, the weight sum (for the C -> regParam conversion) and the row count."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # <= 2 rows
    n = sum(counts.values())
    if weight == "balanced":
        w = {k: n / (len(counts) * v) for k, v in counts.items()}
    elif weight is None:
        w = {k: 1.0 for k in counts}
    else:
        w = {int(k): float(v) for k, v in dict(weight).items()}
    expr = F.lit(1.0)
    for k, v in w.items():
        expr = F.when(F.col(label) == k, F.lit(float(v))).otherwise(expr)
    total = sum(w.get(k, 1.0) * c for k, c in counts.items())
    return df.withColumn(out, expr), total, n


def reg_param(c: float, weight_sum: float) -> float:
    """sklearn's ``C`` (sum of weighted losses + 1/2 ||w||^2 / C) in Spark's scaling
    (mean weighted loss + regParam/2 ||w||^2)."""
    return 1.0 / (c * weight_sum)


#: Characters of text whose features one partition of a fit holds.
FIT_CHARS = 16 << 20


def _chars(text: str):
    """Characters of a text column, as an aggregate (0 without rows)."""
    return F.coalesce(F.sum(F.length(text)), F.lit(0))


#: Characters of text of which fits that run at once may hold features.
ROOM_CHARS = 256 << 20


#: Features of all fits that run at once: an optimiser holds some 30 dense vectors on the driver.
ROOM_FEATURES = 1 << 19


def _at_once(parallelism: int, chars: int, features: int = 0) -> int:
    return max(1, min(parallelism, ROOM_CHARS // max(chars, 1), ROOM_FEATURES // max(features, 1)))


def _fit_frame(df: DataFrame, partitions: int | None, chars: int) -> DataFrame:
    """The feature frame a fit iterates over, written once to the scratch folder and read back: an
    optimiser sends the plan with every task of every iteration, and a plan that holds the
    vocabulary and a name for each feature costs more than the iteration. The fit caches its
    own blocks of it, so it is not cached here again. ``partitions`` merges the result, as L-BFGS
    pays for a dense gradient and a task per partition in every iteration (None: as it is),
    but never to more than ``FIT_CHARS`` of the texts' ``chars`` a partition: what one task reads
    stays bounded, and larger inputs get more partitions."""
    path = scratch_path(df.sparkSession, "features")
    df.select(*[F.col(c).alias(c, metadata={}) for c in df.columns]).write \
        .option("parquet.block.size", ROW_GROUP).parquet(path)
    made = df.sparkSession.read.parquet(path)
    return made if partitions is None else made.coalesce(max(partitions, -(-chars // FIT_CHARS)))


#: Bytes of features that a writer holds, and rows of them that a reader decodes at a time: a row
#: may have thousands of entries.
ROW_GROUP, READ_ROWS = 16 << 20, 128
_READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"


@contextmanager
def _wide_rows(spark: SparkSession) -> Iterator[None]:
    """Fits inside read their features a few rows at a time (Spark's 4096 would fill a heap)."""
    before = spark.conf.get(_READ_ROWS)
    spark.conf.set(_READ_ROWS, str(READ_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_READ_ROWS, before)


# ------------------------------------------------------------------ safety model (M1-M6)
def fit_safety(df: DataFrame, words: Sequence[str], text: str = "text", label: str = "label",
               params: Mapping = SAFETY_BEST, c: float = 1.0, tol: float = 1e-4,
               partitions: int | None = None) -> PipelineModel:
    """TF-IDF || lexicon -> weighted L2 logistic regression at one parameter point. The text
    is read once into a cache, and the features are built once."""
    data, wsum, _ = class_weight_col(df.select(text, F.col(label).cast("double").alias("label")),
                                     "label", params["class_weight"])
    feats, frame = _fit_features(data, safety_feature_stages(
        words, text, tuple(params["ngram"]), params["min_df"], params["max_features"]))
    chars = frame.agg(_chars(text)).first()[0]           # of the cached rows
    train = _fit_frame(frame.select("features", "label", "weight"), partitions, chars)
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                            maxIter=int(params["max_iter"]), regParam=reg_param(c, wsum),
                            elasticNetParam=0.0, standardization=False, tol=tol)
    with _wide_rows(df.sparkSession):
        return PipelineModel(stages=[*feats, lr.fit(train)])


def _fit_features(data: DataFrame, stages: Sequence) -> tuple[list, DataFrame]:
    """Fit feature stages one after the other. What the counting estimators read repeatedly is
    cached: the text, as its terms take ten times the room and are soon made again. Returns
    (fitted stages, transformed frame)."""
    fitted, frame = [], data.persist(StorageLevel.MEMORY_AND_DISK)
    _CACHED_TEXTS.append(frame)
    for st in stages:
        model = st.fit(frame) if hasattr(st, "fit") else st
        fitted.append(model)
        frame = model.transform(frame)
    while len(_CACHED_TEXTS) > 1:            # the previous fit's texts are no longer read
        _CACHED_TEXTS.pop(0).unpersist()
    return fitted, frame


_CACHED_TEXTS: list[DataFrame] = []


def search_safety(df: DataFrame, words: Sequence[str], fold_col: str = "fold",
                  text: str = "text", label: str = "label", grid: Mapping = SAFETY_GRID,
                  c: float = 1.0, tol: float = 1e-4, partitions: int | None = None):
    """Grid search with given folds (``fold_col``), scored by F1 of class 1; the best point
    (the first among equals) is refit on all rows. Features are built once per (feature
    setting, fold); "balanced" weights and the regularisation come from the rows fitted on.
    A point that differs only in ``max_iter`` is not fitted again where the smaller limit was
    not reached. Returns (best PipelineModel, [(params, mean F1)])."""
    base = df.select(text, F.col(label).cast("double").alias("label"), F.col(fold_col).cast("int").alias("__f")) \
        .persist(StorageLevel.MEMORY_AND_DISK)           # every fold and feature setting reads it
    chars = base.agg(_chars(text)).first()[0]
    numbers = [r[0] for r in base.select("__f").distinct().orderBy("__f").collect()]   # k folds
    iters = sorted(grid["max_iter"])
    totals: dict[tuple, float] = {}
    for md in grid["min_df"]:
        for mf in grid["max_features"]:
            for ng in grid["ngram"]:
                for k in numbers:
                    feats, train = _fit_features(base.filter(F.col("__f") != k),
                                                 safety_feature_stages(words, text, tuple(ng), md, mf))
                    train = _fit_frame(train.select("features", "label"), partitions, chars)
                    val = _fit_frame(PipelineModel(stages=feats).transform(base.filter(F.col("__f") == k))
                                     .select("features", "label"), partitions, chars)
                    for i, w in enumerate(grid["class_weight"]):
                        weighted, wsum, _ = class_weight_col(train, "label", w)
                        f1 = None
                        for mi in iters:
                            if f1 is None or model.summary.totalIterations >= done:
                                lr = LogisticRegression(
                                    featuresCol="features", labelCol="label", weightCol="weight", maxIter=int(mi),
                                    regParam=reg_param(c, wsum), standardization=False, tol=tol)
                                with _wide_rows(df.sparkSession):
                                    model = lr.fit(weighted)
                                f1 = _f1(model.transform(val), "label", "prediction")
                            done = int(mi)
                            at = (md, mf, tuple(ng), mi, i)
                            totals[at] = totals.get(at, 0.0) + f1 / len(numbers)
    scores = [({"min_df": md, "max_features": mf, "ngram": ng, "max_iter": mi,
                "class_weight": grid["class_weight"][i]}, f1) for (md, mf, ng, mi, i), f1 in totals.items()]
    best = max(scores, key=lambda x: x[1])[0]
    model = fit_safety(base.select(text, "label"), words, text, "label", best, c, tol, partitions)
    base.unpersist()
    return model, scores


def _f1(df: DataFrame, truth: str, pred: str) -> float:
    r = df.agg(F.count_if((F.col(truth) == 1) & (F.col(pred) == 1)).alias("tp"),
               F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(pred) == 1).alias("pp")).first()
    return 2 * r.tp / (r.pos + r.pp) if (r.pos + r.pp) else 0.0


def score_safety(model: PipelineModel, df: DataFrame, out: str = "safety_prob") -> DataFrame:
    scored = model.transform(df)
    return scored.select(*df.columns, prob1("probability").alias(out))


# ------------------------------------------------------------------ heads
def head_features(df: DataFrame, text: str = "text", **kw) -> DataFrame:
    """Hashed word + char n-grams; stateless (no fit), so train and serve share it."""
    return PipelineModel(stages=head_feature_stages(text, **kw)).transform(df)


def fit_heads(df: DataFrame, heads: Sequence[str], text: str = "text",
              label_suffix: str = "", max_iter: int = 50, reg: float = 1e-4, tol: float = 1e-4,
              skip_missing: bool = False, parallelism: int = 4,
              val: DataFrame | None = None, grid: Sequence[Mapping] | None = None,
              partitions: int | None = None) -> dict:
    """One binary logistic head per label column, all on one feature frame that is built once;
    the fits run concurrently while their copies of it are small. A head without both classes is skipped (or an error).

    With a validation frame and a ``grid`` of ``{"max_iter": .., "reg": ..}`` points, each
    head keeps the point with the best F1 of the positive class on the validation rows
    (a bounded number of fits); otherwise the fixed ``max_iter``/``reg`` are used."""
    cols = [h + label_suffix for h in heads if h + label_suffix in df.columns]
    stats = df.agg(_chars(text).alias("__chars"),
                   *[F.min(c).alias(f"lo_{c}") for c in cols],
                   *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    feats = _fit_frame(head_features(df, text).select("features", *cols), partitions, stats["__chars"])
    vfeats = head_features(val, text).persist(StorageLevel.MEMORY_AND_DISK) \
        if (val is not None and grid) else None
    present = {}
    for h in heads:
        col = h + label_suffix
        both = col in cols and stats[f"lo_{col}"] is not None and stats[f"lo_{col}"] != stats[f"hi_{col}"]
        if not both:
            if skip_missing:
                continue
            raise ValueError(f"head '{h}' has no training data with both classes")
        present[h] = col

    points = list(grid) if vfeats is not None else [{"max_iter": max_iter, "reg": reg}]

    def fit_one(item):
        h, col = item
        best, best_f1 = None, None
        for pt in points:
            lr = LogisticRegression(featuresCol="features", labelCol="__y",
                                    maxIter=int(pt.get("max_iter", max_iter)),
                                    regParam=float(pt.get("reg", reg)), tol=tol,
                                    probabilityCol=f"__p_{h}", rawPredictionCol=f"__r_{h}",
                                    predictionCol=f"__yhat_{h}")
            m = lr.fit(feats.withColumn("__y", F.col(col).cast("double")))
            if vfeats is None:
                return h, m
            s = m.transform(vfeats).select(F.col(col).alias("t"),
                                           (prob1(f"__p_{h}") > 0.5).cast("int").alias("p"))
            f1 = _f1(s, "t", "p")
            if best_f1 is None or f1 > best_f1:
                best, best_f1 = m, f1
        return h, best

    # every fit caches its own copy of the features: as many at once as there is room for
    with _wide_rows(df.sparkSession), ThreadPoolExecutor(max_workers=_at_once(parallelism, stats["__chars"])) as pool:
        models = dict(pool.map(fit_one, present.items()))
    if vfeats is not None:
        vfeats.unpersist()
    return models


# ------------------------------------------------------------------ persistence
def save_safety(model: PipelineModel, path: str, params: Mapping | None = None) -> None:
    """Save the fitted pipeline (standard stages only) and, when given, the chosen
    parameters as one JSON text next to it (numbers stay numbers)."""
    model.write().overwrite().save(f"{path.rstrip('/')}/model")
    if params is not None:
        _save_json(params, f"{path.rstrip('/')}/best_params")


def load_safety(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path.rstrip('/')}/model")


def load_params(path: str) -> dict:
    """The saved parameters; pairs and class maps come back as they were."""
    out = _load_json(f"{path.rstrip('/')}/best_params")
    if isinstance(out.get("ngram"), list):
        out["ngram"] = tuple(out["ngram"])
    if isinstance(out.get("class_weight"), dict):
        out["class_weight"] = {int(k): v for k, v in out["class_weight"].items()}
    return out


def _save_json(value, path: str) -> None:
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _load_json(path: str):
    return json.loads(SparkSession.getActiveSession().read.text(path, wholetext=True).first()[0])


def save_cascade(models, path: str) -> None:
    """Save (safety, heads, (features, label models)) under one folder, with the names."""
    safety, heads, (feats, ml) = models
    root = path.rstrip("/")
    save_safety(safety, f"{root}/safety")
    for kind, own in (("heads", heads), ("labels", ml)):
        for name, m in own.items():
            m.write().overwrite().save(f"{root}/{kind}/{name}")
    feats.write().overwrite().save(f"{root}/features")
    _save_json({"heads": list(heads), "labels": list(ml)}, f"{root}/names")


def load_cascade(path: str):
    """What ``save_cascade`` saved; a missing model is an error."""
    root = path.rstrip("/")
    names = _load_json(f"{root}/names")
    heads = {h: LogisticRegressionModel.load(f"{root}/heads/{h}") for h in names["heads"]}
    ml = {lab: LogisticRegressionModel.load(f"{root}/labels/{lab}") for lab in names["labels"]}
    return load_safety(f"{root}/safety"), heads, (PipelineModel.load(f"{root}/features"), ml)


def score_heads(models: Mapping, df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``<head>_prob`` (probability of the positive label) for every head model."""
    feats = head_features(df, text)
    for h, m in models.items():
        feats = m.transform(feats).withColumn(f"{h}_prob", prob1(f"__p_{h}")).drop(
            f"__p_{h}", f"__r_{h}", f"__yhat_{h}")
    return feats.select(*df.columns, *[f"{h}_prob" for h in models])


# ------------------------------------------------------------------ third stage
def fit_multilabel(train: DataFrame, labels: Sequence[str], text: str = "text",
                   val: DataFrame | None = None, max_iters: Sequence[int] = (50,),
                   vector_size: int = 32, reg: float = 1e-3, seed: int = 42,
                   tol: float = 1e-4, parallelism: int = 4, min_count: int = 2,
                   max_features: int = 1 << 18, w2v_partitions: int = 1, partitions: int | None = None):
    """Shared features (document-mean Word2Vec || TF-IDF) and one logistic model per label.
    With a validation frame, each ``maxIter`` candidate is fitted and the one with the
    lowest validation log loss kept. Returns (feature PipelineModel, {label: model}, loss).

    ``max_features`` bounds the TF-IDF vocabulary (the most frequent terms); Word2Vec averages
    over ``w2v_partitions`` parts, so that number is part of the model: raise it for speed on
    a large corpus, and keep it for equal models."""
    # the text is read once, into a cache that all counts share
    fitted_stages, frame = _fit_features(train.select(text, *labels), [
        *tfidf_stages(text, "tfidf", (1, 1), 1.0, max_features),
        Word2Vec(inputCol="__tok", outputCol="w2v", vectorSize=vector_size, minCount=min_count,
                 seed=seed, maxIter=1, numPartitions=w2v_partitions),
        VectorAssembler(inputCols=["tfidf", "w2v"], outputCol="features")])
    feat_model = PipelineModel(stages=fitted_stages)
    chars = frame.agg(_chars(text)).first()[0]
    tr = _fit_frame(frame.select("features", *labels), partitions, chars)
    va = feat_model.transform(val).persist(StorageLevel.MEMORY_AND_DISK) if val is not None else None
    best, best_loss = None, None
    def fit_one(args):
        mi, lab = args
        lr = LogisticRegression(featuresCol="features", labelCol="__y", maxIter=int(mi),
                                regParam=reg, tol=tol, probabilityCol=f"__p_{lab}",
                                rawPredictionCol=f"__r_{lab}", predictionCol=f"__yhat_{lab}")
        return (mi, lab), lr.fit(tr.withColumn("__y", F.col(lab).cast("double")))

    with _wide_rows(train.sparkSession), ThreadPoolExecutor(max_workers=_at_once(parallelism, chars, max_features)) as pool:
        fitted = dict(pool.map(fit_one, [(mi, lab) for mi in max_iters for lab in labels]))
    for mi in max_iters:
        models = {lab: fitted[(mi, lab)] for lab in labels}
        if va is None:
            best = models
            break
        scored = _apply_label_models(models, va)
        loss = scored.agg(F.avg(bce_terms(labels)).alias("l")).first()["l"]
        if best_loss is None or loss < best_loss:
            best, best_loss = models, loss
    if va is not None:
        va.unpersist()
    return feat_model, best, best_loss


def _apply_label_models(models: Mapping, feats: DataFrame) -> DataFrame:
    for lab, m in models.items():
        feats = m.transform(feats).withColumn(f"{lab}_prob", prob1(f"__p_{lab}")).drop(
            f"__p_{lab}", f"__r_{lab}", f"__yhat_{lab}")
    return feats


def score_multilabel(feat_model: PipelineModel, models: Mapping, df: DataFrame,
                     threshold: float = 0.5) -> DataFrame:
    """Adds ``<label>_prob`` and ``<label>_pred`` (strict ``> threshold``)."""
    scored = _apply_label_models(models, feat_model.transform(df))
    return scored.select(*df.columns, *[f"{lab}_prob" for lab in models],
                         *[(F.col(f"{lab}_prob") > threshold).cast("int").alias(f"{lab}_pred")
                           for lab in models])
