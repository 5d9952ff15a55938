"""User-facing composite jobs (each a chain of operators; inputs and outputs are DataFrames)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetta.functions.labels import any_flag, one_hot
from vetta.functions.text import clean_tweet, collapse_ws, label_line
from vetta.operators.cleaning import (
    band_label, clean_sentences, drop_blank, drop_null, drop_placeholders, explode_prompts, extract_json,
    lists_to_text, parse_labels, render_message, select_renamed,
)
from vetta.operators.features import written
from vetta.operators.ordering import dense_index, split
from vetta.operators.tables import join_business, keep_first, union_all

# Label vocabularies and the renames between them.
CLASS_TO_FINAL = {"label_spam": "spam", "label_advertisement": "advertisement",
                  "label_irrelevant_content": "relevance", "label_non_visitor_rant": "rant",
                  "label_toxicity": "toxicity"}
LLM_TO_FINAL = {"irrelevant_content": "relevance", "non_visitor_rant": "rant"}
FINAL_TO_ENCODER = {"relevance": "irrelevant_content", "rant": "non_visitor_rant"}
JIGSAW_FLAGS = ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"]
HEAD_CATEGORIES = ["spam", "ad", "irrelevant", "rant", "unsafe"]
GENERATION_CLASSES = ["spam", "advertisement", "irrelevant_content", "non_visitor_rant",
                      "toxicity"]


# ------------------------------------------------------------------ W1 prepare reviews
def prepare_reviews(reviews: DataFrame, meta: DataFrame, order: str = "id",
                    null_safe: bool = False) -> DataFrame:
    """reviews -> drop null text -> join business -> dedup (reviewer, text, business),
    first kept -> canonical columns -> lists as text -> dense id -> user_message.

    Until the rows are numbered the text is a key only, so its SHA-256 goes through joins,
    aggregation and sorting; the text itself is shuffled once, to the rows that stay."""
    r = drop_null(reviews, ["text"])
    digest = F.unhex(F.sha2("text", 256))
    j = join_business(r.withColumn("text", digest), meta, "gmap_id", null_safe=null_safe)
    # a business that is listed twice: its first listing by name, category, description
    d = keep_first(j, ["name_x", "text", "gmap_id"], [order, "name_y", "category", "description"],
                   unique_order=False)
    canon = select_renamed(d, {order: "src_order", "name_y": "business_name",
                               "category": "category", "description": "description",
                               "text": "review", "rating": "rating", "resp": "response"})
    canon = lists_to_text(canon)
    idx = dense_index(canon, ["src_order"], out="id").withColumnRenamed("review", "digest")
    texts = r.select(F.col(order).alias("__order"), digest.alias("__digest"), F.col("text").alias("review"))
    repeats = texts.groupBy("__order", "__digest").count().filter("count > 1")
    if not repeats.isEmpty():                           # rows that come twice have one text
        texts = texts.dropDuplicates(["__order", "__digest"])
    whole = idx.join(texts, F.col("src_order").eqNullSafe(F.col("__order")) & (F.col("digest") == F.col("__digest")))
    return render_message(whole).select("id", "business_name", "category", "description",
                                        "review", "rating", "response", "user_message")


# ------------------------------------------------------------------ W2 label table
def build_label_table(labels: DataFrame, reviews: DataFrame, label_key: str = "job_id",
                      review_key: str = "id") -> DataFrame:
    """Label records left-join the reviews they describe; the final columns are
    ``text, spam, advertisement, relevance, rant, toxicity`` (flags as int)."""
    flags = ["spam", "advertisement", "irrelevant_content", "non_visitor_rant", "toxicity"]
    lab = labels.select(F.col(label_key).alias(review_key),
                        *[F.coalesce(F.col(f).try_cast("int"), F.lit(0)).alias(f) for f in flags])
    j = lab.join(reviews.select(review_key, "user_message"), review_key, "left")
    out = j.select(F.col("user_message").alias("text"),
                   *[F.col(f).alias(LLM_TO_FINAL.get(f, f)) for f in flags])
    return out


# ------------------------------------------------------------------ W3 synthetic table
def synthetic_table(responses: DataFrame, seed: int = 42) -> DataFrame:
    """Generation responses -> JSON objects -> one-hot class labels -> drop placeholders
    -> seeded shuffle position -> user_message -> final six columns (+ ``idx``)."""
    from pyspark.sql import types as T
    from vetta.operators.ordering import shuffle_order
    schema = T.StructType([T.StructField("review", T.StringType()),
                           T.StructField("rating", T.DoubleType()),
                           T.StructField("business_name", T.StringType()),
                           T.StructField("category", T.StringType()),
                           T.StructField("description", T.StringType()),
                           T.StructField("response", T.StringType())])
    objs = extract_json(responses, "content", schema, keep=["batch_id", "class_type"])
    objs = objs.select("*", *one_hot("class_type", GENERATION_CLASSES))
    objs = drop_placeholders(objs, "review")
    objs = objs.withColumn("__key", F.concat_ws(":", F.col("batch_id").cast("string"),
                                                F.col("obj_pos").cast("string")))
    shuffled = shuffle_order(objs, "__key", seed, out="idx")
    msg = render_message(shuffled)
    return msg.select("idx", F.col("user_message").alias("text"),
                      *[F.col(k).alias(v) for k, v in CLASS_TO_FINAL.items()])


# ------------------------------------------------------------------ W4-W7 safety tables
def clean_jigsaw(df: DataFrame, order: str = "doc_id") -> DataFrame:
    flagged = df.withColumn("unsafe_label", any_flag(JIGSAW_FLAGS))
    first = keep_first(flagged.select("id", "comment_text", "unsafe_label", order),
                       ["id", "comment_text"], order)
    return first.select(F.col("comment_text").alias("text"), "unsafe_label")


def clean_toxigen(generated: DataFrame, annotated: DataFrame | None = None,
                  parity: bool = False, unique: bool = True) -> DataFrame:
    """Sentences of every prompt plus its generation (labelled with the prompt's label),
    cleaned; plus the banded annotated rows (unless ``parity``, where they never arrive).
    ``unique=False`` leaves the removal of repeats to a later step (``combine_safety``)."""
    gen = clean_sentences(explode_prompts(generated))
    parts = [gen]
    if annotated is not None and not parity:
        ann = band_label(annotated.select("text", "toxicity_human"), "toxicity_human")
        parts.append(ann.select("text", "unsafe_label"))
    out = union_all(*parts)
    return out.distinct() if unique else out


def clean_tweets(df: DataFrame, col: str = "tweet", unique: bool = True) -> DataFrame:
    out = df.select(clean_tweet(col).alias("text"), F.lit(1).alias("unsafe_label"))
    return out.distinct() if unique else out


def combine_safety(*dfs: DataFrame) -> DataFrame:
    """One table of (text, label) without repeats; the inputs may still hold some."""
    return drop_null(union_all(*[d.select("text", "unsafe_label") for d in dfs])).distinct()


# ------------------------------------------------------------------ W9 head training table
def head_training_table(samples: DataFrame, key: str = "doc_id", ratio: float = 0.9,
                        seed: int = 42, categories: Sequence[str] = HEAD_CATEGORIES,
                        positive_value: int = 1) -> tuple[DataFrame, DataFrame]:
    """Parse flags (invalid rows to the second frame), normalise text, drop empty text,
    exact seeded 90/10 split, one ``"<label> <text>"`` line per category."""
    good, bad = parse_labels(drop_blank(samples, [*categories, "text"]), list(categories))
    good = good.withColumn("text", collapse_ws("text")).filter(F.length("text") > 0)
    parts = split(good, key, ratio, seed, out="split", first="train", second="eval")
    args = ", ".join(f"'{c}', `{c}`" for c in categories)
    long = parts.selectExpr("split", key, "text",
                            f"stack({len(categories)}, {args}) AS (category, label)")
    lines = long.select("split", "category", key,
                        label_line("label", "text", positive_value).alias("line"))
    return lines, bad


# ------------------------------------------------------------------ responses
def response_json(labels: Sequence[str]):
    """The response string exactly as a default ``json.dumps`` of the int flags prints it."""
    parts = []
    for i, lab in enumerate(labels):
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{lab}": '), F.col(lab).cast("int").cast("string")]
    parts.append(F.lit("}"))
    return F.concat(*parts)


# ------------------------------------------------------------------ W11 heads from label lines
def lines_to_wide(lines: DataFrame, categories: Sequence[str] = HEAD_CATEGORIES,
                  key: str = "doc_id", positive: str = "__label__pos") -> DataFrame:
    """``(split, category, key, line)`` -> one row per (split, key) with its text and a 0/1
    column per category; one aggregation, and a group holds one line per category."""
    from vetta.functions.text import NON_WS, WS
    parsed = lines.select("split", "category", key,
                          F.regexp_extract("line", f"^({NON_WS}+)", 1).alias("label"),
                          F.regexp_extract("line", f"(?s)^{NON_WS}+{WS}+(.*)$", 1).alias("text"))
    # the text is the same in all lines of a key: grouped by the key, it is carried once
    flags = [F.max(F.when(F.col("category") == c, (F.col("label") == positive).cast("int"))).alias(c)
             for c in categories]
    return parsed.groupBy("split", key).agg(F.first("text").alias("text"), *flags)


def run_heads(lines: DataFrame, heads: Sequence[str] = HEAD_CATEGORIES, key: str = "doc_id",
              threshold: float | None = None, tune_grid: Sequence[dict] | None = None,
              partitions: int | None = None):
    """Train one head per category on the ``train`` lines (tuned on ``eval`` when a grid is
    given), score the ``eval`` lines and report confusion counts, precision, recall and the
    warnings per head. Returns (models, report)."""
    from vetta.operators import metrics as MX
    from vetta.operators import models as MD
    from vetta.operators.gate import fire
    wide = written(lines_to_wide(lines, heads, key), "wide")        # read by the fit and the report
    train, ev = wide.filter(F.col("split") == "train"), wide.filter(F.col("split") == "eval")
    models = MD.fit_heads(train, heads, skip_missing=True,
                          val=ev if tune_grid else None, grid=tune_grid, partitions=partitions)
    scored = MD.score_heads(models, ev.select(key, "text", *models))
    args = ", ".join(f"'{h}', `{h}`, `{h}_prob`" for h in models)
    long = scored.selectExpr(f"stack({len(models)}, {args}) AS (head, truth, prob)")
    long = long.withColumn("pred", fire("prob", threshold).cast("int"))
    return models, MX.binary_report(long, "truth", "pred", by=["head"])


# ------------------------------------------------------------------ W13 moderate requests
def moderate(requests: DataFrame, stage1, stage2, stage3, heads: Sequence[str],
             head_threshold: float = 0.7, labels: Sequence[str] | None = None,
             thresholds: dict | None = None, disabled: Sequence[str] = ()) -> DataFrame:
    """Requests -> completeness check -> serving prompt -> cascade (safety on the review
    text, heads and third stage on the prompt). One verdict per request: incomplete ones are
    quarantined at stage 0 with the missing fields."""
    from vetta.operators.cascade import STAGE3_LABELS, cascade
    from vetta.operators.cleaning import render_prompt, request_errors
    tagged = render_prompt(requests.withColumn("__error", request_errors()))
    req = tagged.select("id", F.col("review").alias("text"), "prompt", "__error")

    def on_prompt(fn):
        def run(df):
            swapped = df.withColumnRenamed("text", "__review").withColumnRenamed("prompt", "text")
            out = fn(swapped)
            return out.withColumnRenamed("text", "prompt").withColumnRenamed("__review", "text")
        return run

    return cascade(req, stage1, on_prompt(stage2), on_prompt(stage3), heads=list(heads),
                   head_threshold=head_threshold, labels=list(labels or STAGE3_LABELS),
                   thresholds=thresholds, disabled=disabled, texts=("text", "prompt"), incomplete="__error")


def moderate_with(requests: DataFrame, models, **settings) -> DataFrame:
    """``moderate`` with fitted models: (safety, heads, (features, label models))."""
    from vetta.operators import models as MD
    safety, heads, (feats, ml) = models
    return moderate(requests, lambda df: MD.score_safety(safety, df), lambda df: MD.score_heads(heads, df),
                    lambda df: MD.score_multilabel(feats, ml, df), list(heads), labels=list(ml), **settings)


def moderate_model_stream(stream: DataFrame, models, out: str, checkpoint: str,
                          available_now: bool = False, **settings):
    """T1 with fitted models: each micro-batch of requests goes through ``moderate``, and
    every request of it gets its verdict."""
    from vetta.streaming import moderate_stream
    return moderate_stream(stream, lambda batch: moderate_with(batch, models, **settings), out, checkpoint,
                           available_now=available_now)


# ------------------------------------------------------------------ W8 table profile
def profile_table(df: DataFrame, cols: Sequence[str] | None = None):
    """(value counts, null summary, duplicate count) of a table."""
    from vetta.operators.profile import duplicate_count, null_summary, value_counts
    return value_counts(df, cols), null_summary(df), duplicate_count(df)


# ------------------------------------------------------------------ W10 safety model
def run_safety(df: DataFrame, words: Sequence[str], key: str = "id", text: str = "text",
               label: str = "unsafe_label", grid: dict | None = None, params: dict | None = None,
               test_ratio: float = 0.25, seed: int = 42, folds_k: int = 3,
               save_to: str | None = None, threshold: float = 0.5, partitions: int | None = None):
    """Drop nulls -> stratified split -> (grid search over stratified folds, or the given
    point) -> fit -> optional save with the chosen parameters -> held-out report.
    Returns (model, scored test rows, report, cv scores or None)."""
    from vetta.operators import metrics as MX
    from vetta.operators import models as MD
    from vetta.operators.ordering import folds
    data = drop_null(df.select(key, text, label))
    parts = split(data, key, 1.0 - test_ratio, seed, stratify=label, first="train", second="test")
    train = parts.filter(F.col("split") == "train").drop("split")
    test = parts.filter(F.col("split") == "test").drop("split")
    scores = None
    if grid:
        model, scores = MD.search_safety(folds(train, key, folds_k, seed, stratify=label), words,
                                         "fold", text, label, grid, partitions=partitions)
        chosen = max(scores, key=lambda x: x[1])[0]
    else:
        chosen = dict(params or MD.SAFETY_BEST)
        model = MD.fit_safety(train, words, text, label, chosen, partitions=partitions)
    if save_to:
        MD.save_safety(model, save_to, chosen)
    scored = MD.score_safety(model, test.select(key, text, label))
    report = MX.classification_report(scored, label, "safety_prob", threshold)
    return model, scored, report, scores


# ------------------------------------------------------------------ W12 third stage
def run_multilabel(df: DataFrame, labels: Sequence[str], key: str = "id", text: str = "text",
                   ratio: float = 0.8, seed: int = 42, max_iters: Sequence[int] = (10, 30), **fit):
    """80/20 split -> fit with validation-loss selection -> per-label report with loss."""
    from vetta.operators import metrics as MX
    from vetta.operators import models as MD
    parts = written(split(df, key, ratio, seed, first="train", second="val"), "parts")
    train, val = parts.filter(F.col("split") == "train"), parts.filter(F.col("split") == "val")
    feats, models, loss = MD.fit_multilabel(train, labels, text, val=val, max_iters=max_iters, **fit)
    scored = MD.score_multilabel(feats, models, val)
    return (feats, models), MX.multilabel_report(scored, labels, loss=MX.bce_terms(labels))
