"""How the shared test tables play the roles of the review data.

Each role has a Spark builder and the equivalent DuckDB SQL (used by the oracle), kept
side by side so they cannot drift. All rules are deterministic functions of the input
rows (md5, modulo on ids); nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetta.functions.hashing import pseudo_prob
from vetta.functions.text import lexicon_hit
from vetta.session import spread

# Mild words planted in the toxic rows of the test tables (test lexicon).
TEST_LEXICON = ["trash", "idiot", "clown", "scum", "worthless", "moron", "pathetic",
                "loser", "disgusting", "stupid"]

# Canonical label vocabulary and the generation classes.
HEADS = ["spam", "ad", "irrelevant", "rant", "unsafe"]
CLASSES = ["spam", "advertisement", "irrelevant_content", "non_visitor_rant", "toxicity"]
ENCODER_LABELS = ["advertisement", "irrelevant_content", "non_visitor_rant", "toxicity"]


# tables whose rows carry long texts: spread them over the cores when the scan is narrow
TEXT_TABLES = {"documents", "conversations", "pages"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def sql_lexicon_hit(col: str, words=TEST_LEXICON) -> str:
    ors = " OR ".join(f"contains(lower({col}), '{w}')" for w in words)
    return f"CAST(({ors}) AS INTEGER)"


def sql_pseudo_prob(tag: str, key: str) -> str:
    return (f"(CAST(('0x' || substr(md5('{tag}:' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT)"
            f" / 4294967295.0)")


# ------------------------------------------------------------------ reviews + business
def reviews_raw(spark, d) -> DataFrame:
    doc = table(spark, d, "documents")
    return doc.select(
        F.col("doc_id").alias("id"), F.col("source").alias("gmap_id"),
        F.concat(F.lit("user"), (F.col("doc_id") % 50).cast("string")).alias("name"),
        F.col("text"), (F.lit(1) + F.col("doc_id") % 5).cast("double").alias("rating"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Thanks from "), F.upper("source")))
        .alias("resp"))


SQL_REVIEWS_RAW = """reviews_raw AS (
  SELECT doc_id AS id, source AS gmap_id, 'user' || CAST(doc_id % 50 AS VARCHAR) AS name, text,
         CAST(1 + doc_id % 5 AS DOUBLE) AS rating,
         CASE WHEN doc_id % 4 = 0 THEN 'Thanks from ' || upper(source) END AS resp
  FROM documents)"""


def business_meta(spark, d) -> DataFrame:
    doc = table(spark, d, "documents")
    return doc.groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("category")) \
        .select(F.col("source").alias("gmap_id"), F.upper("source").alias("name"),
                "category", F.concat(F.lit("Local business "), F.col("source")).alias("description"))


SQL_BUSINESS_META = """business_meta AS (
  SELECT source AS gmap_id, upper(source) AS name, list_sort(list_distinct(list(lang))) AS category,
         'Local business ' || source AS description
  FROM documents GROUP BY source)"""


# ------------------------------------------------------------------ requests
def requests(spark, d) -> DataFrame:
    doc = table(spark, d, "documents")
    return doc.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 17 == 0, F.lit("")).otherwise(F.upper("source")).alias("name"),
        F.col("lang").alias("category"),
        F.when(F.col("doc_id") % 13 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Local business "), F.col("source"))).alias("description"),
        F.col("text").alias("review"),
        (F.lit(1) + F.col("doc_id") % 5).cast("double").alias("rating"))


SQL_REQUESTS = """requests AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE upper(source) END AS name,
         lang AS category,
         CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 'Local business ' || source END AS description,
         text AS review, CAST(1 + doc_id % 5 AS DOUBLE) AS rating
  FROM documents)"""


# ------------------------------------------------------------------ scores
def probabilities(spark, d) -> DataFrame:
    """Per document: safety probability (lexicon-driven), head and label probabilities."""
    return probabilities_from(table(spark, d, "documents"))


def probabilities_from(doc: DataFrame) -> DataFrame:
    """The same scores for any frame with ``doc_id`` and ``text`` (batch or stream)."""
    hit = lexicon_hit("text", TEST_LEXICON)
    cols = {"id": F.col("doc_id"),
            "safety_prob": F.round(hit * 0.55 + pseudo_prob("safety", "doc_id") * 0.45, 6)}
    for h in HEADS:
        p = pseudo_prob(h, "doc_id")
        cols[f"{h}_prob"] = F.round(p * p * p, 6)
    for lab in ENCODER_LABELS:
        p = pseudo_prob(lab, "doc_id")
        cols[f"{lab}_prob"] = F.round(p * p, 6)
    return doc.select(*[v.alias(k) for k, v in cols.items()])


def sql_probabilities() -> str:
    cols = [f"round({sql_lexicon_hit('text')} * 0.55 + {sql_pseudo_prob('safety', 'doc_id')} * 0.45, 6) AS safety_prob"]
    for h in HEADS:
        p = sql_pseudo_prob(h, "doc_id")
        cols.append(f"round({p} * {p} * {p}, 6) AS {h}_prob")
    for lab in ENCODER_LABELS:
        p = sql_pseudo_prob(lab, "doc_id")
        cols.append(f"round({p} * {p}, 6) AS {lab}_prob")
    return "probabilities AS (\n  SELECT doc_id AS id, " + ",\n    ".join(cols) + "\n  FROM documents)"


def head_scores(spark, d) -> DataFrame:
    """Long form (id, head, label, prob): each head's top-1 label and its probability."""
    probs = probabilities(spark, d)
    stacked = probs.select("id", F.explode(F.array(*[
        F.struct(F.lit(h).alias("head"), F.col(f"{h}_prob").alias("p")) for h in HEADS])).alias("s"))
    p = F.col("s.p")
    return stacked.select("id", F.col("s.head").alias("head"),
                          F.when(p > 0.5, F.lit("__label__pos")).otherwise(F.lit("__label__neg"))
                          .alias("label"),
                          F.when(p > 0.5, p).otherwise(F.round(1 - p, 6)).alias("prob"))


def sql_head_scores() -> str:
    parts = " UNION ALL ".join(f"SELECT id, '{h}' AS head, {h}_prob AS p FROM probabilities"
                               for h in HEADS)
    return f"""head_scores AS (
  SELECT id, head, CASE WHEN p > 0.5 THEN '__label__pos' ELSE '__label__neg' END AS label,
         CASE WHEN p > 0.5 THEN p ELSE round(1 - p, 6) END AS prob
  FROM ({parts}))"""


# ------------------------------------------------------------------ toxicity sources
def jigsaw_raw(spark, d) -> DataFrame:
    doc = table(spark, d, "documents")
    lab = table(spark, d, "labels")
    j = doc.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id"), F.col("source").alias("id"), F.col("text").alias("comment_text"),
        F.col("toxic"), (F.lit(1) - F.col("quality")).alias("severe_toxic"),
        (F.col("n_chars") % 97 == 0).cast("int").alias("obscene"),
        F.col("text").contains("!").cast("int").alias("threat"),
        lexicon_hit("text", ["idiot", "moron", "loser"]).alias("insult"),
        F.when(F.col("lang") == "de", F.lit(1)).alias("identity_hate"))


SQL_JIGSAW_RAW = f"""jigsaw_raw AS (
  SELECT d.doc_id, d.source AS id, d.text AS comment_text, l.toxic, 1 - l.quality AS severe_toxic,
         CAST(d.n_chars % 97 = 0 AS INTEGER) AS obscene, CAST(contains(d.text, '!') AS INTEGER) AS threat,
         {sql_lexicon_hit('d.text', ['idiot', 'moron', 'loser'])} AS insult,
         CASE WHEN d.lang = 'de' THEN 1 END AS identity_hate
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def toxigen_gen(spark, d) -> DataFrame:
    doc = table(spark, d, "documents")
    lab = table(spark, d, "labels")
    return doc.join(lab, "doc_id", "left").select(
        F.col("doc_id"),
        F.replace(F.col("text"), F.lit("\n"), F.lit("\\n")).alias("prompt"),
        F.concat(F.lit("-- "), F.col("text")).alias("generation"),
        F.coalesce(F.col("toxic"), F.lit(0)).alias("prompt_label"))


SQL_TOXIGEN_GEN = """toxigen_gen AS (
  SELECT d.doc_id, replace(d.text, chr(10), '\\n') AS prompt, '-- ' || d.text AS generation,
         coalesce(l.toxic, 0) AS prompt_label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def toxigen_annotated(spark, d) -> DataFrame:
    doc = table(spark, d, "documents")
    return doc.select(F.col("doc_id"), F.col("text"),
                      ((F.col("doc_id") % 11) * 0.5).alias("toxicity_human"))


SQL_TOXIGEN_ANNOTATED = """toxigen_annotated AS (
  SELECT doc_id, text, (doc_id % 11) * 0.5 AS toxicity_human FROM documents)"""


def tweets(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("tweet"))


SQL_TWEETS = "tweets AS (SELECT doc_id, text AS tweet FROM documents)"


# ------------------------------------------------------------------ label tables
def llm_labels(spark, d) -> DataFrame:
    """Label records as a labelling service returns them (strings); toxic documents are
    labelled twice (``seq`` 1 then 2) and the later record is the one that counts."""
    doc = table(spark, d, "documents")
    lab = table(spark, d, "labels")
    j = lab.join(doc.select("doc_id", "n_chars", "lang", "text"), "doc_id", "inner")
    j = j.withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(1) + F.col("toxic"))))
    return j.select(
        F.col("doc_id").alias("job_id"), F.col("seq"),
        (F.lit(1) - F.col("quality")).cast("string").alias("spam"),
        (F.col("n_chars") < 300).cast("int").cast("string").alias("advertisement"),
        (F.col("lang") != "en").cast("int").cast("string").alias("irrelevant_content"),
        F.col("text").contains("!").cast("int").cast("string").alias("non_visitor_rant"),
        F.when(F.col("seq") == 2, F.col("toxic")).otherwise(F.lit(0)).cast("string").alias("toxicity"))


SQL_LLM_LABELS = """llm_labels AS (
  SELECT l.doc_id AS job_id, s.seq,
         CAST(1 - l.quality AS VARCHAR) AS spam,
         CAST(CAST(d.n_chars < 300 AS INTEGER) AS VARCHAR) AS advertisement,
         CAST(CAST(d.lang <> 'en' AS INTEGER) AS VARCHAR) AS irrelevant_content,
         CAST(CAST(contains(d.text, '!') AS INTEGER) AS VARCHAR) AS non_visitor_rant,
         CAST(CASE WHEN s.seq = 2 THEN l.toxic ELSE 0 END AS VARCHAR) AS toxicity
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id,
       LATERAL (SELECT unnest(range(1, 2 + l.toxic)) AS seq) s)"""


def head_samples(spark, d) -> DataFrame:
    """Raw head-training rows: string flags (some malformed on purpose) + text."""
    doc = table(spark, d, "documents")
    lab = table(spark, d, "labels")
    j = doc.join(lab, "doc_id", "left")
    # advertising is what the text says: a license or an address; the spelling varies
    m = F.col("doc_id") % 9
    told = F.lower("text").contains("license") | F.col("text").contains("@") | F.col("text").contains("|")
    ad = (F.when(m == 3, F.lit("2")).when(m == 4, F.lit("yes"))
          .when(told, F.when(m == 0, F.lit("1.0")).when(m == 1, F.lit(" 1 ")).otherwise(F.lit("1")))
          .otherwise(F.when(m == 2, F.lit("0.9")).otherwise(F.lit("0"))))
    return j.select(
        "doc_id",
        F.coalesce((F.lit(1) - F.col("quality")).cast("string"), F.lit("0")).alias("spam"),
        ad.alias("ad"),
        (F.col("lang") != "en").cast("int").cast("string").alias("irrelevant"),
        F.col("text").contains("!").cast("int").cast("string").alias("rant"),
        F.coalesce(F.col("toxic").cast("string"), F.lit("0")).alias("unsafe"),
        F.col("text"))


SQL_HEAD_SAMPLES = """head_samples AS (
  SELECT d.doc_id,
         coalesce(CAST(1 - l.quality AS VARCHAR), '0') AS spam,
         CASE WHEN d.doc_id % 9 = 3 THEN '2' WHEN d.doc_id % 9 = 4 THEN 'yes'
              WHEN contains(lower(d.text), 'license') OR contains(d.text, '@') OR contains(d.text, '|')
              THEN CASE d.doc_id % 9 WHEN 0 THEN '1.0' WHEN 1 THEN ' 1 ' ELSE '1' END
              WHEN d.doc_id % 9 = 2 THEN '0.9' ELSE '0' END AS ad,
         CAST(CAST(d.lang <> 'en' AS INTEGER) AS VARCHAR) AS irrelevant,
         CAST(CAST(contains(d.text, '!') AS INTEGER) AS VARCHAR) AS rant,
         coalesce(CAST(l.toxic AS VARCHAR), '0') AS unsafe, d.text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def llm_responses(spark, d) -> DataFrame:
    """Free-text generation responses with JSON objects embedded (one per turn, around the
    whole turn text; some with quotes, braces and newlines), plus a broken brace group on
    every third turn."""
    conv = table(spark, d, "conversations")
    cls = F.element_at(F.array(*[F.lit(c) for c in CLASSES]),
                       (F.col("conv_id") % 5 + 1).cast("int"))
    review = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("Fallback "), cls, F.lit(" review"))) \
        .when(F.col("turn") % 4 == 2, F.concat(F.lit('she said "no" \\ {once}\n'), F.col("text"))) \
        .otherwise(F.col("text"))
    stars = (F.col("turn") % 5 + 1).cast("string")
    # every other rating is a JSON string; the object's text is whatever the conversation holds
    obj = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(
        review.alias("review"), stars.alias("rating"),
        F.concat(F.lit("B"), F.col("conv_id").cast("string")).alias("business_name")))) \
        .otherwise(F.to_json(F.struct(
            review.alias("review"), stars.cast("int").alias("rating"),
            F.concat(F.lit("B"), F.col("conv_id").cast("string")).alias("business_name"))))
    content = F.concat(F.col("role"), F.lit(" wrote: "), obj,
                       F.when(F.col("turn") % 3 == 0, F.lit(' and {broken "x": }'))
                       .otherwise(F.lit("")))
    return conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("batch_id"),
                       cls.alias("class_type"), content.alias("content"))


SQL_LLM_RESPONSES = """llm_responses AS (
  SELECT conv_id * 1000 + turn AS batch_id,
         (['spam','advertisement','irrelevant_content','non_visitor_rant','toxicity'])[conv_id % 5 + 1] AS class_type,
         role || ' wrote: ' || CASE WHEN conv_id % 2 = 0
           THEN CAST(to_json({'review': review, 'rating': CAST(turn % 5 + 1 AS VARCHAR), 'business_name': 'B' || CAST(conv_id AS VARCHAR)}) AS VARCHAR)
           ELSE CAST(to_json({'review': review, 'rating': CAST(turn % 5 + 1 AS INTEGER), 'business_name': 'B' || CAST(conv_id AS VARCHAR)}) AS VARCHAR) END
           || CASE WHEN turn % 3 = 0 THEN ' and {broken "x": }' ELSE '' END AS content
  FROM (SELECT *, CASE turn % 4
          WHEN 3 THEN 'Fallback ' || (['spam','advertisement','irrelevant_content','non_visitor_rant','toxicity'])[conv_id % 5 + 1] || ' review'
          WHEN 2 THEN 'she said "no" \\ {once}' || chr(10) || text ELSE text END AS review
        FROM conversations))"""
