"""Registered queries: one per operator/job, each reading the shared test tables.

``QUERIES[name] = (callable(spark, sf_dir) -> DataFrame, duckdb_sql or None)``. The SQL
twin is what the oracle runs on the same Parquet files; queries that fit models or run
a stream end to end (and so have no SQL twin) say so with ``None``.
Arrays are emitted as comma-joined strings and doubles rounded to 6 digits so both
engines print identical values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetta.functions.hashing import md5_order, pseudo_prob
from vetta.functions.text import NON_WS, clean_tweet, collapse_ws, lexicon_hit
from vetta.operators import cleaning as C
from vetta.operators import metrics as MX
from vetta.operators import ordering as O
from vetta.operators import profile as PF
from vetta.operators import tables as TB
from vetta.operators.cascade import STAGE2_HEADS, STAGE3_LABELS, cascade_rules, verdict_summary
from vetta.operators.gate import fire_top1, or_gate
from vetta.plans import jobs as J
from vetta.plans import roles as R
from vetta.plans import sqltext as S

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


LEX = R.TEST_LEXICON


# =====================================================================================
# Flagship: documents -> tweet cleaning -> lexicon -> rule cascade -> counts by stage
# =====================================================================================
def _scored_clean_docs(spark, d) -> DataFrame:
    doc = R.table(spark, d, "documents").select("doc_id", clean_tweet("text").alias("text"))
    hit = lexicon_hit("text", LEX)
    cols = {"id": F.col("doc_id"),
            "safety_prob": F.round(hit * 0.55 + pseudo_prob("safety", "doc_id") * 0.45, 6)}
    for h in R.HEADS:
        p = pseudo_prob(h, "doc_id")
        cols[f"{h}_prob"] = F.round(p * p * p, 6)
    for lab in R.ENCODER_LABELS:
        p = pseudo_prob(lab, "doc_id")
        cols[f"{lab}_prob"] = F.round(p * p, 6)
    return doc.select(*[v.alias(k) for k, v in cols.items()])


def _sql_probabilities_from(src: str, text: str) -> str:
    cols = [f"round({S.lexicon_hit(text, LEX)} * 0.55 + {R.sql_pseudo_prob('safety', 'doc_id')} * 0.45, 6) AS safety_prob"]
    for h in R.HEADS:
        p = R.sql_pseudo_prob(h, "doc_id")
        cols.append(f"round({p} * {p} * {p}, 6) AS {h}_prob")
    for lab in R.ENCODER_LABELS:
        p = R.sql_pseudo_prob(lab, "doc_id")
        cols.append(f"round({p} * {p}, 6) AS {lab}_prob")
    return f"SELECT doc_id AS id, {', '.join(cols)} FROM {src}"


def _sql_cascade(src: str) -> str:
    fired = ", ".join(f"CASE WHEN {h}_prob > 0.5 AND {h}_prob >= 0.7 THEN '{h}' END"
                      for h in STAGE2_HEADS)
    flagged = ", ".join(f"CASE WHEN {lab}_prob > 0.5 THEN '{lab}' END" for lab in STAGE3_LABELS)
    return f"""SELECT id,
  CASE WHEN safety_prob > 0.5 THEN 1 WHEN fired <> '' THEN 2 ELSE 3 END AS stage,
  CASE WHEN safety_prob > 0.5 OR fired <> '' OR flagged <> '' THEN 'reject' ELSE 'accept' END AS decision,
  safety_prob,
  CASE WHEN safety_prob > 0.5 THEN NULL ELSE fired END AS fired_heads,
  CASE WHEN safety_prob > 0.5 THEN 'safety' WHEN fired <> '' THEN fired ELSE flagged END AS reasons
FROM (SELECT *, concat_ws(',', {fired}) AS fired, concat_ws(',', {flagged}) AS flagged FROM {src})"""


def _flat_verdicts(v: DataFrame) -> DataFrame:
    return v.select("id", "stage", "decision", "safety_prob",
                    F.array_join("fired_heads", ",").alias("fired_heads"),
                    F.array_join("reasons", ",").alias("reasons"))


def flagship(spark, d) -> DataFrame:
    verdicts = cascade_rules(_scored_clean_docs(spark, d))
    lab = R.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "toxic")
    return (verdicts.join(lab, "id", "left")
            .groupBy("stage", "decision", "toxic").agg(F.count(F.lit(1)).alias("reviews")))


register("flagship_moderation", _with(
    f"clean AS (SELECT doc_id, {S.clean_tweet('text')} AS text FROM documents)",
    f"probabilities AS ({_sql_probabilities_from('clean', 'text')})",
    f"verdicts AS ({_sql_cascade('probabilities')})") + """
SELECT v.stage, v.decision, l.toxic, count(*) AS reviews
FROM verdicts v LEFT JOIN labels l ON v.id = l.doc_id GROUP BY ALL""")(flagship)


# =====================================================================================
# Text expressions
# =====================================================================================
@register("p8_clean_tweet", f"SELECT doc_id, {S.clean_tweet('text')} AS text FROM documents")
def q_p8(spark, d):
    return R.table(spark, d, "documents").select("doc_id", clean_tweet("text").alias("text"))


@register("p7_collapse_ws", f"SELECT doc_id, {S.collapse_ws('text')} AS text FROM documents")
def q_p7(spark, d):
    return R.table(spark, d, "documents").select("doc_id", collapse_ws("text").alias("text"))


@register("p21_lexicon_flag",
          f"SELECT doc_id, {S.lexicon_hit('text', LEX)} AS lexicon, "
          f"{S.lexicon_whole_word('text', LEX)} AS lexicon_whole_word FROM documents")
def q_p21(spark, d):
    doc = R.table(spark, d, "documents")
    return doc.select("doc_id", lexicon_hit("text", LEX).alias("lexicon"),
                      lexicon_hit("text", LEX, whole_word=True).alias("lexicon_whole_word"))


@register("p21_lexicon_join", f"SELECT doc_id, {S.lexicon_whole_word('text', LEX)} AS lexicon FROM documents")
def q_p21j(spark, d):
    """Whole lexicon words by the join for large lists; here the list is the test lexicon."""
    from vetta.operators.features import lexicon_join
    words = spark.createDataFrame([(w,) for w in LEX], "word string")
    return lexicon_join(R.table(spark, d, "documents"), "doc_id", "text", words)


_SQL_ITEM_WORDS = ("lex AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{10,}')) AS word FROM benchmark)")


@register("p21_lexicon_index", f"WITH {_SQL_ITEM_WORDS}" + """
SELECT doc_id, CAST(EXISTS (SELECT 1 FROM lex WHERE contains(lower(text), word)) AS INTEGER) AS part,
       CAST(EXISTS (SELECT 1 FROM lex WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])' || word || '([^\\p{L}\\p{N}_]|$)'))
            AS INTEGER) AS whole FROM documents""")
def q_p21i(spark, d):
    """The list is every word of ten letters or more of the benchmark: found inside words of the
    documents, and as whole words, by the q-gram index."""
    from vetta.operators.features import lexicon_join
    long_words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{10,}"), F.lit(0))
    words = R.table(spark, d, "benchmark").select(F.explode(long_words).alias("word"))
    doc = R.table(spark, d, "documents")
    part = lexicon_join(doc, "doc_id", "text", words, out="part", whole_word=False)
    return part.join(lexicon_join(doc, "doc_id", "text", words, out="whole"), "doc_id")


@register("p6_render_prompt", _with(R.SQL_REQUESTS) + f"""
SELECT id, {S.strip_ws("replace(" + " || '            ' || ".join([
    "'Business Name: ' || coalesce(name, 'None')", "'Category: ' || coalesce(category, 'None')",
    "'Description: ' || coalesce(description, 'None')", "'Review: ' || coalesce(review, 'None')",
    "'Rating: ' || coalesce(" + S.rating_text('rating') + ", 'None')"]) + ", chr(10), '')")} AS prompt
FROM requests""")
def q_p6(spark, d):
    return C.render_prompt(R.requests(spark, d)).select("id", "prompt")


# =====================================================================================
# Requests (P24)
# =====================================================================================
def _sql_request_errors() -> str:
    checks = ", ".join(
        f"CASE WHEN {f} IS NULL OR length({S.strip_ws(f'CAST({f} AS VARCHAR)')}) = 0 THEN 'missing {f}' END"
        for f in C.REQUEST_FIELDS)
    return f"SELECT *, concat_ws('; ', {checks}) AS error FROM requests"


@register("p24_valid_requests", _with(R.SQL_REQUESTS) +
          f"SELECT id, name, category, description, review, rating FROM ({_sql_request_errors()}) WHERE error = ''")
def q_p24v(spark, d):
    return C.validate_requests(R.requests(spark, d))[0]


@register("p24_rejected_requests", _with(R.SQL_REQUESTS) +
          f"SELECT id, error FROM ({_sql_request_errors()}) WHERE error <> ''")
def q_p24r(spark, d):
    return C.validate_requests(R.requests(spark, d))[1].select("id", "error")


# =====================================================================================
# Nulls, lists, renames
# =====================================================================================
@register("p1_drop_null_text", """
SELECT d.doc_id AS id, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE (CASE WHEN l.doc_id IS NOT NULL THEN d.text END) IS NOT NULL""")
def q_p1(spark, d):
    doc = R.table(spark, d, "documents")
    lab = R.table(spark, d, "labels").select("doc_id", F.lit(1).alias("has"))
    t = doc.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"), "source", F.when(F.col("has") == 1, F.col("text")).alias("text"))
    return C.drop_null(t, ["text"]).select("id", "source")


@register("p2_drop_any_null", _with(R.SQL_REVIEWS_RAW) +
          "SELECT id, gmap_id, name, rating, resp FROM reviews_raw "
          "WHERE id IS NOT NULL AND gmap_id IS NOT NULL AND name IS NOT NULL AND text IS NOT NULL "
          "AND rating IS NOT NULL AND resp IS NOT NULL")
def q_p2(spark, d):
    return C.drop_null(R.reviews_raw(spark, d)).select("id", "gmap_id", "name", "rating", "resp")


@register("p3_lists_to_text", _with(R.SQL_BUSINESS_META) +
          "SELECT gmap_id, name, array_to_string(category, ', ') AS category, description FROM business_meta")
def q_p3(spark, d):
    return C.lists_to_text(R.business_meta(spark, d))


# =====================================================================================
# Joins and de-duplication
# =====================================================================================
@register("j1_join_business", _with(R.SQL_REVIEWS_RAW, R.SQL_BUSINESS_META) + """
SELECT r.id, r.gmap_id, r.name AS name_x, m.name AS name_y, array_to_string(m.category, ',') AS category,
       m.description, r.rating
FROM reviews_raw r JOIN business_meta m ON r.gmap_id IS NOT DISTINCT FROM m.gmap_id""")
def q_j1(spark, d):
    j = TB.join_business(R.reviews_raw(spark, d), R.business_meta(spark, d))
    return j.select("id", "gmap_id", "name_x", "name_y",
                    F.array_join("category", ",").alias("category"), "description", "rating")


@register("d1_keep_first", _with(R.SQL_REVIEWS_RAW) + """
SELECT id, name, gmap_id FROM (
  SELECT *, row_number() OVER (PARTITION BY name, text, gmap_id ORDER BY id) AS rn FROM reviews_raw)
WHERE rn = 1""")
def q_d1(spark, d):
    r = R.reviews_raw(spark, d).select("id", "name", "text", "gmap_id")
    return TB.keep_first(r, ["name", "text", "gmap_id"], "id").select("id", "name", "gmap_id")


_SQL_W1 = _with(R.SQL_REVIEWS_RAW, R.SQL_BUSINESS_META, """j AS (
  SELECT r.id, r.gmap_id, r.name AS name_x, r.text, r.rating, r.resp, m.name AS name_y, m.category,
         m.description
  FROM reviews_raw r JOIN business_meta m ON r.gmap_id IS NOT DISTINCT FROM m.gmap_id
  WHERE r.text IS NOT NULL)""", """d AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name_x, text, gmap_id ORDER BY id) AS rn FROM j)
  WHERE rn = 1)""", """c AS (
  SELECT row_number() OVER (ORDER BY id) - 1 AS id, name_y AS business_name,
         array_to_string(category, ', ') AS category, description, text AS review, rating,
         resp AS response
  FROM d)""") + f"""SELECT id, business_name, category, description, review, rating, response,
       {S.render_message()} AS user_message FROM c"""


@register("w1_prepare_reviews", _SQL_W1)
def q_w1(spark, d):
    return J.prepare_reviews(R.reviews_raw(spark, d), R.business_meta(spark, d))


# =====================================================================================
# Safety tables (P12, D2, P25, P9, P11, P13, D3, D4, P14, P2) = W4, W5, W6, W7
# =====================================================================================
_SQL_W4_SELECT = """
SELECT comment_text AS text, unsafe_label FROM (
  SELECT *, row_number() OVER (PARTITION BY id, comment_text ORDER BY doc_id) AS rn,
         CAST(greatest(coalesce(toxic, 0), coalesce(severe_toxic, 0), coalesce(obscene, 0),
                       coalesce(threat, 0), coalesce(insult, 0), coalesce(identity_hate, 0), 0) <> 0
              AS INTEGER) AS unsafe_label
  FROM jigsaw_raw) WHERE rn = 1"""
_SQL_W4 = _with(R.SQL_JIGSAW_RAW) + _SQL_W4_SELECT


@register("w4_clean_jigsaw", _SQL_W4)
def q_w4(spark, d):
    return J.clean_jigsaw(R.jigsaw_raw(spark, d))


_SQL_W5_BODY = f"""gen AS (
  SELECT {S.strip_dashes('text')} AS text, unsafe_label FROM (
    SELECT unnest(list_append(coalesce(string_split(prompt, '\\n'), []), generation)) AS text,
           prompt_label AS unsafe_label
    FROM toxigen_gen)
  WHERE text IS NOT NULL AND unsafe_label IS NOT NULL),
gen_clean AS (SELECT * FROM gen WHERE regexp_matches(text, '[A-Za-z]')),
ann AS (
  SELECT text, CASE WHEN toxicity_human > 2.5 THEN 1 WHEN toxicity_human <= 2.0 THEN 0 END AS unsafe_label
  FROM toxigen_annotated),
toxigen AS (
  SELECT DISTINCT text, unsafe_label FROM (
    SELECT text, unsafe_label FROM gen_clean
    UNION ALL SELECT text, unsafe_label FROM ann WHERE unsafe_label IS NOT NULL))"""


@register("w5_clean_toxigen", _with(R.SQL_TOXIGEN_GEN, R.SQL_TOXIGEN_ANNOTATED, _SQL_W5_BODY) +
          "SELECT text, unsafe_label FROM toxigen")
def q_w5(spark, d):
    return J.clean_toxigen(R.toxigen_gen(spark, d), R.toxigen_annotated(spark, d))


@register("p25_explode_prompts", _with(R.SQL_TOXIGEN_GEN) + """
SELECT unnest(list_append(coalesce(string_split(prompt, '\\n'), []), generation)) AS text,
       prompt_label AS unsafe_label
FROM toxigen_gen""")
def q_p25(spark, d):
    return C.explode_prompts(R.toxigen_gen(spark, d))


_SQL_W6 = f"SELECT DISTINCT {S.clean_tweet('tweet')} AS text, 1 AS unsafe_label FROM tweets"


@register("w6_clean_tweets", _with(R.SQL_TWEETS) + _SQL_W6)
def q_w6(spark, d):
    return J.clean_tweets(R.tweets(spark, d))


@register("w7_combine_safety", _with(
    R.SQL_JIGSAW_RAW, R.SQL_TOXIGEN_GEN, R.SQL_TOXIGEN_ANNOTATED, _SQL_W5_BODY, R.SQL_TWEETS,
    "w4 AS (" + _SQL_W4_SELECT + ")",
    "w6 AS (" + _SQL_W6 + ")") + """
SELECT DISTINCT text, unsafe_label FROM (
  SELECT text, unsafe_label FROM w4 UNION ALL SELECT text, unsafe_label FROM toxigen
  UNION ALL SELECT text, unsafe_label FROM w6)
WHERE text IS NOT NULL AND unsafe_label IS NOT NULL""")
def q_w7(spark, d):
    return J.combine_safety(J.clean_jigsaw(R.jigsaw_raw(spark, d)),
                            J.clean_toxigen(R.toxigen_gen(spark, d), R.toxigen_annotated(spark, d), unique=False),
                            J.clean_tweets(R.tweets(spark, d), unique=False))


@register("p13_band_label", _with(R.SQL_TOXIGEN_ANNOTATED) + """
SELECT doc_id, CASE WHEN toxicity_human > 2.5 THEN 1 ELSE 0 END AS unsafe_label FROM toxigen_annotated
WHERE toxicity_human > 2.5 OR toxicity_human <= 2.0""")
def q_p13(spark, d):
    return C.band_label(R.toxigen_annotated(spark, d), "toxicity_human").select("doc_id", "unsafe_label")


# =====================================================================================
# Label parsing and head training lines (P16, P18, P7, O6, P19) = W9
# =====================================================================================
_HEAD_CATS = J.HEAD_CATEGORIES


def _sql_parsed_samples() -> str:
    cols = ", ".join(f"{S.parse_label(c)} AS p_{c}" for c in _HEAD_CATS)
    return f"parsed AS (SELECT *, {cols} FROM head_samples)"


def _sql_bad_cond() -> str:
    return " OR ".join(f"p_{c} IS NULL" for c in _HEAD_CATS)


@register("p16_parse_labels_valid", _with(R.SQL_HEAD_SAMPLES, _sql_parsed_samples()) +
          "SELECT doc_id, " + ", ".join(f"p_{c} AS {c}" for c in _HEAD_CATS) +
          f" FROM parsed WHERE NOT ({_sql_bad_cond()})")
def q_p16v(spark, d):
    good, _ = C.parse_labels(R.head_samples(spark, d), _HEAD_CATS)
    return good.select("doc_id", *_HEAD_CATS)


@register("p16_parse_labels_rejected", _with(R.SQL_HEAD_SAMPLES, _sql_parsed_samples()) +
          "SELECT doc_id, concat_ws('; ', " + ", ".join(
              f"CASE WHEN p_{c} IS NULL THEN '{c}: not a 0/1 flag: ' || coalesce({c}, 'null') END"
              for c in _HEAD_CATS) + f") AS error FROM parsed WHERE {_sql_bad_cond()}")
def q_p16r(spark, d):
    _, bad = C.parse_labels(R.head_samples(spark, d), _HEAD_CATS)
    return bad.select("doc_id", "error")


_SQL_W9 = _with(R.SQL_HEAD_SAMPLES, _sql_parsed_samples(), f"""good AS (
  SELECT doc_id, {', '.join(f'p_{c} AS {c}' for c in _HEAD_CATS)}, {S.collapse_ws('text')} AS text
  FROM parsed WHERE NOT ({_sql_bad_cond()})),
nonempty AS (SELECT * FROM good WHERE length(text) > 0),
parts AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1
                      < floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'eval' END AS split
  FROM nonempty)""") + "SELECT split, category, doc_id, " \
    "CASE WHEN label = 1 THEN '__label__pos' ELSE '__label__neg' END || ' ' || text AS line FROM (" + \
    " UNION ALL ".join(f"SELECT split, '{c}' AS category, doc_id, {c} AS label, text FROM parts"
                       for c in _HEAD_CATS) + ")"


@register("w9_head_training_lines", _SQL_W9)
def q_w9(spark, d):
    lines, _ = J.head_training_table(R.head_samples(spark, d), key="doc_id")
    return lines


# =====================================================================================
# Label tables (S3 shape, J2, P10, J3, P22) = W2 and prompt pairs
# =====================================================================================
def _reviews_msg(spark, d) -> DataFrame:
    raw = R.reviews_raw(spark, d)
    meta = C.lists_to_text(R.business_meta(spark, d))
    j = TB.join_business(raw, meta)
    canon = j.select("id", F.col("name_y").alias("business_name"), "category", "description",
                     F.col("text").alias("review"), "rating", F.col("resp").alias("response"))
    return C.render_message(canon)


_SQL_REVIEWS_MSG = f"""reviews_msg AS (
  SELECT r.id, {S.render_message('m.name', "array_to_string(m.category, ', ')", 'm.description',
                                   'r.text', 'r.rating', 'r.resp')} AS user_message
  FROM reviews_raw r JOIN business_meta m ON r.gmap_id IS NOT DISTINCT FROM m.gmap_id)"""

_FLAGS5 = ["spam", "advertisement", "irrelevant_content", "non_visitor_rant", "toxicity"]


@register("w2_label_table", _with(R.SQL_LLM_LABELS, R.SQL_REVIEWS_RAW, R.SQL_BUSINESS_META,
                                  _SQL_REVIEWS_MSG) + """
SELECT r.user_message AS text,
       coalesce(TRY_CAST(l.spam AS INTEGER), 0) AS spam,
       coalesce(TRY_CAST(l.advertisement AS INTEGER), 0) AS advertisement,
       coalesce(TRY_CAST(l.irrelevant_content AS INTEGER), 0) AS relevance,
       coalesce(TRY_CAST(l.non_visitor_rant AS INTEGER), 0) AS rant,
       coalesce(TRY_CAST(l.toxicity AS INTEGER), 0) AS toxicity
FROM llm_labels l LEFT JOIN reviews_msg r ON l.job_id = r.id""")
def q_w2(spark, d):
    return J.build_label_table(R.llm_labels(spark, d), _reviews_msg(spark, d))


@register("p10_rename_labels", _with(R.SQL_LLM_LABELS) + """
SELECT job_id, seq, spam, advertisement, irrelevant_content AS relevance, non_visitor_rant AS rant,
       toxicity, 0 AS extra_flag FROM llm_labels""")
def q_p10(spark, d):
    out = C.rename_labels(R.llm_labels(spark, d), J.LLM_TO_FINAL, required=["extra_flag"])
    return out


_ENC = R.ENCODER_LABELS


@register("j3_prompt_pairs", _with(R.SQL_LLM_LABELS, R.SQL_REVIEWS_RAW, R.SQL_BUSINESS_META,
                                   _SQL_REVIEWS_MSG) + """
SELECT r.id, r.user_message AS prompt,
       '{' || string_agg('"' || k || '": ' || v, ', ' ORDER BY o) || '}' AS response
FROM reviews_msg r JOIN (
  SELECT job_id, k, o, CAST(coalesce(TRY_CAST(val AS INTEGER), 0) AS VARCHAR) AS v FROM (
    SELECT job_id, unnest(['advertisement','irrelevant_content','non_visitor_rant','toxicity']) AS k,
           unnest([1, 2, 3, 4]) AS o,
           unnest([advertisement, irrelevant_content, non_visitor_rant, toxicity]) AS val
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn
                         FROM llm_labels) WHERE rn = 1))) l
ON r.id = l.job_id GROUP BY r.id, r.user_message""")
def q_j3(spark, d):
    labels = R.llm_labels(spark, d).select(
        "job_id", "seq", *[F.coalesce(F.col(c).try_cast("int"), F.lit(0)).alias(c) for c in _ENC])
    pairs = TB.prompt_pairs(_reviews_msg(spark, d), labels, _ENC)
    return pairs.select("id", F.col("user_message").alias("prompt"),
                        J.response_json(_ENC).alias("response"))


# =====================================================================================
# Synthetic reviews (P23, P15, P20, O1, P5, P10) = W3 and its checks
# =====================================================================================
_SQL_OBJS = f"""objs AS (
  SELECT batch_id, class_type, obj, CAST(obj_pos AS INTEGER) AS obj_pos FROM (
    SELECT batch_id, class_type, unnest({S.json_objects('content')}) AS obj,
           unnest(range(len({S.json_objects('content')}))) AS obj_pos
    FROM llm_responses)
  WHERE json_valid(obj) AND json_type(obj) = 'OBJECT'),
parsed AS (
  SELECT batch_id, class_type, obj_pos, json_extract_string(obj, '$.review') AS review,
         TRY_CAST(json_extract_string(obj, '$.rating') AS DOUBLE) AS rating,
         json_extract_string(obj, '$.business_name') AS business_name,
         json_extract_string(obj, '$.category') AS category,
         json_extract_string(obj, '$.description') AS description,
         json_extract_string(obj, '$.response') AS response,
         {', '.join(f"CAST(class_type = '{c}' AS INTEGER) AS label_{c}" for c in J.GENERATION_CLASSES)}
  FROM objs)"""


@register("p23_extract_json", _with(R.SQL_LLM_RESPONSES, _SQL_OBJS) +
          "SELECT batch_id, obj_pos, review, rating, business_name FROM parsed")
def q_p23(spark, d):
    sch = T.StructType([T.StructField("review", T.StringType()),
                        T.StructField("rating", T.DoubleType()),
                        T.StructField("business_name", T.StringType())])
    return C.extract_json(R.llm_responses(spark, d), "content", sch, keep=["batch_id"])


_SQL_W3 = _with(R.SQL_LLM_RESPONSES, _SQL_OBJS, """kept AS (
  SELECT * FROM parsed WHERE NOT coalesce(contains(lower(review), 'fallback'), false)),
shuffled AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(batch_id AS VARCHAR) || ':' || CAST(obj_pos AS VARCHAR)),
                                        CAST(batch_id AS VARCHAR) || ':' || CAST(obj_pos AS VARCHAR)) - 1 AS idx
  FROM kept)""", f"""w3 AS (
  SELECT idx, {S.render_message()} AS text, label_spam AS spam, label_advertisement AS advertisement,
         label_irrelevant_content AS relevance, label_non_visitor_rant AS rant, label_toxicity AS toxicity
  FROM shuffled)""")


@register("w3_synthetic_table", _SQL_W3 + "SELECT * FROM w3")
def q_w3(spark, d):
    return J.synthetic_table(R.llm_responses(spark, d))


_FINAL5 = ["spam", "advertisement", "relevance", "rant", "toxicity"]


@register("a4_label_distribution", _SQL_W3 + "SELECT label, positives, rows, round(positives * 100.0 / rows, 6) AS pct FROM (" +
          " UNION ALL ".join(f"SELECT '{c}' AS label, CAST(sum({c}) AS BIGINT) AS positives, count(*) AS rows FROM w3"
                             for c in _FINAL5) + ")")
def q_a4(spark, d):
    return PF.label_distribution(J.synthetic_table(R.llm_responses(spark, d)), _FINAL5)


_ROLL = ["severe_toxic", "obscene", "threat", "insult"]
_SQL_ROLL = " UNION ALL ".join(f"""
SELECT CASE WHEN g1 = 0 AND g2 = 0 THEN 'id,toxic' WHEN g1 = 0 THEN 'id' WHEN g2 = 0 THEN 'toxic' ELSE '' END AS level, id, toxic,
       '{c}' AS label, coalesce({c}, 0) AS positives, rows, round({c} * 100.0 / rows, 6) AS pct FROM g""" for c in _ROLL)


@register("a4_label_rollup", _with(R.SQL_JIGSAW_RAW, "g AS (SELECT id, toxic, grouping(id) AS g1, grouping(toxic) AS g2, count(*) AS rows, " +
          ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _ROLL) +
          " FROM jigsaw_raw GROUP BY GROUPING SETS ((id, toxic), (id), (toxic), ()))") + _SQL_ROLL)
def q_a4r(spark, d):
    """Label shares by source and class, by each alone, and in total, by grouping sets."""
    return PF.label_rollup(R.jigsaw_raw(spark, d), _ROLL, ["id", "toxic"])


@register("a5_single_label", _SQL_W3 + """
SELECT count(*) FILTER (WHERE spam + advertisement + relevance + rant + toxicity = 1) AS single_label,
       count(*) AS rows,
       CASE WHEN count(*) FILTER (WHERE spam + advertisement + relevance + rant + toxicity = 1) = count(*)
            THEN 'PASSED' ELSE 'FAILED' END AS status FROM w3""")
def q_a5(spark, d):
    return PF.check_single_label(J.synthetic_table(R.llm_responses(spark, d)), _FINAL5)


@register("a6_placeholder_count", _with(R.SQL_LLM_RESPONSES, _SQL_OBJS) +
          "SELECT count(*) FILTER (WHERE coalesce(contains(lower(review), 'fallback'), false)) AS placeholders FROM parsed")
def q_a6(spark, d):
    sch = T.StructType([T.StructField("review", T.StringType())])
    objs = C.extract_json(R.llm_responses(spark, d), "content", sch, keep=["batch_id"])
    return PF.placeholder_count(objs, "review")


@register("a7_quota_plan", _with(R.SQL_LLM_RESPONSES, _SQL_OBJS) + f"""
SELECT c.class_type, coalesce(n.n, 0) AS current, greatest(0, 3000 - coalesce(n.n, 0)) AS need,
       3000 - coalesce(n.n, 0) > 0 AS planned
FROM (SELECT unnest({[*J.GENERATION_CLASSES, 'unknown_class']}) AS class_type) c
LEFT JOIN (SELECT class_type, max(n) AS n FROM (
             SELECT class_type, batch_id // 1000 % 2 AS src, count(*) AS n FROM parsed GROUP BY ALL)
           GROUP BY class_type) n ON c.class_type = n.class_type""")
def q_a7(spark, d):
    sch = T.StructType([T.StructField("review", T.StringType())])
    objs = C.extract_json(R.llm_responses(spark, d), "content", sch, keep=["batch_id", "class_type"])
    objs = objs.withColumn("src", (F.col("batch_id") / 1000).cast("long") % 2)
    return PF.quota_plan(objs, [*J.GENERATION_CLASSES, "unknown_class"], "class_type", 3000,
                         source_col="src")


# =====================================================================================
# Ordering, splits, folds, batches
# =====================================================================================
@register("o1_seeded_shuffle", """
SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS idx
FROM documents""")
def q_o1(spark, d):
    return O.shuffle_order(R.table(spark, d, "documents").select("doc_id"), "doc_id", 42)


@register("o2_row_cap", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100001")
def q_o2(spark, d):
    return O.head_rows(R.table(spark, d, "documents").select("doc_id", "source"), ["doc_id"], 100001)


@register("o2_row_cap_third", """
SELECT doc_id, source FROM (SELECT *, row_number() OVER (ORDER BY source, doc_id) AS r, count(*) OVER () AS n FROM documents)
WHERE r <= n // 3""")
def q_o2b(spark, d):
    doc = R.table(spark, d, "documents").select("doc_id", "source")
    return O.head_rows(doc, ["source", "doc_id"], doc.count() // 3)


@register("o3_dense_index", """
SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS idx FROM documents""")
def q_o3(spark, d):
    return O.dense_index(R.table(spark, d, "documents").select("doc_id", "source"),
                         ["source", "doc_id"])


@register("o3_dense_index_by_lang", """
SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS idx,
       count(*) OVER (PARTITION BY lang) AS lang_rows
FROM documents""")
def q_o3b(spark, d):
    doc = R.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return O.dense_index(doc, ["-n_chars", "doc_id"], by=["lang"],
                         group_size="lang_rows").select("doc_id", "lang", "idx", "lang_rows")


@register("o3_repeated_keys", """
SELECT lang, count(*) AS rows, min(i) AS first, max(i) AS last, count(DISTINCT i) AS positions,
       count(*) FILTER (WHERE i % 3 = 0) AS fold0, count(*) FILTER (WHERE i % 3 = 1) AS fold1
FROM (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM documents) GROUP BY lang""")
def q_o3c(spark, d):
    """Documents numbered by language alone: rows of a language stand in some order of their
    own, and take every position of their range once."""
    doc = O.dense_index(R.table(spark, d, "documents"), ["lang"], out="i")
    return doc.groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows"), F.min("i").alias("first"), F.max("i").alias("last"),
        F.countDistinct("i").alias("positions"), F.count_if(F.col("i") % 3 == 0).alias("fold0"),
        F.count_if(F.col("i") % 3 == 1).alias("fold1"))


@register("o4_stratified_split", """
SELECT doc_id, toxic, CASE WHEN row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1
                           < floor(count(*) OVER (PARTITION BY toxic) * 0.75) THEN 'train' ELSE 'test' END AS split
FROM labels""")
def q_o4(spark, d):
    return O.split(R.table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", 0.75, 42,
                   stratify="toxic")


@register("o5_plain_split", """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) - 1
                    < floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split
FROM labels""")
def q_o5(spark, d):
    return O.split(R.table(spark, d, "labels").select("doc_id"), "doc_id", 0.8, 7)


@register("o7_folds", """
SELECT doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % 3 AS INTEGER) AS fold
FROM labels""")
def q_o7(spark, d):
    return O.folds(R.table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", 3, 42, "toxic")


def _batches(spark, d) -> DataFrame:
    return O.assemble_batches(_reviews_msg(spark, d), "id", "user_message", size=20, seed=42)


_SQL_BATCHES = _with(R.SQL_REVIEWS_RAW, R.SQL_BUSINESS_META, _SQL_REVIEWS_MSG, f"""ix AS (
  SELECT id, user_message, row_number() OVER (ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1 AS i
  FROM reviews_msg)""", f"""batches AS (
  SELECT CAST(floor(i / 20) AS BIGINT) AS batch_no, count(*) AS n,
         string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) AS ids,
         string_agg('<Job ' || CAST(i % 20 + 1 AS VARCHAR) || '>' || chr(10) || {S.strip_ws('user_message')}
                    || chr(10) || '</Job ' || CAST(i % 20 + 1 AS VARCHAR) || '>' || chr(10) || chr(10), '' ORDER BY i) AS prompt,
         max(i) + 1 AS next_checkpoint
  FROM ix GROUP BY 1)""")


@register("a8_assemble_batches", _SQL_BATCHES + "SELECT * FROM batches")
def q_a8(spark, d):
    return _batches(spark, d)


@register("o8_pending_batches", _SQL_BATCHES + """
SELECT batch_no, n, next_checkpoint FROM batches
WHERE batch_no NOT IN (SELECT batch_no FROM batches WHERE batch_no % 3 = 0)""")
def q_o8(spark, d):
    b = _batches(spark, d).select("batch_no", "n", "next_checkpoint")
    done = b.filter(F.col("batch_no") % 3 == 0).select("batch_no")
    return O.pending_batches(b, done)


def _attach(spark, d):
    b = _batches(spark, d).select(
        "batch_no", F.transform(F.split("ids", ","), lambda x: x.cast("long")).alias("ids"))
    lab = TB.keep_last(R.llm_labels(spark, d).select("job_id", "seq", *_ENC), ["job_id"], "seq")
    items = (b.select("batch_no", F.posexplode("ids").alias("pos", "job_id"))
             .join(lab, "job_id", "left")
             # the service drops its first answer for every seventh batch: a size mismatch
             .filter(~((F.col("batch_no") % 7 == 3) & (F.col("pos") == 0))))
    outputs = items.groupBy("batch_no").agg(F.array_sort(F.collect_list(
        F.struct("pos", *[F.coalesce(F.col(c), F.lit("0")).alias(c) for c in _ENC]))).alias("items"))
    outputs = outputs.select("batch_no", F.transform("items", lambda x: x.dropFields("pos")).alias("items"))
    return TB.attach_ids(b, outputs)


_SQL_ATTACH = _SQL_BATCHES.replace("WITH ", "WITH " + R.SQL_LLM_LABELS + ",\n", 1).rstrip() + ",\n" + """lab AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM llm_labels)
  WHERE rn = 1),
pos AS (
  SELECT batch_no, CAST(unnest(string_split(ids, ',')) AS BIGINT) AS job_id,
         CAST(unnest(range(len(string_split(ids, ',')))) AS INTEGER) AS pos FROM batches),
items AS (
  SELECT p.batch_no, p.pos, p.job_id, coalesce(l.advertisement, '0') AS advertisement,
         coalesce(l.irrelevant_content, '0') AS irrelevant_content,
         coalesce(l.non_visitor_rant, '0') AS non_visitor_rant, coalesce(l.toxicity, '0') AS toxicity
  FROM pos p LEFT JOIN lab l ON p.job_id = l.job_id
  WHERE NOT (p.batch_no % 7 = 3 AND p.pos = 0)),
sizes AS (
  SELECT b.batch_no, len(string_split(b.ids, ',')) AS n_ids,
         (SELECT count(*) FROM items i WHERE i.batch_no = b.batch_no) AS n_outputs
  FROM batches b WHERE b.batch_no IN (SELECT batch_no FROM items))
"""
_SQL_ATTACH = _SQL_ATTACH.replace(
    "WHERE NOT (p.batch_no % 7 = 3 AND p.pos = 0)),",
    "WHERE NOT (p.batch_no % 7 = 3 AND p.pos = 0)),\nranked AS (SELECT *, row_number() OVER "
    "(PARTITION BY batch_no ORDER BY pos) - 1 AS out_pos FROM items),")


@register("j4_attach_ids_ok", _SQL_ATTACH + """
SELECT r.batch_no, CAST(r.out_pos AS INTEGER) AS pos, p.job_id, r.advertisement, r.irrelevant_content,
       r.non_visitor_rant, r.toxicity
FROM ranked r JOIN sizes s ON r.batch_no = s.batch_no AND s.n_ids = s.n_outputs
JOIN pos p ON p.batch_no = r.batch_no AND p.pos = r.out_pos""")
def q_j4ok(spark, d):
    return _attach(spark, d)[0]


@register("j4_attach_ids_rejected", _SQL_ATTACH + """
SELECT batch_no, CAST(n_ids AS INTEGER) AS n_ids, CAST(n_outputs AS INTEGER) AS n_outputs
FROM sizes WHERE n_ids <> n_outputs""")
def q_j4bad(spark, d):
    return _attach(spark, d)[1]


# =====================================================================================
# Profiles (A1, A2, A3)
# =====================================================================================
def _sql_value_counts(cols, table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {table} "
        f"WHERE {c} IS NOT NULL GROUP BY 1, 2" for c in cols)


def _sql_null_summary(cols, table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM {table}"
                              for c in cols)


_DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]
_JIGSAW_COLS = ["doc_id", "id", "comment_text", *J.JIGSAW_FLAGS]


@register("a1_value_counts", _sql_value_counts(_DOC_COLS, "documents"))
def q_a1(spark, d):
    """Every column of the table."""
    return PF.value_counts(R.table(spark, d, "documents"), None)


@register("a1_top_values", f"""
SELECT "column", rank, value, count FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank
  FROM ({_sql_value_counts(_DOC_COLS, "documents")})) WHERE rank <= 20""")
def q_a1t(spark, d):
    """The twenty most frequent values of every column, in order."""
    return PF.top_values(R.table(spark, d, "documents"), 20)


@register("a1_distinct_estimates", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", 2 * count(*) AS rows, 2 * count(*) FILTER (WHERE {c} IS NULL) AS nulls, true AS close FROM documents"
    for c in _DOC_COLS))
def q_a1d(spark, d):
    """Sketches of the table merged with themselves: rows and nulls add up, and the estimate of
    the distinct values is within 5 % of their exact number."""
    doc = R.table(spark, d, "documents")
    made = PF.value_sketches(doc)
    est = PF.distinct_estimates(PF.merge_sketches(made.unionByName(made)))
    exact = PF.value_counts(doc).groupBy(F.col("column").alias("__c")).agg(F.count(F.lit(1)).alias("exact"))
    return est.join(exact, F.col("column") == F.col("__c"), "left").select(
        "column", "rows", "nulls", (F.abs(F.col("distinct") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


@register("a2_null_summary", _with(R.SQL_JIGSAW_RAW) + _sql_null_summary(_JIGSAW_COLS, "jigsaw_raw"))
def q_a2(spark, d):
    """Every column of the table."""
    return PF.null_summary(R.jigsaw_raw(spark, d))


@register("w8_profile", _with(R.SQL_JIGSAW_RAW) + f"""
SELECT 'nulls' AS part, "column", CAST(NULL AS VARCHAR) AS value, nulls AS n FROM ({_sql_null_summary(_JIGSAW_COLS, 'jigsaw_raw')})
UNION ALL SELECT 'values', "column", value, count FROM ({_sql_value_counts(J.JIGSAW_FLAGS, 'jigsaw_raw')})
UNION ALL SELECT 'duplicates', NULL, NULL, CAST(coalesce(sum(c - 1), 0) AS BIGINT)
          FROM (SELECT count(*) AS c FROM jigsaw_raw GROUP BY ALL)""".replace("GROUP BY ALL)", "GROUP BY " + ", ".join(_JIGSAW_COLS) + ")"))
def q_w8(spark, d):
    """The three parts of the profile in one table."""
    values, nulls, dups = J.profile_table(R.jigsaw_raw(spark, d), J.JIGSAW_FLAGS)
    none = F.lit(None).cast("string")
    return nulls.select(F.lit("nulls").alias("part"), "column", none.alias("value"), F.col("nulls").alias("n")) \
        .unionByName(values.select(F.lit("values").alias("part"), "column", "value", F.col("count").alias("n"))) \
        .unionByName(dups.select(F.lit("duplicates").alias("part"), none.alias("column"), none.alias("value"),
                                 F.col("duplicates").alias("n")))


@register("a3_duplicate_count", """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (
  SELECT count(*) AS n FROM documents GROUP BY text, lang, source)""")
def q_a3(spark, d):
    return PF.duplicate_count(R.table(spark, d, "documents"), ["text", "lang", "source"])


# =====================================================================================
# Metrics (A9-A14)
# =====================================================================================
def _lexicon_predictions(spark, d) -> DataFrame:
    doc = R.table(spark, d, "documents")
    lab = R.table(spark, d, "labels")
    return lab.join(doc, "doc_id", "inner").select(
        "doc_id", F.col("toxic").alias("truth"), lexicon_hit("text", LEX).alias("pred"))


_SQL_LEX_PRED = (f"preds AS (SELECT l.doc_id, l.toxic AS truth, {S.lexicon_hit('d.text', LEX)} AS pred "
                 "FROM labels l JOIN documents d ON l.doc_id = d.doc_id)")
_SQL_CM = """cm AS (SELECT count(*) FILTER (WHERE truth = 1 AND pred = 1) AS tp,
  count(*) FILTER (WHERE truth = 1 AND pred <> 1) AS fn, count(*) FILTER (WHERE truth <> 1 AND pred = 1) AS fp,
  count(*) FILTER (WHERE truth <> 1 AND pred <> 1) AS tn FROM preds)"""


def _sql_ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"


@register("a9_confusion", _with(_SQL_LEX_PRED, _SQL_CM) + "SELECT tp, fn, fp, tn FROM cm")
def q_a9(spark, d):
    return MX.confusion(_lexicon_predictions(spark, d))


@register("a10_binary_report", _with(_SQL_LEX_PRED, _SQL_CM) + f"""
SELECT tp, fn, fp, tn, round({_sql_ratio('tp', 'tp + fp')}, 6) AS precision,
       round({_sql_ratio('tp', 'tp + fn')}, 6) AS recall, tp + fn = 0 AS no_positive_truth,
       fp + tn = 0 AS no_negative_truth FROM cm""")
def q_a10(spark, d):
    return MX.binary_report(_lexicon_predictions(spark, d))


def _multilabel_frame(spark, d) -> DataFrame:
    lab = TB.keep_last(R.llm_labels(spark, d).select("job_id", "seq", *_ENC), ["job_id"], "seq")
    lab = lab.select(F.col("job_id").alias("id"), *[F.col(c).try_cast("int").alias(c) for c in _ENC])
    probs = R.probabilities(spark, d).select("id", *[f"{c}_prob" for c in _ENC])
    j = lab.join(probs, "id", "inner")
    return j.withColumns({f"{c}_pred": (F.col(f"{c}_prob") > 0.5).cast("int") for c in _ENC})


_SQL_ML = _with(R.SQL_LLM_LABELS, R.sql_probabilities(), """ml AS (
  SELECT l.job_id AS id, TRY_CAST(l.advertisement AS INTEGER) AS advertisement,
         TRY_CAST(l.irrelevant_content AS INTEGER) AS irrelevant_content,
         TRY_CAST(l.non_visitor_rant AS INTEGER) AS non_visitor_rant, TRY_CAST(l.toxicity AS INTEGER) AS toxicity,
         p.advertisement_prob, p.irrelevant_content_prob, p.non_visitor_rant_prob, p.toxicity_prob
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM llm_labels)
        WHERE rn = 1) l JOIN probabilities p ON l.job_id = p.id)""")


def _sql_bce() -> str:
    terms = []
    for c in _ENC:
        p = f"least(greatest({c}_prob, 1e-07), 1 - 1e-07)"
        terms.append(f"-({c} * ln({p}) + (1 - {c}) * ln(1 - {p}))")
    return "(" + " + ".join(terms) + f") / {float(len(_ENC))}"


def _sql_multilabel() -> str:
    cols, accs = [], []
    for c in _ENC:
        t, p = f"{c} = 1", f"{c}_prob > 0.5"
        tp = f"count(*) FILTER (WHERE {t} AND {p})"
        fn = f"count(*) FILTER (WHERE {t} AND NOT ({p}))"
        fp = f"count(*) FILTER (WHERE NOT ({t}) AND {p})"
        tn = f"count(*) FILTER (WHERE NOT ({t}) AND NOT ({p}))"
        has = f"({tp} + {fn}) > 0"
        prec, rec = _sql_ratio(tp, f"{tp} + {fp}"), _sql_ratio(tp, f"{tp} + {fn}")
        acc = f"CASE WHEN {has} THEN {_sql_ratio(f'{tp} + {tn}', 'count(*)')} END"
        f1 = f"CASE WHEN {prec} + {rec} > 0 THEN 2 * {prec} * {rec} / ({prec} + {rec}) ELSE 0.0 END"
        cols += [f"round({acc}, 6) AS {c}_accuracy",
                 f"round(CASE WHEN {has} THEN {prec} END, 6) AS {c}_precision",
                 f"round(CASE WHEN {has} THEN {rec} END, 6) AS {c}_recall",
                 f"round(CASE WHEN {has} THEN {f1} END, 6) AS {c}_f1"]
        accs.append(f"coalesce({acc}, 0.0)")
    cols.append(f"round(({' + '.join(accs)}) / {float(len(_ENC))}, 6) AS overall_accuracy")
    cols.append(f"round(avg({_sql_bce()}), 6) AS avg_loss")
    return "SELECT " + ",\n  ".join(cols) + " FROM ml"


@register("a12_multilabel_report", _SQL_ML + _sql_multilabel())
def q_a12(spark, d):
    return MX.multilabel_report(_multilabel_frame(spark, d), _ENC, loss=MX.bce_terms(_ENC))


@register("a13_bce_loss", _SQL_ML + f"SELECT round(avg({_sql_bce()}), 6) AS avg_loss FROM ml")
def q_a13(spark, d):
    return MX.bce_loss(_multilabel_frame(spark, d), _ENC)


def _sql_class_report(src: str, prob: str = "prob", truth: str = "truth", thr: float = 0.5) -> str:
    return f"""cm AS (SELECT count(*) FILTER (WHERE {truth} = 1 AND {prob} >= {thr}) AS tp,
    count(*) FILTER (WHERE {truth} = 1 AND NOT ({prob} >= {thr})) AS fn,
    count(*) FILTER (WHERE {truth} <> 1 AND {prob} >= {thr}) AS fp,
    count(*) FILTER (WHERE {truth} <> 1 AND NOT ({prob} >= {thr})) AS tn FROM {src}),
  m AS (SELECT *, tp + fn + fp + tn AS n, tp + fn AS s1, tn + fp AS s0,
    {_sql_ratio('tp', 'tp + fp')} AS p1, {_sql_ratio('tp', 'tp + fn')} AS r1,
    {_sql_ratio('tn', 'tn + fn')} AS p0, {_sql_ratio('tn', 'tn + fp')} AS r0 FROM cm),
  f AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1_1,
    CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f1_0 FROM m)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM (
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f1_0 AS f1, s0 AS support FROM f
  UNION ALL SELECT '1', p1, r1, f1_1, s1 FROM f
  UNION ALL SELECT 'accuracy', NULL, NULL, {_sql_ratio('tp + tn', 'n')}, n FROM f
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n FROM f
  UNION ALL SELECT 'weighted avg', {_sql_ratio('p0 * s0 + p1 * s1', 'n')}, {_sql_ratio('r0 * s0 + r1 * s1', 'n')},
                   {_sql_ratio('f1_0 * s0 + f1_1 * s1', 'n')}, n FROM f)"""


@register("a14_classification_report", _with(R.sql_probabilities(), """scored AS (
  SELECT l.toxic AS truth, p.safety_prob AS prob FROM labels l JOIN probabilities p ON l.doc_id = p.id)""")
          + ", " + _sql_class_report("scored"))
def q_a14(spark, d):
    lab = R.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("truth"))
    scored = lab.join(R.probabilities(spark, d).select("id", F.col("safety_prob").alias("prob")), "id")
    return MX.classification_report(scored, "truth", "prob", 0.5)


# =====================================================================================
# Heads, gate and cascade
# =====================================================================================
@register("m10_head_fire", _with(R.sql_probabilities(), R.sql_head_scores()) +
          "SELECT id, head, label = '__label__pos' AND prob >= 0.7 AS fired FROM head_scores")
def q_m10(spark, d):
    s = R.head_scores(spark, d)
    return s.select("id", "head", fire_top1("label", "prob", 0.7).alias("fired"))


def _settings(spark) -> DataFrame:
    # a per-head settings table: rant has its own threshold, spam is switched off
    return spark.createDataFrame([("rant", 0.6, True), ("spam", None, False), ("unsafe", None, True)],
                                 "head string, threshold double, enabled boolean")


@register("m11_or_gate", _with(R.sql_probabilities(), R.sql_head_scores()) + """
SELECT id, coalesce(string_agg(head, ',' ORDER BY o) FILTER (WHERE fired), '') AS fired,
       CASE WHEN bool_or(fired) THEN 'bad' ELSE 'good' END AS decision
FROM (SELECT s.id, s.head, list_position(['spam','ad','irrelevant','rant','unsafe'], s.head) AS o,
             coalesce(st.enabled, true) AND s.label = '__label__pos'
             AND (coalesce(st.threshold, 0.7) IS NULL OR s.prob >= coalesce(st.threshold, 0.7)) AS fired
      FROM head_scores s LEFT JOIN (VALUES ('rant', 0.6, true), ('spam', NULL, false), ('unsafe', NULL, true))
           st(head, threshold, enabled) ON s.head = st.head)
GROUP BY id""")
def q_m11(spark, d):
    g = or_gate(R.head_scores(spark, d), R.HEADS, _settings(spark), default_threshold=0.7)
    return g.select("id", F.array_join("fired", ",").alias("fired"), "decision")


@register("c1_cascade_rules", _with(R.sql_probabilities()) + _sql_cascade("probabilities"))
def q_c1(spark, d):
    return _flat_verdicts(cascade_rules(R.probabilities(spark, d)))


@register("c2_verdict_summary", _with(R.sql_probabilities(), f"v AS ({_sql_cascade('probabilities')})") +
          "SELECT stage, decision, count(*) AS reviews FROM v GROUP BY ALL")
def q_c2(spark, d):
    return verdict_summary(cascade_rules(R.probabilities(spark, d)))


# =====================================================================================
# Features (M1): relational TF-IDF over the labelled documents
# =====================================================================================
from vetta.operators import features as FT  # noqa: E402


def _sql_tfidf(min_df: int, max_features: int) -> str:
    tok = "regexp_extract_all(lower(d.text), '[\\p{L}\\p{N}_]{2,}')"
    return f"""WITH toks AS (
  SELECT d.doc_id, {tok} AS t FROM documents d),
grams AS (
  SELECT doc_id, unnest(list_concat(t, CASE WHEN len(t) >= 2 THEN
           list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term
  FROM toks),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS (
  SELECT term, count(*) AS df, sum(tf) AS ttf FROM tf GROUP BY term HAVING count(*) >= {min_df}
  ORDER BY ttf DESC, term LIMIT {max_features}),
n AS (SELECT count(*) AS n FROM toks),
raw AS (
  SELECT tf.doc_id, tf.term, tf.tf * (ln((1.0 + n.n) / (v.df + 1.0)) + 1.0) AS raw
  FROM tf JOIN vocab v ON tf.term = v.term, n)
SELECT r.doc_id, r.term, round(r.raw / s.norm, 6) AS weight
FROM raw r JOIN (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY doc_id) s
  ON r.doc_id = s.doc_id"""


def _labelled_docs(spark, d) -> DataFrame:
    return R.table(spark, d, "labels").join(R.table(spark, d, "documents"), "doc_id").select(
        "doc_id", "text", "toxic", "quality")


@register("m1_tfidf_relational", _sql_tfidf(2, 20000))
def q_m1(spark, d):
    return FT.tfidf_relational(R.table(spark, d, "documents"), "doc_id", "text", (1, 2), 2, 20000)


# =====================================================================================
# Models (M2-M9, M13-M15) and the model cascade: fitted models, rows-only checks
# =====================================================================================
from vetta.operators import models as MD  # noqa: E402
from vetta.session import scratch_path  # noqa: E402


#: The test tables are small: few partitions keep an optimiser's iteration short.
FIT_PARTITIONS = 2


def _safety_split(spark, d) -> DataFrame:
    return O.split(_labelled_docs(spark, d).withColumnRenamed("toxic", "label"), "doc_id",
                   0.75, 42, stratify="label", first="train", second="test")


def _fit_safety_model(parts: DataFrame):
    return MD.fit_safety(parts.filter(F.col("split") == "train"), LEX, "text", "label",
                         MD.SAFETY_BEST, partitions=FIT_PARTITIONS)


_SQL_SAFETY_PARTS = """parts AS (
  SELECT l.doc_id, l.toxic, row_number() OVER (PARTITION BY l.toxic ORDER BY md5('42:' || CAST(l.doc_id AS VARCHAR)), l.doc_id) - 1
           < floor(count(*) OVER (PARTITION BY l.toxic) * 0.75) AS train
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


@register("m6_safety_scores", _with(_SQL_SAFETY_PARTS) +
          "SELECT doc_id, toxic AS truth, true AS in_range, true AS decided FROM parts WHERE NOT train")
def q_m6(spark, d):
    """Safety model at the published best point, trained on the 75 % part, scored on the
    held-out 25 %. What is exact whatever the weights: which rows are scored, their labels,
    that every score is a probability, and the decision rule. (Quality floors are tests.)"""
    parts = _safety_split(spark, d)
    model = _fit_safety_model(parts)
    test = parts.filter(F.col("split") == "test").select("doc_id", "text", "label")
    s = MD.score_safety(model, test).withColumn("pred", (F.col("safety_prob") >= 0.5).cast("int"))
    return s.select("doc_id", F.col("label").alias("truth"), F.col("safety_prob").between(0, 1).alias("in_range"),
                    ((F.col("pred") == 1) == (F.col("safety_prob") >= 0.5)).alias("decided"))


@register("w10_safety_report", _with(_SQL_SAFETY_PARTS, "t AS (SELECT * FROM parts WHERE NOT train)") + """
SELECT '0' AS class, count(*) FILTER (WHERE toxic <> 1) AS support, true AS in_range FROM t
UNION ALL SELECT '1', count(*) FILTER (WHERE toxic = 1), true FROM t
UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), count(*), true FROM t""")
def q_w10(spark, d):
    """Split, fit at the published best point, held-out classification report: its
    classes and supports, and that every figure is a share."""
    docs = _labelled_docs(spark, d).select(F.col("doc_id").alias("id"), "text",
                                           F.col("toxic").alias("unsafe_label"))
    _, _, report, _ = J.run_safety(docs, LEX, partitions=FIT_PARTITIONS)
    share = F.lit(True)
    for c in ("precision", "recall", "f1"):
        share = share & F.coalesce(F.col(c).between(0, 1), F.lit(True))
    return report.select("class", "support", share.alias("in_range"))


@register("m4_grid_search", """
SELECT * FROM (VALUES (2, 1, 'balanced', true), (2, 1, 'map', true)) t(min_df, ngram, class_weight, in_range)""")
def q_m4(spark, d):
    """Grid search over two points (one feature setting, two class weightings), two folds."""
    docs = _labelled_docs(spark, d).select("doc_id", "text", F.col("toxic").alias("label"))
    folded = O.folds(docs, "doc_id", 2, 42, "label")
    grid = {"min_df": [2], "max_features": [5000], "ngram": [(1, 1)], "max_iter": [20, 40],
            "class_weight": ["balanced", {0: 1.0, 1: 1.5}]}
    _, scores = MD.search_safety(folded, LEX, grid=grid, partitions=FIT_PARTITIONS)
    rows = {(p["min_df"], p["ngram"][1], "balanced" if p["class_weight"] == "balanced" else "map"): 0 <= f1 <= 1
            for p, f1 in scores}
    return spark.createDataFrame([(*k, ok) for k, ok in sorted(rows.items())],
                                 "min_df int, ngram int, class_weight string, in_range boolean")


def _head_parts(spark, d) -> DataFrame:
    good, _ = C.parse_labels(R.head_samples(spark, d), _HEAD_CATS)
    good = good.withColumn("text", collapse_ws("text")).filter(F.length("text") > 0)
    good = FT.written(good.withColumn("__row", F.monotonically_increasing_id()), "samples")     # read by several jobs
    return O.split(good, "doc_id", 0.9, 42, first="train", second="eval")


@register("w11_head_eval", _SQL_W9.rsplit("SELECT split, category, doc_id, ", 1)[0] + """
SELECT category AS head, count(*) FILTER (WHERE label = 1) AS positives, count(*) AS rows, true AS in_range
FROM (""" + " UNION ALL ".join(f"SELECT split, '{c}' AS category, {c} AS label FROM parts" for c in _HEAD_CATS) + """)
WHERE split = 'eval' GROUP BY category""")
def q_w11(spark, d):
    """W9 label lines -> one head per category trained on the train lines -> scored on the
    eval lines: supports per head, that the counts add up, and that the figures are shares."""
    lines, _ = J.head_training_table(R.head_samples(spark, d), key="doc_id")
    _, report = J.run_heads(lines, _HEAD_CATS, partitions=4 * FIT_PARTITIONS)
    return report.select("head", (F.col("tp") + F.col("fn")).alias("positives"),
                         (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).alias("rows"),
                         (F.col("precision").between(0, 1) & F.col("recall").between(0, 1)).alias("in_range"))


_EMB_HEADS = ["rant", "irrelevant"]


@register("m7_embedding_heads", _SQL_W9.rsplit("SELECT split, category, doc_id, ", 1)[0] + """
SELECT category AS head, count(*) FILTER (WHERE label = 1) AS positives, count(*) AS rows, true AS above, true AS falls
FROM (""" + " UNION ALL ".join(f"SELECT split, '{c}' AS category, {c} AS label FROM parts" for c in _EMB_HEADS) + """)
WHERE split = 'eval' GROUP BY category""")
def q_m7e(spark, d):
    """Embedding-bag heads fitted on the train part in one pass an epoch and scored on the eval
    part: supports, that the F1 of the positive class is above 0.7, and that the loss falls."""
    from vetta.operators import embedding as EM
    parts = _head_parts(spark, d)
    model, losses = EM.fit_embedding_heads(parts.filter(F.col("split") == "train"), _EMB_HEADS, epoch=4, lr=2.0,
                                           buckets=1 << 15, blocks=4, order="__row")
    scored = model.score(parts.filter(F.col("split") == "eval"))
    each = scored.select(F.explode(F.array(*[F.struct(F.lit(h).alias("head"), F.col(h).alias("t"),
                                                      (F.col(f"{h}_prob") > 0.5).alias("p")) for h in _EMB_HEADS])).alias("s"))
    hit, true = F.col("s.p"), F.col("s.t") == 1
    f1 = 2 * F.count_if(hit & true) / (F.count_if(hit) + F.count_if(true))
    return each.groupBy("s.head").agg(F.count_if(true).alias("positives"), F.count(F.lit(1)).alias("rows"),
                                      (f1 > 0.7).alias("above"), F.lit(losses[-1] < losses[0]).alias("falls"))


@register("m9_autotune", _SQL_W9.rsplit("SELECT split, category, doc_id, ", 1)[0] + """
SELECT 0 AS rung, CAST(3 AS BIGINT) AS fits, CAST(1 AS BIGINT) AS kept, count(*) AS rows FROM parts
WHERE split = 'train' AND CAST(('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) < 4294967296 // 3
UNION ALL SELECT 1, 1, 1, count(*) FROM parts WHERE split = 'train'""")
def q_m9(spark, d):
    """Successive halving over three points: how many points and rows each rung fits."""
    from vetta.operators import embedding as EM
    parts = _head_parts(spark, d)
    points = [{"dim": 8, "epoch": 2}, {"dim": 8, "epoch": 2, "lr": 0.05}, {"dim": 4, "epoch": 1}]
    _, _, record = EM.tune(parts.filter(F.col("split") == "train"), parts.filter(F.col("split") == "eval"), "rant", points,
                           "doc_id", lr=2.0, buckets=1 << 14, blocks=4)
    made = spark.createDataFrame([(r["rung"], r["rows"], r["kept"]) for r in record], "rung int, rows long, kept boolean")
    return made.groupBy("rung").agg(F.count(F.lit(1)).alias("fits"), F.count_if("kept").alias("kept"), F.max("rows").alias("rows"))


def _multilabel_table(spark, d) -> DataFrame:
    labels = TB.keep_last(R.llm_labels(spark, d), ["job_id"], "seq").drop("seq")
    t = J.build_label_table(labels, _reviews_msg(spark, d))
    t = C.rename_labels(t, J.FINAL_TO_ENCODER).na.drop(subset=["text"])
    # the label table has no id column; the text (unique per review) keys the split
    return t.select(F.md5("text").alias("id"), "text", *_ENC)


_SQL_W12 = _with(R.SQL_LLM_LABELS, R.SQL_REVIEWS_RAW, R.SQL_BUSINESS_META, _SQL_REVIEWS_MSG, """t AS (
  SELECT md5(r.user_message) AS id, TRY_CAST(l.advertisement AS INTEGER) AS advertisement,
         TRY_CAST(l.irrelevant_content AS INTEGER) AS irrelevant_content,
         TRY_CAST(l.non_visitor_rant AS INTEGER) AS non_visitor_rant, TRY_CAST(l.toxicity AS INTEGER) AS toxicity
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM llm_labels)
        WHERE rn = 1) l JOIN reviews_msg r ON l.job_id = r.id)""", """v AS (
  SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 < floor(count(*) OVER () * 0.8) AS train FROM t)
  WHERE NOT train)""")


@register("w12_multilabel_report", _SQL_W12 + "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {c} = 1) > 0 AS {c}_reported" for c in _ENC) + ", true AS in_range FROM v")
def q_w12(spark, d):
    """Third stage, 80/20 split, fit with validation-loss selection. A label is reported
    exactly when the validation rows have a positive; the figures are shares."""
    _, report = J.run_multilabel(_multilabel_table(spark, d), _ENC, w2v_partitions=4, partitions=FIT_PARTITIONS)
    share = F.col("avg_loss") >= 0
    for c in report.columns:
        if c != "avg_loss":
            share = share & F.coalesce(F.col(c).between(0, 1), F.lit(True))
    return report.select(*[F.col(f"{c}_f1").isNotNull().alias(f"{c}_reported") for c in _ENC], share.alias("in_range"))


def fit_cascade_models(spark, d):
    """Fit the three stages on the labelled tables: (safety, heads, (features, labels))."""
    safety = _fit_safety_model(_safety_split(spark, d))
    hp = _head_parts(spark, d)
    heads = MD.fit_heads(hp.filter(F.col("split") == "train"), STAGE2_HEADS, skip_missing=True,
                         partitions=4 * FIT_PARTITIONS)
    feats, ml, _ = MD.fit_multilabel(_multilabel_table(spark, d), _ENC, max_iters=(30,),
                                     w2v_partitions=4, partitions=FIT_PARTITIONS)
    return safety, heads, (feats, ml)


def score_cascade(spark, d, models) -> DataFrame:
    """W13 scoring: requests -> completeness check -> serving prompt -> model cascade
    (safety on the review, heads on survivors' prompts, third stage on theirs)."""
    v = J.moderate_with(R.requests(spark, d), models)
    return _flat_verdicts(v).withColumn("safety_prob", F.round("safety_prob", 6))


@register("c1_cascade_models", _with(R.SQL_REQUESTS) + f"""
SELECT id, error AS missing, error <> '' AS quarantined, true AS consistent FROM ({_sql_request_errors()})""")
def q_c1m(spark, d):
    """W13 end to end: fit the three stages, save them, load them, and moderate every request
    from the saved folder with per-head thresholds. Each request has one verdict. Exact
    whatever the weights: the incomplete requests, and that stage, decision and reasons
    follow from the scores."""
    path = scratch_path(spark, "cascade")
    MD.save_cascade(fit_cascade_models(spark, d), path)
    v = J.moderate_with(R.requests(spark, d), MD.load_cascade(path), thresholds={"rant": 0.6}, disabled=["ad"])
    p = F.col("safety_prob")
    flagged = F.size(F.map_filter("label_probs", lambda k, x: x > 0.5)) > 0
    follows = (F.when(F.col("stage") == 0, F.col("decision") == "quarantine")
               .when(F.col("stage") == 1, (p > 0.5) & (F.col("decision") == "reject"))
               .when(F.col("stage") == 2, (p <= 0.5) & (F.size("fired_heads") > 0) & (F.col("decision") == "reject"))
               .otherwise((p <= 0.5) & (F.size("fired_heads") == 0) & (flagged == (F.col("decision") == "reject"))))
    stopped = F.col("decision") == "quarantine"
    return v.select("id", F.when(stopped, F.array_join("reasons", "; ")).otherwise("").alias("missing"),
                    stopped.alias("quarantined"),
                    (follows & ~F.coalesce(F.array_contains("fired_heads", "ad"), F.lit(False))).alias("consistent"))


# =====================================================================================
# Streaming (T1, T2): the stream is fed with JSON files Spark writes from the tables
# =====================================================================================
from vetta.sources import readers as RD  # noqa: E402
from vetta.sources import writers as WR  # noqa: E402
from vetta.streaming import dedup_stream, keep_first_stream, moderate_stream  # noqa: E402

_DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()),
                            T.StructField("text", T.StringType())])


def _feed_files(df: DataFrame, path: str) -> None:
    """Write ``df`` as JSON-lines files, one per partition of the scan."""
    df.write.mode("overwrite").json(path)


@register("t1_stream_moderation", _with(R.sql_probabilities()) + _sql_cascade("probabilities"))
def q_t1(spark, d):
    """Documents arrive as JSON files; every micro-batch is scored by the rule cascade in
    ``foreachBatch``; the sink (one folder per batch id) is read back. Equals C1."""
    base = scratch_path(spark, "t1")
    _feed_files(R.table(spark, d, "documents").select("doc_id", "text"), f"{base}/in")
    stream = spark.readStream.schema(_DOC_SCHEMA).option("maxFilesPerTrigger", 2).json(f"{base}/in")
    q = moderate_stream(stream, lambda b: _flat_verdicts(cascade_rules(R.probabilities_from(b))),
                        f"{base}/out", f"{base}/ckpt", available_now=True)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch_id")


_EVENT_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()),
                              T.StructField("ts", T.TimestampType()),
                              T.StructField("user_id", T.LongType()),
                              T.StructField("event_type", T.StringType())])


@register("t2_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def q_t2(spark, d):
    """Events arrive as JSON files; repeats of (user, event type) within the watermark
    delay are dropped in the stream. With a delay that spans the data this equals a
    distinct over the table."""
    base = scratch_path(spark, "t2")
    _feed_files(R.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type"),
                f"{base}/in")
    stream = spark.readStream.schema(_EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(f"{base}/in")
    out = dedup_stream(stream, ["user_id", "event_type"], "ts", "3650 days")
    q = (out.select("user_id", "event_type").writeStream.format("parquet")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema("user_id long, event_type string").parquet(f"{base}/out")


@register("t2_stream_keep_first", """
WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 6 HOUR THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM e)
SELECT user_id, event_type, min(event_id) AS event_id FROM r GROUP BY user_id, event_type, run""")
def q_t2k(spark, d):
    """Events arrive as JSON files in no order of time; of each run of repeats of (user, event
    type) at most six hours apart the row with the smallest id stays. A last event far ahead
    moves the watermark past every run."""
    base = scratch_path(spark, "t2k")
    cols = ["event_id", "ts", "user_id", "event_type"]
    events = R.table(spark, d, "events").select(*cols)
    _feed_files(events.repartition(4, "event_id"), f"{base}/in")
    end = events.agg((F.max("ts") + F.expr("INTERVAL 5000 DAYS")).alias("ts")).select(
        F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(None).cast("long").alias("user_id"), F.lit("end").alias("event_type"))
    end.write.mode("append").json(f"{base}/in")
    stream = spark.readStream.schema(_EVENT_SCHEMA).option("maxFilesPerTrigger", 2).json(f"{base}/in")
    out = keep_first_stream(stream, ["user_id", "event_type"], ["event_id"], "ts", "6 hours", "4000 days")
    q = (out.select("user_id", "event_type", "event_id").writeStream.format("parquet")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema("user_id long, event_type string, event_id long").parquet(f"{base}/out")


# =====================================================================================
# Sources and sinks (S1-S5, S8-S10): round trips through files Spark writes from the tables
# =====================================================================================
_S1_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()),
                           T.StructField("source", T.StringType()),
                           T.StructField("lang", T.StringType()),
                           T.StructField("flag", T.StringType()),
                           T.StructField("ok", T.BooleanType()),
                           T.StructField("text", T.StringType())])


def _py_string(c) -> "F.Column":
    """A text as a Python string literal: é and double quotes as escapes, the rest as repr does."""
    out = F.col(c)
    for ch, esc in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("é", "\\xe9"), ('"', "\\042"), ("ü", "\\u00fc")):
        out = F.replace(out, F.lit(ch), F.lit(esc))
    return F.concat(F.lit("'"), out, F.lit("'"))


def _s1_files(spark, d) -> str:
    """JSON lines with whole texts: strict JSON for most documents, a Python-literal line (escapes,
    joined strings, None, True) for every fifth, plus a blank and a garbage line after every seventh."""
    doc = R.table(spark, d, "documents")
    js = F.to_json(F.struct("doc_id", "source", "lang", F.lit(None).cast("string").alias("flag"),
                            F.lit(True).alias("ok"), "text"))
    py = F.concat(F.lit("{'doc_id': "), F.col("doc_id").cast("string"), F.lit(", 'source': '"),
                  F.col("source"), F.lit("', 'lang': '' u'"), F.col("lang"),
                  F.lit("', 'flag': None, 'ok': True, 'text': "), F.coalesce(_py_string("text"), F.lit("None")), F.lit(",}"))
    line = F.when(F.col("doc_id") % 5 == 1, py).otherwise(js)
    extra = F.when(F.col("doc_id") % 7 == 0,
                   F.array(F.lit("   "), F.concat(F.lit("garbage "), F.col("doc_id").cast("string"))))
    lines = doc.select(F.explode(F.concat(F.array(line), F.coalesce(extra, F.array().cast("array<string>"))))
                       .alias("value"))
    path = scratch_path(spark, "s1")
    lines.write.mode("overwrite").text(path)
    return path


@register("s1_read_json_lines", "SELECT doc_id, source, lang, NULL::VARCHAR AS flag, true AS ok, text FROM documents")
def q_s1(spark, d):
    good, _ = RD.read_json_lines(spark, _s1_files(spark, d), _S1_SCHEMA)
    return good


@register("s1_rejected_lines", "SELECT 'garbage ' || CAST(doc_id AS VARCHAR) AS value FROM documents WHERE doc_id % 7 = 0")
def q_s1r(spark, d):
    _, bad = RD.read_json_lines(spark, _s1_files(spark, d), _S1_SCHEMA)
    return bad.select("value")


@register("o2_s1_first_records", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 250")
def q_s1cap(spark, d):
    """Row cap while reading: the first 250 good records in file order (files in id order)."""
    doc = R.table(spark, d, "documents").select("doc_id", "source", "lang")
    path = scratch_path(spark, "s1cap")
    doc.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(
        F.to_json(F.struct("doc_id", "source", "lang")).alias("value")).write.text(path)
    good, _ = RD.read_json_lines(spark, path, _S1_SCHEMA, limit=250)
    return good.select("doc_id")


_S2_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()),
                           T.StructField("lang", T.StringType()),
                           T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType()),
                           T.StructField("text", T.StringType())])


@register("s2_read_csv", "SELECT doc_id, lang, source, n_chars, text FROM documents")
def q_s2(spark, d):
    """CSV round trip: headers written as ' Doc_ID ', 'LANG', ... (trimmed and matched
    case-insensitively on read), multi-line quoted text."""
    doc = R.table(spark, d, "documents")
    path = scratch_path(spark, "s2")
    WR.write_table(doc.select(F.col("doc_id").alias(" Doc_ID "), F.col("lang").alias("LANG"),
                              F.col("source").alias("Source "), F.col("n_chars").alias("N_Chars"),
                              F.col("text").alias("Text")), path, fmt="csv")
    return RD.read_csv(spark, path, _S2_SCHEMA, required=["doc_id", "text"])


@register("s5_labeled_lines", _SQL_W9.replace("SELECT split, category, doc_id, \nCASE", "SELECT split, category, doc_id, CASE")
          .rsplit("SELECT split, category, doc_id, ", 1)[0] +
          "SELECT split, category, CASE WHEN label = 1 THEN '__label__pos' ELSE '__label__neg' END AS label, text FROM (" +
          " UNION ALL ".join(f"SELECT split, '{c}' AS category, doc_id, {c} AS label, text FROM parts"
                             for c in _HEAD_CATS) + ")")
def q_s5(spark, d):
    """Head training lines written as ``split=/category=`` text folders, read back as
    (label, text) with the folder columns."""
    lines, _ = J.head_training_table(R.head_samples(spark, d), key="doc_id")
    path = scratch_path(spark, "s9")
    WR.write_labeled_lines(lines, path)
    return RD.read_labeled_lines(spark, path).select("split", "category", "label", "text")


@register("s3_label_batches", _with(R.SQL_LLM_LABELS) + """
SELECT job_id, """ + ", ".join(f"coalesce(TRY_CAST({c} AS INTEGER), 0) AS {c}" for c in _FLAGS5) +
          " FROM llm_labels")
def q_s3(spark, d):
    """Label records written as one JSON array per batch of 20 (S10), read back (S3)."""
    lab = R.llm_labels(spark, d)
    ix = O.dense_index(lab, ["job_id", "seq"], out="i")
    batches = ix.withColumn("batch_no", F.floor(F.col("i") / 20).cast("long")) \
        .withColumn("pos", F.col("i") % 20).drop("i", "seq")
    path = scratch_path(spark, "s10")
    WR.write_label_batches(batches, path)
    return RD.read_label_batches(spark, path, _FLAGS5)[0].select("job_id", *_FLAGS5)


@register("s11_metrics_roundtrip", QUERIES["a10_binary_report"][1])
def q_s11(spark, d):
    """Metrics sink: the lexicon head's binary report (A9-A11) written as one JSON file
    and read back with its schema."""
    report = MX.binary_report(_lexicon_predictions(spark, d))
    path = scratch_path(spark, "s11")
    WR.write_metrics(report, path)
    return spark.read.schema(report.schema).json(path)


# =====================================================================================
# Head features before hashing (M7) and the samples reader
# =====================================================================================
def _head_terms(text_col: str = "text"):
    toks = FT.head_tokens(text_col)
    words = F.concat(toks, FT.word_ngrams(toks, 2))
    chars = FT.char_ngrams(toks, 2, 5)
    return words, chars


@register("m7_head_terms", """
WITH t AS (SELECT doc_id, regexp_extract_all(text, '""" + NON_WS + """+') AS toks FROM documents),
g AS (
  SELECT doc_id,
         list_concat(toks, CASE WHEN len(toks) >= 2 THEN
           list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]) ELSE [] END) AS words,
         flatten(list_transform(toks, lambda w: flatten(list_transform(range(2, 6), lambda n:
           list_transform(range(1, length('<' || w || '>') - n + 2), lambda i: substr('<' || w || '>', i, n)))))) AS chars
  FROM t)
SELECT doc_id, len(words) AS word_terms, len(chars) AS char_grams,
       len(list_distinct(list_concat(words, chars))) AS distinct_terms
FROM g""")
def q_m7(spark, d):
    """Word 1-2-grams and char 2-5-grams of ``<token>`` per document, counted before
    hashing: the exact term multiset the heads' HashingTF sees."""
    words, chars = _head_terms()
    doc = R.table(spark, d, "documents").select("doc_id", words.alias("w"), chars.alias("c"))
    return doc.select("doc_id", F.size("w").cast("long").alias("word_terms"),
                      F.size("c").cast("long").alias("char_grams"),
                      F.size(F.array_distinct(F.concat("w", "c"))).cast("long").alias("distinct_terms"))


_S4_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ["doc_id", *_HEAD_CATS, "text"]])


@register("s4_samples_json", _with(R.SQL_HEAD_SAMPLES) +
          "SELECT CAST(doc_id AS VARCHAR) AS doc_id, " + ", ".join(_HEAD_CATS) + ", text FROM head_samples")
def q_s4(spark, d):
    """Head samples written as JSON lines and read back with the array-or-lines reader
    (the first character decides)."""
    path = scratch_path(spark, "s4")
    R.head_samples(spark, d).write.mode("overwrite").json(path)
    return RD.read_samples_json(spark, path, _S4_SCHEMA)[0]


# =====================================================================================
# Blank rows (P18), request files (S6), the toxicity pair
# =====================================================================================
@register("p18_drop_blank", """
SELECT doc_id, lang, note FROM (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE lang END AS lang,
         CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN chr(9) ELSE source END AS note FROM documents)
WHERE doc_id % 5 <> 0""")
def q_p18(spark, d):
    doc = R.table(spark, d, "documents")
    blank = F.col("doc_id") % 5 == 0
    rows = doc.select("doc_id", F.when(blank, F.lit("  ")).otherwise(F.col("lang")).alias("lang"),
                      F.when(blank, F.lit(None).cast("string")).when(F.col("doc_id") % 3 == 0, F.lit("\t"))
                      .otherwise(F.col("source")).alias("note"))
    return C.drop_blank(rows, ["lang", "note"])


@register("s6_read_requests", _with(R.SQL_REQUESTS) + "SELECT name, category, description, review, rating FROM requests")
def q_s6(spark, d):
    """Requests written as JSON and read back with the request schema."""
    path = scratch_path(spark, "s6")
    R.requests(spark, d).drop("id").write.mode("overwrite").json(path)
    return RD.read_requests(spark, path, multi_line=False)


@register("s7_read_pair", _with(R.SQL_TOXIGEN_GEN, R.SQL_TOXIGEN_ANNOTATED) + """
SELECT g.doc_id, g.prompt, g.prompt_label, a.toxicity_human FROM toxigen_gen g JOIN toxigen_annotated a USING (doc_id)""")
def q_s7(spark, d):
    """The two toxicity tables written as Parquet and read back as a pair."""
    base = scratch_path(spark, "s7")
    R.toxigen_gen(spark, d).write.parquet(f"{base}/generated")
    R.toxigen_annotated(spark, d).write.parquet(f"{base}/annotated")
    gen, ann = RD.read_parquet_pair(spark, f"{base}/generated", f"{base}/annotated")
    return gen.join(ann.select("doc_id", "toxicity_human"), "doc_id") \
        .select("doc_id", "prompt", "prompt_label", "toxicity_human")
