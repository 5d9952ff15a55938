"""The registered queries ``opN_<name>`` and, where SQL can express them, their DuckDB twins.

Each query applies its operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, decontaminate, exact_dedup, importance, interpolated_lm, language_id, licenses, line_dedup,
               near_dedup, periodic_runs, pii, suffix_dedup, warc)
from vetta.session import scratch_path

from .common import LOWER, UPPER, text_of


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The key of the registered query; a real run passes its own secret.
PII_KEY = "example-key"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op3_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score(_read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(_read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_read(spark, sf_dir, "documents"), PII_KEY)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(_read(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(_read(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_warc(_read(spark, sf_dir, "pages"), path)
    found = warc.with_page_ids(warc.captures(spark, path))
    return found.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes",
                        F.coalesce("found_digest", "payload_digest").alias("payload_digest"), F.col("type").alias("record_type"),
                        F.col("refers_to_page").cast("long").alias("refers_to"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in documents whose crc32(doc_id as text) is a multiple of ten the words
    from a place on repeat with a period; both follow from the crc (a null id is empty text)."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    none = F.array().cast("array<string>")
    listed = docs.select("doc_id", "text", F.floor(h / 10).alias("g"),
                         F.when(h % 10 == 0, F.regexp_extract_all(text_of("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
                         .otherwise(none).alias("words")).withColumn("n", F.size("words"))
    placed = listed.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")) \
        .withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    block = F.expr("array_repeat(slice(words, a + 1, p), cast((n - a) div p + 1 as int))")
    words = F.concat(F.expr("slice(words, 1, a)"), F.slice(F.flatten(block), F.lit(1), F.expr("n - a")))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_periods(_read(spark, sf_dir, "documents")))
    ranked = F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"),
                                                               r.period.cast("string")), F.lit("\n")))
    return found.withColumn("best", F.array_max(ranked)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length",
        (-F.col("best.period")).alias("period"), F.expr("-(1000 * best.length div best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_ranks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")) \
        .select("doc_id", "n_features", "weight", "score", "rank")


_FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP4_SQL = f"""
with t as (select doc_id, {_FOLDED} as x from documents)
select doc_id, max(doc_id) over (partition by x) as keep_id, count(*) over (partition by x) as group_size,
       doc_id = max(doc_id) over (partition by x) as kept, sha256(x) as text_sha256
from t
"""

OP9_SQL = f"""
with recursive
w as (select doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') as words from documents),
s as (select distinct doc_id, unnest(
        case when len(words) >= 5
             then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
             when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as shingle from w),
n as (select w.doc_id, count(s.shingle) as n_shingles from w left join s using (doc_id) group by 1),
link as (select a.doc_id as u, b.doc_id as v from s a join s b using (shingle)
         join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
         where a.doc_id <> b.doc_id
         group by 1, 2, x.n_shingles, y.n_shingles
         having 100 * count(*) >= 85 * (x.n_shingles + y.n_shingles - count(*))),
reach as (select doc_id as node, doc_id as other from w
          union select r.node, l.v from reach r join link l on l.u = r.other),
c as (select node, min(other) as component_id from reach group by 1)
select n.doc_id, n.n_shingles, c.component_id, n.doc_id = c.component_id as kept
from n join c on c.node = n.doc_id
"""

OP11_SQL = """
with p as (select page_id, coalesce(html, '') as x from pages),
d as (select page_id, strlen(x) as payload_bytes, sha1(x) as digest, max(page_id) over (partition by x) as best from p)
select page_id, payload_bytes, translate(to_base(('0x' || digest[1:10])::bigint, 32, 8) || to_base(('0x' || digest[11:20])::bigint, 32, 8)
           || to_base(('0x' || digest[21:30])::bigint, 32, 8) || to_base(('0x' || digest[31:40])::bigint, 32, 8),
           '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest,
       case when page_id = best then 'response' else 'revisit' end as record_type,
       case when page_id <> best then best end as refers_to
from d
"""

OP13_SQL = f"""
with
w as (select 'd' as side, doc_id as id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents
      union all
      select 'b', item_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from benchmark),
f as (select side, id, unnest(list_concat(words, list_transform(range(1, len(words)),
             lambda i: words[i] || ' ' || words[i + 1]))) as gram from w),
tab as (select list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(8)),
             lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) as crc),
x as (select distinct gram, hex(encode(gram)) as bytes from f),
h as (select gram, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(bytes) // 2),
             lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::bigint)),
             lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 10000 as bucket from x, tab),
b as (select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from f join h using (gram) group by 1),
g as (select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double
             / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from b),
m as (select id, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight
      from f join h using (gram) join g using (bucket) where side = 'd' group by 1),
d as (select id as doc_id, len(words) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || id), 8))::bigint + 0.5::double)
             / 4294967296::double)))::bigint as score from w left join m using (id) where side = 'd'),
r as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from d where n_words >= 20)
select doc_id, n_features, weight, score, case when place <= 25 * n // 100 then place end as rank
from d left join r using (doc_id)
"""

QUERIES = {
    "op1_line_dedup": (op1_line_dedup, None),
    "op2_language_id": (op2_language_id, None),
    "op3_interpolated_lm": (op3_interpolated_lm, None),
    "op4_exact_dedup": (op4_exact_dedup, OP4_SQL),
    "op5_suffix_dedup": (op5_suffix_dedup, None),
    "op6_pii": (op6_pii, None),
    "op7_licenses": (op7_licenses, None),
    "op8_byte_bpe": (op8_byte_bpe, None),
    "op9_near_dedup": (op9_near_dedup, OP9_SQL),
    "op10_decontaminate": (op10_decontaminate, None),
    "op11_warc": (op11_warc, OP11_SQL),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_importance_resampling": (op13_importance_resampling, OP13_SQL),
}
