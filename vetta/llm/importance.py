"""Importance resampling towards a target distribution, over hashed n-gram buckets.

The features of a text are its runs of 1 to ``LONGEST`` words (A-Z lower-cased), repeats
counted; a feature's bucket is its CRC-32 modulo ``BUCKETS``. CRCs come from one scan of the
separator-normalised text (``prefix_crc``). A bucket's gain is the log ratio of its smoothed
shares in target and corpus, in thousandths; a document's weight is the floored mean of its
features' gains. Weight plus Gumbel noise, keyed by the id, ranks the documents of at least
``MIN_WORDS`` words, and the highest ``PERCENT`` per cent are drawn: sampling without
replacement in proportion to exp(weight / 1000).

Scale: tasks count buckets in an array and give one row a bucket; the counts that reach the
driver and the gains that go back are ``BUCKETS`` numbers whatever the input. Ranks come from
a range-partitioned sort of narrow rows; each task numbers its own, and partition sizes (one
number a partition) give the offsets. No window without a key, no text moves.

Cases: a null text has no words (no features, weight 0, never drawn); a null id counts as
empty text in the key of the noise and is the last of a tie; rows that repeat an id score
alike and are ranked each, in the order in which they were read; very long texts are scanned
whole, at about 30 bytes of memory a character; an empty table gives an empty result, and
without target texts every gain follows from the smoothing alone; other columns are never
read, so names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, ship, table, text_of
from .prefix_crc import ngram_crcs
from .shingles import groups_of

LONGEST, BUCKETS, PERCENT, SEED, MIN_WORDS = 2, 10000, 25, 7, 20
MEASURES = "n_words long, n_features long, weight long"


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many features of all texts fall into each bucket that has any."""
    ship(docs.sparkSession)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in groups_of(texts):
                for crcs, _ in ngram_crcs(texts[a:b], longest):
                    total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    found = docs.select(text_of(text_col).alias("text")).mapInPandas(count, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln(smoothed target share / smoothed corpus share)) of every bucket."""
    s, t = ([0] * buckets for _ in range(2))
    for side, counts in ((s, corpus), (t, target)):
        for r in counts.collect():
            side[r.bucket] = r.n
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t)))
                     for b in range(buckets)], np.int64)


def measures(gain: np.ndarray, longest: int = LONGEST):
    """A column function: the number of words and features of a text, and its weight."""
    buckets = np.uint32(len(gain))

    @F.pandas_udf(MEASURES)
    def of(text: pd.Series) -> pd.DataFrame:
        texts, out = text.tolist(), []
        for a, b in groups_of(texts):
            n = b - a
            words, features, total = None, np.zeros(n, np.int64), np.zeros(n, np.int64)
            for crcs, own in ngram_crcs(texts[a:b], longest):
                sums = np.concatenate([[0], np.cumsum(gain[crcs % buckets])])
                total += sums[own[1:]] - sums[own[:-1]]
                features += np.diff(own)
                words = features.copy() if words is None else words
            out.append(pd.DataFrame({"n_words": words, "n_features": features,
                                     "weight": np.where(features > 0, total // np.maximum(features, 1), 0)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"n_words": [], "n_features": [], "weight": []}, dtype="int64")

    return of


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256('<seed>:<id>')."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _ranked(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_text: str, longest: int, buckets: int,
            percent: int, seed: int, min_words: int, whole_rows: bool) -> DataFrame:
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text, longest, buckets), buckets)
    rows = packed(docs, doc_id=F.col(id_col), m=measures(gain, longest)(text_of(text_col)))
    kept = ["row"] if whole_rows else []
    scored = table(rows.select(*kept, "doc_id", "m.*", (F.col("m.weight") + noise(F.col("doc_id"), seed)).alias("score"),
                               F.monotonically_increasing_id().alias("at")), "scored")
    fit = scored.filter(F.col("n_words") >= min_words)
    drawn = percent * fit.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("at").asc()]
    sorted_rows = fit.drop("row").repartitionByRange(*order).sortWithinPartitions(*order) \
        .withColumn("place", F.monotonically_increasing_id())
    placed = table(sorted_rows, "placed")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, {}
    for p, n in sizes:
        starts[p], before = before, before + n
    start = F.lit(0).cast("long")
    if starts:                                          # one number a partition
        offsets = F.create_map(*[F.lit(v).cast("long") for kv in starts.items() for v in kv])
        start = F.element_at(offsets, part)
    rank = start + inside + 1
    ranked = placed.select("doc_id", "n_words", "n_features", "weight", "score", "at",
                           F.when(rank <= drawn, rank).alias("rank"))
    if whole_rows:
        return scored.select("row", "at").join(ranked.filter("rank is not null").select("at", "rank"), "at")
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("at")


def importance_ranks(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT,
                     seed: int = SEED, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_features, weight, score, rank`` (1, 2, ... for
    the drawn ones from the highest score, ties to the smaller id; else null)."""
    return _ranked(docs, target, id_col, text_col, target_text, longest, buckets, percent, seed, min_words, False)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT,
             seed: int = SEED, min_words: int = MIN_WORDS) -> DataFrame:
    """The drawn rows of ``docs``, columns unchanged."""
    return _ranked(docs, target, id_col, text_col, target_text, longest, buckets, percent, seed, min_words, True).select("row.*")
