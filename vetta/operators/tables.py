"""Joins, de-duplication and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only after checking it has at most ``max_rows`` rows; otherwise
    return it unchanged so the planner (AQE) chooses a shuffle join."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def join_business(reviews: DataFrame, meta: DataFrame, key: str = "gmap_id",
                  null_safe: bool = False, suffixes: tuple[str, str] = ("_x", "_y")
                  ) -> DataFrame:
    """Inner equi-join of reviews and business metadata (many-to-many fan-out kept).

    Clashing column names get ``_x`` (review side) / ``_y`` (meta side). ``null_safe``
    matches null keys with each other, as an in-memory merge does; it is off by default,
    as all null keys would then meet each other. The join strategy
    is left to the planner: AQE broadcasts the metadata when its runtime size is under
    the broadcast threshold and falls back to a skew-aware sort-merge join otherwise.
    """
    clash = (set(reviews.columns) & set(meta.columns)) - {key}
    r = reviews.select(*[F.col(c).alias(c + suffixes[0] if c in clash else c)
                         for c in reviews.columns])
    m = meta.select(*[F.col(c).alias(c + suffixes[1] if c in clash else
                                     ("__mkey" if c == key else c)) for c in meta.columns])
    cond = r[key].eqNullSafe(m["__mkey"]) if null_safe else (r[key] == m["__mkey"])
    return r.join(m, cond, "inner").drop("__mkey")


def _keep(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool,
          unique_order: bool) -> DataFrame:
    kinds = dict(df.dtypes)
    hashed = [F.sha2(F.col(k), 256) if kinds[k] == "string" else F.col(k) for k in keys]
    own = df.select("*", *[h.alias(f"__h{i}") for i, h in enumerate(hashed)])
    names = [f"__h{i}" for i in range(len(keys))]
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    best = own.groupBy(*names).agg((F.max if last else F.min)(rank).alias("__best"))
    right = best.select(*[F.col(n).alias(f"__r{n}") for n in names], "__best")
    same = rank.eqNullSafe(F.col("__best"))
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"__r{n}"))
    out = own.join(right, same, "left_semi")
    if not unique_order:
        out = out.dropDuplicates(names)
    return out.select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: str | Sequence[str],
               unique_order: bool = True) -> DataFrame:
    """One row per ``keys`` (nulls equal): the one with the smallest ``order`` (one or more
    columns that tell the rows of a key apart; where they may not, ``unique_order=False``
    keeps one of the rows that tie).

    Text keys are compared by SHA-256, so the shuffle of the aggregation carries hashes and
    order values only; it aggregates partially before, so a hot key costs one partial row
    per input partition. The winners come back by a semi-join."""
    return _keep(df, keys, [order] if isinstance(order, str) else list(order), False, unique_order)


def keep_last(df: DataFrame, keys: Sequence[str], order: str | Sequence[str],
              unique_order: bool = True) -> DataFrame:
    """One row per ``keys``: the one with the largest ``order`` (last wins)."""
    return _keep(df, keys, [order] if isinstance(order, str) else list(order), True, unique_order)


def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by column name; columns missing on one side are null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def prompt_pairs(reviews: DataFrame, labels: DataFrame, label_cols: Sequence[str],
                 review_key: str = "id", label_key: str = "job_id", seq: str = "seq",
                 prompt: str = "user_message") -> DataFrame:
    """Reviews that have a label; a duplicated label id keeps its last row (max ``seq``)."""
    last = keep_last(labels.select(label_key, seq, *label_cols), [label_key], seq).drop(seq)
    return (reviews.select(F.col(review_key), F.col(prompt))
            .join(last.withColumnRenamed(label_key, review_key), on=review_key, how="inner"))


def attach_ids(batches: DataFrame, outputs: DataFrame, batch_key: str = "batch_no",
               ids: str = "ids", items: str = "items", id_out: str = "job_id"
               ) -> tuple[DataFrame, DataFrame]:
    """Attach ids to a batch's outputs by position; a batch whose sizes differ goes to
    the second (rejected) frame as a whole.

    ``batches``: (batch_no, ids array<long>); ``outputs``: (batch_no, items array<struct>).
    """
    both = batches.select(batch_key, ids).join(outputs.select(batch_key, items), batch_key, "inner")
    ok = F.size(ids) == F.size(items)
    good = (both.filter(ok)
            .select(batch_key, F.arrays_zip(F.col(ids).alias("i"), F.col(items).alias("o")).alias("z"))
            .select(batch_key, F.posexplode("z").alias("pos", "z"))
            .select(batch_key, "pos", F.col("z.i").alias(id_out), F.col("z.o").alias("o"))
            .select(batch_key, "pos", id_out, "o.*"))
    bad = both.filter(~ok).select(batch_key, F.size(ids).alias("n_ids"),
                                  F.size(items).alias("n_outputs"))
    return good, bad
