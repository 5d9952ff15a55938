"""Head decisions (M10), head settings (J5) and the OR gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE = "__label__pos"


def fire(prob_pos, threshold=None) -> Column:
    """A binary head fires iff its top-1 label is positive (p > 0.5) and, when a
    threshold is set, ``p >= threshold``; what is not a number fires nothing."""
    p = F.col(prob_pos) if isinstance(prob_pos, str) else prob_pos
    on = (p > 0.5) & ~F.isnan(p.cast("double"))
    if threshold is None:
        return on
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return on & (t.isNull() | (p >= t))


def fire_top1(label, prob, threshold=None, positive: str = POSITIVE) -> Column:
    """Same rule on a (top-1 label, its probability) pair."""
    lab = F.col(label) if isinstance(label, str) else label
    p = F.col(prob) if isinstance(prob, str) else prob
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    ok = lab == F.lit(positive)
    return ok if t is None else ok & (t.isNull() | (p >= t))


def check_settings(settings: DataFrame | None, heads: Sequence[str]) -> None:
    """Fail when a head in ``heads`` has two settings rows or every one is disabled. One row
    of counts reaches the driver, whatever the table's size."""
    if settings is None or not heads:
        return
    own = settings.filter(F.col("head").isin(list(heads)))
    row = own.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("head").alias("heads"),
                  F.count_if(~F.coalesce(F.col("enabled"), F.lit(True))).alias("off")).first()
    if row["n"] != row["heads"]:
        raise ValueError("a head has more than one settings row")
    if row["off"] == len(set(heads)):
        raise ValueError("all heads are disabled")


def or_gate(scores: DataFrame, heads: Sequence[str], settings: DataFrame | None = None,
            default_threshold: float | None = None, id_col: str = "id",
            positive: str = POSITIVE) -> DataFrame:
    """OR gate over long-form head outputs ``(id, head, label, prob)`` (top-1 label).

    ``settings(head, threshold, enabled)`` overrides the default threshold per head and
    can switch heads off; heads without an entry use the default. Only ``heads`` count,
    in that order; an id that has none of them is ``good``.
    Output: ``id, decision ('bad'|'good'), fired (array, head order)``.
    """
    check_settings(settings, heads)
    order = F.create_map(*[x for i, h in enumerate(heads) for x in (F.lit(h), F.lit(i))])
    s = scores
    if settings is not None:
        # at most one row a head (checked), so the table is as small as the head list
        st = F.broadcast(settings.filter(F.col("head").isin(list(heads))).select("head", "threshold", "enabled"))
        s = s.join(st, "head", "left")
        thr = F.coalesce(F.col("threshold"), F.lit(default_threshold))
        enabled = F.coalesce(F.col("enabled"), F.lit(True))
    else:
        thr, enabled = F.lit(default_threshold), F.lit(True)
    fired = F.col("head").isin(list(heads)) & enabled & fire_top1("label", "prob", thr, positive)
    per = s.select(id_col, F.when(fired, F.struct(order[F.col("head")].alias("o"),
                                                   F.col("head").alias("h"))).alias("f"))
    agg = per.groupBy(id_col).agg(F.array_sort(F.collect_list("f")).alias("__f"))
    out = agg.select(id_col, F.transform("__f", lambda x: x["h"]).alias("fired"))
    return out.withColumn("decision", F.when(F.size("fired") > 0, F.lit("bad"))
                          .otherwise(F.lit("good")))


def or_gate_wide(df: DataFrame, heads: Sequence[str], prob_cols: Sequence[str] | None = None,
                 default_threshold: float | None = None,
                 thresholds: dict | None = None, disabled: Sequence[str] = (),
                 out: str = "fired") -> DataFrame:
    """OR gate when each head's positive probability is a column (no shuffle at all)."""
    prob_cols = list(prob_cols or [f"{h}_prob" for h in heads])
    thresholds = thresholds or {}
    if heads and all(h in disabled for h in heads):
        raise ValueError("all heads are disabled")
    names = [F.when(fire(c, thresholds.get(h, default_threshold)), F.lit(h))
             for h, c in zip(heads, prob_cols) if h not in disabled]
    fired = F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array()
    return df.withColumn(out, fired)
