"""Cheap-first cascade (C1) and its verdict summary.

Every request gets one verdict: ``accept``, ``reject`` or ``quarantine``. A review is
quarantined, with the reason, when it cannot be judged: an incomplete request (stage 0) or
a score that is missing at the stage that needs it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetta.operators.gate import fire, or_gate_wide

# Stage-2 heads in use and the default head threshold; stage-3 labels.
STAGE2_HEADS = ["ad", "irrelevant", "rant", "unsafe"]
DEFAULT_HEAD_THRESHOLD = 0.7
STAGE3_LABELS = ["advertisement", "irrelevant_content", "non_visitor_rant", "toxicity"]


def _none(c: str) -> Column:
    """No score: null, or not a number (which compares above every threshold)."""
    return F.col(c).isNull() | F.isnan(F.col(c).cast("double"))


def _missing(cols: Sequence[str]) -> Column:
    """Reasons for the score columns that are null or not a number."""
    return F.array_compact(F.array(*[F.when(_none(c), F.lit(f"no {c}")) for c in cols]))


def _verdicts(g: DataFrame, id_col: str, safety_prob: str, heads: Sequence[str], labels: Sequence[str],
              label_threshold: float, incomplete: Column | None) -> DataFrame:
    """The verdict of each row from its scores and fired heads: one projection."""
    p = F.col(safety_prob)
    flagged = F.array_compact(F.array(*[F.when(~_none(f"{lab}_prob") & (F.col(f"{lab}_prob") > label_threshold), F.lit(lab))
                                        for lab in labels]))
    bad = F.lit("") if incomplete is None else F.coalesce(incomplete, F.lit(""))
    g = g.withColumns({"__flag": flagged, "__bad": bad,
                       "__no2": _missing([f"{h}_prob" for h in heads]),
                       "__no3": _missing([f"{lab}_prob" for lab in labels])})
    s0, s1 = F.col("__bad") != "", ~_none(safety_prob) & (p > 0.5)
    s2, s3 = F.size("__fired") > 0, F.size("__flag") > 0
    q1, q2, q3 = _none(safety_prob), F.size("__no2") > 0, F.size("__no3") > 0
    stage = F.when(s0, 0).when(q1 | s1, 1).when(s2 | q2, 2).otherwise(3)
    decision = (F.when(s0 | q1, "quarantine").when(s1 | s2, "reject").when(q2, "quarantine")
                .when(s3, "reject").when(q3, "quarantine").otherwise("accept"))
    reasons = (F.when(s0, F.array("__bad")).when(q1, F.array(F.lit(f"no {safety_prob}")))
               .when(s1, F.array(F.lit("safety"))).when(s2, F.col("__fired")).when(q2, F.col("__no2"))
               .when(s3, F.col("__flag")).otherwise(F.col("__no3")))
    seen2 = ~s0 & ~q1 & ~s1
    probs = F.create_map(*[x for lab in labels for x in (F.lit(lab), F.col(f"{lab}_prob"))])
    return g.select(F.col(id_col), stage.alias("stage"), decision.alias("decision"),
                    F.when(~s0, p).alias("safety_prob"), F.when(seen2, F.col("__fired")).alias("fired_heads"),
                    reasons.alias("reasons"), F.when(seen2 & ~s2 & ~q2, probs).alias("label_probs"))


def cascade_rules(df: DataFrame, id_col: str = "id", safety_prob: str = "safety_prob",
                  heads: Sequence[str] = STAGE2_HEADS,
                  head_threshold: float = DEFAULT_HEAD_THRESHOLD,
                  labels: Sequence[str] = STAGE3_LABELS,
                  label_threshold: float = 0.5, thresholds: Mapping | None = None,
                  disabled: Sequence[str] = ()) -> DataFrame:
    """Cascade over given probability columns (``safety_prob``, ``<head>_prob``,
    ``<label>_prob``): one projection, no shuffle.

    Stage 1 rejects when the safety probability of class 1 is above 0.5; stage 2 when
    any head that is not ``disabled`` fires at its threshold; stage 3 when any label
    probability is above ``label_threshold``. Accepted reviews finish at stage 3.
    """
    g = or_gate_wide(df, heads, default_threshold=head_threshold, thresholds=thresholds,
                     disabled=disabled, out="__fired")
    on = [h for h in heads if h not in disabled]
    return _verdicts(g, id_col, safety_prob, on, labels, label_threshold, None)


def cascade(df: DataFrame, stage1: Callable, stage2: Callable, stage3: Callable, id_col: str = "id",
            heads: Sequence[str] = STAGE2_HEADS, head_threshold: float = DEFAULT_HEAD_THRESHOLD,
            labels: Sequence[str] = STAGE3_LABELS, label_threshold: float = 0.5,
            thresholds: Mapping | None = None, disabled: Sequence[str] = (),
            texts: Sequence[str] = ("text",), incomplete: str | None = None) -> DataFrame:
    """Model cascade in one pass: each stage scores only the survivors of the previous one.

    ``stage1(df) -> df + safety_prob``; ``stage2(df) -> df + <head>_prob``;
    ``stage3(df) -> df + <label>_prob``. The ``texts`` of a row that is already decided are
    blanked before the next stage, so its expensive features are never built; nothing is
    cached and no row is read twice. ``incomplete`` names a column with the reason why a
    request cannot be scored (blank: complete).
    """
    def only(frame: DataFrame, alive: Column) -> DataFrame:
        alive = F.coalesce(alive, F.lit(False))
        return frame.withColumns({c: F.when(alive, F.coalesce(F.col(c), F.lit(""))).otherwise(F.lit("")) for c in texts})

    complete = F.lit(True) if incomplete is None else F.coalesce(F.col(incomplete), F.lit("")) == ""
    s1 = stage1(only(df, complete))
    alive = complete & ~_none("safety_prob") & (F.col("safety_prob") <= 0.5)
    s2 = or_gate_wide(stage2(only(s1, alive)), heads, default_threshold=head_threshold,
                      thresholds=thresholds, disabled=disabled, out="__fired")
    s3 = stage3(only(s2, alive & (F.size("__fired") == 0)))
    on = [h for h in heads if h not in disabled]
    return _verdicts(s3, id_col, "safety_prob", on, labels, label_threshold,
                     None if incomplete is None else F.col(incomplete))


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """Counts by (stage, decision)."""
    return verdicts.groupBy("stage", "decision").agg(F.count(F.lit(1)).alias("reviews"))


__all__ = ["cascade_rules", "cascade", "verdict_summary", "fire", "STAGE2_HEADS",
           "STAGE3_LABELS", "DEFAULT_HEAD_THRESHOLD"]
