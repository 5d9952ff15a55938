"""Table profiles and label checks (one aggregation pass each)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _name(c: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + c.replace("`", "``") + "`")


def _long(df: DataFrame, pairs: Sequence[tuple[str, Column]], name: str, value: str, *keep: str) -> DataFrame:
    """One row per (label, expression) pair of every row; no shuffle."""
    each = F.explode_outer(F.array(*[F.struct(F.lit(n).alias(name), c.alias(value)) for n, c in pairs]))
    return df.select(*keep, each.alias("__each")).select(*keep, f"__each.{name}", f"__each.{value}")


def value_counts(df: DataFrame, cols: Sequence[str] | None = None, ordered: bool = False) -> DataFrame:
    """(column, value, count) for every non-null value of each column; ``ordered``: by column,
    the most frequent first (ties by value), a range-partitioned sort.

    The count is partially aggregated per input partition, so a value that fills a
    third of the table is still one shuffled row per partition.
    """
    cols = list(cols or df.columns)
    counts = (_long(df, [(c, _name(c).cast("string")) for c in cols], "column", "value")
              .filter(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))
    return counts.orderBy("column", F.desc("count"), "value") if ordered else counts


def top_values(df: DataFrame, k: int, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, rank, value, count): the ``k`` most frequent values of each column (ties by
    value). Each partition of the counts keeps its own ``k`` first, so what meets in one
    task is ``k`` rows a column and partition, however many distinct values there are."""
    counts = value_counts(df, cols)
    best = [F.desc("count"), F.asc("value")]
    part = Window.partitionBy("column", "__part").orderBy(*best)
    few = counts.withColumn("__part", F.pmod(F.xxhash64("value"), F.lit(1024))) \
        .withColumn("__r", F.row_number().over(part)).filter(F.col("__r") <= k)
    rank = F.row_number().over(Window.partitionBy("column").orderBy(*best))
    return few.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("column", "rank", "value", "count")


def value_sketches(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, rows, nulls, sketch): one mergeable sketch of the distinct values of each column
    (HyperLogLog), in one pass, with nothing shuffled but the sketches."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.struct(F.count(F.lit(1)).alias("rows"), F.count_if(_name(c).isNull()).alias("nulls"),
                             F.hll_sketch_agg(_name(c).cast("string")).alias("sketch")).alias(f"c{k}") for k, c in enumerate(cols)])
    return _long(wide, [(c, F.col(f"c{k}")) for k, c in enumerate(cols)], "column", "s").select("column", "s.*")


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """The sketches of several tables or days as those of their union."""
    return sketches.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
                                          F.hll_union_agg("sketch").alias("sketch"))


def distinct_estimates(sketches: DataFrame) -> DataFrame:
    """(column, rows, nulls, distinct): the estimated number of distinct non-null values."""
    return sketches.select("column", "rows", "nulls", F.hll_sketch_estimate("sketch").alias("distinct"))


def null_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls) in one pass over the table."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(_name(c).isNull()).alias(f"c{k}") for k, c in enumerate(cols)])
    return _long(wide, [(c, F.col(f"c{k}")) for k, c in enumerate(cols)], "column", "nulls")


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each identical group (nulls compare equal)."""
    cols = list(cols or df.columns)
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
            .agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("duplicates")))


def _shares(wide: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    long = _long(wide, [(c, F.col(f"c{k}")) for k, c in enumerate(cols)], "label", "positives", "__rows", *by)
    return long.select(
        *by, "label", F.coalesce("positives", F.lit(0)).cast("long").alias("positives"),
        F.col("__rows").alias("rows"),
        F.round(F.try_divide(F.col("positives") * 100.0, F.col("__rows")), 6).alias("pct"))


def _sums(cols: Sequence[str]) -> list[Column]:
    return [F.count(F.lit(1)).alias("__rows"), *[F.sum(_name(c).cast("long")).alias(f"c{k}") for k, c in enumerate(cols)]]


def label_distribution(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(label, positives, rows, pct) with pct = 100 * positives / rows (6 digits)."""
    return _shares(df.agg(*_sums(cols)), cols, [])


def label_rollup(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The label distribution of every combination of ``by``, of each ``by`` column alone and of
    the whole table, by grouping sets in one pass: ``level`` (the columns that are grouped,
    joined by a comma; blank: the total), the ``by`` columns (null where not grouped; a null
    group keeps its level), label, positives, rows, pct."""
    by = list(by)
    sets = [by, *([[c] for c in by] if len(by) > 1 else []), []]
    wide = df.groupingSets([[_name(c) for c in s] for s in sets], *[_name(c) for c in by]) \
        .agg(*_sums(cols), *[F.grouping(_name(c)).alias(f"g{k}") for k, c in enumerate(by)])
    level = F.concat_ws(",", *[F.when(F.col(f"g{k}") == 0, F.lit(c)) for k, c in enumerate(by)])
    return _shares(wide.withColumn("level", level), cols, ["level", *by])


def check_single_label(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose labels sum to exactly 1, all rows, and PASSED/FAILED."""
    total = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in cols), F.lit(0))
    agg = df.agg(F.count_if(total == 1).alias("single_label"),
                 F.count(F.lit(1)).alias("rows"))
    return agg.withColumn("status", F.when(F.col("single_label") == F.col("rows"),
                                           F.lit("PASSED")).otherwise(F.lit("FAILED")))


def placeholder_count(df: DataFrame, col: str = "review", word: str = "fallback") -> DataFrame:
    return df.agg(F.count_if(F.coalesce(F.lower(F.col(col)).contains(word.lower()),
                                        F.lit(False))).alias("placeholders"))


def quota_plan(df: DataFrame, classes: Sequence[str], class_col: str = "class_type",
               target: int = 3000, source_col: str | None = None) -> DataFrame:
    """Per class: current count (max over sources when given), ``need = max(0, target - n)``
    and whether generation is planned (``need > 0``). Absent classes count 0."""
    spark = df.sparkSession
    counts = df.groupBy(class_col, *([source_col] if source_col else [])).agg(
        F.count(F.lit(1)).alias("__n"))
    if source_col:
        counts = counts.groupBy(class_col).agg(F.max("__n").alias("__n"))
    wanted = spark.createDataFrame([(c,) for c in classes],
                                   T.StructType([T.StructField(class_col, T.StringType())]))
    # the class list is a small parameter; the counts have one row per class
    out = wanted.join(counts, class_col, "left")
    cur = F.coalesce(F.col("__n"), F.lit(0)).cast("long")
    return out.select(F.col(class_col), cur.alias("current"),
                      F.greatest(F.lit(0), F.lit(target) - cur).cast("long").alias("need"),
                      (F.lit(target) - cur > 0).alias("planned"))
