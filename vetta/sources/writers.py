"""Writers. Outputs are folders of part files written by the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def write_labeled_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``(split, category, line)`` -> ``split=<s>/category=<c>/part-*`` text files."""
    lines.select("split", "category", "line").write.mode(mode) \
        .partitionBy("split", "category").text(path)


def write_label_batches(df: DataFrame, path: str, batch: str = "batch_no",
                        order: str = "pos", mode: str = "overwrite", per_folder: int = 10_000) -> None:
    """One JSON line per batch: ``batch_no``, ``last_row`` (where a resumed run goes on) and
    the ``records``. A folder holds a range of ``per_folder`` batches. A batch is bounded in
    size, so collecting its records into one array is bounded too."""
    cols = [c for c in df.columns if c not in (batch, order)]
    agg = df.groupBy(batch).agg(
        F.array_sort(F.collect_list(F.struct(order, *cols))).alias("__r"))
    out = agg.select(F.floor(F.col(batch) / per_folder).alias("batch_range"), batch,
                     F.element_at("__r", -1)[order].alias("last_row"),
                     F.transform("__r", lambda x: x.dropFields(order)).alias("records"))
    out.write.mode(mode).partitionBy("batch_range").json(path)


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small metrics frame (a few rows) as one JSON file."""
    df.coalesce(1).write.mode(mode).json(path)
