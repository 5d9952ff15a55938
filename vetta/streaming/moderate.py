"""Streaming jobs.

``moderate_stream`` scores each micro-batch with the batch cascade inside
``foreachBatch`` and writes it to ``<out>/batch_id=<n>`` with overwrite, so a batch that
is replayed after a failure rewrites the same folder (idempotent sink); progress and
source offsets live in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def moderate_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str,
                    checkpoint: str, available_now: bool = False,
                    processing_time: str | None = None, name: str | None = None
                    ) -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def dedup_stream(stream: DataFrame, keys: Sequence[str], event_time: str,
                 delay: str = "1 hour") -> DataFrame:
    """Drop repeats of ``keys`` seen within ``delay`` of event time (bounded state)."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def keep_first_stream(stream: DataFrame, keys: Sequence[str], order: Sequence[str], event_time: str,
                      within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """The row with the smallest ``order`` of each run of repeats of ``keys``, whatever the order of
    arrival: rows of a key that follow one another within ``within`` of event time are one run.

    A run is a session window: its state is one row, merged as rows come (before the shuffle
    too where ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is on, so a hot
    key is a row a partition), and the row is emitted and the state dropped when the watermark,
    ``late`` behind the newest event, passes the run's end. Rows that come later still are
    dropped by the watermark, as are rows without event time. Null keys are equal."""
    run = stream.withWatermark(event_time, late).groupBy(F.session_window(event_time, within), *keys)
    row = F.struct(*[F.col(f"`{c}`") for c in stream.columns])
    first = run.agg(F.min_by(row, F.struct(*[F.col(c) for c in order])).alias("__row"))
    return first.select(*[F.col("__row").getField(c).alias(c) for c in stream.columns])
