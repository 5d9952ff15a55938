"""Keep-first in a stream: arrival order does not matter inside the delay, state expires."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vetta.operators.tables import keep_first
from vetta.streaming import keep_first_stream

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "seq long, ts timestamp, who string, text string"


def run(spark, batches, tmp_path, **options):
    """Feed the batches as files in their order; the emitted rows, and the state rows after each batch."""
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        df.write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    out = keep_first_stream(stream, ["who", "text"], ["seq"], "ts", **options)
    q = (out.writeStream.format("parquet").option("path", f"{tmp_path}/out")
         .option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    state = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    return spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out"), state


def test_shuffled_arrivals_equal_keep_first(spark, tmp_path):
    rng = random.Random(3)
    # repeats of a key inside half an hour; keys an hour and more apart
    rows = [(100 * k + rng.randrange(100), T0 + dt.timedelta(hours=2 * k, minutes=rng.randrange(30)),
             rng.choice(["a", "b", None]), f"t{k % 5}") for k in range(40) for _ in range(4)]
    rows = list({r[0]: r for r in rows}.values())
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(50)))      # up to 50 minutes out of order
    batches = [order[i:i + 20] for i in range(0, len(order), 20)] + [[(10**6, T0 + dt.timedelta(days=400), "end", "end")]]
    got, state = run(spark, batches, tmp_path, within="1 hour", late="1 hour")
    df = spark.createDataFrame(rows, SCHEMA).withColumn("day", F.floor(F.unix_timestamp("ts") / 7200))
    want = keep_first(df, ["who", "text", "day"], "seq").drop("day")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, want.collect()), key=lambda r: r[0])
    assert max(state) < len(order) / 2 and state[-1] == 1           # only the marker is held in the end


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    m = lambda k: T0 + dt.timedelta(minutes=k)
    batches = [[(5, m(0), "a", "x"), (9, m(1), "b", "x")], [(4, m(20), "a", "x"), (7, m(300), "c", "x")],
               [(50, m(400), "d", "x")], [(1, m(10), "a", "x"), (2, m(350), "d", "x"), (3, m(345), "e", "x")], [(99, m(5000), "end", "end")]]
    got, state = run(spark, batches, tmp_path, within="30 minutes", late="1 hour")
    # (1, a) comes when a's run is closed; (2, d) and (3, e) are late, but in time
    assert sorted((r.seq, r.who) for r in got.collect()) == [(2, "d"), (3, "e"), (4, "a"), (7, "c"), (9, "b"), (50, "d")]
    assert state[-1] == 1
