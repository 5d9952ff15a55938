"""Dense numbering, seeded shuffles, exact splits, folds and batches.

``dense_index`` is the one primitive: a 0-based position in a total order, optionally
restarting per group. Rows that agree in the order columns follow one another by a hash of
the whole row; rows equal in everything are counted before any exchange and written out
again as so many copies, so each row gets one position whatever the keys. Only order and
group columns and the hash are range partitioned, sorted and frozen with a reliable
checkpoint (so a lost executor recomputes nothing non-deterministic) and numbered with
``monotonically_increasing_id``; the payload joins the positions on them. Per-(partition,
group) counts turn local positions into global ones. A null group is a group like any
other. ``split`` needs no numbering at all: hash-prefix counts give the one row per stratum
at which the parts meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetta.functions.hashing import md5_order
from vetta.operators.tables import bounded_broadcast
from vetta.session import ensure_checkpoint_dir

_LOW33 = (1 << 33) - 1


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _row_hash(df: DataFrame) -> Column:
    """A hash of all columns; maps, which have no order, count as their JSON text."""
    def part(f):
        name = F.col(f"`{f.name}`")
        return F.to_json(F.struct(name)) if "map<" in f.dataType.simpleString() else name
    return F.xxhash64(*[part(f) for f in df.schema.fields])


#: Copies of one row that a task writes out.
COPIES = 100_000


def _copies(df: DataFrame, out: str) -> DataFrame:
    """Each row ``__c`` times, ``out`` counting on from ``__start``. The copies of a frequent row
    are dealt over the tasks in blocks."""
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__c") - 1) / COPIES)))
    dealt = df.withColumn("__block", block).repartition(F.xxhash64(F.col("__start"), F.col("__block")))
    low = F.col("__start") + F.col("__block") * COPIES
    high = F.least(low + COPIES, F.col("__start") + F.col("__c")) - 1
    return dealt.withColumn(out, F.explode(F.sequence(low, high)))


def dense_index(df: DataFrame, order: Sequence[str], by: Sequence[str] = (),
                out: str = "idx", group_size: str | None = None,
                partitions: int | None = None) -> DataFrame:
    """Add a 0-based position ``out`` following the columns ``order`` (``"-c"``: descending),
    restarting inside each ``by`` group (nulls are one group). Rows that agree in all of
    them keep their number of rows and stand in an order that their content gives.
    ``group_size`` optionally adds the group's row count from the same count table."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = list(dict.fromkeys([*by, *(c.removeprefix("-") for c in order)]))
    whole = set(df.columns) <= set(keys)
    marked = df if whole else df.withColumn("__h", _row_hash(df))
    ident = keys if whole else [*keys, "__h"]
    sort = [*_cols(by), *[F.col(c[1:]).desc() if c.startswith("-") else F.col(c) for c in order],
            *([] if whole else [F.col("__h")])]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = (marked.groupBy(*ident).agg(F.count(F.lit(1)).alias("__c"))
              .repartitionByRange(n, *sort).sortWithinPartitions(*sort).checkpoint(eager=True))
    ties = not narrow.filter("__c > 1").isEmpty()
    tagged = narrow.withColumn("__mid", F.monotonically_increasing_id()).withColumns({
        "__pid": F.shiftrightunsigned(F.col("__mid"), 33),
        "__pos": F.col("__mid").bitwiseAND(F.lit(_LOW33))})
    counts = tagged.groupBy("__pid", *by).agg(F.sum("__c").alias("__n"), F.min("__pos").alias("__first"))
    w = Window.partitionBy(*by).orderBy("__pid")
    counts = counts.withColumn(
        "__off", F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    extra = [group_size] if group_size else []
    if group_size:
        counts = counts.withColumn(group_size, F.sum("__n").over(Window.partitionBy(*by)))
    small = counts.select(F.col("__pid").alias("__cpid"), *[F.col(c).alias(f"__c_{c}") for c in by],
                          "__off", "__first", *extra)
    if not by:
        # one row per partition: bounded by the partition count, safe to broadcast
        small = F.broadcast(small)
    on = F.col("__pid") == F.col("__cpid")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__c_{c}"))
    if ties:                                            # positions count rows, not distinct rows
        before = Window.partitionBy("__pid", *by).orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
        tagged = tagged.withColumn("__at", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    inside = F.col("__at") if ties else F.col("__pos") - F.col("__first")
    placed = tagged.join(small, on).select(*ident, (F.col("__off") + inside).alias("__start"), "__c", *extra)
    if whole:
        numbered = _copies(placed, out) if ties else placed.withColumnRenamed("__start", out)
        return numbered.select(*df.columns, out, *extra)
    right = placed.select(*[F.col(k).alias(f"__k_{k}") for k in ident], "__start", "__c", *extra)
    same = F.lit(True)
    for k in ident:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = marked.join(right, same)
    if not ties:
        return joined.select(*df.columns, F.col("__start").alias(out), *extra)
    once = joined.filter("__c = 1").withColumn(out, F.col("__start"))
    again = _copies(joined.filter("__c > 1").dropDuplicates(ident), out)
    return once.select(*df.columns, out, *extra).unionByName(again.select(*df.columns, out, *extra))


def shuffle_order(df: DataFrame, key: str, seed: int = 42, out: str = "idx") -> DataFrame:
    """Seeded full shuffle: position in ``md5('<seed>:<key>')`` order (key breaks ties)."""
    return dense_index(df.withColumn("__ord", md5_order(key, seed)), ["__ord", key],
                       out=out).drop("__ord")


def head_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Row cap that keeps exactly the first ``n`` rows in ``order`` (a total order). Rows are
    numbered where they stand, so no task receives ``n`` rows of every partition."""
    return dense_index(df, order, out="__i").filter(F.col("__i") < int(n)).drop("__i")


#: Leading md5 hex digits counted to find where two parts meet (65,536 prefixes a stratum).
PREFIX = 4


#: Strata whose cuts are broadcast.
STRATA = 100_000


def _cut_keys(df: DataFrame, key: str, ratio: float, stratify: str | None) -> DataFrame:
    """One row per stratum: ``__s, __m, __k``, the (hash, key) of the first row of the second
    part, null where the first part has every row. Only the rows of one hash prefix a
    stratum are ranked. Hashes and keys are read once, into a checkpoint, and so are the cuts."""
    ensure_checkpoint_dir(df.sparkSession)
    stratum = F.col(stratify) if stratify else F.lit(1)
    rows = df.select(stratum.alias("__s"), F.col("__ord").alias("__m"), F.col(key).alias("__k"),
                     F.substring("__ord", 1, PREFIX).alias("__p")).checkpoint(eager=True)
    counts = rows.groupBy("__s", "__p").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__s")
    counts = counts.select("__s", "__p", "__n",
                           F.sum("__n").over(w.orderBy("__p")).alias("__upto"), F.sum("__n").over(w).alias("__all"))
    first = F.floor(F.col("__all") * F.lit(float(ratio)))
    edge = counts.withColumn("__left", first - (F.col("__upto") - F.col("__n"))) \
        .filter((F.col("__left") >= 0) & (F.col("__left") < F.col("__n"))) \
        .select(F.col("__s").alias("__es"), F.col("__p").alias("__ep"), "__left")
    inside = rows.join(edge, F.col("__s").eqNullSafe(F.col("__es")) & (F.col("__p") == F.col("__ep")))
    place = F.row_number().over(Window.partitionBy("__s").orderBy("__m", "__k")) - 1
    return inside.withColumn("__at", place).filter(F.col("__at") == F.col("__left")).select("__s", "__m", "__k") \
        .checkpoint(eager=True)


def split(df: DataFrame, key: str, ratio: float, seed: int = 42,
          stratify: str | None = None, out: str = "split",
          first: str = "train", second: str = "test") -> DataFrame:
    """Exact seeded split: inside each stratum (or overall; null is a stratum) the first
    ``floor(n*ratio)`` rows in (md5, key) order go to ``first``, the rest to ``second``.
    Every row lands in one part, and no payload is moved: the cuts are broadcast, as the
    rows of a stratum would all meet in one task (of more than ``STRATA``, they are joined)."""
    keyed = df.withColumn("__ord", md5_order(key, seed))
    cut = bounded_broadcast(_cut_keys(keyed, key, ratio, stratify), STRATA)
    stratum = F.col(stratify) if stratify else F.lit(1)
    joined = keyed.withColumn("__own", stratum).join(cut, F.col("__own").eqNullSafe(F.col("__s")), "left")
    before = F.col("__m").isNull() | (F.struct(F.col("__ord"), F.col(key)) < F.struct("__m", "__k"))
    return joined.select(*df.columns, F.when(before, F.lit(first)).otherwise(F.lit(second)).alias(out))


def folds(df: DataFrame, key: str, k: int = 3, seed: int = 42,
          stratify: str | None = None, out: str = "fold") -> DataFrame:
    """Fold number = (position inside the stratum in md5 order) mod k."""
    by = [stratify] if stratify else []
    idx = dense_index(df.withColumn("__ord", md5_order(key, seed)), ["__ord", key], by=by,
                      out="__i")
    return idx.withColumn(out, (F.col("__i") % k).cast("int")).drop("__ord", "__i")


def assemble_batches(df: DataFrame, id_col: str = "id", text_col: str = "user_message",
                     size: int = 20, seed: int | None = 42, order: str | None = None
                     ) -> DataFrame:
    """Group rows (in seeded-shuffle order, or ``order``) into batches of ``size``.

    One row per batch: ``batch_no``, ``n``, ``ids`` (comma-joined), ``prompt`` (the
    ``<Job k>`` blocks) and ``next_checkpoint``. A batch holds at most ``size`` rows, so
    collecting one batch is bounded; the last batch may be short.
    """
    if order is None:
        indexed = shuffle_order(df, id_col, seed if seed is not None else 42, out="__i")
    else:
        indexed = dense_index(df, [order, id_col], out="__i")
    pos = (F.col("__i") % size) + 1
    block = F.concat(F.lit("<Job "), pos.cast("string"), F.lit(">\n"), strip_text(text_col),
                     F.lit("\n</Job "), pos.cast("string"), F.lit(">\n\n"))
    rows = indexed.select(F.floor(F.col("__i") / size).cast("long").alias("batch_no"),
                          F.col("__i"), F.col(id_col).alias("__id"), block.alias("__block"))
    agg = rows.groupBy("batch_no").agg(
        F.array_sort(F.collect_list(F.struct("__i", "__id", "__block"))).alias("__items"),
        F.max("__i").alias("__last"))
    return agg.select(
        "batch_no",
        F.size("__items").cast("long").alias("n"),
        F.array_join(F.transform("__items", lambda x: x["__id"].cast("string")), ",").alias("ids"),
        F.array_join(F.transform("__items", lambda x: x["__block"]), "").alias("prompt"),
        (F.col("__last") + 1).alias("next_checkpoint"))


def strip_text(c: str) -> Column:
    from vetta.functions.text import strip_ws
    return strip_ws(F.col(c))


def pending_batches(batches: DataFrame, done: DataFrame, key: str = "batch_no") -> DataFrame:
    """Batches not yet written (resume from checkpoint)."""
    return batches.join(done.select(key).distinct(), on=key, how="left_anti")
