"""Helpers shared by the operators: text normalisation, written tables, folds, components."""

from __future__ import annotations

import math
import os
import string
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetta.session import scratch_path

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers (once a session), so that a cluster needs no
    installation: Spark's file server hands the archive to every executor, new ones too."""
    sc = spark.sparkContext
    if getattr(sc, "_vetta_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="vetta-"), "vetta.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("vetta", os.path.relpath(path, top)))
    sc.addPyFile(target)
    sc._vetta_shipped = True


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What the Python workers read: the id as text (a null in a long column would reach
    pandas as a float) and the text, null read as empty."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), text_of(text_col).alias("text"))


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` as one struct column ``row`` beside working columns, whose names then cannot
    clash with those of the table; ``select("row.*")`` gives the table back."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, *[c.alias(name) for name, c in columns.items()])


def text_of(column: Column | str) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A pure ASCII text takes the cheap built-in path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
        .otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (a null id counts as empty text)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


#: Spark's setting that removes the shuffle files of a query when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to a fresh folder under the shared checkpoint root and read it back.

    It cuts the lineage like a checkpoint, survives lost executors, and lets later jobs
    read only the columns they need. The shuffle files behind it are removed once it stands."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(CLEAN_UP, None)
    try:
        spark.conf.set(CLEAN_UP, "true")
        df.write.option("compression", compression).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Distributed union-find: ``node, root`` for every node of an edge list (bigint ids).

    Each round hooks every node to its smallest neighbour, halves the pointer paths until
    they are flat, and contracts the edges to the roots that remain. A round at least
    halves the number of roots with edges, so rounds and jumps are logarithmic. Nothing is
    gathered on the driver; hooks are ``min`` aggregates, so a hub pre-aggregates before the
    shuffle. Self-loops and repeated edges are allowed; an empty list gives an empty table."""
    spark = edges.sparkSession
    live = table(edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
                 .filter("u is not null and v is not null").distinct(), "edges")
    roots = None
    while True:
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = table(both.groupBy(F.col("u").alias("node"))
                       .agg(F.least(F.min("v"), F.first("u")).alias("root")), "parents")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = table(parent.join(up, "root", "left")
                           .select("node", F.coalesce("above", "root").alias("root"),
                                   (F.col("above") < F.col("root")).alias("moved")), "jumps")
            parent = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        if roots is None:
            roots = parent
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            roots = table(roots.join(up, "root", "left")
                          .select("node", F.coalesce("above", "root").alias("root")), "roots")
        pu = parent.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        pv = parent.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        live = table(live.join(pu, "u").join(pv, "v")
                     .select(F.col("ru").alias("u"), F.col("rv").alias("v"))
                     .filter("u <> v").distinct(), "edges")
        if live.isEmpty():
            return roots


#: Buckets of at most so many nodes may be compared pair by pair.
FEW = 8
#: How often buckets are dealt into finer ones before what is left is compared pair by pair.
DEALS = 1


def _rooted(member: DataFrame, roots: DataFrame) -> DataFrame:
    """``band, node, busy, side, root, n, hub`` of the buckets that hold more than one component
    and, if they have sides, both of them."""
    own = member.join(roots, "node", "left") \
        .select("band", "node", "busy", "side", F.coalesce("root", "node").alias("root"))
    whole = own.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"),
                                    F.max(F.struct("busy", "node", "root")).alias("hub"),
                                    (F.min("side") + F.max("side")).alias("bare"))
    return own.join(whole.filter("low <> high and bare = 0").select("band", "n", "hub"), "band")


#: Sizes of differences in one class are within this ratio.
RATIO = 1.15


def refined(hubs: DataFrame, differences: Callable[[DataFrame], DataFrame], numerator: int,
            denominator: int) -> tuple[DataFrame, DataFrame]:
    """Finer buckets ``band, node, busy, side`` for the pairs that the hub of a bucket was no part of, and
    the pairs ``u, v`` of hub and node that the differences show to link.

    ``hubs``: ``hub, node, busy``; ``differences`` adds ``nh, nx`` (set sizes) and ``d`` (hashes of
    the elements in one of the two sets only) to ``hub, node`` pairs. Write t for the threshold,
    r = (1-t)/(1+t), and D(x) for the difference of x to the hub. The difference of linked sets
    a, b has at most k = |a|(1-t)/t elements (and r(|a|+|b|)), and it is that of D(a) and D(b).
    So |D(a)| and |D(b)| are at most k apart and share (|D(a)| + |D(b)| - k) / 2 elements at
    least. One of the two does not link with the hub, that is, has |D| > r(|x|+|hub|); as
    |D(a)| >= ||a|-|hub||, they share at least one element in any case. Linked nodes therefore
    meet at one of the rarest elements of their differences, up to the prefix which that
    overlap leaves, taken for each class of sizes of the other's difference. Copies that
    differ by edits of their own do not meet. A bucket names an element and two classes:
    ``side`` is -1 for a node of the smaller class that looks for the larger, 1 the other way,
    0 if they are one class. A pair has a node on each side (or both at 0); two of one side
    meet, if they can link, in the bucket of their own class, so a bucket with one side
    only is dropped and nodes of one side are not compared."""
    more, less = numerator + denominator, denominator - numerator
    nd, nh, nx, k, place = (F.col(c) for c in ("nd", "nh", "nx", "k", "place"))
    close = nd * more <= (nx + nh) * less
    twice = F.when(close, nd * more + (nh - nx) * less).otherwise(nd * more - (nx + nh) * less)
    least = F.greatest(F.lit(1), F.ceil(twice / (2 * more) - F.lit(1e-9)))
    found = differences(hubs.select("hub", "node")).withColumn("nd", F.size("d")).join(hubs, ["hub", "node"])
    each = table(found.select("hub", "node", "busy", "nd", least.alias("least"), close.alias("close"),
                              F.floor(nx * less / F.lit(numerator)).alias("k"), F.explode_outer("d").alias("element")),
                 "differences")
    shared = each.groupBy("hub", "element").agg(F.count("*").alias("often")).filter("often > 1 and element is not null")
    own = Window.partitionBy("hub", "node")
    rarity = F.row_number().over(own.orderBy("often", "element")) + F.col("nd") - F.count("*").over(own)
    near = each.join(shared, ["hub", "element"]).withColumn("place", rarity).filter("place <= nd - least + 1")

    def size_class(n: Column) -> Column:
        return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double") + F.lit(1e-6)) / F.lit(math.log(RATIO))).cast("int")

    # the other difference has nd - k elements at least; this place is in the prefix of up to
    # nd + k - 2 (place - 1)
    low, high = F.greatest(nd - k, F.lit(1)), nd + k - 2 * (place - 1)
    near = near.filter(high >= low)
    dealt = near.select("hub", "element", "node", "busy", size_class(nd).alias("mine"),
                        F.explode(F.sequence(size_class(low), size_class(high))).alias("other"))
    band = F.xxhash64("hub", "element", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.signum(F.col("mine") - F.col("other")).cast("int")
    return dealt.select(band.alias("band"), "node", "busy", side.alias("side")), each.filter("close").select(
        F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v")).distinct()


def linked(member: DataFrame, confirm: Callable[[DataFrame], DataFrame], differences: Callable[[DataFrame], DataFrame],
           numerator: int, denominator: int) -> DataFrame:
    """``node, root`` of the components that candidate buckets and ``confirm`` give.

    ``member``: ``band, node, busy`` rows of buckets (all on side 0); ``confirm`` keeps the true links of ``u, v``
    pairs. Every node of a bucket meets the bucket's busiest node, its hub. A bucket whose
    nodes then share a component is done; one of at most ``FEW`` nodes compares its pairs
    across components; a larger one (with those whose hubs are in the same component, under one hub) is dealt into finer buckets by what its nodes have and
    the hub has not, or the other way (:func:`refined`), which begin anew without that hub.
    The pairs across components that stand on opposite sides of a bucket after ``DEALS`` deals,
    which differ from the hubs in the same rare elements, are compared one by one. So no link between
    components is missed, and a bucket of like nodes is never expanded into its pairs."""
    spark = member.sparkSession
    member = member.withColumn("side", F.lit(0))
    seen, links = empty(spark, "u long, v long"), empty(spark, "u long, v long")
    roots, few, closer = empty(spark, "node long, root long"), None, None
    for deal in range(DEALS + 2):
        own = table(_rooted(member, roots), "rooted")
        met = own.filter("root <> hub.root").select(F.col("hub.node").alias("u"), F.col("node").alias("v"))
        if few is not None:
            met = met.union(few.alias("a").join(few.alias("b"), F.expr("a.band = b.band and a.root < b.root and a.side + b.side = 0"))
                            .select(F.col("a.node").alias("u"), F.col("b.node").alias("v")))
        met = met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        met = table(met.join(seen, ["u", "v"], "left_anti"), "met")
        found = not met.isEmpty()
        if found:
            seen = seen.union(met)
            links = links.union(table(confirm(met), "links"))
        if found or closer is not None:
            links = links if closer is None else links.union(closer)
            roots, closer = components(links), None
        left = table(_rooted(own.select("band", "node", "busy", "side"), roots).filter("n > 2"), "left")
        if left.isEmpty():
            break
        few = left.filter(F.col("n") <= (FEW if deal < DEALS else 2**62)).select("band", "node", "side", "root")
        # buckets whose hubs share a component share the busiest of those hubs
        open_ = left.filter(F.col("n") > FEW)
        bands = open_.select("band", "hub").distinct()
        chief = bands.groupBy(F.col("hub.root").alias("root")).agg(F.max(F.struct("hub.busy", "hub.node")).alias("chief"))
        led = bands.select("band", F.col("hub.root").alias("root")).join(chief, "root").select("band", "chief")
        hubs = open_.select("band", "node", "busy").join(led, "band").filter(F.col("node") != F.col("chief.node")) \
            .select(F.col("chief.node").alias("hub"), "node", "busy").distinct()
        hubs = table(hubs, "hubs") if deal < DEALS else None
        member = empty(spark, "band long, node long, busy long, side int")
        if hubs is not None and not hubs.isEmpty():
            made, closer = refined(hubs, differences, numerator, denominator)
            member = table(made, "refined")
    return roots
