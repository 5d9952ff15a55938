"""Near-duplicate documents by circulant MinHash.

A document's set holds its distinct ``WIDTH``-word shingles. Two permutations make every
signature coordinate: one scatters the shingles on a ring of 2^32 places, the other is
applied after a circular shift by the coordinate's number, and the minimum is the
coordinate. ``BANDS`` bands of ``ROWS`` coordinates give candidates (a pair at the threshold
of 0.85 is missed with probability 4e-7); confirmation is exact, on the full sets.

Scale: documents with equal sets are one node from the start, so thousands of copies cost
one node. Within a bucket every node meets only the bucket's busiest node, and confirmed pairs
join components. A bucket that still holds more than one is dealt anew by the shingles in
which its nodes differ from that hub, rarest first, so no link is lost and no bucket is
expanded into all its pairs (see ``common.linked``). Buckets and hubs pre-aggregate; set joins
are equi-joins that adaptive execution can split.

Cases: null or word-less texts have an empty set, link with nothing, and stay; rows that
repeat an id with the same text share one row's result; a null id takes part, but is
smaller than no id (``component_id`` is the smallest non-null id, or null); other columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, linked, packed, ship, table
from .shingles import groups_of, mix, shingle_sets

WIDTH, BANDS, ROWS = 5, 25, 5
NUMERATOR, DENOMINATOR = 85, 100
#: Shingles of a set hashed at once per coordinate block.
BLOCK = 1 << 14


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a non-empty set: min over the set of pi(sigma(x) + k * step)."""
    sigma = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    shift = (np.arange(1, size + 1, dtype=np.uint64) * np.uint64(2654435769)).astype(np.uint32)
    out = np.full(size, np.uint32(0xFFFFFFFF))
    for a in range(0, len(sigma), BLOCK):
        part = sigma[a:a + BLOCK]
        step = max(1, (1 << 17) // len(part))
        for k in range(0, size, step):
            x = part[None, :] + shift[k:k + step, None]
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x7FEB352D)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x846CA68B)
            np.minimum(out[k:k + step], x.min(axis=1), out=out[k:k + step])
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    grid = sig.reshape(bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for k in range(rows):
        key = mix(key * np.uint64(31) + grid[:, k])
    return key.view(np.int64)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole set, as two signed longs."""
    order = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    a = mix(np.array([np.bitwise_xor.reduce(mix(shingles + order)) + np.uint64(len(shingles))]))
    b = mix(np.array([np.sum(mix(shingles ^ (order << np.uint64(20))), dtype=np.uint64)]))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, node, check, bands, sig``: one narrow row per document."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, rows = frame["text"].tolist(), []
            for a, b in groups_of(texts):
                for own in shingle_sets(texts[a:b], width):
                    if len(own):
                        sig = signature(own)
                        rows.append((len(own), *_digest(own), band_keys(sig), sig.astype(np.uint8).tobytes()))
                    else:
                        rows.append((0, None, None, None, None))
            made = pd.DataFrame(rows, columns=["n_shingles", "node", "check", "bands", "sig"])
            for c in ("node", "check"):
                made[c] = pd.array([r[1 if c == "node" else 2] for r in rows], dtype="Int64")
            made.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield made

    return id_and_text(docs, id_col, text_col).mapInPandas(
        work, "doc_id string, n_shingles long, node long, check long, bands array<bigint>, sig binary") \
        .withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``node, shingles`` (packed sorted 64-bit hashes) of the wanted nodes; ``nodes`` names
    one document of each."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, rows = frame["text"].tolist(), []
            for a, b in groups_of(texts):
                rows += [(_digest(own)[0], own.tobytes()) for own in shingle_sets(texts[a:b], width) if len(own)]
            yield pd.DataFrame(rows, columns=["node", "shingles"])

    ship(docs.sparkSession)
    wanted = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .join(nodes.select(F.col("doc_id").alias("_want")).distinct(),
              F.col("_id").eqNullSafe(F.col("_want")), "left_semi")
    return wanted.select("text").mapInPandas(work, "node long, shingles binary") \
        .join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


@F.pandas_udf(T.DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
    return pd.Series((x == y).mean(axis=1))


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), True))
                      for x, y in zip(a, b)], dtype="int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _either(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([np.setxor1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), True) for x, y in zip(a, b)], dtype=object)


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``hub, node, nh, nx, d``: the sizes of both sets and the shingles in one of them only."""
    a = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("sh"))
    both = pairs.join(sets.select("node", F.col("shingles").alias("sx")), "node").join(a, "hub")
    return both.select("hub", "node", (F.octet_length("sh") / 8).cast("long").alias("nh"),
                       (F.octet_length("sx") / 8).cast("long").alias("nx"), _either("sh", "sx").alias("d"))


def similar_enough(pairs: DataFrame, nodes: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose signatures agree on at least the
    threshold less 0.25 (more than six standard deviations below it)."""
    side = nodes.select("node", "n_shingles", "sig")
    a = side.select(F.col("node").alias("u"), F.col("n_shingles").alias("nu"), F.col("sig").alias("su"))
    b = side.select(F.col("node").alias("v"), F.col("n_shingles").alias("nv"), F.col("sig").alias("sv"))
    return pairs.join(a, "u").join(b, "v") \
        .filter(F.least("nu", "nv") * denominator >= F.greatest("nu", "nv") * numerator) \
        .filter(_agreement("su", "sv") >= numerator / denominator - 0.25).select("u", "v")


def confirmed(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs with denominator * |intersection| >= numerator * |union|, on full sets. The small
    side of a hub's pairs is fetched first, so the hub's set is joined where the pairs meet."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    both = pairs.join(b, "v").join(a, "u").withColumn("common", _common("su", "sv"))
    union = F.octet_length("su") / 8 + F.octet_length("sv") / 8 - F.col("common")
    return both.filter(F.col("common") * denominator >= union * numerator).select("u", "v")


def linked_nodes(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int,
                 numerator: int, denominator: int) -> DataFrame:
    """``node, root`` for nodes with at least one confirmed link."""
    member = nodes.select("node", F.explode("bands").alias("band"))
    sizes = member.groupBy("band").count().filter("count > 1")
    member = table(member.join(sizes, "band").select("band", "node", F.col("count").alias("size")), "buckets")
    busy = member.groupBy("node").agg(F.sum("size").alias("busy"))
    wanted = table(busy.join(nodes.select("node", "doc_id"), "node"), "wanted")
    sets = table(full_sets(docs, wanted, id_col, text_col, width), "sets")
    member = table(member.join(wanted.select("node", "busy"), "node").select("band", "node", "busy"), "members")
    return linked(member, lambda pairs: confirmed(
        similar_enough(pairs, nodes, numerator, denominator), sets, numerator, denominator),
        lambda pairs: differences(pairs, sets), numerator, denominator)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``. Documents link when
    denominator * |intersection| >= numerator * |union| of their shingle sets."""
    rows = table(sketches(docs, id_col, text_col, width), "sketches")
    nodes = table(rows.filter("n_shingles > 0").groupBy("node", "check", "n_shingles")
                  .agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"),
                       F.first("sig").alias("sig")), "nodes")
    roots = linked_nodes(docs, nodes, id_col, text_col, width, numerator, denominator)
    rooted = nodes.select("node", "doc_id").join(roots, "node", "left") \
        .select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    return rows.select("doc_id", "n_shingles", "node").join(named, "node", "left") \
        .select("doc_id", "n_shingles",
                F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
                .alias("component_id")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
              numerator: int = 80, denominator: int = 100) -> DataFrame:
    """``docs`` with the smallest id of each near-duplicate component; columns unchanged."""
    kept = near_components(docs, id_col, text_col, width, numerator, denominator).filter("kept") \
        .select("doc_id").distinct()
    return packed(docs, id=F.col(id_col)).join(kept, F.col("id").eqNullSafe(F.col("doc_id")), "left_semi") \
        .select("row.*")
