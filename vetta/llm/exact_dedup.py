"""Exact de-duplication by content-defined chunk recipes (DataFrame functions only).

A text is cut after the first newline or full stop that follows at least ``MIN_CHUNK``
characters (hard cut at ``MAX_CHUNK``), so an edit moves only the cuts near it. Each
distinct chunk crosses the network once, to prove that its 64-bit identifier names one
text; after that documents are compared by their ordered identifier lists, about 2 % of
the text, and no document moves whole.

Cases: a null text counts as empty (all empty texts are one group); a null id sorts below
every other id; rows that repeat id and text each get a row and share ``kept``, and
:func:`drop_exact` leaves one of them; other columns are never read, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, packed, table, text_of

MIN_CHUNK, MAX_CHUNK = 256, 2048


def chunks(text: Column, shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> Column:
    """Content-defined pieces whose concatenation is the whole text."""
    return F.regexp_extract_all(
        text, F.lit(rf"(?s).{{{shortest},{longest}}}?[\n.]|.{{1,{longest}}}"), F.lit(0))


def _identifiers(pieces: Column) -> Column:
    return F.transform(pieces, lambda c: F.xxhash64(c))


def clashing_identifiers(texts: DataFrame) -> DataFrame:
    """Identifiers that name more than one chunk text (``text`` normalised): normally none."""
    piece = texts.select(F.explode(chunks(F.col("text"))).alias("chunk"))
    distinct = piece.select(F.xxhash64("chunk").alias("id"), "chunk").distinct()
    return distinct.groupBy("id").count().filter("count > 1").select("id")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_sha256, recipe, exact``: the verified identifier list of every row.

    ``exact`` is null but for documents with a chunk whose identifier clashes; those carry
    the chunk texts themselves, so equal (recipe, exact) means equal text."""
    base = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text_of(text_col)).alias("text"))
    clashes = table(clashing_identifiers(base), "clashes")
    listed = base.select("doc_id", "text", _identifiers(chunks(F.col("text"))).alias("recipe"))
    exact = F.lit(None).cast("array<string>")
    if not clashes.isEmpty():
        listed = listed.withColumn("row", F.xxhash64("recipe"))
        touched = listed.select("row", F.explode(F.array_distinct("recipe")).alias("id")) \
            .join(clashes, "id", "left_semi").select("row").distinct()
        listed = listed.join(touched.withColumn("touched", F.lit(True)), "row", "left")
        exact = F.when(F.col("touched"), chunks(F.col("text")))
    return table(listed.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "recipe",
                               exact.alias("exact")), "recipes")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The row with the largest id of each group of equal texts stays. Group sizes pre-aggregate
    before the shuffle; the join back carries identifier lists only, and adaptive execution
    splits the partition of a hot group."""
    rows = recipes(docs, id_col, text_col)
    key = ["recipe", "exact"]
    groups = rows.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    on = (F.col("r.recipe") == F.col("g.recipe")) & F.col("r.exact").eqNullSafe(F.col("g.exact"))
    return rows.alias("r").join(groups.alias("g"), on).select(
        "r.doc_id", "g.keep_id", "g.group_size",
        F.col("r.doc_id").eqNullSafe(F.col("g.keep_id")).alias("kept"), "r.text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns unchanged."""
    kept = exact_groups(docs, id_col, text_col).filter("kept") \
        .groupBy("doc_id", "text_sha256").agg(F.count("*").alias("same"))
    rows = packed(docs, id=F.col(id_col), sha=F.sha2(ascii_lower(text_of(text_col)), 256))
    stay = rows.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256")))
    again = stay.filter("same > 1").dropDuplicates(["id", "sha"])
    return stay.filter("same = 1").select("row.*").unionByName(again.select("row.*"))
