"""Benchmark decontamination by pigeonhole edit matching.

A text and a test item are compared as lower-cased letters and digits with single blanks
between. An item with an error budget of ``k`` edits (``RATE`` of its length) is split into
``k + 1`` pieces: an occurrence within the budget leaves at least one piece intact, so
exact piece hits, found by one automaton for all pieces, are all the places to look. A hit is
verified outwards with Myers' bit-parallel distance: of any m neighbouring pieces in the
tree above the intact one, at most m - 1 edits may fall on them, so most chance hits end after
a few dozen characters and only the rest are compared with the whole item.

An item shorter than ``SHORTEST`` normalised characters has no error budget: it is found
verbatim, between word boundaries (scripts without blanks between words have none to ask for).

Items go out in blocks of at most ``BLOCK_CHARS`` characters and ``BLOCK_ITEMS`` items, and
the hits of a block are written before the next one is broadcast, so what is alive at once is
bounded; all rows of the corpus meet every block.

Cases: null or empty texts, and items that normalise to nothing, match nothing; an empty
benchmark leaves all documents clean; items that share an id (null is one) are one item with
several texts; repeated rows get equal results; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, ship, table

RATE = 0.1
SHORTEST = 40
BLOCK_CHARS, BLOCK_ITEMS = 4_000_000, 20_000
#: Characters of text worked through at once; neighbours overlap by the longest window.
STRETCH = 1 << 20


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


#: Characters of scripts without blanks between words.
UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u1950-\u1aaf\u1b00-\u1b7f\u2e80-\ua4cf\ua980-\ua9df\uaa60-\uaa7f\uf900-\ufaff\U00020000-\U0003ffff]")


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate) if len(item) >= SHORTEST else 0


def joined(left: str, right: str) -> bool:
    """Whether the two neighbouring characters stand inside one word."""
    return " " not in (left, right) and not UNSPACED.match(left) and not UNSPACED.match(right)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``errors + 1`` near-equal pieces."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def character_masks(item: str) -> dict[str, int]:
    at: dict[str, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    return at


def best_distance(item: str, text: str, at: dict[str, int] | None = None) -> int:
    """The least edit distance of ``item`` to any substring of ``text`` (Myers); ``at`` is
    ``character_masks(item)``."""
    m = len(item)
    if m == 0:
        return 0
    at = character_masks(item) if at is None else at
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = score
    for c in text:
        eq = at.get(c, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        plus = (down | ~(diagonal | up)) & full
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) & full             # a match may start anywhere: no carry into the first row
        minus = (minus << 1) & full
        up = (minus | ~(diagonal | plus)) & full
        down = plus & diagonal
        if score < best:
            best = score
    return best


class Matcher:
    """One block of items: an automaton of their pieces, and for every piece the groups of
    pieces above it."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(i, t, budget(t, rate)) for i, t in items]
        self.cuts = []
        self.masks: dict[tuple[int, int, int], tuple[str, dict[str, int]]] = {}
        self.reach = max((len(t) + 2 * e + 2 for _, t, e in self.items), default=0)
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, e) in enumerate(self.items):
            own = pieces(t, e)
            self.cuts.append([a for a, _ in own] + [len(t)])
            for j, (_, piece) in enumerate(own):
                found.setdefault(piece, []).append((k, j))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()

    def _group(self, k: int, low: int, high: int) -> tuple[str, dict[str, int]]:
        got = self.masks.get((k, low, high))
        if got is None:
            cuts = self.cuts[k]
            own = self.items[k][1][cuts[low]:cuts[high]]
            got = self.masks[k, low, high] = (own, character_masks(own))
        return got

    def verify(self, k: int, j: int, text: str, at: int) -> int | None:
        """The least distance of item ``k`` around a hit of its piece ``j`` at ``at``, or None
        where a group of pieces around the hit, or the item, needs too many edits."""
        cuts = self.cuts[k]
        count, size, low, high, d = len(cuts) - 1, 1, j, j + 1, 0
        while high - low < count:
            size *= 2
            new_low = j // size * size
            new = (new_low, min(new_low + size, count))
            if new == (low, high):
                continue
            low, high = new
            own, masks = self._group(k, low, high)
            errors = high - low - 1
            begin = at - (cuts[j] - cuts[low]) - errors
            d = best_distance(own, text[max(0, begin):begin + len(own) + 2 * errors], masks)
            if d > errors:
                return None
        return d

    def matches(self, text: str) -> dict[int, int]:
        """Item to its least distance in ``text``, where that is within its budget."""
        out: dict[int, int] = {}
        if not self.items:
            return out
        for begin in range(0, max(1, len(text)), STRETCH):
            part = text[max(0, begin - self.reach):begin + STRETCH + self.reach]
            done: set[tuple[int, int]] = set()
            for end, (size, owners) in self.automaton.iter(part):
                at = end + 1 - size
                for k, j in owners:
                    i = self.items[k][0]
                    start = at - self.cuts[k][j]
                    if out.get(i) == 0 or (k, start) in done:
                        continue
                    if len(self.items[k][1]) < SHORTEST and (
                            at and joined(part[at - 1], part[at]) or end + 1 < len(part) and joined(part[end], part[end + 1])
                            # at a cut, where the neighbour is not seen, the stretch beside it holds the item too
                            or not at and begin > self.reach or end + 1 == len(part) and begin + STRETCH + self.reach < len(text)):
                        continue
                    d = self.verify(k, j, part, at)
                    if d is not None:
                        out[i] = min(d, out.get(i, d))
                        done.add((k, start))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items, streamed to the driver a partition at a time, in bounded blocks."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), normalised(F.col(text_col)).alias("t")) \
        .filter(F.length("t") > 0).distinct()
    block, chars = [], 0
    for row in items.toLocalIterator():
        if block and (chars + len(row["t"]) > BLOCK_CHARS or len(block) >= BLOCK_ITEMS):
            yield block
            block, chars = [], 0
        block.append((row["i"], row["t"]))
        chars += len(row["t"])
    if block:
        yield block


KIND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()),
                                 T.StructField("distance", T.IntegerType())]))


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
              item_text: str = "text", rate: float = RATE) -> DataFrame:
    """``row, found``: the rows of ``docs`` and their matched items, array of (item_id, distance).

    A single block is matched where the rows stand. Of several, each writes its hits, by text,
    before the next is broadcast, and the rows fetch them."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    blocks = _blocks(benchmark, item_id, item_text)
    block, after = next(blocks, None), next(blocks, None)
    if block is None:
        return packed(docs, found=F.array().cast(KIND))
    if after is None:
        return packed(docs, found=_finder(spark.sparkContext.broadcast(block), rate, KIND)(normalised(text)))
    key = F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text), F.length(text))
    written = None
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        found = docs.select(key.alias("key"), _finder(shared, rate, KIND)(normalised(text)).alias("found"))
        part = table(found.filter(F.size("found") > 0).dropDuplicates(["key"]), "hits")
        shared.destroy()
        written = part if written is None else written.union(part)
        block, after = after, next(blocks, None)
    by_text = written.groupBy("key").agg(F.flatten(F.collect_list("found")).alias("found"))
    return packed(docs, key=key).join(by_text, "key", "left") \
        .select("row", F.coalesce("found", F.array().cast(KIND)).alias("found"))


def _finder(shared, rate: float, kind: T.DataType):
    made: list[Matcher] = []

    @F.pandas_udf(kind)
    def find(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Matcher(shared.value, rate))
        return pd.Series([[{"item_id": i, "distance": d} for i, d in made[0].matches(t).items()]
                          for t in texts], index=texts.index, dtype=object)

    return find


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """One row per document: ``doc_id, contaminated, n_items, item_ids, min_distance``."""
    rows = with_hits(docs, benchmark, text_col, item_id, item_text, rate) \
        .select(F.col("row").getField(id_col).alias("doc_id"), "found")
    ids = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["item_id"])))
    return rows.select("doc_id", (F.size("found") > 0).alias("contaminated"),
                       F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
                       F.array_min(F.transform("found", lambda x: x["distance"])).alias("min_distance"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                      rate: float = RATE) -> DataFrame:
    """``docs`` without the rows that hold a test item; columns unchanged."""
    return with_hits(docs, benchmark, text_col, rate=rate).filter(F.size("found") == 0).select("row.*")
