"""Fuzzy line de-duplication by MinHash (DataFrame functions only).

A line is its set of character shingles: ``WIDTH`` characters from every word start, from
places inside longer runs that the content picks (after an ``ANCHOR`` within ``STEP``
characters, else the next character), and from every character of scripts without word breaks
(Thai, Lao, Tibetan, Myanmar, Khmer and their like, and all from U+2E80). So an inserted
character changes only the shingles around it.
(Shingles at all positions cost several times the time budget in this form, see the README.)
The hashes of a line are sorted once, as places on a ring; a band is the ``ROWS`` hashes that
follow a fixed point of the ring, ``ROWS`` successive minima of one permutation, so two large
sets of similarity s agree on it with probability near s^ROWS. ``BANDS`` bands give candidates.
On small sets the bands depend on each other, so a pair with a set of at most ``SMALL`` shingles
is found exactly, by prefixes: sets that reach the threshold share three hashes among the
``n - ceil(n * threshold) + 3`` smallest of either (sets of up to three are equal, at 0.75 and more), so all
triples of those are keys. Exact Jaccard similarity of the full shingle sets (64-bit hashes)
confirms the candidates, and distributed union-find keeps one line of each component: the one that occurs
first (smallest document, then position).

Scale: equal lines are one node from the start (a line with a third of all occurrences is
pre-aggregated), so one text of each line crosses the network; occurrences travel as 64-bit
hashes.

Cases: blank lines and null texts are structure and stay; a null id comes before every other.
Rows that repeat id and text are judged alike; of rows that share an id (or have none) and
differ in text each loses its own lines only, and a line that stands at the same position
in several of them counts as one occurrence and stays in each. A very long line is one set
of shingles, at about 30 bytes of memory a character. Other columns are never read.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import linked, packed, table, text_of

WIDTH, STEP, BANDS, ROWS = 10, 8, 12, 4
NUMERATOR, DENOMINATOR = 80, 100
#: Fixed points on the ring of signed 64-bit hashes, ascending.
POINTS = [int(-(2**63) + (2 * j + 1) * 2**63 // BANDS) for j in range(BANDS)]
#: A character of a run: U+0021 to U+2E7F without the scripts there that are written without blanks
#: between words (0E00-109F, 1780-17FF, 1950-1AAF, 1B00-1B7F). The common range is tried first, by itself;
#: written as an intersection, this and the class before an anchor took nine times the matching time.
RUN = r"[\x21-\x{DFF}[\x{10A0}-\x{177F}\x{1800}-\x{194F}\x{1AB0}-\x{1AFF}\x{1B80}-\x{2E7F}]]"
ANCHOR = "dltDLT149"
#: A step through the line and, captured ahead, the shingle that starts it. A step is the end of
#: a run (at most STEP characters, and the blanks after it), or the part of a longer run up to
#: the next anchor, or one character: of a run without an anchor near, or of an unspaced script.
SHINGLE = (rf"(?s)(?=(.{{1,{WIDTH}}}))(?:{RUN}{{1,{STEP}}}+(?!{RUN})\s*+"
           rf"|[^\x00-\x20\x{{250}}-\x{{10FFFF}}{ANCHOR}]{{0,{STEP - 1}}}+[{ANCHOR}]|{RUN}|\S\s*+|\s++)")
FIRST_ID = -(2**63)
#: Sets of at most so many shingles have an exact candidate route.
SMALL = 19


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, own, at, line`` of all lines that are not blank (``own``: a hash of the text, as ids may
    repeat)."""
    lines = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID)).alias("id"),
                        F.xxhash64(text_of(text_col)).alias("own"),
                        F.posexplode_outer(F.split(text_of(text_col), "\n")).alias("at", "line"))
    return lines.filter(F.trim("line") != "")


def place(id_: Column, at: Column) -> Column:
    """(document, position) as one number, so that its minimum pre-aggregates in a hash table."""
    return id_.cast("decimal(20,0)") * F.lit(Decimal(2**32)) + at


def shingles(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(line, F.lit(SHINGLE), F.lit(1)))


def hashes(line: Column) -> Column:
    """The 64-bit hashes of the line's shingles, each once."""
    steps = F.regexp_extract_all(line, F.lit(SHINGLE), F.lit(1))
    return F.array_distinct(F.transform(steps, lambda s: F.xxhash64(s)))


def band_keys(lines: DataFrame, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """``node, bands`` of the lines: the hashes that follow each fixed point, cyclically, of
    sets of more than ``SMALL``; prefix triples of sets that can reach the threshold with a
    small one (so some have both).

    Where the points stand is written out, which compiles to loops over plain numbers; the
    bands are made in one higher-order function, as both written out make a method too long
    for the compiler. There, hashes are named one by one: ``slice`` would copy the whole set."""
    hashed = lines.select("node", F.sort_array(hashes(F.col("line"))).alias("h"))
    ring = hashed.select("node", "h", F.concat("h", F.slice("h", 1, ROWS)).alias("around"),
                         F.sort_array(F.concat("h", F.array(*[F.lit(p) for p in POINTS]))).alias("ring"))
    stands = ring.select("node", "h", "around", F.array(*[F.array_position("ring", F.lit(p)) for p in POINTS]).alias("stands"))

    def band(at: Column, j: Column) -> Column:
        # where a point stands among the sorted hashes = how many are smaller
        start = ((at - (j + 1)) % F.size("h")).cast("int")
        return F.xxhash64(j, *[F.get("around", start + k) for k in range(ROWS)])

    reach = SMALL * denominator // numerator
    prefix = [n + 3 - -(-n * numerator // denominator) for n in range(reach + 1)]
    # ordered by the last place, so the triples of a shorter prefix come first
    triples = [(a, b, c) for c in range(max(prefix)) for b in range(c) for a in range(b)]
    count = [0] * 4 + [min(n, m) * (min(n, m) - 1) * (min(n, m) - 2) // 6 for n, m in enumerate(prefix)][4:]
    n = F.size("h")

    def triple(t: Column) -> Column:
        return F.xxhash64(F.lit("triple"), *[F.get(F.col("h"), F.get(t, F.lit(k))) for k in range(3)])

    none = F.array().cast("array<bigint>")
    rings = F.when(n > SMALL, F.transform("stands", band)).otherwise(none)
    some = F.slice(F.lit([list(t) for t in triples]), F.lit(1), F.get(F.lit(count), n))
    exact = F.when(n.between(1, 3), F.array(F.xxhash64(F.lit("whole"), F.col("h")))) \
        .when(n.between(4, reach), F.transform(some, triple)).otherwise(none)
    return stands.select("node", F.concat(exact, rings).alias("bands"))


def confirmed(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold. (Spark moves the filter below the
    selection and computes what it names for each mention, so it names the intersection once.)"""
    a = sets.select(F.col("node").alias("u"), F.col("h").alias("hu"))
    b = sets.select(F.col("node").alias("v"), F.col("h").alias("hv"))
    common = F.size(F.array_intersect("hu", "hv"))
    return pairs.join(a, "u").join(b, "v") \
        .filter(common * (denominator + numerator) >= (F.size("hu") + F.size("hv")) * numerator).select("u", "v")


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``hub, node, nh, nx, d``: the sizes of both sets and the hashes of the shingles in one only."""
    a = sets.select(F.col("node").alias("hub"), F.col("h").alias("hh"))
    both = pairs.join(sets.select("node", F.col("h").alias("hx")), "node").join(a, "hub")
    return both.select("hub", "node", F.size("hh").alias("nh"), F.size("hx").alias("nx"),
                       F.concat(F.array_except("hh", "hx"), F.array_except("hx", "hh")).alias("d"))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """``node, first``: for every line text that occurs more than once or has a near
    duplicate, the place of the one occurrence that stays."""
    seen = occurrences(docs, id_col, text_col)
    lines = table(seen.groupBy("line").agg(F.min(place(F.col("id"), F.col("at"))).alias("first"),
                                           F.count("*").alias("n"))
                  .select(F.xxhash64("line").alias("node"), "line", "first", "n"), "lines", "zstd")
    keyed = table(band_keys(lines, numerator, denominator), "bands")
    # outer: for a plain explode Spark infers a filter, and would compute the bands again in it
    bands = keyed.select("node", F.explode_outer("bands").alias("band"))
    # a band names its number too, so a line has it once, and the count alone tells
    shared = bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    # hash joins: the short side is one row a band or line, the long one need not be sorted
    member = table(bands.join(shared.hint("shuffle_hash"), "band"), "buckets")
    busy = member.groupBy("node").agg(F.sum("size").alias("busy"))
    # the sets are made once for a candidate, not for each of its pairs
    sets = table(lines.join(busy.hint("shuffle_hash"), "node").select("node", hashes(F.col("line")).alias("h")), "candidates")
    roots = linked(member.join(busy, "node").select("band", "node", "busy"),
                   lambda pairs: confirmed(pairs, sets, numerator, denominator),
                   lambda pairs: differences(pairs, sets), numerator, denominator)
    rooted = lines.select("node", "first", "n").join(roots, "node", "left") \
        .filter("n > 1 or root is not null").select("node", "first", F.coalesce("root", "node").alias("root"))
    stay = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return table(rooted.select("node", "root").join(stay, "root").select("node", "first").distinct(), "stay")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """``id, own, dropped``: ``(at, keep_id)`` of the lines that go, for texts that lose any:
    their positions and the documents in which the lines that stand for them stay."""
    stay = duplicate_lines(docs, id_col, text_col, numerator, denominator)
    own = occurrences(docs, id_col, text_col).select("id", "own", "at", F.xxhash64("line").alias("node"))
    gone = own.join(stay.hint("shuffle_hash"), "node").filter(place(F.col("id"), F.col("at")) != F.col("first"))
    keep = F.floor(F.col("first") / F.lit(Decimal(2**32))).cast("long")
    return gone.groupBy("id", "own").agg(F.sort_array(F.collect_set(F.struct(
        "at", F.nullif(keep, F.lit(FIRST_ID)).alias("keep_id")))).alias("dropped"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, dropped, keep_ids`` (positions from
    0 of the lines that go, and for each the document in which its component's line stays)."""
    none = F.array().cast("array<struct<at:int,keep_id:bigint>>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID)).alias("id"),
                       F.xxhash64(text_of(text_col)).alias("own"),
                       F.size(F.split(text_of(text_col), "\n")).cast("long").alias("n_lines"))
    found = rows.join(dropped_lines(docs, id_col, text_col), ["id", "own"], "left") \
        .withColumn("dropped", F.coalesce("dropped", none))
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"),
                        F.col("dropped.at").alias("dropped"), F.col("dropped.keep_id").alias("keep_ids"))


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that go cut from the text; columns unchanged, null texts kept."""
    rows = packed(docs, id=F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID)), own=F.xxhash64(text_of(text_col)),
                  text=F.col(text_col))
    joined = rows.join(dropped_lines(docs, id_col, text_col), ["id", "own"], "left")
    left = F.filter(F.split("text", "\n"), lambda line, at: ~F.array_contains("dropped.at", at))
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.withColumn("row", F.col("row").withField(text_col, text)).select("row.*")
