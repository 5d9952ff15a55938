"""Removal of repeated byte strings through a sparse suffix array.

A byte goes if a ``LENGTH``-byte string covering it also starts earlier (smaller id, or
the same document further left); matches never cross documents.

Not every suffix is moved: a string of ``LENGTH`` bytes contains its *anchor*, the leftmost
smallest hashed ``SEED``-byte token in it, so equal strings have equal anchors at equal
offsets, and suffixes at anchors (about 3 % of all positions) are enough for an exact answer.

1. Anchor tokens are counted over the corpus; only tokens that occur in two different texts
   or twice in one can matter. Copies of a whole text count once.
2. The suffixes at such anchors, with the bytes their strings need on both sides, are
   range-partitioned by their leading tokens with sampled splitters (equal tokens never
   part, so no comparison crosses a boundary but between unequal tokens). Each bucket sorts
   by multikey quicksort, eight bytes at a time, on the suffix and on the reversed prefix;
   common-prefix lengths then name every string exactly, and all but the first go. Tokens
   that a task meets ``OFTEN`` (periodic texts, common passages) are compared there the same
   way before the shuffle, and only suffixes with a string that is new to the task move on.
3. Tokens more frequent than ``HOT`` would fill a bucket; their strings are instead
   compared one by one by a 128-bit digest in a pre-aggregated grouping.
4. Every document unites its spans. A later copy of a whole text is covered in full.

Cases: null texts count as empty; texts shorter than ``LENGTH`` lose nothing; a null id
sorts first; rows with the same id and text are one document (equal results), rows with
the same id and other text are ordered by a hash of the text; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table, text_of
from .shingles import mix

LENGTH, SEED = 100, 32
SPAN = LENGTH - SEED + 1                # places of a token in a string
HOT = 20_000
#: A token met so often among the texts that a task holds at once is compared there first.
OFTEN = 8
BUCKET_ROWS = 100_000
FIRST_ID = -(2**63)
#: Bytes of text worked through at once.
STRETCH = 1 << 22


def _words(data: np.ndarray) -> np.ndarray:
    """The 8-byte little-endian word at every byte."""
    n = len(data) - 7
    return np.ndarray((n,), "<u8", data, strides=(1,)).copy()


def token_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``SEED``-byte token at every byte."""
    w = _words(data)
    n = len(data) - SEED + 1
    out = np.full(n, np.uint64(SEED))
    for k in range(0, SEED, 8):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w[k:k + n])
    return out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For one text: anchor positions, their token hashes, and the first and last start of
    the ``LENGTH``-byte strings that each anchor stands for."""
    if len(data) < LENGTH:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none
    found = []
    for a in range(0, len(data) - LENGTH + 1, STRETCH):
        part = data[a:a + STRETCH + LENGTH - 1]
        hashes = token_hashes(part)
        low = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        reach = 1
        while reach * 2 <= SPAN:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        low = np.minimum(low[:len(low) - (SPAN - reach)], low[SPAN - reach:])
        own = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        change = np.flatnonzero(np.diff(own)) + 1
        first = np.concatenate([[0], change])
        last = np.concatenate([change - 1, [len(own) - 1]])
        at = own[first]
        found.append((at + a, hashes[at], first + a, last + a))
    return tuple(np.concatenate(x) for x in zip(*found))


def _bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def _tokens(base: DataFrame) -> DataFrame:
    """``id, key, token, twice``: the distinct anchor tokens of each document."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text in frame["text"]:
                values, counts = np.unique(anchors(_bytes_of(text))[1], return_counts=True)
                out.append((values.view(np.int64), counts > 1))
            yield pd.DataFrame({"id": frame["id"], "key": frame["key"],
                                "tokens": [o[0] for o in out], "twice": [o[1] for o in out]})

    made = base.filter(F.octet_length("text") >= LENGTH).select("id", "key", "text").mapInPandas(
        work, "id long, key long, tokens array<bigint>, twice array<boolean>")
    return made.select("id", "key", F.explode(F.arrays_zip("tokens", "twice")).alias("t")) \
        .select("id", "key", F.col("t.tokens").alias("token"), F.col("t.twice").cast("int").alias("twice"))


def repeated_tokens(base: DataFrame) -> DataFrame:
    """``token, n``: anchor tokens of two texts, or twice in one; ``n`` counts documents."""
    return _tokens(base).groupBy("token").agg(
        F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"), F.max("twice").alias("t")) \
        .filter("a <> b or t = 1").select("token", "n")


def _suffixes(wanted: DataFrame, hot: bool) -> DataFrame:
    """Suffix rows at the wanted anchors of each document. Plain: leading tokens ``w0, w1``
    (order-preserving longs), ``after`` and ``before`` (reversed) bytes; spans that are found
    on the way have ``low`` -1 and their length in ``high``. Hot: one row for each string with
    its digest."""

    def plain(frame: pd.DataFrame) -> pd.DataFrame:
        rows, names = [], []
        for i, key, text, tokens in zip(frame["id"], frame["key"], frame["text"], frame["tokens"]):
            raw = text.encode()
            at, hashes, first, last = anchors(np.frombuffer(raw, np.uint8))
            take = np.isin(hashes.view(np.int64), np.asarray(tokens, np.int64))
            names.append(hashes[take])
            for p, a, b in zip(at[take].tolist(), first[take].tolist(), last[take].tolist()):
                rows.append((i, key, p, p - b, p - a, raw[p:b + LENGTH], raw[a:p][::-1]))
        made = pd.DataFrame(rows, columns=["id", "key", "at", "low", "high", "after", "before"])
        if len(made):
            _, number, count = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
            often = count[number] >= OFTEN
            if often.any():
                spans_, new = repeated_spans(made[often])
                made = pd.concat([made[~often], new, merged_spans(spans_)], ignore_index=True)
        lead = np.frombuffer(b"".join(x[:16].ljust(16, b"\0") for x in made["after"]), ">i8").reshape(-1, 2) \
            ^ np.int64(FIRST_ID)
        return made.assign(w0=lead[:, 0].astype(np.int64), w1=lead[:, 1].astype(np.int64))

    def single(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for i, key, text, tokens in zip(frame["id"], frame["key"], frame["text"], frame["tokens"]):
            raw = text.encode()
            _, hashes, first, last = anchors(np.frombuffer(raw, np.uint8))
            take = np.isin(hashes.view(np.int64), np.asarray(tokens, np.int64))
            for a, b in zip(first[take].tolist(), last[take].tolist()):
                rows += [(i, key, s, hashlib.blake2b(raw[s:s + LENGTH], digest_size=16).digest())
                         for s in range(a, b + 1)]
        return pd.DataFrame(rows, columns=["id", "key", "at", "digest"])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size = 0
            begin = 0
            for k, text in enumerate(frame["text"]):     # a few megabytes of text at a time
                size += len(text)
                if size > STRETCH or k == len(frame) - 1:
                    yield (single if hot else plain)(frame.iloc[begin:k + 1])
                    begin, size = k + 1, 0

    schema = "id long, key long, at long, digest binary" if hot else \
        "id long, key long, at long, low int, high int, after binary, before binary, w0 long, w1 long"
    return wanted.mapInPandas(work, schema)


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Row order of a byte matrix by multikey quicksort on 8-byte characters: each round
    sorts by the next character only rows that are still equal to another."""
    words = rows.view(">u8").astype(np.uint64)
    n = len(words)
    order = np.argsort(words[:, 0], kind="stable")
    group = np.zeros(n, np.int64)
    group[1:] = np.cumsum(words[order[1:], 0] != words[order[:-1], 0])
    for d in range(1, words.shape[1]):
        sizes = np.bincount(group)
        tied = np.flatnonzero(sizes[group] > 1)
        if not len(tied):
            break
        own = words[order[tied], d]
        sub = np.lexsort((own, group[tied]))
        order[tied] = order[tied[sub]]
        step = np.zeros(n, bool)
        step[1:] = group[1:] != group[:-1]
        own = own[sub]
        step[tied[1:]] |= (own[1:] != own[:-1])
        group = np.cumsum(step)
    return order


def _classes(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each row in sorted order, common prefix of each sorted row with the one before)."""
    width += -width % 8
    matrix = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width)
    order = multikey_order(matrix)
    sorted_ = matrix[order]
    differ = sorted_[1:] != sorted_[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, np.concatenate([[0], common]).astype(np.int64)


def repeated_spans(bucket: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(``id, key, begin, stop``: byte spans of strings in the bucket that start earlier too;
    the rows with a string that is the first of its kind here)."""
    bucket = bucket.sort_values(["id", "key", "at"], kind="stable").reset_index(drop=True)
    bucket = bucket.drop_duplicates(["id", "key", "at", "low", "high"], ignore_index=True)   # repeated rows
    n = len(bucket)
    rank_a, common_a = _classes(bucket["after"].tolist(), LENGTH)
    rank_b, common_b = _classes(bucket["before"].tolist(), SPAN)
    low, high = bucket["low"].to_numpy(), bucket["high"].to_numpy()
    again = np.zeros((n, SPAN + 2), np.int16)         # a frame of zeros around the offsets
    for offset in range(SPAN):
        own = np.flatnonzero((low <= offset) & (offset <= high))
        if len(own) < 2:
            continue
        after = np.cumsum(common_a < LENGTH - offset)[rank_a[own]]
        before = np.cumsum(common_b < offset)[rank_b[own]] if offset else np.zeros(len(own), np.int64)
        _, first = np.unique(after * (n + 1) + before, return_index=True)
        again[own, offset + 1] = 1
        again[own[first], offset + 1] = 0
    edge = np.diff(again, axis=1)
    row, a = np.nonzero(edge == 1)                    # offsets a .. b - 1 repeat, row by row
    _, b = np.nonzero(edge == -1)
    at = bucket["at"].to_numpy()[row]
    found = pd.DataFrame({"id": bucket["id"].to_numpy()[row], "key": bucket["key"].to_numpy()[row],
                          "begin": at - (b - 1), "stop": at - a + LENGTH})
    return found, bucket[again.sum(axis=1) < high - low + 1]


def merged_spans(found: pd.DataFrame) -> pd.DataFrame:
    """Spans of a task, united within each document, in the shape of suffix rows."""
    found = found.sort_values(["id", "key", "begin"], ignore_index=True)
    ids, keys, begin, stop = (found[c].to_numpy() for c in ("id", "key", "begin", "stop"))
    rows: list[list] = []
    for i, k, a, b in zip(ids.tolist(), keys.tolist(), begin.tolist(), stop.tolist()):
        if rows and rows[-1][0] == i and rows[-1][1] == k and a <= rows[-1][3]:
            rows[-1][3] = max(rows[-1][3], b)
        else:
            rows.append([i, k, a, b])
    # spread over the buckets by their place; a bucket passes them on
    return pd.DataFrame([(i, k, a, -1, b - a, ((i * 1_000_003 + a) % 2**64).to_bytes(8, "big"), b"")
                         for i, k, a, b in rows], columns=["id", "key", "at", "low", "high", "after", "before"])


def _bucket_spans(suffixes: DataFrame, buckets: int) -> DataFrame:
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        bucket = pd.concat(parts, ignore_index=True)
        done = bucket[bucket["low"] < 0]
        yield pd.DataFrame({"id": done["id"], "key": done["key"], "begin": done["at"], "stop": done["at"] + done["high"]})
        if len(done) < len(bucket):
            yield repeated_spans(bucket[bucket["low"] >= 0])[0]

    return suffixes.repartitionByRange(buckets, "w0", "w1") \
        .mapInPandas(work, "id long, key long, begin long, stop long")


def _hot_spans(strings: DataFrame) -> DataFrame:
    first = strings.groupBy("digest").agg(F.min(F.struct("id", "key", "at")).alias("first"))
    return strings.join(first, "digest").filter(F.struct("id", "key", "at") > F.col("first")) \
        .select("id", "key", F.col("at").alias("begin"), (F.col("at") + LENGTH).alias("stop"))


def _cut(base: DataFrame) -> DataFrame:
    """Unite the spans of each document and cut them out."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, spans, copy in zip(frame["text"], frame["spans"], frame["copy"]):
                raw = text.encode()
                if copy and len(raw) >= LENGTH:
                    merged = [(0, len(raw))]
                else:
                    merged = []
                    own = [] if copy or spans is None else spans
                    for s in sorted((s["begin"], s["stop"]) for s in own):
                        if merged and s[0] <= merged[-1][1]:
                            merged[-1] = (merged[-1][0], max(merged[-1][1], s[1]))
                        else:
                            merged.append(s)
                digest, at = hashlib.sha256(), 0
                for a, b in merged:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in merged), len(merged), digest.hexdigest()))
            made = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            made.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield made

    return base.mapInPandas(
        work, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents as ``doc_id, id, key, text``; repeated spans as ``id, key, begin, stop, copy``)."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("string").alias("doc_id"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID)).alias("id"),
                       text_of(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    narrow = table(base.select("id", "key", F.sha2("text", 256).alias("sha")).distinct(), "texts")
    first = narrow.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = table(narrow.join(first, "sha").filter("id > first").select("id", "key"), "copies")
    tokens = table(repeated_tokens(base), "tokens")
    own = _tokens(base).join(tokens, "token").join(copies, ["id", "key"], "left_anti")
    wanted = table(own.groupBy("id", "key").agg(
        F.collect_list(F.when(F.col("n") <= HOT, F.col("token"))).alias("plain"),
        F.collect_list(F.when(F.col("n") > HOT, F.col("token"))).alias("hot")), "wanted")
    count = wanted.agg(F.coalesce(F.sum(F.size("plain")), F.lit(0)), F.coalesce(F.sum(F.size("hot")), F.lit(0))).first()
    texts = base.select("id", "key", "text")
    found = copies.select("id", "key", F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("stop"),
                          F.lit(True).alias("copy"))
    for column, hot in (("plain", False), ("hot", True)):
        if not count[int(hot)]:
            continue
        rows = wanted.filter(F.size(column) > 0).select("id", "key", F.col(column).alias("tokens"))
        suffixes = _suffixes(texts.join(rows, ["id", "key"]).select("id", "key", "text", "tokens"), hot)
        part = _hot_spans(suffixes) if hot else _bucket_spans(suffixes, 1 + count[0] // BUCKET_ROWS)
        found = found.union(table(part, "spans").withColumn("copy", F.lit(False)))
    return base, found


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    base, found = spans(docs, id_col, text_col)
    own = found.groupBy("id", "key").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"),
                                         F.max("copy").alias("copy"))
    rows = base.join(own, ["id", "key"], "left") \
        .select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))
    return _cut(rows).withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
