"""Byte-level BPE encoding and decoding without a regex.

Pre-tokenisation is vectorised. Each code point maps to a class (space, letter, number,
other). Reading the pattern as an automaton, the transition function of a character is a
constant (its class) everywhere but inside a contraction, and a contraction is decided by
three characters; so the prefix composition of transition functions, an associative scan,
collapses to the last run start (a running maximum), and every boundary is a comparison of
shifted class arrays. The slices feed a cache of merged pieces; byte offsets of the tokens
are kept, and decoding gathers the bytes of each id from one flat table.

Cases: a null text counts as empty (0 tokens); a text longer than ``SEGMENT`` characters is
worked through in segments cut where a space follows a non-space, which is always a
boundary, so memory follows the segment and not the text; repeated rows get equal results;
other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, ship

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
SEGMENT = 1 << 20
CACHED_PIECES = 400_000
BLANK = frozenset([*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                   0x202F, 0x205F, 0x3000])   # Unicode White_Space


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point, from the Unicode general category."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)),
                      np.uint8, sys.maxunicode + 1)
    out[list(BLANK)] = SPACE
    return out


def boundaries(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Token start positions in the concatenated texts ``codes``; ``starts`` are text starts
    of non-empty texts."""
    n = len(codes)
    if n == 0:
        return np.empty(0, np.int64)
    cls = class_table()[codes]
    first = np.zeros(n, bool)
    first[starts] = True
    run = first.copy()
    run[1:] |= cls[1:] != cls[:-1]
    blank = cls == SPACE
    after_blank = np.zeros(n, bool)          # a plain space just before, in the same text
    after_blank[1:] = (codes[:-1] == 32) & ~first[1:]
    cut = run & (blank | ~after_blank)
    # the last blank before a non-blank of the same text starts a token of its own
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~first[1:]
    cut |= last
    quotes = np.flatnonzero((codes == 39) & run & ~after_blank)
    if len(quotes):
        text_of = np.searchsorted(starts, quotes, "right")
        limit = np.append(starts, n)[text_of]
        padded = np.append(codes, np.zeros(2, codes.dtype))
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & (quotes + 1 < limit)
        long = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        long &= quotes + 2 < limit
        hit = short | long
        at, size = quotes[hit], np.where(short[hit], 2, 3)
        cut[at + 1] = False
        ends = at + size
        cut[ends[ends < n]] = True
    return np.flatnonzero(cut)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Cut a long text where a blank follows a non-blank, at or after ``size`` characters."""
    at, n = 0, len(text)
    while n - at > size:
        cut = at + size
        while cut < n and not (ord(text[cut]) in BLANK and ord(text[cut - 1]) not in BLANK):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Pair merging of one piece: lowest rank first, leftmost among equals, by a heap over a
    linked list (n log n for long pieces)."""
    if piece in ranks:
        return (ranks[piece],)
    n = len(piece)
    end = list(range(1, n + 1))             # end of the part that starts here; 0 once merged away
    before = list(range(-1, n - 1))
    heap = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n and (r := ranks.get(piece[a:end[b]])) is not None:
            heapq.heappush(heap, (r, a, b, end[b]))

    for i in range(n):
        offer(i)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if end[a] != b or end[b] != c:
            continue
        end[a], end[b] = c, 0
        if c < n:
            before[c] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return tuple(out)


class Codec(dict):
    """Pieces to (ids as text, ids), filled on demand; emptied when it holds too many."""

    def __init__(self, ranks: dict[bytes, int], most: int = CACHED_PIECES):
        super().__init__()
        self.ranks, self.most = ranks, most
        words = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, i in ranks.items():
            words[i] = word
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(words), np.uint8)

    def __missing__(self, piece: str):
        ids = merge(piece.encode(), self.ranks)
        got = (" ".join(map(str, ids)), ids)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = got
        return got

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of an id list, gathered from the flat table."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        index = np.repeat(self.begin[ids] - (ends - sizes), sizes) + np.arange(total)
        return self.bytes[index].tobytes()

    def encode_many(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """For each text its piece id strings and its ids."""
        lengths = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        cuts = boundaries(codes, offsets[:-1][lengths > 0])
        ends = np.append(cuts, len(joined))
        at = np.searchsorted(cuts, offsets).tolist()
        stops = ends.tolist()
        pieces = [joined[a:b] for a, b in zip(stops, stops[1:])]
        found = list(map(self.__getitem__, pieces))
        out = []
        for k in range(len(texts)):
            own = found[at[k]:at[k + 1]]
            out.append(([x[0] for x in own],
                        np.fromiter(chain.from_iterable([x[1] for x in own]), np.int64)))
        return out


@lru_cache(maxsize=2)
def load_codec(path: str) -> Codec:
    """Ranks of a ``.tiktoken`` file, from the installed vocabulary folder of the worker."""
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def _batches(texts: list[str], size: int = SEGMENT) -> Iterator[list[int]]:
    group, chars = [], 0
    for i, t in enumerate(texts):
        if group and chars + len(t) > size:
            yield group
            group, chars = [], 0
        group.append(i)
        chars += len(t)
    if group:
        yield group


def _encoded(codec: Codec, texts: list[str]) -> Iterator[tuple[int, list[tuple[list[str], np.ndarray]]]]:
    """(row, its encoded segments) in order, with bounded work arrays."""
    for group in _batches(texts):
        if len(group) == 1 and len(texts[group[0]]) > SEGMENT:
            yield group[0], [codec.encode_many([s])[0] for s in segments(texts[group[0]])]
        else:
            for i, got in zip(group, codec.encode_many([texts[i] for i in group])):
                yield i, [got]


def token_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row; the ids are decoded
    again from the id table. ``vocabulary`` is a rank file present on every worker."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = load_codec(vocabulary)
        for frame in frames:
            rows = []
            for _, parts in _encoded(codec, frame["text"].tolist()):
                listed, plain, n = hashlib.sha256(), hashlib.sha256(), 0
                for k, (names, ids) in enumerate(p for p in parts if len(p[1])):
                    listed.update(((" " if k else "") + " ".join(names)).encode())
                    plain.update(codec.decode(ids))
                    n += len(ids)
                rows.append((n, listed.hexdigest(), plain.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]) \
                .assign(doc_id=frame["doc_id"].to_numpy())[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]]

    return id_and_text(docs, id_col, text_col).mapInPandas(
        work, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string") \
        .withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, offsets``: token ids and the byte offset at which each token starts."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = load_codec(vocabulary)
        for frame in frames:
            ids = [np.concatenate([p[1] for p in parts]) for _, parts in _encoded(codec, frame["text"].tolist())]
            offsets = [np.cumsum(codec.sizes[x]) - codec.sizes[x] for x in ids]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": ids, "offsets": offsets})

    return id_and_text(docs, id_col, text_col).mapInPandas(
        work, "doc_id string, ids array<bigint>, offsets array<bigint>") \
        .withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a ``decoded`` binary column, the bytes of its id lists (null: none)."""

    ship(encoded.sparkSession)

    @F.pandas_udf("binary")
    def bytes_of(ids: pd.Series) -> pd.Series:
        codec = load_codec(vocabulary)
        return ids.map(lambda x: None if x is None else codec.decode(np.asarray(x, np.int64)))

    return encoded.withColumn("decoded", bytes_of(F.col(ids_col)))
