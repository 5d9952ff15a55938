"""Embedding-bag heads (M7-M9): averaged embeddings of hashed word and character n-grams and a
softmax, one model a head, all heads in one pass over the rows.

Fitting is stochastic gradient descent with parameter averaging. The rows are dealt once into
blocks by a hash of the text, more than asked for where a block would hold more than
``BLOCK_CHARS`` characters, so that a task's memory is bounded; in each epoch every block starts from the shared parameters,
goes through its rows in numpy, and returns the embeddings it touched; their averages over
the blocks that touched them are the next parameters. What reaches the driver or is broadcast
is ``heads * buckets * dim`` numbers at most, whatever the rows; texts stay in their tasks.

``tune`` chooses among points by successive halving: all points are fitted on a small part of
the rows, the better ones go on to parts ``eta`` times as large, which hold the smaller ones, and
only the last few see every row.

Cases: a null text has no n-grams and scores the bias alone; a null label is not learned
from; a head without both classes is an error, or skipped; the seed fixes the result for
given blocks.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetta.functions.hashing import md5_order
from vetta.operators.features import checkpointed


#: Characters of text that a block holds.
BLOCK_CHARS = 16 << 20


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SEED = np.uint64(42)                   # of Spark's xxhash64


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _these(mask: np.ndarray):
    """The places of a mask (a slice if it is true everywhere)."""
    return slice(None) if mask.all() else np.flatnonzero(mask)


def _xxhash64(text: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for parts of a text, given by bytes, as signed numbers."""
    one = np.frombuffer(text + bytes(12), np.uint8).astype(np.uint64)
    four = one[:-3] | one[1:-2] << np.uint64(8) | one[2:-1] << np.uint64(16) | one[3:] << np.uint64(24)

    def eight(at: np.ndarray) -> np.ndarray:
        return four[at] | four[at + 4] << np.uint64(32)

    with np.errstate(over="ignore"):
        h = np.full(len(starts), _SEED + _P5)
        long = np.flatnonzero(sizes >= 32)
        if len(long):
            lanes = [np.full(len(long), x) for x in (_SEED + _P1 + _P2, _SEED + _P2, _SEED, _SEED - _P1)]
            for k in range(int(sizes[long].max()) // 32):
                own = np.flatnonzero(sizes[long] // 32 > k)
                for j, v in enumerate(lanes):
                    v[own] = _turned(v[own] + eight(starts[long[own]] + 32 * k + 8 * j) * _P2, 31) * _P1
            whole = sum(_turned(v, by) for v, by in zip(lanes, (1, 7, 12, 18)))
            for v in lanes:
                whole = (whole ^ _turned(v * _P2, 31) * _P1) * _P1 + _P4
            h[long] = whole
        h += sizes.astype(np.uint64)
        at, words = starts + sizes // 32 * 32, sizes % 32 // 8
        for k in range(int(words.max(initial=0))):
            own = _these(words > k)
            h[own] = _turned(h[own] ^ _turned(eight(at[own] + 8 * k) * _P2, 31) * _P1, 27) * _P1 + _P4
        at = at + 8 * words
        if len(half := np.flatnonzero(sizes & 4)):
            own = slice(None) if len(half) == len(sizes) else half
            h[own] = _turned(h[own] ^ four[at[own]] * _P1, 23) * _P2 + _P3
        at, left = at + (sizes & 4), sizes & 3
        for k in range(int(left.max(initial=0))):
            own = _these(left > k)
            h[own] = _turned(h[own] ^ one[at[own] + k] * _P5, 11) * _P1
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        return (h ^ h >> np.uint64(32)).view(np.int64)


def bag_of(text: str, buckets: int, word_ngrams: int = 2, chars: tuple[int, int] = (2, 5)) -> np.ndarray:
    """The buckets (Spark's ``xxhash64`` modulo their number) of all n-grams of a text: of words (runs
    without whitespace, joined by blanks) and of the characters of each ``<word>``."""
    tokens = text.split()
    if not tokens:
        return np.empty(0, np.int64)
    joined = " ".join(tokens).encode()
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.append(0, blanks + 1), np.append(blanks, len(joined))
    spans = [(starts[:len(starts) - n + 1], ends[n - 1:]) for n in range(1, min(word_ngrams, len(starts)) + 1)]
    first, last = (np.concatenate(x) for x in zip(*spans))
    hashes = [_xxhash64(joined, first, last - first)]
    wrapped = ("<" + "><".join(tokens) + ">").encode()
    begin = np.flatnonzero(np.frombuffer(wrapped, np.uint8) & 0xC0 != 0x80)         # of each character
    word, begin = np.repeat(np.arange(len(starts)), ends - starts + 2)[begin], np.append(begin, len(wrapped))
    for n in range(chars[0], min(chars[1], len(word)) + 1):
        own = np.flatnonzero(word[:len(word) - n + 1] == word[n - 1:])
        hashes.append(_xxhash64(wrapped, begin[own], begin[own + n] - begin[own]))
    return np.mod(np.concatenate(hashes), buckets)


@dataclass
class EmbeddingHeads:
    """Fitted heads: ``table`` (head, bucket, dim) and ``out`` (head, dim + 1), the last one the bias."""

    heads: list[str]
    table: np.ndarray
    out: np.ndarray
    word_ngrams: int = 2
    chars: tuple[int, int] = (2, 5)

    def score(self, df: DataFrame, text: str = "text", suffix: str = "_prob") -> DataFrame:
        """``df`` with the probability of the positive class of each head."""
        shared = df.sparkSession.sparkContext.broadcast((self.table, self.out))
        names = [f"{h}{suffix}" for h in self.heads]
        columns, word_ngrams, chars = list(df.columns), self.word_ngrams, self.chars

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, out = shared.value
            for batch in batches:
                p = np.empty((len(names), batch.num_rows))
                for r, own in enumerate(batch.column(batch.num_columns - 1)):
                    ids, share = _counted(bag_of(own.as_py(), table.shape[1], word_ngrams, chars), table.shape[1])
                    for h in range(len(names)):
                        z = (share @ table[h][ids]) @ out[h, :-1] + out[h, -1]
                        p[h, r] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(x) for x in p]], names=[*columns, *names])

        made = df.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("__text"))
        schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
        return made.mapInArrow(work, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(h, b, [float(v) for v in vec]) for k, h in enumerate(self.heads)
                for b, vec in [*enumerate(self.table[k]), (-1, self.out[k])] if b < 0 or np.any(vec)]
        head = spark.createDataFrame([(self.heads, int(self.table.shape[1]), int(self.table.shape[2]), self.word_ngrams, list(self.chars))],
                                     "heads array<string>, buckets int, dim int, word_ngrams int, chars array<int>")
        head.write.mode("overwrite").json(f"{path}/settings")
        spark.createDataFrame(rows, "head string, bucket int, vec array<double>").write.mode("overwrite").parquet(f"{path}/vectors")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "EmbeddingHeads":
        s = spark.read.schema("heads array<string>, buckets int, dim int, word_ngrams int, chars array<int>").json(f"{path}/settings").first()
        table = np.zeros((len(s.heads), s.buckets, s.dim), np.float32)
        out = np.zeros((len(s.heads), s.dim + 1), np.float32)
        at = {h: k for k, h in enumerate(s.heads)}
        for r in spark.read.parquet(f"{path}/vectors").collect():          # at most heads * buckets rows
            if r.bucket < 0:
                out[at[r.head]] = r.vec
            else:
                table[at[r.head], r.bucket] = r.vec
        return EmbeddingHeads(list(s.heads), table, out, s.word_ngrams, tuple(s.chars))


def _tally(bag: np.ndarray, buckets: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different buckets and how often they occur."""
    if buckets is None or buckets > 16 * len(bag):
        return np.unique(bag, return_counts=True)
    n = np.bincount(bag, minlength=buckets)
    ids = np.flatnonzero(n)
    return ids, n[ids]


def _counted(bag, buckets: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different buckets of a text and their shares of its n-grams."""
    ids, n = _tally(np.asarray(bag, np.int64), buckets)
    return ids.astype(np.int32), (n / max(n.sum(), 1)).astype(np.float32)


def _width(values: np.ndarray) -> int:
    """Bytes that the largest number needs: 1, 2 or 4."""
    most = int(values.max()) if len(values) else 0
    return 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4


def _pack(batches: Iterator[pa.RecordBatch], buckets: int | None = None, **grams) -> Iterator[pa.RecordBatch]:
    """The last column, a list of buckets or (with ``buckets``) a text, as the compressed steps
    between its sorted distinct buckets and their counts."""
    for batch in batches:
        packed = []
        for own in batch.column(batch.num_columns - 1):
            bag = own.values.to_numpy(zero_copy_only=False) if buckets is None else bag_of(own.as_py(), buckets, **grams)
            ids, n = _tally(bag, buckets)
            steps = np.diff(ids, prepend=0)
            a, b = _width(steps), _width(n)
            packed.append(zlib.compress(bytes([a, b]) + steps.astype(f"<u{a}").tobytes() + n.astype(f"<u{b}").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], names=[*batch.schema.names[:-1], "__bag"])


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What ``_counted`` gives for a packed list."""
    data = zlib.decompress(packed)
    a, b = data[:2]
    n = (len(data) - 2) // (a + b)
    steps, often = np.frombuffer(data, f"<u{a}", n, 2), np.frombuffer(data, f"<u{b}", n, 2 + n * a)
    return np.cumsum(steps, dtype=np.int32), (often / max(often.sum(), 1)).astype(np.float32)


#: Packed bytes of a block whose rows are held unpacked.
HELD = 16 << 20


class _Rows:
    """Packed rows, unpacked when they are read if all of them would take too much room."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed
        self.held = [_unpack(b) for b in packed] if sum(map(len, packed)) <= HELD else None

    def some(self, at: np.ndarray) -> "_Rows":
        own = copy.copy(self)
        own.packed = [self.packed[i] for i in at]
        own.held = self.held and [self.held[i] for i in at]
        return own

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.held[i] if self.held is not None else _unpack(self.packed[i])


def _descend(table: np.ndarray, out: np.ndarray, rows: _Rows, labels: np.ndarray, rate: float, last: float,
             rng: np.random.Generator) -> float:
    """One pass over a block for one head, row by row, in place; the rate falls from ``rate`` to
    ``last``. Returns the summed loss."""
    order, loss = rng.permutation(len(rows)), 0.0
    taken, change = np.empty_like(table), np.empty_like(table)
    for a, r in enumerate(order):
        ids, share = rows[r]
        step, own = rate + (last - rate) * a / len(order), np.take(table, ids, axis=0, out=taken[:len(ids)], mode="clip")
        mean = share @ own
        p = 1 / (1 + math.exp(-min(30.0, max(-30.0, float(mean @ out[:-1] + out[-1])))))
        y = float(labels[r])
        loss -= math.log((p if y else 1 - p) + 1e-12)
        err = np.float32(step * (p - y))
        own -= np.multiply((err * share)[:, None], out[:-1], out=change[:len(ids)])
        table[ids] = own
        out[:-1] -= err * mean
        out[-1] -= err
    return loss


def _blocks(df: DataFrame, heads: Sequence[str], text: str, buckets: int, word_ngrams: int, chars: tuple[int, int], blocks: int,
            seed: int, skip_missing: bool, order: str | None) -> tuple[list[str], DataFrame]:
    """The heads that have both classes, and the packed rows dealt into blocks."""
    wanted = [h for h in heads if h in df.columns]
    seen = df.agg(*[F.min(h).alias(f"lo{k}") for k, h in enumerate(wanted)], *[F.max(h).alias(f"hi{k}") for k, h in enumerate(wanted)],
                  F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars")).first()
    blocks = max(blocks, -(-seen["chars"] // BLOCK_CHARS))
    have = [h for k, h in enumerate(wanted) if seen[f"lo{k}"] is not None and seen[f"lo{k}"] != seen[f"hi{k}"]]
    if len(have) < len(heads) and not skip_missing:
        raise ValueError("no training data with both classes for: " + ", ".join(h for h in heads if h not in have))
    block, place = F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(blocks)).cast("int"), F.col(order) if order else F.lit(0)
    packed = df.select(block.alias("block"), place.cast("long").alias("place"), F.array(*[F.col(h).cast("float") for h in have]).alias("y"),
                       F.coalesce(F.col(text), F.lit("")).alias("__text")) \
        .mapInArrow(partial(_pack, buckets=buckets, word_ngrams=word_ngrams, chars=tuple(chars)), "block int, place long, y array<float>, __bag binary").repartition(blocks, "block")
    return have, checkpointed(packed.sortWithinPartitions("place") if order else packed)


def fit_embedding_heads(df: DataFrame, heads: Sequence[str], text: str = "text", dim: int = 16, lr: float = 0.5, epoch: int = 5,
                        buckets: int = 1 << 16, word_ngrams: int = 2, chars: tuple[int, int] = (2, 5), blocks: int = 8,
                        seed: int = 42, skip_missing: bool = False, packs: dict | None = None,
                        order: str | None = None) -> tuple[EmbeddingHeads, list[float]]:
    """The heads, and the mean loss of each epoch. ``df`` has the text and a 0/1 column a head. Fits on
    the same rows share the packed ones by being given one dict as ``packs``. ``order`` names a
    number by which a block has its rows (else they are as they come)."""
    packs, key = {} if packs is None else packs, (*heads, text, buckets, word_ngrams, *chars, blocks, seed, skip_missing, order)
    if key not in packs:
        packs[key] = _blocks(df, heads, text, buckets, word_ngrams, chars, blocks, seed, skip_missing, order)
    have, data = packs[key]
    rng = np.random.default_rng(seed)
    table = ((rng.random((len(have), buckets, dim)) - 0.5) * 2 / dim).astype(np.float32)
    out = np.zeros((len(have), dim + 1), np.float32)
    losses = []
    for e in range(epoch):
        shared = df.sparkSession.sparkContext.broadcast((table, out))
        rate, last = lr * (1 - e / epoch), lr * (1 - (e + 1) / epoch)

        def work(frames: Iterator[pd.DataFrame], shared=shared, rate=rate, last=last, e=e) -> Iterator[pd.DataFrame]:
            packed, labels, own = [], [], 0
            for frame in frames:
                packed += list(frame["__bag"])
                labels += [np.asarray(y, np.float32) for y in frame["y"]]
                own = int(frame["block"].iloc[0]) if len(frame) else own
            if not packed:
                return
            rows, (start, first) = _Rows(packed), shared.value
            y = np.stack(labels)
            for h in range(len(start)):
                known = np.flatnonzero(~np.isnan(y[:, h]))
                mine, w = start[h].copy(), first[h].copy()
                some = rows.some(known)
                loss = _descend(mine, w, some, y[known, h], rate, last, np.random.default_rng([seed, e, own, h]))
                seen = np.zeros(len(mine), bool)
                for k in range(len(some)):
                    seen[some[k][0]] = True
                touched = np.flatnonzero(seen)
                vec = np.vstack([np.pad(mine[touched], ((0, 0), (0, 1))), w])
                yield pd.DataFrame({"head": h, "bucket": np.concatenate([touched, [-1]]), "loss": [0.0] * len(touched) + [loss],
                                    "n": float(len(known)), **{f"v{d}": vec[:, d] for d in range(dim + 1)}})

        sums = [F.sum(f"v{d}").alias(f"v{d}") for d in range(dim + 1)]
        got = data.mapInPandas(work, "head int, bucket int, loss double, n double, " + ", ".join(f"v{d} float" for d in range(dim + 1))) \
            .groupBy("head", "bucket").agg(F.count("*").alias("blocks"), F.sum("loss").alias("loss"), F.sum("n").alias("n"), *sums).toPandas()
        vec = got[[f"v{d}" for d in range(dim + 1)]].to_numpy(np.float64) / got["blocks"].to_numpy()[:, None]
        bias = (got["bucket"] < 0).to_numpy()
        table = table.copy()
        table[got["head"][~bias], got["bucket"][~bias]] = vec[~bias, :dim]
        out = out.copy()
        out[got["head"][bias]] = vec[bias]
        losses.append(float(got["loss"].sum() / max(got["n"][bias].sum(), 1)))
        shared.unpersist()
    return EmbeddingHeads(have, table, out, word_ngrams, tuple(chars)), losses


def part_of(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """The rows whose first 32 bits of md5('<seed>:<key>') are in the lowest ``share``: nested samples."""
    top = f"{min(2**32, int(share * 2**32)):09x}"
    return df.filter(F.concat(F.lit("0"), F.substring(md5_order(key, seed), 1, 8)) < F.lit(top))


def tune(df: DataFrame, val: DataFrame, head: str, points: Sequence[Mapping], key: str, text: str = "text", eta: int = 3,
         seed: int = 42, **fixed) -> tuple[EmbeddingHeads, Mapping, list[dict]]:
    """The best point's head fitted on all rows, the point, and one record a fit: ``rung, point,
    rows, f1, kept``. Each rung keeps the best ``1 / eta`` of its points (at least one; ties to the
    earlier point) by the F1 of the positive class on ``val``. Both frames are read several times."""
    rungs = 1
    while eta ** rungs < len(points):
        rungs += 1
    left, record, model = list(range(len(points))), [], None
    for rung in range(rungs + 1):
        part = part_of(df, key, eta ** (rung - rungs), seed)
        rows, scored, packs = part.count(), [], {}
        for k in left:
            try:
                made, _ = fit_embedding_heads(part, [head], text, seed=seed, packs=packs, **{**fixed, **dict(points[k])})
            except ValueError:                           # a part without both classes tells nothing
                scored.append((0.0, k, None))
                continue
            p = made.score(val, text).select((F.col(f"{head}_prob") > 0.5).alias("p"), (F.col(head) == 1).alias("t"))
            tp, fp, fn = p.agg(F.count_if(F.expr("p and t")), F.count_if(F.expr("p and not t")), F.count_if(F.expr("t and not p"))).first()
            scored.append((2 * tp / (2 * tp + fp + fn) if tp else 0.0, k, made))
        scored.sort(key=lambda s: (-s[0], s[1]))
        keep = max(1, len(left) // eta) if rung < rungs else 1
        kept = {k for _, k, _ in scored[:keep]}
        record += [{"rung": rung, "point": k, "rows": rows, "f1": f1, "kept": k in kept} for f1, k, _ in scored]
        left, model = sorted(kept), scored[0][2]
    if model is None:
        raise ValueError(f"no training data with both classes for: {head}")
    return model, points[left[0]], record
