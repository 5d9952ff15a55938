"""Language-model scores by deleted interpolation.

Tokens are A-Z-lower-cased words and one end token per text; the vocabulary is that of the
training texts and one type for all other words. A token's probability is a mixture of its
share among all tokens that follow the previous word (pairs of all words are counted), and of
a lower order: the probability of its class after the previous token's class, times its own
within the class. Words of at least ``FREQUENT`` of all training tokens are classes of their
own (so there are at most 1 / FREQUENT), the end token is one, and all other words share one.

The lower order is itself a mixture of maximum-likelihood estimates of falling order. Over
classes: bigram, unigram and uniform. Within the shared class: word frequency, uniform over
its known words, and the unknown type. The weights of words and of classes are learned for
each bucket of the context's frequency (powers of two), by expectation-maximisation on the
counts of a held-out tenth of the training texts against estimates from the rest; the final
estimates use all training texts.

Scale: texts are read once, into chunks of at most ``CHUNK`` characters (a longer text is one)
that hold their words' 64-bit hashes and the numbers of the tokens. A chunk sends each distinct
word and pair of it once, with its counts, to the bucket of the hash; the bucket adds up and
answers every chunk. So a word or pair travels once a chunk however often it occurs, no key is
hot, and what a task holds is a chunk or a bucket. What reaches the driver or is broadcast is
bounded by construction: class pairs (at most (1 / FREQUENT + 3)^2), words of more than
``COMMON`` of all training tokens (at most 1 / COMMON), whose counts no chunk is sent, and
cells of held-out events by frequency bucket and ratio of the two orders.

Cases: a null or blank text has the end token alone; with no training text all estimates
are uniform; repeated rows count as often as they stand and score alike (each row keeps its
place in its chunk, whatever its id); other columns are never read.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, ship, table, text_of
from .shingles import groups_of, mix, word_hashes

FREQUENT = 1 / 4000
COMMON = 2e-6
DEV_FOLDS = 10
LIMIT = 4096                            # more than the number of classes
EM_STEPS = 40
EXACT_COUNTS = 64                       # larger counts are weighed in sixteenths of an octave
CHUNK = 1 << 22                         # characters of texts that are counted and scored together
BUCKET = 1 << 21                        # words or pairs that a bucket is sent by all chunks
#: Stand for the end and the start of a text in the hashes of pairs.
_EDGES = np.array([0x5BD1E9955BD1E995, 0xC2B2AE3D27D4EB4F], np.uint64)
_CONTEXT = np.uint64(0xA0761D6478BD642F)


def mixture_weights(parts: np.ndarray, counts: np.ndarray, bucket: np.ndarray, buckets: int = 64) -> np.ndarray:
    """EM: (buckets, k) weights that maximise the held-out likelihood of sum(w * parts) for
    events with ``parts`` (n, k) component probabilities. A bucket without held-out events
    keeps equal weights."""
    k = parts.shape[1]
    w = np.full((buckets, k), 1.0 / k)
    for _ in range(EM_STEPS):
        share = w[bucket] * parts
        share *= (counts / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        new = np.stack([np.bincount(bucket, share[:, j], buckets) for j in range(k)], axis=1)
        total = new.sum(axis=1, keepdims=True)
        w = np.where(total > 0, new / np.maximum(total, 1e-300), w)
    w = np.maximum(w, 1e-6)             # every event keeps some probability
    return w / w.sum(axis=1, keepdims=True)


def frequency_bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64) + 1, 0)


class Sequence:
    """Interpolated n-gram over small integers: events are (context..., symbol) packed in
    base ``base``; ``order`` symbols an event."""

    def __init__(self, keys: np.ndarray, est: np.ndarray, dev: np.ndarray, base: int, order: int, symbols: int):
        self.base, self.order, self.symbols = base, order, symbols
        self.weights = None
        self._count(keys, est)
        held = dev > 0
        parts, bucket = self._parts(keys[held])
        self.weights = mixture_weights(parts, dev[held].astype(float), bucket)
        self._count(keys, est + dev)

    def _count(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.tables, self.contexts = [], []
        for n in range(self.order, 0, -1):
            own = keys % self.base**n
            self.tables.append(self._sum(own, counts))
            self.contexts.append(self._sum(own // self.base, counts))

    @staticmethod
    def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, at = np.unique(keys, return_inverse=True)
        return values, np.bincount(at, counts, len(values))

    @staticmethod
    def _find(table_: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        values, counts = table_
        if not len(values):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(values, keys), len(values) - 1)
        return np.where(values[at] == keys, counts[at], 0.0)

    def _parts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, bucket = [], None
        for n, table_, context in zip(range(self.order, 0, -1), self.tables, self.contexts):
            own = keys % self.base**n
            below = self._find(context, own // self.base)
            parts.append(self._find(table_, own) / np.maximum(below, 1))
            if bucket is None:
                bucket = frequency_bucket(below)
        parts.append(np.full(len(keys), 1.0 / self.symbols))
        return np.stack(parts, axis=1), bucket

    def before(self, keys: np.ndarray, est: np.ndarray) -> "Sequence":
        """The same weights over these counts alone."""
        own = copy.copy(self)
        own._count(keys, est)
        return own

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each event given its context."""
        values, at = np.unique(keys, return_inverse=True)
        parts, bucket = self._parts(values)
        return np.log10((parts * self.weights[bucket]).sum(axis=1))[at]


def _arrays(df: DataFrame, *names: str) -> list[np.ndarray]:
    frame = df.select(*names).toPandas()
    return [frame[n].to_numpy(np.int64) for n in names]


class Words:
    """Word hashes to classes, by binary search in a bounded table."""

    def __init__(self, hashes: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers of at least 0 as byte planes, as many as the largest needs."""
    values = np.ascontiguousarray(values).astype("<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :data[0]] = planes.T
    return out.view("<i8").ravel()


def _pack_sorted(hashes: np.ndarray) -> bytes:
    """Rising hashes by their steps."""
    return hashes[:1].tobytes() + _pack(np.diff(hashes)) if len(hashes) else b""


def _unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], np.uint64), _unpack(data[8:]).view(np.uint64)]), dtype=np.uint64)


def _all(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


class Events:
    """The tokens of a chunk with their contexts, as numbers of its words; the end and the start
    of a text come after those. ``offsets``: of the texts; ``role``: of each token's text."""

    def __init__(self, row, n_words: int):
        roles, sizes = np.frombuffer(row.roles, np.uint8), _unpack(row.sizes)
        self.offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.symbol = np.full(self.offsets[-1], n_words, np.int64)
        inside = np.ones(len(self.symbol), bool)
        inside[self.offsets[1:] - 1] = False
        self.symbol[inside] = _unpack(row.tokens)
        self.context = np.empty_like(self.symbol)
        self.context[1:] = self.symbol[:-1]
        self.context[self.offsets[:-1]] = n_words + 1
        self.role = np.repeat(roles, sizes + 1)

    def pairs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted hashes of the distinct pairs, and the place of each token's pair among them."""
        known = np.concatenate([words, _EDGES])
        return np.unique(mix(mix(known + _CONTEXT)[self.context] + known[self.symbol]), return_inverse=True)


def _chunk(number: int, ids: list, roles: list[int], texts: list[str]) -> pd.DataFrame:
    hashes, sizes = [], []
    for a, b in groups_of(texts):
        own, at = word_hashes(texts[a:b])
        hashes.append(own)
        sizes.append(np.diff(at))
    words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
    sizes, role = np.concatenate(sizes), np.array(roles, np.uint8)
    return pd.DataFrame({
        "chunk": [number], "ids": [ids], "roles": [role.tobytes()], "sizes": [_pack(sizes)], "words": [_pack_sorted(words)],
        "tokens": [_pack(tokens)], "n_words": [len(words)], "n_tokens": [len(tokens) + len(ids)],
        "n_train": [int((sizes[role < 2] + 1).sum())], "est_ends": [int((role == 0).sum())], "dev_ends": [int((role == 1).sum())]})


def _messages(chunk: int, first: int, buckets: int, hashes: np.ndarray, est: np.ndarray, dev: np.ndarray) -> pd.DataFrame:
    """Sorted hashes and their counts, by ranges of the hash: bucket ``first`` and the following."""
    own = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.searchsorted(own, np.arange(buckets + 1))
    spans = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
    return pd.DataFrame({"bucket": [first + k for k, _ in spans], "chunk": chunk, "hash": [_pack_sorted(hashes[x]) for _, x in spans],
                         "est": [_pack(est[x]) for _, x in spans], "dev": [_pack(dev[x]) for _, x in spans]})


def _mass(est: np.ndarray) -> np.ndarray:
    """Larger counts in sixteenths of an octave."""
    return np.where(est > EXACT_COUNTS, 2.0 ** (np.floor(np.log2(np.maximum(est, 1)) * 16 + 0.5) / 16), est)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5,
          held_out: int = 1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"),
                       (fold(id_col, folds) == held_out).alias("held_out"))
    # 0 estimation, 1 held-out tenth of the training texts, 2 not learned from
    role = F.when(F.col("held_out"), 2).when(
        F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(DEV_FOLDS)) == 0, 1).otherwise(0)
    base = base.select(F.col("doc_id").cast("string").alias("doc_id"), "text", role.alias("role"))
    most, in_bucket = CHUNK, BUCKET

    def chunked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        ids, roles, texts, size = [], [], [], 0
        for f in frames:
            for i, r, t in zip(f["doc_id"], f["role"], f["text"]):
                ids.append(i)
                roles.append(r)
                texts.append(t)
                size += len(t)
                if size >= most:
                    yield _chunk(number, ids, roles, texts)
                    ids, roles, texts, size, number = [], [], [], 0, number + 1
        if ids:
            yield _chunk(number, ids, roles, texts)

    chunks = table(base.mapInPandas(chunked, "chunk long, ids array<string>, roles binary, sizes binary, words binary, tokens binary, "
                                    "n_words long, n_tokens long, n_train long, est_ends long, dev_ends long"), "chunks", "zstd")
    sums = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_tokens", "n_train", "est_ends", "dev_ends")]).first()
    total, est_ends, n_ends = sums[2], sums[3], sums[3] + sums[4]
    word_buckets, pair_buckets = (max(1, -(-n // in_bucket)) for n in sums[:2])
    least, many = max(1, FREQUENT * total), max(0.5, COMMON * total)

    def sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                words = _unpack_sorted(row.words)
                events = Events(row, len(words))
                est, dev = (np.bincount(events.symbol[events.role == k], minlength=len(words))[:len(words)] for k in (0, 1))
                yield _messages(row.chunk, 0, word_buckets, words, est, dev)
                pairs, at = events.pairs(words)
                est, dev = (np.bincount(at[events.role == k], minlength=len(pairs)) for k in (0, 1))
                yield _messages(row.chunk, word_buckets, pair_buckets, pairs, est, dev)

    def counted(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        """The counts of all chunks, for each chunk in the order of its message; of a bucket of words
        also the frequent and common ones (chunk -1), sums over the words that are not frequent (-2)
        and their held-out counts by estimated count (-3)."""
        parts = [_unpack_sorted(x) for x in f["hash"]]
        values, at = np.unique(np.concatenate(parts), return_inverse=True)
        est, dev = (np.bincount(at, _all([_unpack(x) for x in f[c]]), len(values)).astype(np.int64) for c in ("est", "dev"))
        out = []
        if key[0] < word_buckets:
            n = est + dev
            named, rare = (n >= least) | (n > many), (n > 0) & (n < least)
            cells, own = np.unique(_mass(est[rare & (dev > 0)]), return_inverse=True)
            out += [(-1, values[named].tobytes(), _pack(est[named]), _pack(dev[named])),
                    (-2, b"", _pack(np.array([est[rare].sum(), (est[rare] > 0).sum(), n[rare].sum(), rare.sum(), (n > 0).sum()])), b""),
                    (-3, cells.tobytes(), b"", _pack(np.bincount(own, dev[rare & (dev > 0)], len(cells))))]
            est[n > many] = dev[n > many] = 0
        cut = np.cumsum([0, *map(len, parts)])
        out += [(chunk, b"", _pack(est[at[a:b]]), _pack(dev[at[a:b]])) for chunk, a, b in zip(f["chunk"], cut, cut[1:])]
        return pd.DataFrame(out, columns=["chunk", "hash", "est", "dev"]).assign(bucket=key[0])

    answers = table(chunks.select("chunk", "roles", "sizes", "words", "tokens")
                    .mapInPandas(sent, "bucket int, chunk long, hash binary, est binary, dev binary").groupBy("bucket")
                    .applyInPandas(counted, "chunk long, hash binary, est binary, dev binary, bucket int"), "counts", "zstd")
    found = {k: [] for k in (-1, -2, -3)}
    for r in answers.filter("chunk < 0").collect():      # named words, and bounded cells of each bucket of words
        found[r.chunk].append(r)
    named = np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(r.hash, np.uint64) for r in found[-1]]])
    by_role = np.stack([_all([_unpack(r[c]) for r in found[-1]]) for c in ("est", "dev")])
    often = by_role.sum(axis=0)
    frequent, near = Words(np.sort(named[often >= least])), Words(named[often > many])
    near_counts = by_role[:, often > many]
    end = len(frequent.hashes) + 1
    others = np.sum([np.zeros(5, np.int64), *[_unpack(r.est) for r in found[-2]]], axis=0)
    distinct = int(others[4]) + (n_ends > 0)
    n_est, v_est, n_all, v_all = (max(1, int(x)) for x in others[:4])

    # words within the shared class
    est, at = np.unique(_all([np.frombuffer(r.hash, np.float64) for r in found[-3]]).astype(float), return_inverse=True)
    dev = np.bincount(at, _all([_unpack(r.dev) for r in found[-3]]), len(est))
    parts = np.stack([est / n_est, (est > 0) / v_est, (est == 0).astype(float)], axis=1)
    by_word, by_type, unknown = mixture_weights(parts, dev, np.zeros(len(est), np.int64), 1)[0]
    shared = spark.sparkContext.broadcast((frequent, near, near_counts))

    def answered(_key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = next(left.itertuples())
        frequent_, near_, near_counts_ = shared.value
        words = _unpack_sorted(row.words)
        right = right.sort_values("bucket")
        est, dev = (_all([_unpack(x) for x in right[c]]) for c in ("est", "dev"))
        number = near_.find(words)
        hit = np.flatnonzero(number >= 0)
        est[hit], dev[hit] = near_counts_[0, number[hit]], near_counts_[1, number[hit]]
        _, at = Events(row, len(words)).pairs(words)
        n = len(words)
        return pd.DataFrame({
            "ids": [row.ids], "roles": [row.roles], "sizes": [row.sizes], "tokens": [row.tokens],
            "classes": [_pack(frequent_.find(words) + 1)], "est": [_pack(est[:n])], "dev": [_pack(dev[:n])],
            "pair_est": [_pack(est[n:][at])], "pair_dev": [_pack(dev[n:][at])]})

    texts = table(chunks.drop("n_words", "n_tokens", "n_train", "est_ends", "dev_ends").groupBy("chunk")
                  .cogroup(answers.filter("chunk >= 0").select("chunk", "bucket", "est", "dev").groupBy("chunk"))
                  .applyInPandas(answered, "ids array<string>, roles binary, sizes binary, tokens binary, classes binary, "
                                 "est binary, dev binary, pair_est binary, pair_dev binary"), "texts", "zstd")

    def read(row) -> tuple[Events, np.ndarray, np.ndarray]:
        """The tokens, their packed class pairs, and the counts (est, dev) of the words."""
        counts = np.stack([_unpack(row.est), _unpack(row.dev)])
        events = Events(row, counts.shape[1])
        classes = np.concatenate([_unpack(row.classes), [end, end + 1]])
        return events, classes[events.context] * LIMIT + classes[events.symbol], counts

    def class_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                events, pairs, _ = read(row)
                train = events.role < 2
                keys, n = np.unique(pairs[train] * 2 + events.role[train], return_counts=True)
                yield pd.DataFrame({"pair": keys // 2, "role": keys % 2, "n": n})

    pairs = texts.mapInPandas(class_pairs, "pair long, role long, n long") \
        .groupBy("pair").agg(F.sum(F.expr("if(role = 0, n, 0)")).alias("est"),
                             F.sum(F.expr("if(role = 1, n, 0)")).alias("dev"))
    keys, pair_est, pair_dev = _arrays(pairs, "pair", "est", "dev")
    sequence = Sequence(keys, pair_est, pair_dev, LIMIT, 2, end + 1)
    learning = spark.sparkContext.broadcast(sequence.before(keys, pair_est))

    def held_events(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Held-out tokens by frequency bucket of the context and ratio of the pair's estimate to
        the lower order's (0, or in sixteenths of an octave)."""
        seq = learning.value
        for f in frames:
            for row in f.itertuples():
                events, pairs_, counts = read(row)
                at = np.flatnonzero(events.role == 1)
                if not len(at):
                    continue
                n = counts[0]
                own = np.where(counts.sum(axis=0) >= least, 1.0, by_word * n / n_est + np.where(n > 0, by_type / v_est, unknown))
                low = 10 ** seq.log10(pairs_[at]) * np.append(own, 1.0)[events.symbol[at]]
                below = np.concatenate([n, [0, est_ends]])[events.context[at]]
                ratio = _unpack(row.pair_est)[at] / np.maximum(below, 1) / low
                cell = np.where(ratio > 0, np.floor(np.log2(np.where(ratio > 0, ratio, 1)) * 16), -(1 << 20)).astype(np.int64)
                values, own_cell = np.unique(np.stack([frequency_bucket(below), cell]), axis=1, return_inverse=True)
                yield pd.DataFrame({"bucket": values[0], "cell": values[1], "n": np.bincount(own_cell.ravel()),
                                    "ratio": np.bincount(own_cell.ravel(), ratio)})

    cells = texts.mapInPandas(held_events, "bucket long, cell long, n long, ratio double") \
        .groupBy("bucket", "cell").agg(F.sum("n").alias("n"), F.sum("ratio").alias("ratio")).toPandas()
    n = cells["n"].to_numpy(float)
    parts = np.stack([cells["ratio"].to_numpy(float) / n, np.ones(len(n))], axis=1)
    weights = mixture_weights(parts, n, cells["bucket"].to_numpy(np.int64))
    weights[0] = 0, 1                                    # after a context that is not known

    bottom = total + 0.5 * (distinct + 1)
    end_log = float(np.log10((n_ends + 0.5) / bottom))
    model = spark.sparkContext.broadcast((sequence, weights))

    def scores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, weights_ = model.value
        for f in frames:
            for row in f.itertuples():
                events, pairs_, counts = read(row)
                n, first = counts.sum(axis=0), events.offsets[:-1]
                own = np.where(n >= least, 1.0, np.where(n > 0, by_word * n / n_all + by_type / v_all, unknown))
                low = 10 ** seq.log10(pairs_) * np.append(own, 1.0)[events.symbol]
                below = np.concatenate([n, [0, n_ends]])[events.context]
                share = weights_[frequency_bucket(below), 0]
                whole = share * (_unpack(row.pair_est) + _unpack(row.pair_dev)) / np.maximum(below, 1) + (1 - share) * low
                yield pd.DataFrame({
                    "doc_id": list(row.ids), "n_tokens": np.diff(events.offsets),
                    "n_known": np.add.reduceat(np.append(n > 0, n_ends > 0)[events.symbol].astype(np.int64), first),
                    "base_score": np.add.reduceat(np.append(np.log10((n + 0.5) / bottom), end_log)[events.symbol], first),
                    "score": np.add.reduceat(np.log10(whole), first)})

    return texts.mapInPandas(scores, "doc_id string, n_tokens long, n_known long, base_score double, score double").select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"),
        (fold("doc_id", folds) == held_out).alias("held_out"), "n_tokens", "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
