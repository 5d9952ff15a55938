"""Periodic runs: stretches of words that repeat with a period, found by seeds and diagonals.

A run is a maximal stretch of consecutive words with smallest period q (words q apart are
identical) and length of at least max(``SHORTEST``, 2 q). Along the diagonal of lag q it
matches itself over length - q >= max(``SHORTEST`` - q, q) words, the guaranteed overlap.

Seeds: lags are dealt into classes that double. The grams of a class are half as long as the
overlap that its smallest lag guarantees, so every diagonal holds a whole gram that starts
at a multiple of the gram's length. Each such gram is paired with its later occurrences in
the same document at the lags of the class, found by binary search in the index of all
occurrences. A class thus gives at most two pairs a word, even where one word fills the text,
and there are logarithmically many classes: no group is expanded into all its pairs.

Diagonals: along one lag, a seed that starts where the seed before it ended lies in what that
one's extension covers. The furthest covered place of every lag, held as the running end of
such a chain, suppresses it; only the two ends of a chain are extended, by less than a gram,
with the grams of smaller classes. Equal stretches found at multiples of a period keep the
smallest. Gram names are exact (ranks of pairs of names), so nothing needs verification.

Cases: a null or blank text has no words, no runs and collapses to an empty text; a null id
stays null; rows that repeat an id are judged each alone; a very long text is one array of
words in one task (about 100 bytes a word where all of it repeats at every length); an empty
table gives an empty result; other columns are never read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, ship, text_of
from .shingles import groups_of

SHORTEST = 12
FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class _Names(dict):
    """Numbers for the words of one text, counted on from ``base``."""

    def __init__(self, base: int):
        super().__init__()
        self.base = base

    def __missing__(self, word: bytes) -> int:
        name = self[word] = self.base + len(self)
        return name


def _pair_names(first: np.ndarray, second: np.ndarray, apart: int) -> np.ndarray:
    """Names of the grams made of ``first`` at each place and ``second`` ``apart`` places on:
    equal just if both are. Grams that occur once get a negative name of their own."""
    n = len(first)
    out = -1 - np.arange(n, dtype=np.int64)
    at = np.flatnonzero((first[:n - apart] >= 0) & (second[apart:] >= 0)) if n > apart else np.empty(0, np.int64)
    if len(at):
        key = first[at] * np.int64(n + int(second.max()) + 1) + second[at + apart]
        _, name, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[name] > 1
        dense = np.cumsum(count > 1) - 1
        out[at[again]] = dense[name[again]]
    return out


def _reach(tables: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray, forward: bool, n: int) -> np.ndarray:
    """How many words match on from i and j (or backwards, before i and j), up to the sum of
    the gram lengths in ``tables``, which descend."""
    got = np.zeros(len(i), np.int64)
    for size, names in tables:
        a, b = (i + got, j + got) if forward else (i - got - size, j - got - size)
        ok = (b + size <= n) if forward else (a >= 0)
        ok[ok] = names[a[ok]] == names[b[ok]]
        got += np.where(ok, size, 0)
    return got


def find_runs(words: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """(start, length, period) rows, by start and period, of all runs in an array of word
    numbers; numbers of different documents must differ, so that no gram recurs elsewhere."""
    n = len(words)
    found = []
    once = words.astype(np.int64)
    step = max(1, (max(shortest - shortest // 2, 1) + 1) // 2)      # the smallest guaranteed overlap, halved
    gram, built = once, 1
    while built < step:                                             # grams of ``step`` words by growing ones
        grow = min(built, step - built)
        gram = _pair_names(gram, gram, grow)
        built += grow
    tables = [(1, once)] * (step - 1)                               # extends by less than a gram
    low, high = 1, max(4 * step, 2)
    while low < n and (gram >= 0).any():
        seeds = np.arange(0, n, step)
        seeds = seeds[gram[seeds] >= 0]
        if len(seeds):
            place = np.flatnonzero(gram >= 0)
            key = gram[place] * np.int64(2 * n + high) + place
            key.sort()
            own = gram[seeds] * np.int64(2 * n + high) + seeds
            left, right = np.searchsorted(key, own + low), np.searchsorted(key, own + high)
            many = right - left
            i = np.repeat(seeds, many)
            nth = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            j = key[np.repeat(left, many) + nth] - gram[i] * np.int64(2 * n + high)
            if len(i):
                lag = j - i
                order = np.lexsort((i, lag))
                i, lag = i[order], lag[order]
                # furthest covered place of the lag: the end of the chain so far
                covered = (lag[1:] == lag[:-1]) & (i[1:] == i[:-1] + step)
                head = np.flatnonzero(np.concatenate([[True], ~covered]))
                tail = np.concatenate([head[1:], [len(i)]]) - 1
                start, end, lag = i[head], i[tail] + step, lag[head]
                start = start - _reach(tables, start, start + lag, False, n)
                end = end + _reach(tables, end, end + lag, True, n)
                length = end - start + lag
                good = length >= np.maximum(shortest, 2 * lag)
                found.append(np.stack([start[good], length[good], lag[good]], axis=1))
        tables = [(step, gram), *tables]
        gram = _pair_names(gram, gram, step)
        low, high, step = high, 2 * high, 2 * step
    if not found:
        return np.empty((0, 3), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):
        same = (runs[1:, :2] == runs[:-1, :2]).all(axis=1)          # a multiple of the smallest period
        runs = runs[np.concatenate([[True], ~same])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _judge(texts: list[str], shortest: int) -> Iterator[tuple]:
    parts, numbers, base = [], [], 0
    for t in texts:
        names = _Names(base)
        own = t.encode().split()                                    # runs without ASCII blanks
        numbers.append(np.fromiter(map(names.__getitem__, own), np.int64, len(own)))
        base += len(names)
        parts.append(own)
    words = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
    runs = find_runs(words, shortest)
    limits = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(cover[:-1]) == 0
    bounds = np.searchsorted(runs[:, 0], limits)
    for k, (own, text) in enumerate(zip(parts, texts)):
        mine = runs[bounds[k]:bounds[k + 1]] - np.array([limits[k], 0, 0])
        stay = kept[limits[k]:limits[k + 1]]
        left = own if stay.all() else [w for w, s in zip(own, stay.tolist()) if s]
        yield len(own), [{"start": a, "length": b, "period": c} for a, b, c in mine.tolist()], b" ".join(left).decode()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """One row per document: ``doc_id, n_words, runs, collapsed``. ``runs`` are (start, length,
    period) in words from 0, by start, then period; ``collapsed`` is the text without the words
    that a run contains after its first period, joined by one blank."""
    if shortest < 2:
        raise ValueError("a run has two words at least")
    ship(docs.sparkSession)

    @F.pandas_udf(FOUND)
    def judge(text: pd.Series) -> pd.DataFrame:
        texts = text.tolist()
        rows = [r for a, b in groups_of(texts) for r in _judge(texts[a:b], shortest)]
        return pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).alias("doc_id"), judge(text_of(text_col)).alias("found")).select("doc_id", "found.*")


def collapse_runs(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with the text of every row that has a run replaced by the collapsed one;
    other rows and columns unchanged."""
    rows = packed(docs, text=F.col(text_col))
    # the whole row as the id of its own judgement: nothing is joined
    judged = periodic_runs(rows, "row", "text", shortest)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(f"doc_id.`{text_col}`"))
    return judged.select(F.col("doc_id").withField(f"`{text_col}`", text).alias("row")).select("row.*")
