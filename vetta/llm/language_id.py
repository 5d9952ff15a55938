"""Hierarchical language identification with linear support vector machines.

A text is a frequency vector of hashed byte 2- and 3-grams. One-versus-one machines first
choose the language family; within it, one-versus-one machines separate the related
languages. Training uses about ``PER_LANGUAGE`` different texts of each language, one at least
(drawn by a hash of id and text, whole texts, features computed on the executors: 16 KB a row
reach the driver, which fits the machines, 16 KB each, one for two families or two related
languages); prediction reads every whole text and nothing but the text.

Cases: a null text, or one without a letter, is ``und`` with score 0; rows without a label
are not learned from; with no labelled row everything is ``und``; with one language that
language is predicted with score 1; ties go to the smaller name; repeated rows get equal
results; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, id_and_text, ship
from .shingles import groups_of

DIMENSIONS = 4096
PER_LANGUAGE = 400
SCALE = 30.0
UNDETERMINED = "und"
# Families of closely related languages (ISO 639-1); others stand alone.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "mk", "pl", "cs", "sk"],
    "indic": ["hi", "mr", "ne", "bn", "gu", "pa", "ur"],
    "turkic": ["tr", "az", "kk", "uz", "ky"],
    "uralic": ["fi", "et", "hu"],
}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of the 2- and the 3-grams at each byte of the joined texts, and the
    byte offsets of the texts (each is followed by two separator bytes)."""
    parts = [t.encode() + b"\0\0" for t in texts]
    data = _LOWER[np.frombuffer(b"".join(parts) + b"\0\0", np.uint8)].astype(np.uint32)
    two = data[:-2] * np.uint32(256) + data[1:-1]
    three = two * np.uint32(256) + data[2:] + np.uint32(1 << 24)
    hashed = [((x * np.uint32(2654435761)) >> np.uint32(20)) % np.uint32(DIMENSIONS) for x in (two, three)]
    return *hashed, np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def features(texts: list[str]) -> np.ndarray:
    two, three, at = grams(texts)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        counts = np.bincount(two[a:b], minlength=DIMENSIONS) + np.bincount(three[a:b], minlength=DIMENSIONS)
        out[i] = counts * (SCALE / (2 * (b - a)))
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, strength: float = 100.0, steps: int = 300) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge machine for labels of -1 and 1,
    classes weighted equally, by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    rate = 1.0 / (2 * strength * float((share[:, None] * x * x).sum()) + 1.0)
    w = look = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ look))
        new = look - rate * (look - 2 * strength * (x.T @ (share * slack * y)))
        look, w = new + k / (k + 3) * (new - w), new
    return w


class Model:
    """Machines by pair of names on two levels; a few hundred kilobytes at most per level."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        languages = np.array(labels)
        families = np.array([family_of(n) for n in labels])
        self.languages = sorted(set(labels))
        self.families = sorted({family_of(n) for n in self.languages})
        self.members = {f: [n for n in self.languages if family_of(n) == f] for f in self.families}
        self.pairs, weights = [], []
        for level, names, own in (("family", families, self.families),
                                  *[("language", languages, m) for m in self.members.values()]):
            for a, b in combinations(own, 2):
                rows = np.flatnonzero((names == a) | (names == b))
                self.pairs.append((level, a, b))
                weights.append(linear_svm(x[rows], np.where(names[rows] == a, 1, -1).astype(np.float32)))
        self.weights = np.array(weights, np.float32).reshape(len(weights), DIMENSIONS + 1)

    def margins(self, texts: list[str]) -> np.ndarray:
        two, three, at = grams(texts)
        out = np.empty((len(texts), len(self.pairs)))
        size = 2.0 * np.diff(at)
        for j, w in enumerate(self.weights):
            part = np.add.reduceat((w[two] + w[three]).astype(np.float64), at[:-1])
            out[:, j] = part * (SCALE / size) + w[-1]
        return out

    def choose(self, margins: np.ndarray, level: str, own: list[str]) -> tuple[str, float]:
        """The name with most pairwise wins (then the larger margin sum, then the smaller
        name), and its smallest margin."""
        wins, total, least = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0), dict.fromkeys(own, np.inf)
        for j, (lv, a, b) in enumerate(self.pairs):
            if lv == level and a in wins and b in wins:
                m = margins[j]
                wins[a if m >= 0 else b] += 1
                for name, v in ((a, m), (b, -m)):
                    total[name] += v
                    least[name] = min(least[name], v)
        best = min(own, key=lambda n: (-wins[n], -total[n], n))
        return best, least[best]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out = []
        if not self.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        for row in self.margins(texts):
            family, first = self.choose(row, "family", self.families)
            language, second = self.choose(row, "language", self.members[family])
            out.append((language, float(1 / (1 + np.exp(-3 * np.clip(min(first, second), -10, 10))))))
        return out


def limit(rows: int, wanted: int) -> int:
    """The largest signed 64-bit hash of a drawn row, so that about ``wanted`` of ``rows`` are drawn."""
    return -(2**63) + min(2**64 - 1, 2**64 * wanted // rows)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample; only its feature vectors reach the driver."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    # ids may be null or repeat, so the text takes part in the draw
    draw = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(17))
    counts = rows.groupBy(lang_col).agg(F.count("*").alias("n"), F.min(draw).alias("least")).collect()
    if not counts:
        return Model(np.zeros((0, DIMENSIONS), np.float32), [])
    # a language with fewer rows than wanted is taken whole, any other has one row at least;
    # a map, as there may be many labels
    most = {r[0]: max(limit(r["n"], per_language), r["least"]) for r in counts if r["n"] > per_language}
    at_most = F.lit(2**63 - 1) if not most else F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(v) for pair in most.items() for v in pair]), F.col(lang_col)),
        F.lit(2**63 - 1))
    # equal texts of a language are drawn once, so that a frequent one does not fill the sample
    drawn = rows.filter(draw <= at_most).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).distinct()
    ship(labelled.sparkSession)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in groups_of(texts):
                yield pd.DataFrame({"lang": frame["lang"].iloc[a:b],
                                    "x": [v.tobytes() for v in features(texts[a:b])]})

    got = drawn.mapInPandas(work, "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(-1, DIMENSIONS)
    return Model(x, [r["lang"] for r in got])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in frames:
            texts, letters = frame["text"].tolist(), frame["letter"].tolist()
            for a, b in groups_of(texts):
                got = own.predict(texts[a:b])
                got = [g if ok else (UNDETERMINED, 0.0) for g, ok in zip(got, letters[a:b])]
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[a:b].to_numpy(),
                                    "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

    return id_and_text(docs, id_col, text_col).withColumn("letter", F.col("text").rlike(r"\p{L}")) \
        .mapInPandas(work, "doc_id string, lang_pred string, score double") \
        .withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             folds: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learn from the labelled rows outside the
    held-out fold, predict all rows."""
    model = train(docs.filter(fold(id_col, folds) != held_out), id_col, text_col, lang_col, per_language)
    return predict(docs, model, id_col, text_col) \
        .select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "lang_pred", "score")


def drop_undetermined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language cannot be determined; columns unchanged.
    Rows are judged where they stand, so repeated or null ids need no join. Where no row is
    labelled there is nothing to tell languages by, and every text with a letter stays."""
    model = train(docs, id_col, text_col, lang_col)
    if not model.languages:
        return docs.filter(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def language(text: pd.Series) -> pd.Series:
        out, texts = [], text.tolist()
        for a, b in groups_of(texts):
            out += [g[0] for g in shared.value.predict(texts[a:b])]
        return pd.Series(out, index=text.index, dtype=object)

    ship(docs.sparkSession)
    named = F.when(F.col(text_col).rlike(r"\p{L}"), language(F.coalesce(F.col(text_col), F.lit(""))))
    return docs.filter(F.coalesce(named, F.lit(UNDETERMINED)) != UNDETERMINED)
