"""Round 4: no task gets a whole part, nothing is computed once a term that is one a row; results as before."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from vetta.operators import embedding as EM
from vetta.operators import features as FT
from vetta.operators import models as MD
from vetta.operators import ordering as O


def plan(df):
    return df._jdf.queryExecution().toString()


# ------------------------------------------------------------------ splits
def test_a_split_moves_no_rows_to_their_stratum(spark):
    rows = [(k, None if k % 7 == 0 else k % 2, "t" * k) for k in range(200)] + [(5, 1, "again"), (None, 0, "x")]
    df = spark.createDataFrame(rows, "id long, label int, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stratify in ("label", None):
            made = O.split(df, "id", 0.75, 42, stratify=stratify)
            assert "BuildRight" in plan(made) and "SortMergeJoin" not in plan(made)
            got = made.collect()
            assert Counter((r.id, r.label, r.text) for r in got) == Counter(rows)
            for s in {r[1] for r in rows} if stratify else [...]:
                own = [r for r in got if s is ... or r.label == s]
                assert sum(r.split == "train" for r in own) == math.floor(len(own) * 0.75)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# ------------------------------------------------------------------ TF-IDF
def test_tfidf_sums_a_document_once_and_sorts_few_terms(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) + rng.choice(["", "", str(rng.randrange(9))])
                         for _ in range(rng.randrange(1, 30)))) for k in range(60)] + [(100, None), (101, ""), (102, "b")]
    df = spark.createDataFrame(rows, "id long, text string")
    docs = {}
    for k, t in rows:
        w = [x for x in (t or "").split() if len(x) > 1]
        docs[k] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df_of, ttf = Counter(t for c in docs.values() for t in c), Counter()
    for c in docs.values():
        ttf.update(c)
    top = set(sorted((t for t in df_of if df_of[t] >= 2), key=lambda t: (-ttf[t], t))[:25])
    want = {}
    for k, c in docs.items():
        raw = {t: n * (math.log((1 + len(rows)) / (1 + df_of[t])) + 1) for t, n in c.items() if t in top}
        want.update({(k, t): x / math.sqrt(sum(y * y for y in raw.values())) for t, x in raw.items()})
    sorted_ = []
    real = FT.head_rows
    monkeypatch.setattr(FT, "head_rows", lambda d, *a: sorted_.append(d.count()) or real(d, *a))
    for limit in (FT.BROADCAST_TERMS, 1):                # vocabulary broadcast, and joined
        monkeypatch.setattr(FT, "BROADCAST_TERMS", limit)
        made = FT.tfidf_relational(df, "id", "text", (1, 2), 2, 25)
        got = {(r.id, r.term): r.weight for r in made.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)
    assert 25 <= sorted_[0] < sum(n >= 2 for n in df_of.values())
    assert "lambdafunction" not in plan(FT.tfidf_relational(df, "id", "text", (1, 1), 2, 25))      # the norm is no fold over the terms


def test_vocabulary_is_that_of_the_counts(spark):
    rows = [["b", "a", "b"], ["a", "c"], [], None, ["c", "d", "d", "d", "d"], ["e", "a"]]
    df = spark.createDataFrame([(r,) for r in rows], "t array<string>")
    def fit(**kw):
        return FT.TermVocabulary(inputCol="t", outputCol="v", **kw).fit(df)
    assert fit().vocabulary == ["d", "a", "b", "c", "e"]           # by count, ties by name
    assert fit(vocabSize=4).vocabulary == ["d", "a", "b", "c"] and fit(minDF=2.0).vocabulary == ["a", "c"]
    assert fit(minDF=0.4).vocabulary == ["a"]                      # 2.4 of six rows
    with pytest.raises(ValueError):
        fit(minDF=9.0)
    assert FT._counting(["a\0", "", "b"], spark, "t", "v").vocabulary == ["a\0", "", "b"]
    assert FT._counting(["", "b", ""], spark, "t", "v").vocabulary == ["", "b", ""]
    got = fit().transform(df.filter("t is not null")).collect()
    assert [{int(i): v for i, v in zip(r.v.indices, r.v.values)} for r in got][0] == {1: 1.0, 2: 2.0}


# ------------------------------------------------------------------ n-gram buckets
def test_buckets_are_those_of_the_ngrams(spark):
    rng = random.Random(2)
    texts = ["ab <a> ab", "", "  ", "x", "über naïve   😀😀 a\x1cb\x85c", "ab" * 70 + " y ab\u3000é", "<ab> a b a b"]
    texts += [" ".join("".join(rng.choice("abc<>é😀") for _ in range(rng.randrange(1, 45))) for _ in range(30))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for buckets in (1 << 15, 1000, 1 << 40):
        stages = FT.head_feature_stages("t", word_ngrams_hi=3)[:1]
        made = PipelineModel(stages=stages).transform(df).select(
            "t", F.transform("__hterms", lambda x: F.pmod(F.xxhash64(x), F.lit(buckets))).alias("bag"))
        for r in made.collect():
            assert sorted(r.bag) == sorted(EM.bag_of(r.t, buckets, 3).tolist())


def test_rows_unpacked_when_read_learn_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    bags = [rng.integers(0, 64, 30) for _ in range(20)]
    steps = [np.unique(b, return_counts=True) for b in bags]
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([b.tolist() for b in bags], pa.list_(pa.int32()))], names=["k", "__bag"])
    packed = next(EM._pack(iter([batch]))).column(1).to_pylist()
    made = []
    for held in (EM.HELD, 0):
        monkeypatch.setattr(EM, "HELD", held)
        rows = EM._Rows(packed).some(np.arange(0, 20, 2))
        assert (rows.held is None) == (held == 0) and len(rows) == 10
        table, out = np.ones((64, 4), np.float32), np.zeros(5, np.float32)
        loss = EM._descend(table, out, rows, np.arange(10) % 2, 0.5, 0.1, np.random.default_rng(1))
        made.append((table, out, loss))
    assert np.array_equal(made[0][0], made[1][0]) and np.array_equal(made[0][1], made[1][1]) and made[0][2] == made[1][2]
    assert steps[0][0].tolist() == EM._unpack(packed[0])[0].tolist()


def test_points_share_the_packed_rows(spark, monkeypatch):
    rows = [(k, f"good day {k}" if k % 2 else f"bad night {k}", k % 2) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, text string, h int")
    packs, real = [], EM.checkpointed
    monkeypatch.setattr(EM, "checkpointed", lambda d: packs.append(1) or real(d))
    points = [{"dim": 2}, {"dim": 4}, {"lr": 0.1}]
    EM.tune(df, df, "h", points, "id", epoch=1, buckets=64, blocks=1)
    assert len(packs) == 2                               # one a rung


# ------------------------------------------------------------------ fits
def test_fits_read_few_wide_rows_and_cache_the_text(spark, monkeypatch):
    rows = [(("idiot trash " if i % 4 == 0 else "nice place ") + str(i), int(i % 4 == 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "text string, label int")
    name, seen = "spark.sql.parquet.columnarReaderBatchSize", []
    before, real = spark.conf.get(name), MD.LogisticRegression.fit
    monkeypatch.setattr(MD.LogisticRegression, "fit", lambda self, d, *a: seen.append(spark.conf.get(name)) or real(self, d, *a))
    MD.fit_safety(df, ["idiot"], params=dict(MD.SAFETY_BEST, min_df=1, max_iter=5))
    assert MD._CACHED_TEXTS[-1].columns == ["text", "label", "weight"]
    MD.fit_heads(df.withColumnRenamed("label", "ad"), ["ad"], max_iter=3)
    assert seen == [str(MD.READ_ROWS)] * 2 and spark.conf.get(name) == before


def test_fits_at_once_follow_the_features():
    assert MD._at_once(4, 0, MD.ROOM_FEATURES // 2) == 2 and MD._at_once(4, 0, 10 * MD.ROOM_FEATURES) == 1 and MD._at_once(4, 0, 1) == 4
