"""Round 3: what a task reads, holds and sends stays bounded; results as before."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from vetta.operators import embedding as EM
from vetta.operators import features as FT
from vetta.operators import models as MD


def plan(df):
    return df._jdf.queryExecution().toString()


def test_fit_frame_gets_more_partitions_with_more_text(spark, monkeypatch):
    df = spark.range(0, 40, 1, 10).select(F.lit("x" * 10).alias("text"), F.col("id").cast("double").alias("a"))
    feats = VectorAssembler(inputCols=["a"], outputCol="features").transform(df).select("features", "a")
    assert MD._fit_frame(feats, 2, 400).rdd.getNumPartitions() == 2
    monkeypatch.setattr(MD, "FIT_CHARS", 100)
    made = MD._fit_frame(feats, 2, 400)
    assert made.rdd.getNumPartitions() == 4 and made.count() == 40
    assert made.schema["features"].metadata == {}        # no names of features travel with a task


def test_fits_at_once_follow_the_size():
    assert MD._at_once(4, 0) == 4 and MD._at_once(4, MD.ROOM_CHARS // 2) == 2 and MD._at_once(4, 10 * MD.ROOM_CHARS) == 1


def test_blocks_grow_with_the_text(spark, monkeypatch):
    rows = [(f"good day {k}" if k % 2 else f"bad night {k}", k % 2) for k in range(60)] + [(None, 1)]
    df = spark.createDataFrame(rows, "text string, h int")
    seen, real = [], EM.checkpointed
    monkeypatch.setattr(EM, "checkpointed", lambda d: seen.append(real(d)) or seen[-1])
    monkeypatch.setattr(EM, "BLOCK_CHARS", 100)
    EM.fit_embedding_heads(df, ["h"], dim=2, epoch=1, buckets=256, blocks=2)
    assert seen[0].rdd.getNumPartitions() >= 6 and seen[0].count() == 61


def test_packed_buckets_are_the_counted_ones():
    bags = [[5, 1, 5, 9], [], [0], [65535, 0, 65535]]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3]), pa.array(bags, pa.list_(pa.int32()))], names=["block", "__bag"])
    made = next(EM._pack(iter([batch])))
    for bag, packed in zip(bags, made.column(1).to_pylist()):
        (ids, share), (want, part) = EM._unpack(packed), EM._counted(bag)
        assert ids.tolist() == want.tolist() and np.array_equal(share, part)


def test_tfidf_with_null_and_repeated_ids_and_no_term_exchange(spark):
    rows = [(1, "aa bb aa"), (1, "bb cc"), (2, "aa dd"), (None, "cc cc"), (None, "dd aa"), (3, "bb dd aa bb"), (4, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    docs = {}
    for k, t in rows:
        docs.setdefault(k, Counter()).update(re.findall(r"\w\w+", t or ""))
    df_of = Counter(t for c in docs.values() for t in c)
    ttf = Counter()
    for c in docs.values():
        ttf.update(c)
    top = sorted((t for t in df_of if df_of[t] >= 2), key=lambda t: (-ttf[t], t))[:3]
    want = {}
    for k, c in docs.items():
        raw = {t: n * (math.log((1 + len(rows)) / (1 + df_of[t])) + 1) for t, n in c.items() if t in top}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        want.update({(k, t): round(x / norm, 6) for t, x in raw.items() if k is not None})
    made = FT.tfidf_relational(df, "id", "text", (1, 1), 2, 3)
    got = {(r.id, r.term): r.weight for r in made.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)
    assert "SortMergeJoin [term" not in plan(made) and "REPARTITION_BY_COL" in plan(made)


def test_a_short_list_is_broadcast(spark):
    df = spark.createDataFrame([(1, "a testing day"), (2, "Attesting"), (3, None), (4, "testing\n")], "id long, text string")
    lex = spark.createDataFrame([("testing",)], "word string").union(spark.createDataFrame([("te sting\n",)], "word string"))
    for whole, want in ((True, [1, 0, None, 1]), (False, [1, 1, None, 1])):
        made = FT.lexicon_join(df, "id", "text", lex, whole_word=whole)
        assert [r.lexicon for r in made.orderBy("id").collect()] == want
        assert "SortMergeJoin [gram" not in plan(made) and "SortMergeJoin [word" not in plan(made)


def test_char_ngrams_of_wide_and_empty_texts(spark):
    def cut(t):
        return Counter(f"<{w}>"[i:i + n] for w in t.split() for n in range(2, 6) for i in range(len(w) + 3 - n))
    texts = ["ab c", "", "😀a 😀😀 x", "über <a> $1 \\n", "abcdefg hi"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", FT.char_ngrams(FT.head_tokens("t")).alias("g")).collect():
        assert Counter(r.g) == cut(r.t)
    # one matcher a length, not a function call a character
    assert "regexp_extract_all(concat(<, array_join" in plan(df.select(FT.char_ngrams(FT.head_tokens("t"))))
