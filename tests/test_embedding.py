"""Embedding-bag heads: learning, saving, awkward rows; tuning by successive halving."""

import random

import pytest

from vetta.operators import embedding as EM

GOOD, BAD = "lovely food friendly staff nice place", "terrible rude dirty waste of money"


def rows(spark, n=120, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        y = k % 2
        words = (BAD if y else GOOD).split() + ["the", "and", "was", "we"]
        out.append((k, " ".join(rng.choice(words) for _ in range(12)), y, 1 - y if k % 3 else None, 1))
    return spark.createDataFrame(out, "id long, text string, rant int, ad int, one int")


def f1(model, df, head):
    got = model.score(df).select(head, f"{head}_prob").collect()
    tp = sum(r[1] > 0.5 and r[0] == 1 for r in got)
    return 2 * tp / max(1, sum(r[1] > 0.5 for r in got) + sum(r[0] == 1 for r in got))


def test_heads_learn_and_survive_saving(spark, tmp_path):
    model, losses = EM.fit_embedding_heads(rows(spark), ["rant", "ad"], dim=8, lr=1.0, epoch=4, buckets=1 << 12, blocks=2)
    assert losses[-1] < losses[0] / 2
    held = rows(spark, 60, seed=2)
    assert f1(model, held, "rant") > 0.95
    model.save(spark, f"{tmp_path}/m")
    again = EM.EmbeddingHeads.load(spark, f"{tmp_path}/m")
    a, b = ({r.id: (r.rant_prob, r.ad_prob) for r in m.score(held).collect()} for m in (model, again))
    assert a.keys() == b.keys() and all(abs(x - y) < 1e-6 for k in a for x, y in zip(a[k], b[k]))
    odd = spark.createDataFrame([(1, None), (2, ""), (None, GOOD)], "id long, text string")
    got = model.score(odd).collect()
    assert len(got) == 3 and all(0 <= r.rant_prob <= 1 for r in got) and got[0].rant_prob == got[1].rant_prob
    assert model.score(odd).columns == ["id", "text", "rant_prob", "ad_prob"]


def test_the_seed_fixes_the_result(spark):
    make = lambda: EM.fit_embedding_heads(rows(spark, 40), ["rant"], dim=4, epoch=2, buckets=256, blocks=2)[0]
    a, b = make(), make()
    assert (abs(a.table - b.table) < 1e-6).all() and (abs(a.out - b.out) < 1e-6).all()


def test_a_head_needs_both_classes(spark):
    with pytest.raises(ValueError):
        EM.fit_embedding_heads(rows(spark, 20), ["rant", "one"], epoch=1, buckets=64)
    model, _ = EM.fit_embedding_heads(rows(spark, 20), ["rant", "one", "absent"], epoch=1, buckets=64, blocks=1, skip_missing=True)
    assert model.heads == ["rant"]


def test_successive_halving(spark):
    points = [{"lr": 0.0}, {"lr": 1.0}, {"lr": 1e-6}, {"lr": 2.0}]
    train, val = rows(spark, 200), rows(spark, 60, seed=2)
    model, best, record = EM.tune(train, val, "rant", points, "id", eta=2, dim=4, epoch=2, buckets=512, blocks=1)
    assert best["lr"] in (1.0, 2.0) and f1(model, val, "rant") > 0.9
    assert [sum(r["rung"] == k for r in record) for k in range(3)] == [4, 2, 1]
    sizes = [max(r["rows"] for r in record if r["rung"] == k) for k in range(3)]
    assert sizes[2] == 200 and sizes == sorted(sizes) and sizes[0] < 100
    small = {r.id for r in EM.part_of(train, "id", 0.25).collect()}
    assert small <= {r.id for r in EM.part_of(train, "id", 0.5).collect()} and EM.part_of(train, "id", 1).count() == 200
