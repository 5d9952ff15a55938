"""Importance resampling against zlib and a plain-Python version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vetta.llm import importance, prefix_crc

from .cases import corpus, folded, frame, row

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, longest):
    words = WORD.findall(folded(text).encode())
    return words, [b" ".join(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, longest=2, buckets=10000, percent=25, seed=7, least=20):
    def count(texts):
        return Counter(zlib.crc32(g) % buckets for t in texts for g in grams(t, longest)[1])
    s, t = count(r[1] for r in rows), count(target)
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t))) for b in range(buckets)]
    out = []
    for r in rows:
        words, feats = grams(r[1], longest)
        weight = sum(gain[zlib.crc32(g) % buckets] for g in feats) // len(feats) if feats else 0
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((r[0], len(words), len(feats), weight, score))
    fit = sorted((o for o in out if o[1] >= least), key=lambda o: (-o[4], o[0] is None, o[0] or 0))
    drawn = [o[0] for o in fit[:percent * len(fit) // 100]]
    return out, drawn


def check(spark, rows, target, **options):
    got = importance.importance_ranks(frame(spark, rows), frame(spark, [(k, t) for k, t in enumerate(target)]), **options).collect()
    out, drawn = brute(rows, target, **{{"min_words": "least"}.get(k, k): v for k, v in options.items()})
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(out)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [r.doc_id for r in ranked] == drawn


def test_equals_brute_force(spark):
    target = ["alpha3 beta4 Über7 naïve1", None, "", "omega1 sigma2 rho3 " * 30]
    check(spark, corpus(), target)
    check(spark, corpus(5), target, longest=3, buckets=97, percent=60, seed=11, min_words=5)
    check(spark, corpus(6), [], percent=100, min_words=0)


def test_ties_repeats_and_empty(spark):
    rows = [(None, "one two three " * 10)] * 4 + [(9, "one two three " * 10)] * 30 + [(2, "x"), (2, None)]
    check(spark, rows, ["one two"], percent=50)
    got = importance.resample(frame(spark, rows), frame(spark, [(1, "one two")]), percent=50)
    assert got.columns == frame(spark, rows).columns and got.count() == 17
    assert importance.importance_ranks(frame(spark, []), frame(spark, [])).count() == 0
    assert importance.resample(frame(spark, []), frame(spark, [(1, "a b")])).count() == 0


def test_resample_keeps_whole_rows(spark):
    rows = corpus(8)
    drawn = Counter(brute(rows, ["gamma7 delta9"])[1])
    got = importance.resample(frame(spark, rows), frame(spark, [(1, "gamma7 delta9")])).collect()
    assert Counter(r.doc_id for r in got) == drawn
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t)
    assert all(r.text in texts[r.doc_id] and r.source == "src" for r in got)


def test_a_very_long_text(spark):
    check(spark, [row(1, "word " * 400000), row(2, "y" * 3000000), row(3, "a b c " * 10)], ["a b"], percent=100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ9é -\x00　_", max_size=60), max_size=6), st.integers(1, 4))
def test_crcs_equal_zlib(texts, longest):
    for k, (crcs, own) in enumerate(prefix_crc.ngram_crcs(texts, longest), 1):
        for n, t in enumerate(texts):
            words = WORD.findall(folded(t).encode())
            want = [zlib.crc32(b" ".join(words[i:i + k])) for i in range(len(words) - k + 1)]
            assert crcs[own[n]:own[n + 1]].tolist() == want


def test_scan_over_many_lanes():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(70000))
    regs = prefix_crc.running(np.frombuffer(data, np.uint8))
    ones = np.array([prefix_crc.ONES])
    for n in (0, 1, 63, 64, 4096, 69999, 70000):
        whole = regs[n:n + 1] ^ prefix_crc.shift(ones, np.array([n])) ^ ones
        assert int(whole[0]) == zlib.crc32(data[:n])
