"""Periodic runs against all lags compared word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vetta.llm import queries
from vetta.llm.periodic_runs import collapse_runs, find_runs, periodic_runs

from .cases import corpus, frame, row

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, shortest=12):
    """All (start, length, period): each lag's matching stretches; a stretch keeps its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shortest, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def periodic(rng, n):
    words = []
    while len(words) < n:
        if words and rng.random() < 0.4:
            p = rng.randrange(1, min(len(words), 40) + 1)
            for _ in range(rng.randrange(60)):
                words.append(words[-p])
        words += [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 15))]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        shortest = rng.choice([12, 12, 12, 2, 3, 5, 7, 8, 9, 20, 31])
        words = periodic(rng, rng.randrange(1, 200))
        assert [tuple(r) for r in find_runs(np.array(words), shortest).tolist()] == brute(words, shortest)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(2, 14))
def test_runs_of_few_words(words, shortest):
    assert [tuple(r) for r in find_runs(np.array(words, np.int64), shortest).tolist()] == brute(words, shortest)


def test_work_stays_linear_in_bad_texts():
    one = find_runs(np.zeros(300000, np.int64))
    assert one.tolist() == [[0, 300000, 1]]
    a, b = [0], [0, 1]
    while len(b) < 100000:                                # Fibonacci words have about 0.76 runs a word
        a, b = b, b + a
    runs = find_runs(np.array(b))
    assert len(runs) < len(b)
    half = [0, 1] * 100 + [0]                             # every odd period has a run of its own
    assert [tuple(r) for r in find_runs(np.array(half + half)).tolist()] == brute(half + half)


def test_documents(spark):
    rng = random.Random(9)
    rows = [row(*r) for r in corpus()] + [row(500 + k, "  ".join(f"w{w}" for w in periodic(rng, 120))) for k in range(30)]
    rows += [row(700, "la " * 40000), row(701, "é x y " * 9 + "\ttail"), row(702, "a b c d e f " * 2), row(702, "a b c d e f " * 2)]
    got = periodic_runs(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        runs = brute(words) if len(words) < 5000 else [(0, 40000, 1)] if words[0] == "la" else []
        want.append((i, len(words), tuple(runs), collapsed(words, runs)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert sorted(((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in got), key=key) == sorted(want, key=key)


def test_collapse_keeps_rows_and_columns(spark):
    rows = [row(1, "a b c d e f " * 3 + "end"), row(1, None), row(None, ""), row(3, "no  run\there"), row(4, "x " * 30)]
    docs = frame(spark, rows)
    out = collapse_runs(docs)
    assert out.schema.names == docs.columns
    assert sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str) == sorted(
        [(1, "a b c d e f end", "src"), (1, None, "src"), (None, "", "src"), (3, "no  run\there", "src"), (4, "x", "src")], key=str)
    empty = frame(spark, [])
    assert periodic_runs(empty).count() == 0 and collapse_runs(empty).count() == 0


def test_query_equals_its_contract(spark):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    planted = 0
    for r in rows:
        words = WORD.findall(r.text or "")
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if n > 3000:
            continue
        if h % 10 == 0 and n:
            planted += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        text = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        own = got[r.doc_id]
        assert (own.n_runs, own.start, own.length, own.period) == (len(runs), *best)
        assert own.exponent_milli == (best[1] * 1000 // best[2] if runs else None)
        assert own.runs_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert own.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted > 5
