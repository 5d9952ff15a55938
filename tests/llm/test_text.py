"""Language ID, language model, pseudonyms, licenses, tokeniser and decontamination."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from vetta.llm import byte_bpe, decontaminate, interpolated_lm, language_id, licenses, pii
from vetta.llm.common import fold

from .cases import corpus, folded, frame, row

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_fold_is_crc32(spark):
    rows = frame(spark, [(i, "x") for i in range(20)] + [(None, "y")])
    for r in rows.select("doc_id", fold("doc_id", 5).alias("f")).collect():
        assert r.f == zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5


# ---------------------------------------------------------------- language ID
WORDS = {"en": "the and of to with which there house", "de": "der und die nicht auch eine straße über",
         "fr": "le et les avec une mais où être", "es": "el y los con una pero dónde niño"}


def language_rows(seed=1, n=240):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append(row(i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(4, 60))), lang))
    return out


def test_language_of_held_out_texts(spark):
    rows = language_rows()
    rows += [row(900, None), row(901, ""), row(902, "123 !! 45"), row(903, "le et les avec", None), row(None, "der und die", "de"),
             row(905, "the and of " * 5000)]
    truth = {r[0]: r[2] for r in rows}
    got = {r.doc_id: r for r in language_id.identify(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[903].lang_pred == "fr" and got[905].lang_pred == "en"
    held = [i for i in range(240) if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240))
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_without_labels_or_with_one(spark):
    rows = [row(i, t, None) for i, t in enumerate(["the and", None, "der"])]
    assert {r.lang_pred for r in language_id.identify(frame(spark, rows)).collect()} == {"und"}
    rows = [row(i, "the and of", "en") for i in range(6)]
    assert {(r.lang_pred, r.score > 0.9) for r in language_id.identify(frame(spark, rows)).collect()} == {("en", True)}
    assert language_id.identify(frame(spark, [])).count() == 0


def test_a_huge_language_keeps_its_share(spark):
    for n in (401, 10**6, 4 * 10**8 + 1, 10**12):
        share = (language_id.limit(n, 400) + 2**63) / 2**64
        assert abs(share * n - 400) < 1e-3
    rows = [row(i, "the and of", "en") for i in range(3000)] + [row(5000, "der die und", "de")]
    model = language_id.train(frame(spark, rows), per_language=30)
    assert model.languages == ["de", "en"]


def test_language_with_null_or_repeated_ids(spark):
    rng = random.Random(4)
    for ids in ([None], [7, 8, 9]):
        rows = [row(rng.choice(ids), " ".join(rng.choice(WORDS[lang].split()) for _ in range(20)), lang)
                for lang in ("en", "de") for _ in range(900)]
        model = language_id.train(frame(spark, rows), per_language=100)
        assert model.languages == ["de", "en"]
        assert [g[0] for g in model.predict(["der und die nicht", "the and of with"])] == ["de", "en"]
    same = [row(k, "the and of", "en") for k in range(2000)] + [row(k, "der die und", "de") for k in range(9)]
    assert language_id.train(frame(spark, same), per_language=5).languages == ["de", "en"]


def test_an_unlabelled_table_stays(spark):
    rows = [row(1, "the and", None), row(2, "77", None), row(3, None, None), row(None, "über", None), row(1, "", None)]
    assert sorted(r.text for r in language_id.drop_undetermined(frame(spark, rows)).collect()) == ["the and", "über"]
    assert language_id.drop_undetermined(frame(spark, [])).count() == 0


def test_all_labels_can_be_learned(spark):
    rows = [row(i, f"w{i} " * 5, f"l{i:03d}") for i in range(300)]
    model = None
    old = language_id.linear_svm
    try:                                                    # the machines are not the point
        language_id.linear_svm = lambda x, y: language_id.np.zeros(x.shape[1] + 1, "float32")
        model = language_id.train(frame(spark, rows))
    finally:
        language_id.linear_svm = old
    assert len(model.languages) == 300


def test_undetermined_rows_go(spark):
    rows = language_rows(n=40) + [row(900, None), row(901, "12 34")]
    got = language_id.drop_undetermined(frame(spark, rows))
    assert sorted(r.doc_id for r in got.collect()) == list(range(40))
    assert got.columns == frame(spark, rows).columns


# ------------------------------------------------------------- language model
def test_base_scores_and_held_out_gain(spark):
    rows = [r for r in corpus(n=60) if r[0] is not None] + [(800 + i, "fresh words " + str(i)) for i in range(10)]
    got = interpolated_lm.score(frame(spark, rows)).collect()
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", folded(t)) + [" "] for _, t in rows]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for words, h in zip(tokens, held) if not h for w in words)
    n, v = sum(c.values()), len(c)
    want = Counter((i, h, len(w), sum(x in c for x in w), n,
                    round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6))
                   for (i, _), w, h in zip(rows, tokens, held))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert all(r.score < 0 for r in got)


def test_far_words_are_joined(spark, monkeypatch):
    rows = [r for r in corpus(n=30) if r[0] is not None]
    near = {(r.doc_id, round(r.base_score, 6), round(r.score, 6), r.n_known) for r in interpolated_lm.score(frame(spark, rows)).collect()}
    monkeypatch.setattr(interpolated_lm, "COMMON", 0.01)
    far = {(r.doc_id, round(r.base_score, 6), round(r.score, 6), r.n_known) for r in interpolated_lm.score(frame(spark, rows)).collect()}
    assert near == far


def test_language_model_of_nothing(spark):
    assert interpolated_lm.score(frame(spark, [])).count() == 0
    i = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    r = interpolated_lm.score(frame(spark, [(i, "never seen")])).first()
    assert (r.train_tokens, r.n_tokens, r.n_known) == (0, 3, 0) and math.isfinite(r.score) and r.base_score == 0


def test_probabilities_of_a_context_sum_to_one():
    import numpy as np
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 6, 80) * 16 + rng.integers(0, 6, 80))
    s = interpolated_lm.Sequence(keys, rng.integers(0, 9, len(keys)), rng.integers(0, 4, len(keys)), 16, 2, 6)
    for context in range(6):
        assert abs((10 ** s.log10(context * 16 + np.arange(6))).sum() - 1) < 1e-9


def test_rare_words_are_scored_in_their_context(spark, monkeypatch):
    """Words that share a class: a pair that was seen is likelier than its words the other way round."""
    monkeypatch.setattr(interpolated_lm, "FREQUENT", 0.2)
    texts = [f"w{k % 300} v{k % 300}" for k in range(3000)]
    held = [i for i in range(9000, 9400) if zlib.crc32(str(i).encode()) % 5 == 1][:20]
    rows = list(enumerate(texts)) + [(i, f"w{k} v{k}" if k % 2 else f"v{k} w{k}") for k, i in enumerate(held)]
    got = {r.doc_id: r.score for r in interpolated_lm.score(frame(spark, rows)).collect()}
    assert min(got[i] for i in held[1::2]) > max(got[i] for i in held[::2]) + 1


def test_all_pairs_are_counted_whatever_the_chunks(spark, monkeypatch):
    rows = corpus(n=30)
    whole = sorted((r.doc_id or -1, round(r.base_score, 6), round(r.score, 6), r.n_known) for r in interpolated_lm.score(frame(spark, rows)).collect())
    written = {}
    real = interpolated_lm.table
    monkeypatch.setattr(interpolated_lm, "table", lambda df, name, *a: written.setdefault(name, real(df, name, *a)))
    monkeypatch.setattr(interpolated_lm, "CHUNK", 2000)
    monkeypatch.setattr(interpolated_lm, "BUCKET", 300)
    cut = sorted((r.doc_id or -1, round(r.base_score, 6), round(r.score, 6), r.n_known) for r in interpolated_lm.score(frame(spark, rows)).collect())
    assert cut == whole and len(whole) == len(rows) and written["chunks"].count() > 10
    words = [["^", *re.findall(r"[^\x20\x09-\x0D]+", folded(t)), "$"] for _, t in rows]
    train = [zlib.crc32(str("" if i is None else i).encode()) % 5 != 1 for i, _ in rows]
    want = Counter(p for w, t in zip(words, train) if t for p in zip(w, w[1:]))
    expected = Counter((i, tuple(want[p] for p in zip(w, w[1:]))) for (i, _), w in zip(rows, words))
    seen = Counter()
    for r in written["texts"].collect():
        n = interpolated_lm._unpack(bytes(r.pair_est)) + interpolated_lm._unpack(bytes(r.pair_dev))
        at = interpolated_lm.Events(r, 0).offsets
        seen.update((None if i is None else int(i), tuple(n[a:b].tolist())) for i, a, b in zip(r.ids, at, at[1:]))
    assert seen == expected


def test_byte_planes():
    import numpy as np
    for x in ([], [0], [255, 256, 0], [2**62, 1, 2**40]):
        assert interpolated_lm._unpack(interpolated_lm._pack(np.array(x, np.int64))).tolist() == x
    h = np.array([3, 2**63, 2**64 - 1], np.uint64)
    assert interpolated_lm._unpack_sorted(interpolated_lm._pack_sorted(h)).tolist() == h.tolist()


# ------------------------------------------------------------------ tokeniser
def reference_encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_equal_the_library(spark):
    rng = random.Random(7)
    letters = list("ab1 '  \n\t\r's'll've're'd'm!?é٣x\x1c\x85 😀́") + ["don't", "I'LL", "  ", "aaaaaaaa"]
    rows = corpus() + [(2000 + k, "".join(rng.choice(letters) for _ in range(rng.randrange(40)))) for k in range(300)]
    rows += [(3000, "z" * 5000), (3001, " " * 3000 + "x")]
    own = reference_encoding()
    want = Counter()
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, byte_bpe.token_digests(frame(spark, rows), RANKS).collect())) == want
    coded = byte_bpe.decode(byte_bpe.encode(frame(spark, rows[:60]), RANKS), RANKS).collect()
    assert Counter(bytes(r.decoded) for r in coded) == Counter((t or "").encode() for _, t in rows[:60])
    for r in coded:
        assert list(r.offsets) == sorted(r.offsets) and len(r.offsets) == len(r.ids)


def test_segments_do_not_change_tokens(monkeypatch):
    codec = byte_bpe.load_codec(RANKS)
    rng = random.Random(2)
    text = "".join(rng.choice("ab  'sd\n!1") for _ in range(4000))
    own = [i for s in byte_bpe.segments(text, 50) for i in codec.encode_many([s])[0][1].tolist()]
    assert own == reference_encoding().encode_ordinary(text)


# ----------------------------------------------------------------- pseudonyms
CARD, CARD2 = "4111111111111111", "5500005555555559"


def texts_of(spark, texts, **kw):
    rows = frame(spark, list(enumerate(texts)))
    return [r for r in pii.pseudonymise(rows, "k", **kw).orderBy("doc_id").collect()]


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms_link_and_keep_their_format(spark):
    texts = [f"card {CARD}.", "card 4111-1111-1111-1111, again", f"{CARD} and {CARD2}", "not 4111111111111112 a card",
             "born 1984-02-29, 29.02.1984 or 02/29/1984", "no date 1984-02-30", "call +1 (212) 555-0187 or 212-555-0187",
             "ip 192.168.0.1 not 999.1.1.1", "mail Ann.Lee42@example.org!", "ssn 123-45-6789 not 000-12-3456", None, "", "plain text"]
    got = texts_of(spark, texts)
    first = re.search(r"\d{16}", got[0].text)[0]
    assert luhn(first) and first != CARD and got[0].n_card == 1
    assert re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", got[1].text)[0].replace("-", "") == first
    assert got[2].text.split()[0] == first and got[2].n_card == 2
    assert got[3].text == texts[3] and not got[3].changed
    iso, dots, slash = re.findall(r"\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}", got[4].text)
    assert iso == f"{dots[6:]}-{dots[3:5]}-{dots[:2]}" == f"{slash[6:]}-{slash[:2]}-{slash[3:5]}" and got[4].n_date == 3
    assert got[5].n_found == 0
    a, b = re.findall(r"\(?\d{3}\)?[ -]\d{3}-\d{4}", got[6].text)
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) and got[6].text.startswith("call +1 (")
    assert got[7].n_ip == 1 and got[7].text.endswith("not 999.1.1.1") and "192.168.0.1" not in got[7].text
    assert re.fullmatch(r"mail [A-Z][a-z]{2}\.[A-Z][a-z]{2}\d{2}@example\.org!", got[8].text) and "Ann.Lee42" not in got[8].text
    assert got[9].n_ssn == 1 and "000-12-3456" in got[9].text
    assert got[10].text is None and got[10].n_found == 0 and got[11].text == "" and got[12].text == texts[12]


def test_cards_beside_other_numbers_are_found(spark):
    spaced = "4111 1111 1111 1111"
    texts = [spaced + " 123", f"12 {CARD}", f"12 27 {spaced}", f"1234 {spaced} 1234 5678", f"7 {CARD2} 4111-1111-1111-1111 9",
             f"12 {CARD} 212-555-0187", "1 2 3 4 5 6 7 8 9 0 1 2", None, f"x{CARD}0000"]
    got = texts_of(spark, texts)
    for r in got[:6]:
        assert not any(c in re.sub(r"[ -]", "", r.text) for c in (CARD, CARD2)) and r.n_card >= 1
    assert got[0].text.endswith(" 123") and got[1].text.startswith("12 ") and got[2].text.startswith("12 27 ")
    assert got[4].n_card == 2 and got[5].n_phone == 1 and got[6].text == texts[6] and got[7].text is None


def test_pseudonyms_can_be_inverted(spark):
    texts = [f"{CARD} x 10.20.30.40 x 1999-12-31 x 212-555-0187 x b.c1@d.org x 123-45-6789", "5.5.5.5", "01/31/2001"]
    back = pii.pseudonymise(pii.pseudonymise(frame(spark, list(enumerate(texts))), "k"), "k", decrypt=True)
    assert [r.text for r in back.orderBy("doc_id").collect()] == texts


def test_day_permutation_is_one_to_one(spark):
    from pyspark.sql import functions as F
    days = spark.range(pii.CYCLE).withColumn("p", pii.permute_pair(
        F.floor(F.col("id") / pii.NARROW), F.col("id") % pii.NARROW, pii.WIDE, pii.NARROW, "k", "date"))
    assert pii.WIDE * pii.NARROW == pii.CYCLE
    assert days.limit(3000).select("p.*").distinct().count() == 3000


# ------------------------------------------------------------------- licenses
def brute_license(text):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    words = licenses.words_of(text or "")
    found = set()
    for name, own in scanner.templates:
        n = len(own)
        for a in range(len(words)):
            got = licenses.patience(words[a:a + int(n * 1.25) + 2], own)
            if len(got) >= licenses.COVERAGE * n - 1e-9:
                found.add(name)
                break
    return found


def test_licenses_against_every_window(spark):
    long = licenses.TEMPLATES["MIT"][2]
    edited = " ".join(w for k, w in enumerate(long.split()) if k % 12 != 5)
    texts = ["x " * 50 + "\nReleased under the MIT License.\n" + "y " * 50, long, edited, "tail " + edited.upper() + " end",
             "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0. And released under the MIT License!",
             "a license to kill, version 3 of the film", None, "", "the mit campus was released", " ".join(long.split()[::-1])]
    rows = list(enumerate(texts)) + [(None, long), (1, long)]
    got = licenses.scan_licenses(frame(spark, rows)).collect()
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        assert set(r.licenses) <= brute_license(text) and bool(r.licenses) == bool(brute_license(text))
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[0].license == "MIT" and (by[0].begin, by[0].stop, by[0].coverage) == (50, 55, 1.0)
    assert by[2].license == "MIT" and 0.85 <= by[2].coverage < 1 and by[6].license is None
    assert set(by[5].licenses) == {"CC-BY-NC-4.0", "MIT"}
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_second_place_of_a_license_is_found():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    text = "This work is licensed under the GNU General Public License, version 3. " + "x " * 40 \
        + "This code is licensed under the GNU General Public License, version 2."
    got = scanner.scan(text)
    assert [g[0] for g in got] == ["GPL-3.0", "GPL-2.0"] and got[1][2] >= 52
    assert all(a[3] <= b[2] or b[3] <= a[2] for a in got for b in got if a is not b)


def test_patience_matches_are_increasing_and_equal():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(15))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randrange(15))]
        got = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert licenses.patience(list("xabcy"), list("abc")) == [(1, 0), (2, 1), (3, 2)]


# ------------------------------------------------------------ decontamination
def substring_distance(a, t):
    last = [0] * (len(t) + 1)
    for i in range(1, len(a) + 1):
        now = [i] + [0] * len(t)
        for j in range(1, len(t) + 1):
            now[j] = min(last[j - 1] + (a[i - 1] != t[j - 1]), last[j] + 1, now[j - 1] + 1)
        last = now
    return min(last)


def norm(t):
    return re.sub(r"[\W_]+", " ", (t or "").lower()).strip()


def edit(rng, text, n):
    for _ in range(n):
        k = rng.randrange(len(text))
        text = rng.choice([text[:k] + text[k + 1:], text[:k] + "q" + text[k:], text[:k] + "q" + text[k + 1:]])
    return text


@pytest.mark.parametrize("block", [20_000, 3])
def test_contamination_against_all_distances(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
    rng = random.Random(11)
    from .cases import sentence
    items = [(k, sentence(rng, 14)) for k in range(8)] + [(90, "short"), (91, None), (0, "tiny"), (3, sentence(rng, 12))]
    docs = [(i, sentence(rng, 30)) for i in range(12)]
    for n, (k, t) in enumerate(items[:8] * 2):
        docs.append((100 + n, sentence(rng, 9) + " " + edit(rng, t, n) + " " + sentence(rng, 9)))
    docs += [(200, items[2][1].upper()), (201, None), (202, ""), (203, items[1][1] + "\n" + items[4][1]), (204, "!!" + items[5][1].replace(" ", " -- "))]
    docs += [(None, items[1][1]), (203, items[1][1] + "\n" + items[4][1])]
    want = Counter()
    for i, t in docs:
        found = {}
        for k, item in items:
            item = norm(item)
            d = substring_distance(item, norm(t)) if len(item) >= decontaminate.SHORTEST else 10**6
            if d <= int(len(item) * decontaminate.RATE):
                found[k] = min(d, found.get(k, d))
        want[(i, bool(found), len(found), tuple(sorted(found)), min(found.values(), default=None))] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, docs), bench).collect()
    assert Counter((r.doc_id, r.contaminated, len(set(r.item_ids)), tuple(r.item_ids), r.min_distance) for r in got) == want
    left = decontaminate.drop_contaminated(frame(spark, docs), bench)
    assert Counter(r.doc_id for r in left.collect()) == Counter(i for (i, bad, *_), n in want.items() for _ in range(n) if not bad)


@pytest.mark.parametrize("block", [20_000, 1])
def test_short_items_and_items_without_id_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
    items = [(1, "What is the capital of France?"), (None, "a text without an id that is longer than forty characters"), (2, "法国的首都是哪里"), (3, "!?")]
    docs = [(1, "So: what is the  CAPITAL of France, then?"), (2, "somewhat is the capital of france"), (3, "what is the capital of frances"),
            (4, "x " + items[1][1]), (5, "请问法国的首都是哪里呢"), (6, None), (7, "clean"), (7, "clean"), (8, items[0][1] + items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: list(r.item_ids) for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert got == {1: [1], 2: [], 3: [], 4: [None], 5: [2], 6: [], 7: [], 8: [1, 2]}
    left = decontaminate.drop_contaminated(frame(spark, docs), bench)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 6, 7, 7] and left.columns == frame(spark, docs).columns


def test_stretches_do_not_lose_short_items(monkeypatch):
    text = "ab cd " * 50 + "what is it" + " xcd" * 50
    for size in (20, 33, 10**6):
        monkeypatch.setattr(decontaminate, "STRETCH", size)
        assert decontaminate.Matcher([(1, "what is it"), (2, "b cd"), (3, "what is i")]).matches(text) == {1: 0}


def test_stretches_do_not_lose_matches(monkeypatch):
    rng = random.Random(1)
    item = "".join(rng.choice("abcdefg ") for _ in range(80))
    text = "".join(rng.choice("abcdefg ") for _ in range(950)) + item + "x" * 500
    for size in (100, 333, 10**6):
        monkeypatch.setattr(decontaminate, "STRETCH", size)
        assert decontaminate.Matcher([(1, item)]).matches(text) == {1: 0}


def test_empty_benchmark_or_corpus(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(frame(spark, [(1, "a b c")]), none).first().contaminated is False
    bench = spark.createDataFrame([(1, "x" * 60)], "item_id long, text string")
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0


def test_pseudonyms_of_very_long_texts(spark):
    import time
    size = 1 << 18
    texts = ["x" * size, "a." * (size // 2), "1 " + "a." * 10000, "1 " * (size // 2), "@" * size, "a@b." * (size // 4), "12-" * (size // 3),
             "a" * 20000 + "@example.com", "a." * 40 + "b@example.com", "x@" + "y." * 100 + "org", "1.2.3." * 100000]
    times = []
    for t in texts:
        began = time.time()
        got = pii.pseudonymise(frame(spark, [(1, t + " 1")]), "k").first()
        times.append(time.time() - began)
        assert len(got.text) == len(t) + 2
        if "example" in t or t.endswith("org"):
            assert got.n_email == 1 and got.text != t + " 1"
    assert max(times) < 10, times                          # quadratic scans took minutes, or the JVM
    rng = random.Random(1)
    table = " ".join(str(rng.randrange(10**4)).zfill(4) for _ in range(5000))
    got = pii.pseudonymise(frame(spark, [(1, table)]), "k").first()
    assert got.n_card > 200 and len(got.text) == len(table)
