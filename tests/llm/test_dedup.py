"""Exact, near, line and byte-string de-duplication against brute force."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vetta.llm import exact_dedup, line_dedup, near_dedup, suffix_dedup
from vetta.llm.common import CLEAN_UP, components, linked, table

from .cases import corpus, folded, frame


def test_components_against_union_find(spark):
    import random
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_tables_leave_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}
    before, setting = shuffled(), spark.conf.get(CLEAN_UP, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    made = table(df.join(df.withColumnRenamed("count", "n").repartition(3, "k"), "k"), "probe")
    for _ in range(50):                                   # files are removed in the background
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    assert made.count() == 7 and spark.conf.get(CLEAN_UP, None) == setting


def test_exact_groups(spark):
    rows = corpus()
    got = exact_dedup.exact_groups(frame(spark, rows)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[folded(t)].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert Counter(map(tuple, got)) == Counter(want)


def test_chunks_are_the_text(spark):
    rows = corpus() + [(900, "x" * 9000), (901, "a.\n" * 3000)]
    got = frame(spark, rows).select("text", exact_dedup.chunks(exact_dedup.text_of("text")).alias("c")).collect()
    for r in got:
        assert "".join(r.c) == (r.text or "")
        assert all(len(c) <= exact_dedup.MAX_CHUNK for c in r.c)


def test_clashing_identifiers_fall_back_to_texts(spark, monkeypatch):
    rows = corpus()
    plain = {tuple(r) for r in exact_dedup.exact_groups(frame(spark, rows)).collect()}
    short = exact_dedup.F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: exact_dedup.F.pmod(short(*c), exact_dedup.F.lit(5)))
    assert {tuple(r) for r in exact_dedup.exact_groups(frame(spark, rows)).collect()} == plain


def test_drop_exact_leaves_one_of_each(spark):
    rows = corpus()
    got = exact_dedup.drop_exact(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    assert Counter(folded(r.text) for r in got.collect()) == Counter({folded(t): 1 for _, t in rows})


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", folded(text))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, numerator, denominator):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(range(len(rows)), 2):
        common, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if union and denominator * common >= numerator * union:
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k)), i == least.get(find(k))) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("numerator", [85, 60])
def test_near_components(spark, numerator):
    rows = corpus(seed=8, n=60)
    got = near_dedup.near_components(frame(spark, rows), numerator=numerator).collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(rows, numerator, 100))


def test_drop_near_keeps_clean_documents(spark):
    rows = [r for r in corpus(seed=9) if r[0] is not None][:-2]
    got = near_dedup.drop_near(frame(spark, rows))
    kept = {i for i, _, _, keep in brute_components(rows, 80, 100) if keep}
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept)
    assert got.columns == frame(spark, rows).columns


def link_sets(spark, sets, buckets, numerator, denominator):
    """Components by ``linked`` over explicit sets (node -> set), the pairs confirmed, and brute force."""
    from pyspark.sql import functions as F
    table = spark.createDataFrame([(n, sorted(s)) for n, s in sets.items()], "node long, s array<long>").cache()
    member = spark.createDataFrame([(b, n, busy) for b, nodes in buckets.items() for n, busy in nodes], "band long, node long, busy long")
    pairs = []

    def joined(met, u, v):
        a = table.select(F.col("node").alias(u), F.col("s").alias("a"))
        return met.join(a, u).join(table.select(F.col("node").alias(v), F.col("s").alias("b")), v)

    def confirm(met):
        pairs.append(met.count())
        common = F.size(F.array_intersect("a", "b"))
        return joined(met, "u", "v").filter(common * denominator >= (F.size("a") + F.size("b") - common) * numerator).select("u", "v")

    def differences(met):
        return joined(met, "hub", "node").select("hub", "node", F.size("a").alias("nh"), F.size("b").alias("nx"),
                                                 F.concat(F.array_except("a", "b"), F.array_except("b", "a")).alias("d"))

    got = {r.node: r.root for r in linked(member, confirm, differences, numerator, denominator).collect()}
    def brute(groups):
        parent = {n: n for n in sets}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for nodes in groups:
            for a, b in itertools.combinations(nodes, 2):
                common = len(sets[a] & sets[b])
                if common * denominator >= (len(sets[a]) + len(sets[b]) - common) * numerator:
                    a, b = sorted((find(a), find(b)))
                    parent[b] = a
        return {n: find(n) for n in sets}

    want, most = brute([n for n, _ in nodes] for nodes in buckets.values()), brute([list(sets)])
    for n in sets:                                        # no link of a bucket missed, none but true ones found
        assert got.get(n, n) == got.get(want[n], want[n]) and most[got.get(n, n)] == most[n]
    return sum(pairs), len(set(want.values()))


def test_links_that_no_hub_is_part_of(spark):
    numerator, rng = 85, random.Random(85)
    chain = {n: set(range(4 * n, 4 * n + 60)) for n in range(1, 121)}       # each like the next ones alone
    busy = {n: 1000 - n for n in chain}
    pairs, _ = link_sets(spark, chain, {1: list(busy.items())}, numerator, 100)
    assert pairs < 40 * len(chain) / 2
    # copies with windows of their own replaced, a few or many, a cluster among them, and a hub unlike all
    star = {}
    for n in range(1, 401):
        copy = set(range(150))
        for k in range(rng.randrange(2, 9)):
            at = rng.randrange(146)
            copy = copy - set(range(at, at + 5)) | {1000 * n + 10 * k + w for w in range(5)}
        star[n] = copy
    star |= {n: set(range(1, 130)) | {7, 10**6 + n % 3} | set(range(2000, 2060)) for n in range(401, 431)}
    star[500] = set(range(30, 100)) | set(range(5000, 5040))
    pairs, groups = link_sets(spark, star, {1: [(n, 900 if n == 500 else n) for n in star]}, numerator, 100)
    assert groups > 50 and pairs < 20 * len(star)
    # several buckets with random sets of random sizes
    mixed = {n: set(rng.sample(range(40), rng.randrange(1, 40))) for n in range(1, 200)}
    buckets = {b: [(n, rng.randrange(9)) for n in rng.sample(sorted(mixed), 40)] for b in range(6)}
    busy = {n: rng.randrange(9) for n in mixed}
    link_sets(spark, mixed, {b: [(n, busy[n]) for n, _ in nodes] for b, nodes in buckets.items()}, numerator, 100)


def test_nodes_on_one_side_of_a_bucket_are_not_compared(spark):
    # far from the hub by 20 shared elements; the large ones, unlike each other, look for smaller ones alone
    far = set(range(100)) | set(range(200, 220))
    sets = {1: far, 2: far | {300}}
    for n in range(10, 50):
        sets[n] = far | {1000 + 10 * (n // 2) + w for w in range(7)} | {10000 + 100 * n + w for w in range(16)}
    sets[500] = set(range(100))
    pairs, groups = link_sets(spark, sets, {1: [(n, n) for n in sets]}, 85, 100)
    assert groups == 42 and pairs < 8 * len(sets)


def test_minhash_agreement_estimates_similarity():
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1200).astype(np.uint64)
    a, b = np.sort(x[:1000]), np.sort(x[200:])
    agree = (near_dedup.signature(a, 400) == near_dedup.signature(b, 400)).mean()
    assert abs(agree - 800 / 1200) < 0.08


BLANK = " \t\n\x0b\f\r"
STEP = re.compile(f"(?s)[\x21-\u2E7F]{{1,{line_dedup.STEP}}}[{BLANK}]*|[^{BLANK}][{BLANK}]*|[{BLANK}]+")


def line_set(line):
    """The shingles by the rule in plain Python: 10 characters from every step's start."""
    blanks = " \t\n\x0b\f\r"

    def run(k):
        c = ord(line[k]) if k < len(line) else 0
        unspaced = 0xE00 <= c <= 0x109F or 0x1780 <= c <= 0x17FF or 0x1950 <= c <= 0x1AAF or 0x1B00 <= c <= 0x1B7F
        return 0x21 <= c <= 0x2E7F and not unspaced

    def after_blanks(k):
        while k < len(line) and line[k] in blanks:
            k += 1
        return k
    at, out = 0, set()
    while at < len(line):
        out.add(line[at:at + 10])
        n = 0
        while n < 8 and run(at + n):
            n += 1
        if n and not run(at + n):                         # the end of a run
            at = after_blanks(at + n)
            continue
        m = 0
        while m < 7 and at + m < len(line) and 0x21 <= ord(line[at + m]) <= 0x24F and line[at + m] not in "dltDLT149":
            m += 1
        if at + m < len(line) and line[at + m] in "dltDLT149":
            at += m + 1
        elif run(at):
            at += 1
        elif line[at] not in blanks:
            at = after_blanks(at + 1)
        else:
            at = after_blanks(at)
    return out


def test_line_sets_follow_the_rule(spark):
    rng = random.Random(6)
    lines = ["A line that many documents share, word for word.", "x" * 50, "การทดสอบ ภาษาไทย", "漢字かな交じり文 and more", "  lead", "\x00\x01 odd\t\tends  "]
    lines += ["".join(rng.choice("ab dlt19 .é漢ก\t") for _ in range(rng.randrange(1, 80))) for _ in range(150)]
    rows = spark.createDataFrame([(t,) for t in lines], "line string").select("line", line_dedup.shingles(line_dedup.F.col("line")).alias("s"))
    for r in rows.collect():
        assert set(r.s) == line_set(r.line), r.line


def test_rows_that_share_an_id_lose_their_own_lines_only(spark):
    shared = "A line that several documents hold in full length."
    rows = [(None, f"{shared}\nTail one of it alone."), (None, f"A first remark of its own.\n{shared}"), (None, f"Another opening, unlike all.\nmiddle\n{shared}"),
            (5, f"{shared}\nfirst five"), (5, f"second five\nends differently"), (5, f"{shared}\nfirst five")]
    out = sorted(r.text for r in line_dedup.drop_duplicate_lines(frame(spark, rows)).collect())
    assert out == sorted([f"{shared}\nTail one of it alone.", "A first remark of its own.", "Another opening, unlike all.\nmiddle",
                          "first five", "second five\nends differently", "first five"])
    report = line_dedup.line_report(frame(spark, rows)).collect()
    assert len(report) == 6 and sorted(r.n_dropped for r in report) == [0, 0, 1, 1, 1, 1]


def test_lines_against_brute_force(spark):
    rows = [r for r in corpus(seed=4) if r[0] != 3][:-2]
    rows += [(500, "A line that many documents share, word for word.\nunique tail five hundred"),
             (501, "\n\nA line that many documents share, word for word.\n\nunique tail 501"),
             (502, "A line that many documents share, word for word!\nA line that many documents share, word for word.")]
    rows = [r for r in rows if r[0] is not None]
    got = {r.doc_id: (r.n_lines, list(r.dropped), list(r.keep_ids)) for r in line_dedup.line_report(frame(spark, rows)).collect()}
    places = sorted((i, at, line) for i, t in rows for at, line in enumerate((t or "").split("\n")) if line.strip(" "))
    texts = sorted({p[2] for p in places})
    sets = {t: line_set(t) for t in texts}
    parent = {t: t for t in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(texts, 2):
        common = len(sets[a] & sets[b])
        if common * 100 >= 80 * (len(sets[a]) + len(sets[b]) - common):
            parent[find(a)] = find(b)
    seen, dropped, keeps = {}, defaultdict(list), defaultdict(list)
    for i, at, line in places:
        root = find(line)
        if root in seen:
            dropped[i].append(at)
            keeps[i].append(seen[root])
        seen.setdefault(root, i)
    assert got == {i: (len((t or "").split("\n")), dropped[i], keeps[i]) for i, t in rows}
    out = {r.doc_id: r.text for r in line_dedup.drop_duplicate_lines(frame(spark, rows)).collect()}
    for i, t in rows:
        want = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in dropped[i])
        assert out[i] == want


def test_small_sets_of_every_size_are_candidates(spark):
    import random
    rng = random.Random(21)
    rows, pairs = [], []
    for n in [*range(1, 20)] * 12:                        # n shingles common, up to a fifth of the larger set not
        words = [f"w{rng.randrange(10**6):06d}xx" for _ in range(n + n // 4)]
        more = words[:n], words[:n + rng.randrange(n // 4 + 1)]
        pairs.append(len(rows))
        rows += [(len(rows) + k, w) for k, w in enumerate(more)]
    # one shingle a word, whatever stands beside it
    lines = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "node long, line string")
    plain = lines.select("node", "line")
    old = line_dedup.SHINGLE
    try:
        line_dedup.SHINGLE = r"(\S+)"
        keys = {r.node: list(r.bands) for r in line_dedup.band_keys(plain).collect()}
    finally:
        line_dedup.SHINGLE = old
    assert [i for i in pairs if not set(keys[i]) & set(keys[i + 1])] == []
    assert all(len(k) == len(set(k)) for k in keys.values())


def test_inserted_characters_change_only_near_shingles(spark):
    import random
    rng = random.Random(22)
    long = ["".join(rng.choice(letters) for _ in range(160)) for letters in
            ("กขคงจฉชซญฎฏฐดตถทธนบปผฝพฟภมยรลวศษสห", "abcdefghijklmnopqrstuvwxyz/.-=&0123456789", "0123456789abcdef", "абвгдежзийклмноп", "aeiou")]
    rows = [(2 * k + e, t[:9] + "x" * e + t[9:]) for k, t in enumerate(long) for e in (0, 1)]
    rows += [(10, "the plain words"), (11, "a" * 40)]
    got = {r.node: set(r.s) for r in spark.createDataFrame(rows, "node long, line string")
           .select("node", line_dedup.shingles(line_dedup.F.col("line")).alias("s")).collect()}
    for k in range(len(long)):
        a, b = got[2 * k], got[2 * k + 1]
        assert len(a & b) >= 0.7 * len(a | b), (k, len(a & b), len(a | b))
    assert got[10] == {"the plain ", "plain word", "words"} and "a" * 10 in got[11]


def test_shingles_are_those_of_the_class_intersections(spark):
    """The classes of the pattern are written out; they match what the intersections match, at every edge of a range too."""
    unspaced = r"\x{0E00}-\x{109F}\x{1780}-\x{17FF}\x{1950}-\x{1AAF}\x{1B00}-\x{1B7F}"
    run = rf"[\x21-\x{{2E7F}}&&[^{unspaced}]]"
    before = (rf"(?s)(?=(.{{1,10}}))(?:{run}{{1,8}}+(?!{run})\s*+"
              rf"|[\x21-\x{{24F}}&&[^dltDLT149]]{{0,7}}+[dltDLT149]|{run}|\S\s*+|\s++)")
    edges = [0x21, 0x7F, 0x24F, 0xE00, 0x10A0, 0x1780, 0x1800, 0x1950, 0x1AB0, 0x1B00, 0x1B80, 0x2E7F, 0x10000, 0x1F600]
    letters = [chr(c + k) for c in edges for k in (-1, 0, 1)] + list(" \t\r\x0b\x1f\xa0ab dlt149DLT.")
    rng = random.Random(31)
    lines = [c * n for c in letters for n in (1, 9, 12)]
    lines += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in lines], "line string").select(
        "line", line_dedup.shingles(F.col("line")).alias("s"),
        F.array_distinct(F.regexp_extract_all("line", F.lit(before), F.lit(1))).alias("before")).collect()
    assert [r.line for r in rows if r.s != r.before] == []
    assert "&&" not in line_dedup.SHINGLE


def test_pairs_are_confirmed_on_sets_made_once(spark):
    sets = {1: range(100), 2: range(10, 100), 3: range(19, 100), 4: range(20, 99), 5: range(90), 6: [7], 7: [7], 8: [8]}
    frame_ = spark.createDataFrame([(n, list(s)) for n, s in sets.items()], "node long, h array<long>")
    pairs = list(itertools.combinations(sets, 2))
    met = spark.createDataFrame(pairs, "u long, v long")
    out = line_dedup.confirmed(met, frame_, 80, 100)
    want = [(u, v) for u, v in pairs if 100 * len(set(sets[u]) & set(sets[v])) >= 80 * len(set(sets[u]) | set(sets[v]))]
    assert sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1 and "regexp" not in plan
    hubs = met.select(F.col("u").alias("hub"), F.col("v").alias("node"))
    found = line_dedup.differences(hubs, frame_)
    assert {(r.hub, r.node, r.nh, r.nx, frozenset(r.d)) for r in found.collect()} == {
        (u, v, len(sets[u]), len(sets[v]), frozenset(set(sets[u]) ^ set(sets[v]))) for u, v in pairs}
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()


def brute_cut(rows, length=suffix_dedup.LENGTH):
    first, out = {}, []
    for i, t in sorted(set(rows), key=lambda r: (-2**63 if r[0] is None else r[0])):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            piece = raw[s:s + length]
            if piece in first:
                gone[s:s + length] = b"\1" * length
            else:
                first[piece] = True
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        left = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def test_byte_strings_against_brute_force(spark):
    shared = "This passage stands in a number of documents, é and all, and it is longer than one hundred bytes by far. " * 2
    rows = corpus(seed=6) + [(600 + k, f"{k} lead {shared[k:]} tail {k}") for k in range(5)]
    rows += [(700, "ab" * 400), (701, "é" * 300), (702, shared + "x" + shared), (703, "x" + "ab" * 500 + shared)]
    rows += [(710 + k, "Is onhe. " * (20 + k) + shared[k:]) for k in range(12)]
    got = suffix_dedup.cut_repeats(frame(spark, rows)).collect()
    assert {tuple(r) for r in got} == set(brute_cut(rows))
    assert len(got) == len(rows)


def test_hot_strings_take_the_grouped_path(spark, monkeypatch):
    rows = corpus(seed=6)
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    got = suffix_dedup.cut_repeats(frame(spark, rows)).collect()
    assert {tuple(r) for r in got} == set(brute_cut(rows))


def test_multikey_order_is_byte_order():
    import numpy as np
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 99, (500, 24)).astype(np.uint8)
    order = suffix_dedup.multikey_order(rows)
    assert [bytes(rows[i]) for i in order] == sorted(bytes(r) for r in rows)


def test_empty_table(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_exact(none).count() == 0
    assert near_dedup.near_components(none).count() == 0
    assert line_dedup.line_report(none).count() == 0
    assert suffix_dedup.cut_repeats(none).count() == 0
