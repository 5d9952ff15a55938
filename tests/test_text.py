"""Text expressions against the rules they implement, on the edge rows of FIXTURES.md."""

import re

from pyspark.sql import functions as F

from vetta.functions.text import clean_tweet, collapse_ws, lexicon_hit, strip_dashes
from vetta.operators import cleaning as C


def tweet_rule(t):
    """Brute-force statement of the cleaning rule with Python's re (str patterns)."""
    if t is None:
        return None
    for pat, rep in [(r'"+', ""), (r"@\w+", ""), (r"http\S+", ""), (r"&+\S*", ""),
                     (r"!+\S*", ""), (r"RT", "")]:
        t = re.sub(pat, rep, t)
    return re.sub(r"\s+", " ", t).strip()


def one_col(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(fn("t")).collect()]


def test_clean_tweet_edge_rows(spark):
    rows = ['!!! RT @mayasolovely: As a woman you "shouldn\'t" complain &#8220;x y',
            "SMART http://x.co/a b", "héllo @josé_1 x", "&#8220;x y", "@x² y", None,
            'a  b　c\u001cd\u0085e', "x RT y !bang z"]
    assert one_col(spark, rows, clean_tweet) == [tweet_rule(r) for r in rows]


def test_clean_tweet_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r[0] for r in docs]
    assert one_col(spark, texts, clean_tweet) == [tweet_rule(t) for t in texts]


def test_collapse_ws(spark):
    rows = ["a\u001cb", "a b", "a\u0085b", "a　b", "a​b", "", "  x \t\n y  "]
    expected = [" ".join(r.replace("\t", " ").replace("\n", " ").split()) for r in rows]
    assert one_col(spark, rows, collapse_ws) == expected
    assert "​" in one_col(spark, ["a​b"], collapse_ws)[0]  # zero-width space stays


def test_strip_dashes_and_alpha(spark):
    rows = ["- a", "-- b ", " - c", "123"]
    assert one_col(spark, rows, strip_dashes) == ["a", "b", "- c", "123"]
    df = spark.createDataFrame([(r,) for r in rows], "text string")
    kept = [r[0] for r in C.clean_sentences(df).collect()]
    assert kept == ["a", "b", "- c"]


def test_lexicon_substring_and_whole_word(spark):
    rows = ["Trash", "trashy", "t r a s h", "a trash can", None]
    sub = one_col(spark, rows, lambda c: lexicon_hit(c, ["trash"]))
    whole = one_col(spark, rows, lambda c: lexicon_hit(c, ["trash"], whole_word=True))
    assert sub == [1, 1, 0, 1, None]
    assert whole == [1, 0, 0, 1, None]


def test_render_message_nulls_and_ratings(spark):
    df = spark.createDataFrame(
        [("B", "c", None, "r", 3.0, None), (None, None, "d", None, 3.5, "resp")],
        "business_name string, category string, description string, review string, "
        "rating double, response string")
    out = [r[0] for r in C.render_message(df).select("user_message").collect()]
    assert out[0] == ("Business Name: B\nCategory: c\nDescription: N/A\nReview: r\n"
                      "Rating: 3\nResponse: N/A")
    assert out[1].split("\n")[4] == "Rating: 3.5"


def test_render_prompt_matches_serving_format(spark):
    req = {"name": "Cafe", "category": "Food", "description": "Nice", "review": "Good\nfood",
           "rating": 4.0}
    df = spark.createDataFrame([req], "name string, category string, description string, "
                                      "review string, rating double")
    got = C.render_prompt(df).select("prompt").first()[0]
    pad = " " * 12
    expected = (f"\n{pad}Business Name: Cafe\n{pad}Category: Food\n{pad}Description: Nice\n"
                f"{pad}Review: Good\nfood\n{pad}Rating: 4\n        ").replace("\n", "").strip()
    assert got == expected


def test_drop_placeholders(spark):
    df = spark.createDataFrame([("Fallback spam review for X",), ("a fallBACK",), (None,), ("ok",)],
                               "review string")
    assert sorted([r[0] for r in C.drop_placeholders(df).collect()], key=str) == [None, "ok"]


def test_extract_json_fixtures(spark):
    from pyspark.sql import types as T
    content = ('```json\n[{"review": "a", "rating": 5}, {"review": "b", "rating": 2}]\n```'
               ' {"review": "n", "meta": {"k": 1}, "rating": 3}'
               ' {"review": "has } brace", "rating": 1} {"review": "unclosed"')
    df = spark.createDataFrame([(1, content)], "batch_id long, content string")
    sch = T.StructType([T.StructField("review", T.StringType()),
                        T.StructField("rating", T.DoubleType())])
    got = [(r.review, r.rating) for r in C.extract_json(df, "content", sch, keep=["batch_id"])
           .orderBy("obj_pos").collect()]
    # the brace inside a string breaks that group (it does not parse) and is dropped
    assert got == [("a", 5.0), ("b", 2.0), ("n", 3.0)]


def test_validate_requests(spark):
    df = spark.createDataFrame([("n", "c", "d", None, 1.0), ("", "c", "d", "r", 1.0),
                                ("n", "c", "d", "r", 2.0)],
                               "name string, category string, description string, review string, "
                               "rating double")
    ok, bad = C.validate_requests(df)
    assert ok.count() == 1
    assert sorted(r.error for r in bad.collect()) == ["missing name", "missing review"]


def test_explode_prompts(spark):
    df = spark.createDataFrame([("a\\nb\\nc", "g", 1), (None, "g2", 0), ("p", None, 1)],
                               "prompt string, generation string, prompt_label int")
    rows = [(r.text, r.unsafe_label) for r in C.explode_prompts(df).collect()]
    assert rows == [("a", 1), ("b", 1), ("c", 1), ("g", 1), ("g2", 0), ("p", 1), (None, 1)]
    assert C.drop_null(C.explode_prompts(df)).count() == 6


def test_parse_labels(spark):
    good_vals = ["0", "1", "1.0", " 1 ", "1e0", "0.9", "-0.5"]
    bad_vals = ["2", "nan", "inf", "", "yes"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(good_vals + bad_vals)],
                               "i int, x string")
    good, bad = C.parse_labels(df, ["x"])
    assert [r.x for r in good.orderBy("i").collect()] == [0, 1, 1, 1, 1, 0, 0]
    assert bad.count() == len(bad_vals)
    import pytest
    with pytest.raises(Exception):
        C.parse_labels(df, ["x"], strict=True)[0].collect()


def test_band_label(spark):
    df = spark.createDataFrame([(2.0,), (2.2,), (2.5,), (2.6,)], "s double")
    assert [r.unsafe_label for r in C.band_label(df, "s").collect()] == [0, 1]


def test_any_flag(spark):
    from vetta.functions.labels import any_flag
    df = spark.createDataFrame([(0, 0), (0, 1), (None, None)], "a int, b int")
    assert [r[0] for r in df.select(any_flag(["a", "b"])).collect()] == [0, 1, 0]


def test_label_line(spark):
    from vetta.functions.text import label_line
    df = spark.createDataFrame([(1, "x"), (0, "y")], "l int, t string")
    assert [r[0] for r in df.select(label_line("l", "t")).collect()] == \
        ["__label__pos x", "__label__neg y"]
    assert [r[0] for r in df.select(label_line("l", "t", positive_value=0)).collect()] == \
        ["__label__neg x", "__label__pos y"]


def test_whitespace_class_matches_python(spark):
    chars = [chr(c) for c in range(0, 0x3100) if chr(c).isspace()]
    df = spark.createDataFrame([(f"a{c}b",) for c in chars], "t string")
    got = [r[0] for r in df.select(collapse_ws("t")).collect()]
    assert got == ["a b"] * len(chars)
    assert F is not None


def test_json_objects_in_hostile_text(spark):
    from pyspark.sql import types as T
    from vetta.operators import cleaning as C
    sch = T.StructType([T.StructField("review", T.StringType()), T.StructField("rating", T.DoubleType())])
    nested = "{" + "{a}" * 20000 + "}"
    rows = [(1, nested), (2, 'x {"review": "says \\"no\\" {once}", "rating": "5"} y'), (3, '{"rating": "many"} {bad'), (4, None)]
    got = C.extract_json(spark.createDataFrame(rows, "id int, t string"), "t", sch, keep=["id"]).collect()
    assert sorted((r.id, r.review, r.rating) for r in got if r.id == 2) == [(2, 'says "no" {once}', 5.0)]
    assert [(r.review, r.rating) for r in got if r.id == 3] == [(None, None)] and {r.id for r in got} == {2, 3}


def test_strip_is_linear_and_label_numbers_strict(spark):
    import time
    from pyspark.sql import functions as F
    from vetta.functions.labels import parse_label
    from vetta.functions.text import strip_ws
    t0 = time.time()
    text = "a" + " " * 60000 + "b"
    assert spark.createDataFrame([(f"\u2003\n {text}\x1f ",)], "t string").select(strip_ws("t")).first()[0] == text
    assert time.time() - t0 < 20
    df = spark.createDataFrame([(x,) for x in ["1d", "0f", "1", " 0.9 ", "+1", "1e0", ".5", "1_0", "0x1", "nan"]], "t string")
    assert [r[0] for r in df.select(parse_label(F.col("t"))).collect()] == [None, None, 1, 0, 1, 1, 0, None, None, None]


def test_whole_words_are_quoted_everywhere(spark):
    from vetta.functions.text import lexicon_hit
    from vetta.operators.features import lexicon_join, lexicon_stage
    df = spark.createDataFrame([(1, "pay a$$ now"), (2, "pay a now"), (3, "It's BAD stuff"), (4, None), (5, "very bad idea")],
                               "id int, text string")
    words = ["a$$", "it's", "bad idea"]
    stage = lexicon_stage(words, "text", "lex", whole_word=True).transform(df)
    assert {r.id: r.lex for r in stage.collect()} == {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.0, 5: 1.0}
    hits = df.select("id", lexicon_hit("text", words, whole_word=True).alias("h")).collect()
    assert {r.id: r.h for r in hits} == {1: 1, 2: 0, 3: 1, 4: None, 5: 1}
    table = spark.createDataFrame([("bad idea",), ("Stuff",)], "word string")
    assert {r.id: r.lexicon for r in lexicon_join(df, "id", "text", table).collect()} == {1: 0, 2: 0, 3: 1, 4: None, 5: 1}
