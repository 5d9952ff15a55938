"""DuckDB spellings of the text expressions in ``vetta.functions`` (oracle side only)."""

from __future__ import annotations

from vetta.functions.text import TWEET_CHAIN, WS

# RE2 has no possessive quantifiers and needs none
JSON_OBJECT = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def collapse_ws(e: str) -> str:
    return f"trim(regexp_replace({e}, {q(WS + '+')}, ' ', 'g'))"


def strip_ws(e: str) -> str:
    return f"regexp_replace({e}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def clean_tweet(e: str) -> str:
    for pat, rep in TWEET_CHAIN:
        e = f"regexp_replace({e}, {q(pat)}, {q(rep)}, 'g')"
    return collapse_ws(e)


def strip_dashes(e: str) -> str:
    return strip_ws(f"regexp_replace({e}, '^-+', '')")


def rating_text(col: str) -> str:
    return (f"CASE WHEN {col} IS NULL THEN NULL WHEN {col} = floor({col}) "
            f"THEN CAST(CAST({col} AS BIGINT) AS VARCHAR) ELSE CAST({col} AS VARCHAR) END")


def parse_label(col: str) -> str:
    v = f"TRY_CAST(trunc(TRY_CAST({strip_ws(f'CAST({col} AS VARCHAR)')} AS DOUBLE)) AS INTEGER)"
    return f"CASE WHEN {v} IN (0, 1) THEN {v} END"


def json_objects(col: str) -> str:
    return f"regexp_extract_all({col}, {q(JSON_OBJECT)})"


def render_message(name="business_name", category="category", description="description",
                   review="review", rating="rating", response="response", null="N/A") -> str:
    nl = " || chr(10) || "
    parts = [f"'Business Name: ' || coalesce(CAST({name} AS VARCHAR), {q(null)})",
             f"'Category: ' || coalesce(CAST({category} AS VARCHAR), {q(null)})",
             f"'Description: ' || coalesce(CAST({description} AS VARCHAR), {q(null)})",
             f"'Review: ' || coalesce(CAST({review} AS VARCHAR), {q(null)})",
             f"'Rating: ' || coalesce({rating_text(rating)}, {q(null)})",
             f"'Response: ' || coalesce(CAST({response} AS VARCHAR), {q(null)})"]
    return nl.join(parts)


def lexicon_hit(col: str, words) -> str:
    ors = " OR ".join(f"contains(lower({col}), {q(w)})" for w in words)
    return f"CAST(({ors}) AS INTEGER)"


def lexicon_whole_word(col: str, words) -> str:
    # RE2 has no look-around: a word is whole when bounded by a non-word char or an end
    alt = "|".join(words)
    pat = f"(^|[^\\p{{L}}\\p{{N}}_])({alt})([^\\p{{L}}\\p{{N}}_]|$)"
    return f"CAST(regexp_matches(lower({col}), {q(pat)}) AS INTEGER)"
