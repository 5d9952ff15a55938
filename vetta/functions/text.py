"""Text expressions.

Regular expressions are written so that Java (Spark) and RE2 (DuckDB, the oracle)
give the same answer as Python's ``re`` module on ``str`` patterns:

* Python ``\\s`` is Unicode whitespace; neither Java's nor RE2's ``\\s`` is. We spell
  the class out: ASCII controls, the information separators U+001C..U+001F, NEL and
  every ``\\p{Z}`` code point.
* Python ``\\w`` is letters, numbers and underscore: ``[\\p{L}\\p{N}_]``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes shared by every engine we target.
WS_CLASS = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\p{Z}"
WS = f"[{WS_CLASS}]"
NON_WS = f"[^{WS_CLASS}]"
WORD = r"[\p{L}\p{N}_]"

# The tweet-cleaning chain, applied in this order (pattern -> replacement).
#   '"+' -> ''   (double quotes)
#   '@\w+' -> '' (mentions)
#   'http\S+' -> '' (links)
#   '&+\S*' -> '' (entities)
#   '!+\S*' -> '' (bangs)
#   'RT' -> ''   (retweet marker, also inside words)
#   '\s+' -> ' ', then strip
TWEET_CHAIN = [
    ('"+', ""),
    ("@" + WORD + "+", ""),
    ("http" + NON_WS + "+", ""),
    ("&+" + NON_WS + "*", ""),
    ("!+" + NON_WS + "*", ""),
    ("RT", ""),
]

# Every code point of WS_CLASS, for the linear trim.
WS_CHARS = "".join(chr(c) for c in [*range(9, 14), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680,
                                    *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000])

# Fixed value: the pattern that finds JSON objects (nesting depth at most one) in free text.
# The quantifiers are possessive: the classes do not overlap, so matches are the same, and
# the matcher neither backtracks nor recurses once per nested group.
JSON_OBJECT = r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c) -> Column:
    """Runs of whitespace become one blank; leading/trailing blanks removed."""
    return F.trim(F.regexp_replace(_c(c), WS + "+", " "))


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends (linear in the text)."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def clean_tweet(c) -> Column:
    """Tweet cleaning chain; null stays null."""
    out = _c(c)
    for pat, rep in TWEET_CHAIN:
        out = F.regexp_replace(out, pat, rep)
    return collapse_ws(out)


def strip_dashes(c) -> Column:
    """Leading dashes first, then surrounding whitespace (order matters)."""
    return strip_ws(F.regexp_replace(_c(c), "^-+", ""))


def has_ascii_letter(c) -> Column:
    return _c(c).rlike("[A-Za-z]")


def rating_text(c) -> Column:
    """Ratings print like the served JSON: ``3`` for integral values, ``3.5`` otherwise."""
    c = _c(c)
    return (F.when(c.isNull(), F.lit(None))
            .when(c == F.floor(c), c.cast("bigint").cast("string"))
            .otherwise(c.cast("string")))


def lexicon_hit(c, words: Iterable[str], whole_word: bool = False) -> Column:
    """1 if any lexicon word occurs in the lower-cased text.

    Substring semantics by default (a word inside another word counts); ``whole_word``
    requires non-word characters (or the ends) around the match. The list is a
    parameter; it is expanded into one codegen'd predicate, so it should stay small
    (thousands of words go through ``operators.features.lexicon_join`` instead).
    """
    words = [w.lower() for w in words if w]
    if not words:
        return F.lit(0)
    low = F.lower(_c(c))
    if whole_word:
        hit = low.rlike(whole_word_pattern(words))
    else:
        hit = None
        for w in words:
            h = low.contains(w)
            hit = h if hit is None else (hit | h)
    return F.when(_c(c).isNull(), F.lit(None)).otherwise(hit.cast("int"))


def whole_word_pattern(words: Iterable[str]) -> str:
    """The one matcher of whole lexicon words: every word is quoted."""
    alt = "|".join("".join("\\" + ch if not ch.isalnum() else ch for ch in w) for w in words)
    return f"(?<!{WORD})(?:{alt})(?!{WORD})"


def label_line(label, text, positive_value=1,
               pos: str = "__label__pos", neg: str = "__label__neg") -> Column:
    """``"<label> <text>"`` line; which raw value counts as positive is a parameter."""
    return F.concat(F.when(_c(label) == F.lit(positive_value), F.lit(pos)).otherwise(F.lit(neg)),
                    F.lit(" "), _c(text))


def json_object_candidates(c) -> Column:
    """All brace groups (nesting <= 1) in the text, in order of appearance."""
    return F.regexp_extract_all(_c(c), F.lit("(" + JSON_OBJECT + ")"), 1)
