"""Column-level building blocks (pure Spark SQL expressions, codegen-friendly)."""

from vetta.functions.text import (  # noqa: F401
    WS, WORD, NON_WS, collapse_ws, strip_ws, clean_tweet, strip_dashes, has_ascii_letter,
    rating_text, lexicon_hit, label_line, json_object_candidates,
)
from vetta.functions.labels import parse_label, any_flag, band, one_hot  # noqa: F401
from vetta.functions.hashing import md5_order, pseudo_prob  # noqa: F401
