"""Row-level table operators: null handling, renames, rendering, parsing, explode."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetta.functions.labels import band, parse_label
from vetta.functions.text import (
    has_ascii_letter, json_object_candidates, rating_text, strip_dashes, strip_ws,
)


# ---------------------------------------------------------------- nulls, blanks
def drop_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in ``cols`` (all columns when None)."""
    return df.na.drop(how="any", subset=list(cols) if cols else None)


def drop_blank(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows whose every (string form of a) field is empty after stripping."""
    cols = list(cols or df.columns)
    joined = F.concat_ws("", *[F.coalesce(strip_ws(F.col(c).cast("string")), F.lit(""))
                               for c in cols])
    return df.filter(F.length(joined) > 0)


# ---------------------------------------------------------------- lists, renames
def lists_to_text(df: DataFrame, sep: str = ", ") -> DataFrame:
    """Every array<string> column becomes its ``sep``-joined text."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            out.append(F.array_join(F.col(f.name), sep).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def select_renamed(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Select exactly the keys of ``mapping`` (in order), renamed to its values."""
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items()])


def rename_labels(df: DataFrame, mapping: Mapping[str, str],
                  required: Sequence[str] = ()) -> DataFrame:
    """Rename label columns between vocabularies; required-but-absent ones become 0."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    out = df.withColumnsRenamed(present) if present else df
    missing = [c for c in required if c not in out.columns]
    if missing:
        out = out.withColumns({c: F.lit(0) for c in missing})
    return out


# ---------------------------------------------------------------- rendering
def _txt(c: Column, null_token: str) -> Column:
    return F.coalesce(c.cast("string"), F.lit(null_token))


def render_message(df: DataFrame, out: str = "user_message", null_token: str = "N/A",
                   name: str = "business_name", category: str = "category",
                   description: str = "description", review: str = "review",
                   rating: str = "rating", response: str = "response") -> DataFrame:
    """Six labelled lines joined by newlines; nulls print as ``null_token``."""
    # The six field labels, in this order.
    parts = [
        F.concat(F.lit("Business Name: "), _txt(F.col(name), null_token)),
        F.concat(F.lit("Category: "), _txt(F.col(category), null_token)),
        F.concat(F.lit("Description: "), _txt(F.col(description), null_token)),
        F.concat(F.lit("Review: "), _txt(F.col(review), null_token)),
        F.concat(F.lit("Rating: "), _txt(rating_text(F.col(rating)), null_token)),
        F.concat(F.lit("Response: "), _txt(F.col(response), null_token)),
    ]
    return df.withColumn(out, F.concat_ws("\n", *parts))


# Fixed value: the serving prompt puts 12 blanks between fields (newlines deleted).
PROMPT_SEPARATOR = " " * 12


def render_prompt(df: DataFrame, out: str = "prompt", separator: str = PROMPT_SEPARATOR,
                  null_token: str = "None", name: str = "name", category: str = "category",
                  description: str = "description", review: str = "review",
                  rating: str = "rating") -> DataFrame:
    """Serving prompt: five labelled fields, every newline deleted, outer whitespace stripped."""
    fields = [("Business Name: ", name), ("Category: ", category),
              ("Description: ", description), ("Review: ", review), ("Rating: ", rating)]
    parts = []
    for label, col in fields:
        v = rating_text(F.col(col)) if col == rating else F.col(col).cast("string")
        parts.append(F.concat(F.lit(label), F.coalesce(v, F.lit(null_token))))
    glued = F.concat_ws(separator, *parts)
    return df.withColumn(out, strip_ws(F.regexp_replace(glued, "\n", "")))


# ---------------------------------------------------------------- labels
def keep_alphabetic(df: DataFrame, col: str = "text") -> DataFrame:
    return df.filter(has_ascii_letter(col))


def band_label(df: DataFrame, col: str, out: str = "unsafe_label",
               hi: float = 2.5, lo: float = 2.0) -> DataFrame:
    """Keep rows with score ``> hi`` (label 1) or ``<= lo`` (label 0); drop the middle."""
    return df.withColumn(out, band(col, hi, lo)).filter(F.col(out).isNotNull())


def parse_labels(df: DataFrame, cols: Sequence[str], strict: bool = False
                 ) -> tuple[DataFrame, DataFrame]:
    """Parse 0/1 label columns. Returns (valid rows, rejected rows with ``error``).

    ``strict`` makes any invalid value fail the job via ``raise_error`` instead.
    """
    parsed = df.withColumns({f"__p_{c}": parse_label(c) for c in cols})
    bad = None
    for c in cols:
        cond = F.col(f"__p_{c}").isNull()
        bad = cond if bad is None else (bad | cond)
    errors = F.concat_ws("; ", *[
        F.when(F.col(f"__p_{c}").isNull(),
               F.concat(F.lit(f"{c}: not a 0/1 flag: "),
                        F.coalesce(F.col(c).cast("string"), F.lit("null"))))
        for c in cols])
    if strict:
        # the check is a filter condition, so it is evaluated on every row
        parsed = parsed.filter(F.when(bad, F.raise_error(errors)).otherwise(F.lit(True)))
    good = (parsed.filter(~bad)
            .select(*[F.col(f"__p_{c}").alias(c) if c in cols else F.col(c) for c in df.columns]))
    rejected = parsed.filter(bad).select(*[F.col(c) for c in df.columns],
                                         errors.alias("error"))
    return good, rejected


def drop_placeholders(df: DataFrame, col: str = "review", word: str = "fallback") -> DataFrame:
    """Drop rows whose text contains ``word`` (case-insensitive); null text is kept."""
    return df.filter(~F.coalesce(F.lower(F.col(col)).contains(word.lower()), F.lit(False)))


# ---------------------------------------------------------------- free text -> JSON
def extract_json(df: DataFrame, col: str, schema: T.StructType,
                 keep: Sequence[str] = ()) -> DataFrame:
    """One row per brace group in ``col`` that parses as a JSON object.

    Every field is read as text and then cast, so a value of another type than ``schema``
    asks for (``"rating": "5"``) costs that value at most (null), never the object.
    Groups that are not JSON are dropped.
    """
    read = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]
                        + [T.StructField("_corrupt", T.StringType())])
    exploded = df.select(*[F.col(k) for k in keep],
                         F.posexplode(json_object_candidates(col)).alias("obj_pos", "obj"))
    parsed = exploded.withColumn(
        "_j", F.from_json("obj", read,
                          {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
                           "allowSingleQuotes": "false"}))
    return (parsed.filter(F.col("_j").isNotNull() & F.col("_j._corrupt").isNull())
            .select(*[F.col(k) for k in keep], "obj_pos",
                    *[F.col(f"_j.{f.name}").try_cast(f.dataType).alias(f.name) for f in schema.fields]))


# ---------------------------------------------------------------- requests
REQUEST_FIELDS = ("name", "category", "description", "review", "rating")


def request_errors(fields: Sequence[str] = REQUEST_FIELDS) -> Column:
    """The missing fields of a request; a field is missing when null or blank."""
    return F.concat_ws("; ", *[
        F.when(F.col(f).isNull() | (F.length(strip_ws(F.col(f).cast("string"))) == 0),
               F.lit(f"missing {f}")) for f in fields])


def validate_requests(df: DataFrame, fields: Sequence[str] = REQUEST_FIELDS
                      ) -> tuple[DataFrame, DataFrame]:
    """Split requests into (valid, rejected with ``error``)."""
    tagged = df.withColumn("error", request_errors(fields))
    ok = F.col("error") == ""
    return tagged.filter(ok).drop("error"), tagged.filter(~ok)


# ---------------------------------------------------------------- sentences
def explode_prompts(df: DataFrame, prompt: str = "prompt", generation: str = "generation",
                    label: str = "prompt_label", out: str = "text",
                    out_label: str = "unsafe_label") -> DataFrame:
    """Split each prompt on the two characters backslash-n; add the generation as one more row."""
    parts = F.array_append(F.coalesce(F.split(F.col(prompt), r"\\n"), F.array().cast("array<string>")),
                           F.col(generation))
    return df.select(F.explode(parts).alias(out), F.col(label).alias(out_label))


def clean_sentences(df: DataFrame, col: str = "text") -> DataFrame:
    """Drop nulls, strip leading dashes then whitespace, keep rows with an ASCII letter."""
    out = drop_null(df).withColumn(col, strip_dashes(col))
    return keep_alphabetic(out, col)
