"""Label expressions: parsing, flags, banding, one-hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vetta.functions.text import strip_ws


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Fixed value: how a decimal number is written.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_label(c) -> Column:
    """``"0"``/``"1"`` or anything whose float truncates to 0/1; otherwise null (invalid).

    ``0.9`` -> 0, ``-0.5`` -> 0, ``1e0`` -> 1; ``2``, ``nan``, ``inf``, empty -> null.
    Nested ``try_cast`` keeps ANSI mode from throwing on NaN/inf; the number pattern keeps
    out what only the cast would take (``1d``, ``0f``).
    """
    text = strip_ws(_c(c).cast("string"))
    as_double = F.when(text.rlike(NUMBER), text).try_cast("double")
    as_int = as_double.try_cast("int")
    return F.when(as_int.isin(0, 1), as_int)


def any_flag(cols: Sequence[str]) -> Column:
    """1 if any flag is non-zero; null flags count as 0."""
    return (F.greatest(*[F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in cols], F.lit(0))
            != 0).cast("int")


def band(c, hi: float = 2.5, lo: float = 2.0) -> Column:
    """Score banding: ``> hi`` -> 1, ``<= lo`` -> 0, between -> null (dropped by callers)."""
    c = _c(c)
    return F.when(c > hi, F.lit(1)).when(c <= lo, F.lit(0))


def one_hot(c, classes: Sequence[str], prefix: str = "label_") -> list[Column]:
    """One int column per class name: 1 where ``c`` equals it."""
    return [F.coalesce((_c(c) == F.lit(k)).cast("int"), F.lit(0)).alias(prefix + k)
            for k in classes]
