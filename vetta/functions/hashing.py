"""Portable deterministic hashing (identical in Spark and DuckDB: md5 hex strings)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_order(key, seed: int | str = 42) -> Column:
    """Seeded shuffle key: ``md5('<seed>:<key>')``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")))


def pseudo_prob(tag: str, key) -> Column:
    """A stable number in [0, 1] from ``md5('<tag>:<key>')`` (first 32 bits / 2^32-1)."""
    h = F.md5(F.concat(F.lit(f"{tag}:"), _c(key).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)
