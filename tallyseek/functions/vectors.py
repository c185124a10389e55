"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_bucket(term: Column, dimensions: int) -> Column:
    """Bucket of a term from its MD5, so that other engines can compute the same one."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long"), F.lit(dimensions))
