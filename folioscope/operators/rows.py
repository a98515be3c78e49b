"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: Column | str, name: str, *keep: str | Column) -> DataFrame:
    """``keep`` columns and one row per element of ``array``.

    For a plain ``explode`` Spark adds a check that the array is not empty and
    pushes it down, which computes a costly array twice.  The outer form has no
    such check; rows of empty arrays are dropped after it.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
