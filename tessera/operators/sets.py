"""Set algebra over rows and over array columns; nulls are equal to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_distinct(*frames: DataFrame) -> DataFrame:
    """Rows of any frame, each once; columns go by name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of the left frame that the right one lacks."""
    return left.select(right.columns).subtract(right)


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of both frames."""
    return left.select(right.columns).intersect(right)


def changes(df: DataFrame, before: str, after: str) -> DataFrame:
    """`df` with the members added, removed and kept between two array columns, and whether they share none."""
    a, b = (F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c in (before, after))
    return df.withColumns({"added": F.array_sort(F.array_except(b, a)), "removed": F.array_sort(F.array_except(a, b)), "kept": F.array_sort(F.array_intersect(a, b)), "disjoint": F.size(F.array_intersect(a, b)) == 0})
