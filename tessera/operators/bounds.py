"""The contract of every bounded result: total order before the limit, exact totals beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import order_key_udf

QUERY_LIMIT, SEARCH_LIMIT, QUEUE_LIMIT, RELATION_LIMIT = 100, 100, 1000, 12


def clamp_limit(limit: int) -> int:
    """Documentation queries clamp their limit; they never fail on a large one."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 0:
        raise ValueError("limit must be a non-negative integer")
    return min(limit, QUERY_LIMIT)


def require_limit(limit: int, most: int) -> int:
    """Search and queue refuse a limit out of range."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    return limit


def bounded(df: DataFrame, order: list[Column], limit: int) -> tuple[DataFrame, DataFrame]:
    """(first rows, one row of total, returned, truncated). The top rows come from a partial sort, not a full one."""
    totals = df.agg(F.count("*").alias("total"))
    bounds = totals.select("total", F.least("total", F.lit(limit)).alias("returned"), (F.col("total") > limit).alias("truncated"))
    return df.orderBy(*order).limit(limit), bounds


def bounded_per(df: DataFrame, owner: list[str], order: list[Column], limit: int = RELATION_LIMIT) -> DataFrame:
    """First rows of each owner with their place, and total, returned and truncated of that owner.

    Totals come from an aggregate, so that ranking keeps `limit` rows of an owner before anything is shuffled.
    """
    place = F.row_number().over(Window.partitionBy(*owner).orderBy(*order))
    first = df.withColumn("place", place).filter(F.col("place") <= limit).alias("first")
    totals = df.groupBy(*owner).agg(F.count("*").alias("total")).alias("totals")
    same = [F.col(f"first.{c}").eqNullSafe(F.col(f"totals.{c}")) for c in owner]
    kept = first.join(totals, same).select("first.*", "totals.total")
    return kept.withColumn("returned", F.least("total", F.lit(limit))).withColumn("truncated", F.col("total") > limit)


def in_total_order(df: DataFrame, column: str) -> list[Column]:
    """(casefold, text): an order that doesn't depend on how the rows arrived."""
    return [order_key_udf(F.col(column)), F.col(column)]


def distinct_paths(paths: DataFrame, limit: int = 100) -> DataFrame:
    """Supplied paths without repeats, in total order, with their place; more than `limit` is an error."""
    found = paths.select("path").filter(F.col("path").isNotNull()).dropDuplicates().limit(limit + 1)
    if found.count() > limit:
        raise ValueError(f"more than {limit} paths")
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.lower("path"), "path")))


def page_of(df: DataFrame, order: list[Column], offset: int, limit: int, per: list[str] | None = None) -> DataFrame:
    """Rows offset+1 to offset+limit of an order (of each group), with their place from 0."""
    window = (Window.partitionBy(*per) if per else Window).orderBy(*order)
    return df.withColumn("place", F.row_number().over(window) - 1).filter((F.col("place") >= offset) & (F.col("place") < offset + limit))


def within_bytes(df: DataFrame, order: list[Column], json_column: str, ceiling: int, per: list[str] | None = None) -> DataFrame:
    """The longest prefix of an order whose encoded rows fit a byte ceiling."""
    window = (Window.partitionBy(*per) if per else Window).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("bytes_so_far", F.sum(F.octet_length(json_column)).over(window)).filter(F.col("bytes_so_far") <= ceiling)
