"""Ranks and order statistics of whole tables, by ranges of values instead of one task.

Rows are range-partitioned by their order, counted per range, and each range is ordered by
itself: what lies before a row is what its range has before it and all earlier ranges.
Equal values are counted first, so that a frequent value is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.tables import written


def _ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df written with `__range`, the number of the range of (keys, order) that a row is in."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def running(df: DataFrame, keys: list[str], order: list[str], amount: str) -> DataFrame:
    """df with `before`, the sum of amount over the rows of the key that come earlier, and `whole`, that of all of the key.

    Rows of a key must differ in their order; nulls come first. A key may hold any part of the rows.
    """
    parts = _ranges(df, keys, order)
    sums = parts.groupBy(*keys, "__range").agg(F.sum(amount).alias("s"))
    kind = sums.schema["s"].dataType
    zero = F.lit(0).cast(kind)
    add = lambda entries: F.aggregate(entries, zero, lambda acc, e: (acc + e["s"]).cast(kind))
    # a key has no more entries than there are ranges
    lists = sums.groupBy(*keys).agg(F.collect_list(F.struct(F.col("__range").alias("r"), "s")).alias("__all"))
    offsets = F.transform("__all", lambda x: F.struct(x["r"].alias("r"), add(F.filter("__all", lambda e: e["r"] < x["r"])).alias("o")))
    table = lists.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], add(F.col("__all")).alias("whole"), F.explode(offsets).alias("__at"))
    same = F.col("__range") == F.col("__at.r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumn("__own", F.coalesce(F.sum(amount).over(inside), zero))
    return own.join(table, same).withColumn("before", F.col("__own") + F.col("__at.o")).select(*df.columns, "before", "whole")


def least_ahead(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the least value of a row and all that come after it."""
    parts = _ranges(df, [], order)
    lists = parts.groupBy("__range").agg(F.min(value).alias("m")).agg(F.collect_list(F.struct(F.col("__range").alias("r"), "m")).alias("__all"))
    # one row, which has no more entries than there are ranges
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    later = F.array_min(F.transform(F.filter("__all", lambda e: e["r"] > F.col("__range")), lambda e: e["m"]))
    return parts.crossJoin(F.broadcast(lists)).withColumn(name, F.least(F.min(value).over(inside), later)).select(*df.columns, name)


def counted(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, value, n, before, whole): how many rows have each value and how many a smaller one; nulls are left out."""
    by_value = df.select(*keys, value.alias("value")).where("value IS NOT NULL").groupBy(*keys, "value").agg(F.count("*").alias("n"))
    return running(by_value, keys, ["value"], "n")


def quantiles_of(ranked: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """(keys, q): exact quantiles of counted() values, between neighbours by their distance, one for each share."""
    last = F.col("before") + F.col("n") - 1
    at = [(F.col("whole") - 1) * s for s in shares]
    needed = [x for a in at for x in (F.floor(a), F.ceil(a))]
    held = F.lit(False)
    for x in needed:
        held = held | ((F.col("before") <= x) & (x <= last))
    pick = lambda x: F.max(F.when((F.col("before") <= x) & (x <= last), F.col("value")))
    parts = ranked.where(held).groupBy(*keys).agg(F.max("whole").alias("whole"), *[pick(x).alias(f"__v{i}") for i, x in enumerate(needed)])
    mixed = [F.col(f"__v{2 * i}") + (a - F.floor(a)) * (F.col(f"__v{2 * i + 1}") - F.col(f"__v{2 * i}")) for i, a in enumerate(at)]
    return parts.select(*keys, F.array(*mixed).alias("q"))


def quantiles(df: DataFrame, keys: list[str], value: Column, shares: list[float]) -> DataFrame:
    """(keys, q): exact quantiles of value within each key, which may hold any part of the rows."""
    return quantiles_of(counted(df, keys, value.cast("double")), keys, shares)
