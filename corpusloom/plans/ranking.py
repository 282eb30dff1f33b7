"""Ranks within groups of which one may hold a large share of all rows.

A plain window sorts a group in one task.  Here the rows are range-partitioned by (group, order), each part is ranked
by itself, and the counts of the parts before it in the group (one small row per group and part) are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import cut, width


def _parts(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows with ``__part``, ascending in the order of the group.  Cut, so that both readers see the same parts."""
    spread = df.repartitionByRange(width(df.sparkSession), *[F.col(k) for k in keys], *order)
    return cut(spread.withColumn("__part", F.spark_partition_id()))


def _before(parts: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    totals = parts.groupBy(*keys, "__part").agg(F.sum(weight).alias("__total"))
    up_to = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "__part", F.coalesce(F.sum("__total").over(up_to), F.lit(0)).alias("__before"))


def positions(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with the 1-based row number ``name`` per group; ``order`` must be total within a group."""
    parts = _parts(df, keys, order)
    inner = Window.partitionBy(*keys, "__part").orderBy(*order)
    numbered = parts.withColumn("__row", F.row_number().over(inner))
    return (
        numbered.join(_before(parts, keys, F.lit(1)), [*keys, "__part"])
        .withColumn(name, F.col("__row") + F.col("__before"))
        .drop("__row", "__part", "__before")
    )


def competition_ranks(df: DataFrame, keys: list[str], value: str, rank: str, ties: str) -> DataFrame:
    """One row per group and distinct value: competition rank (greatest first) and the number of equal rows."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(ties))
    parts = _parts(counted, keys, [F.col(value).desc()])
    inner = Window.partitionBy(*keys, "__part").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumn("__inner", F.coalesce(F.sum(ties).over(inner), F.lit(0)))
    return summed.join(_before(parts, keys, F.col(ties)), [*keys, "__part"]).select(
        *keys, value, ties, (F.col("__inner") + F.col("__before") + 1).alias(rank)
    )
