"""Running sums and row numbers that no single task has to sort.

Rows are range-partitioned by group and order together, so a hot group is spread over many slices. Each slice is
summed, the sums before a slice give its start (at most groups + slices rows), and a window inside the slice does
the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def with_before(rows: DataFrame, size: Column, order: list[str], groups: list[str] | None = None, out: str = "before", slices: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``size`` over all rows that come earlier in the same group; without groups over the whole table.

    ``order`` should be a total order of each group; of rows that tie in it, any may come first. Null groups are a group.
    The rows are written out once, so give only the columns that are needed.
    """
    groups = groups or []
    keys = [*groups, *order]
    n = slices or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    cut = rows.withColumn("__size", size.cast("long")).repartitionByRange(n, *keys).withColumn("__slice", F.spark_partition_id())
    cut = materialize(cut, "slices")  # range bounds are sampled: both uses below must see the same slices
    sums = cut.groupBy("__slice", *groups).agg(F.sum("__size").alias("__sum"))
    earlier = Window.partitionBy(*groups).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(F.col("__slice").alias("__s"), *(F.col(g).alias(f"__g_{g}") for g in groups), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__slice", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("__own", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    same = F.col("__slice") == F.col("__s")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    placed = placed.join(start, same).withColumn(out, F.col("__own") + F.col("__start"))
    return placed.drop("__size", "__slice", "__own", "__start", "__s", *(f"__g_{g}" for g in groups))


def with_number(rows: DataFrame, order: list[str], groups: list[str] | None = None, out: str = "number") -> DataFrame:
    """``rows`` numbered from 1 on in each group."""
    return with_before(rows, F.lit(1), order, groups, out).withColumn(out, F.col(out) + 1)
