"""Numbers and running sums over one order of all rows, without one task for all rows.

Rows are dealt to ranges of the order, written once, numbered inside their range, and the
ranges' totals, one row each, are added up. Ranges follow the rows, so neither a busy day nor a common prefix makes a large task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage


def in_ranges(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` written in ranges of ``order``, with _range (rising with the order) and _at (rising in it)."""
    dealt = df.repartitionByRange(storage.tasks(df.sparkSession), *order).sortWithinPartitions(*order)
    return storage.materialize(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), name)


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its expression over all earlier rows of the same ``by``."""
    names = list(sums)
    d = in_ranges(df.withColumns({f"_w_{n}": F.coalesce(e, F.lit(0)).cast("bigint") for n, e in sums.items()}), [*by, *order], "ranges")
    keys = [*by, "_range"]
    totals = d.groupBy(*keys).agg(*(F.sum(f"_w_{n}").alias(f"_t_{n}") for n in names))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in names))
    inside = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_w_{n}").over(inside), F.lit(0)) for n in names})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return d.join(bases, match).select(*df.columns, *((F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(n) for n in names))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "row") -> DataFrame:
    """Adds the row number from 1."""
    return running(df, by, order, {name: F.lit(1)}).withColumn(name, F.col(name) + 1)


def day(column: str = "ts") -> Column:
    return F.date_trunc("day", F.col(column))
