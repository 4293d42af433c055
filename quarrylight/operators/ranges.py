"""Running sums and places within a key whose rows are spread over all tasks.

A window over a key puts all its rows into one task.  Here rows are sorted into ranges of (key, order); each range is summed for itself,
and moved up by what the ranges before it came to.  Only a row a key and range meets in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.tables import cut


def running(rows: DataFrame, key: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the running sum of a value within a key, in an order that leaves no ties."""
    ordered = rows.withColumns({"__value": value, **{f"__o{i}": o for i, o in enumerate(order)}})
    places = [F.asc(f"__o{i}") for i in range(len(order))]
    ranges = cut(ordered.repartitionByRange(F.asc(key), *places).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = ranges.groupBy(F.col(key).alias("__key"), F.col("__range").alias("__at")).agg(F.sum("__value").alias("__total"))
    before = F.sum("__total").over(Window.partitionBy("__key").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.withColumn("__before", before)
    own = F.sum("__value").over(Window.partitionBy(key, "__range").orderBy(*places).rowsBetween(Window.unboundedPreceding, 0))
    met = ranges.withColumn("__own", own).join(offsets, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__at")))
    return met.withColumn(name, F.col("__own") + F.coalesce("__before", F.lit(0))).select(*rows.columns, name)


def placed(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """Adds the row's place within its key, from 1."""
    return running(rows, key, order, F.lit(1).cast("long"), name)
