"""Numbers rows by their place in an order of the whole table, without bringing them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import saved


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds the number of each row from 1 on: ranges of the order are numbered apart, and begin where the ranges before them end.

    Rows that are equal in the order are numbered as they happen to stand, so the order should be total.
    """
    dealt = saved(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")  # one row for each range
    starts = sizes.select("__range", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn(name, inside.cast("long")).join(F.broadcast(starts), "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")
