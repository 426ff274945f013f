"""Ids that count rows in an order, without a task that gets all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens.session import cut


def numbered(df: DataFrame, order: list[str], start: int, form: str = "I-%03d", name: str = "issue_id") -> DataFrame:
    """df with ids from ``start`` on by the columns of ``order``: rows are dealt to ranges, and an id is the row's place in
    its range after the rows of the ranges before."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_range").withColumn(name, F.format_string(form, F.col("_before") + F.col("_at") + start)).drop("_range", "_at", "_before")
