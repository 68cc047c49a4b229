"""Dense numbers along an order, without bringing a group together in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .keep import cut


def numbered(rows: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """rows with `name`: their place from 1 among those of equal `by`, along `order` (unique within `by`).

    Rows are dealt by ranges and numbered in each partition; a range's first number is what the ranges before it hold,
    one small row for each range and value of `by`.
    """
    dealt = cut(rows.repartitionByRange(by, order)).withColumn("_part", F.spark_partition_id())
    held = dealt.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.select(by, "_part", before.alias("_before"))
    inside = F.row_number().over(W.partitionBy(by, "_part").orderBy(order))
    return dealt.join(held, [by, "_part"]).withColumn(name, (F.col("_before") + inside).cast("long")).drop("_part", "_before")
