"""Exact weighted quantiles and cumulative cut-offs by group, by rounds of histograms.

Each group's interval of values is cut into BINS bins, weights are summed by bin with partial sums in every task, and the
bin in which the wanted weight is reached is the next interval. No group's values are sorted or come together, and a
round keeps BINS rows for each group at most. Values are whole numbers; a range of 64 bits takes seven rounds, one of a
thousand values one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .keep import cut

BINS = 1024


def _reached(rows: DataFrame, by: list[str], value: str, weight: str, wanted: Column, bins: int) -> DataFrame:
    """by, value: the smallest value up to which a group's weights sum up to `wanted` (of its total `total`) or more; null where they don't."""
    counts = cut(rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("long").alias("_v")).agg(F.sum(weight).alias("_w")).filter("_w > 0"))
    state = counts.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_w").alias("total"))
    state = cut(state.select(*by, "_lo", "_hi", wanted.alias("_want"), F.lit(0).cast("double").alias("_below"), F.when(F.col("total") >= wanted, F.lit(True)).otherwise(F.lit(False)).alias("_there")))
    lost = state.filter("not _there").select(*by)
    state = state.filter("_there").drop("_there")
    order = W.partitionBy(*by).orderBy("_bin")
    while True:
        open_ = state.filter("_hi > _lo")
        if open_.isEmpty():
            break
        # In decimals, as an interval may be as wide as all 64-bit numbers.
        span = F.col("_hi").cast("decimal(20,0)") - F.col("_lo").cast("decimal(20,0)") + 1
        each = open_.withColumn("_step", F.ceil(span / bins).cast("decimal(20,0)"))
        at = counts.join(each, by).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        at = at.withColumn("_bin", F.floor((F.col("_v").cast("decimal(20,0)") - F.col("_lo")) / F.col("_step")).cast("int"))
        sums = at.groupBy(*by, "_lo", "_hi", "_step", "_want", "_below", "_bin").agg(F.sum("_w").alias("_w"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
        sums = sums.withColumn("_sum", F.col("_below") + F.sum("_w").over(order))
        hit = sums.filter(F.col("_sum") >= F.col("_want")).groupBy(*by).agg(F.min(F.struct("_bin", "_first", "_last", (F.col("_sum") - F.col("_w")).alias("_below"), "_want")).alias("_h"))
        new = hit.select(*by, F.col("_h._first").alias("_lo"), F.col("_h._last").alias("_hi"), F.col("_h._want").alias("_want"), F.col("_h._below").alias("_below"))
        state = cut(state.filter("_hi = _lo").unionByName(new))
    return state.select(*by, F.col("_lo").alias(value)).unionByName(lost.withColumn(value, F.lit(None).cast("long")))


def weighted_quantile(rows: DataFrame, by: list[str], value: str, share: float, weight: str | None = None, bins: int = BINS) -> DataFrame:
    """by, value: the smallest value of each group up to which its weights are `share` of all or more (0.5: the lower median).

    Nulls don't count, nor do weights of 0 or less; without `weight` every row weighs 1. Groups without a value are left out.
    """
    weighed = rows.select(*by, value, (F.lit(1) if weight is None else F.col(weight)).cast("double").alias("_weight"))
    return _reached(weighed, by, value, "_weight", F.col("total") * share, bins)


def cumulative_cut(rows: DataFrame, by: list[str], value: str, amount: float, weight: str | None = None, bins: int = BINS) -> DataFrame:
    """by, value: the smallest value of each group up to which its weights sum up to `amount` or more; null where all of them don't."""
    weighed = rows.select(*by, value, (F.lit(1) if weight is None else F.col(weight)).cast("double").alias("_weight"))
    return _reached(weighed, by, value, "_weight", F.lit(float(amount)), bins)
