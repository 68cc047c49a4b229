"""Range joins by bins: each interval goes to the bins it touches, so the join is on equal keys at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 128


def points_in_intervals(points: DataFrame, intervals: DataFrame, by: list[str], at: str, first: str, last: str, width: int = BIN) -> DataFrame:
    """Rows of points joined to the intervals [first, last] that hold their value `at`, equal in the columns `by`."""
    spread = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))
    binned = points.withColumn("_bin", F.floor(F.col(at) / width))
    return binned.join(spread, [*by, "_bin"]).filter(F.col(at).between(F.col(first), F.col(last))).drop("_bin")


def overlapping(left: DataFrame, right: DataFrame, by: list[str], condition: Column, left_ends: tuple[str, str], right_ends: tuple[str, str], width: int = BIN) -> DataFrame:
    """Pairs of intervals that share a bin and meet the condition, each pair once."""
    a = left.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(left_ends[0]) / width), F.floor(F.col(left_ends[1]) / width))))
    b = right.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(right_ends[0]) / width), F.floor(F.col(right_ends[1]) / width))))
    # A pair is taken in the first bin that both touch.
    first = F.greatest(F.floor(F.col(left_ends[0]) / width), F.floor(F.col(right_ends[0]) / width))
    return a.join(b, [*by, "_bin"]).filter((F.col("_bin") == first) & condition).drop("_bin")
