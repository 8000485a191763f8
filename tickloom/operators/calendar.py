"""One-row-per-date tables.

A table with one row per calendar date is bounded by the calendar itself: about 25,000
trading days in a century, 3.65 million for every date a DATE can hold (under 200 MB for
a handful of doubles). This is the only kind of table the library broadcasts by hand
and the only kind it orders in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_date(*partition: str) -> WindowSpec:
    """Order over dates; with no partition the whole (calendar-bounded) table is one series."""
    return Window.partitionBy(*partition).orderBy("date") if partition else Window.partitionBy(F.lit(0)).orderBy("date")


def join_daily(df: DataFrame, daily: DataFrame, how: str = "left") -> DataFrame:
    """Attach a one-row-per-date table to a panel without shuffling the panel."""
    return df.join(F.broadcast(daily), "date", how)


def date_ordinals(df: DataFrame) -> DataFrame:
    """Distinct dates numbered 0, 1, 2, ... in order."""
    dates = df.select("date").distinct()
    return dates.withColumn("day_no", F.row_number().over(by_date()) - 1)


def one_row(*parts: DataFrame) -> DataFrame:
    """Several one-row tables side by side: a union and one aggregate, no join."""
    names = [c for part in parts for c in part.columns]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in names])
