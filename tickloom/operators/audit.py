"""Look-ahead audits of feature tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import double_columns
from ..session import stored
from .calendar import by_date


def daily_values(features: DataFrame, columns: list[str]) -> DataFrame:
    """One row per date: each column's value of the first symbol that has one."""
    firsts = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("symbol"))).alias(c) for c in columns]
    return features.groupBy("date").agg(*firsts)


GAPS = "feature_at int, other_at int, n_pairs long, max_gap double"


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Largest gap and number of dates of each pair of columns, over the dates of one task."""
    most, seen = None, None
    for batch in batches:
        now, later = (np.asarray(batch[c].flatten().fill_null(np.nan)).reshape(batch.num_rows, -1) for c in ("now", "later"))
        for a, b in zip(now, later, strict=True):
            gap = np.abs(a[:, None] - b[None])
            if most is None:
                most, seen = np.full(gap.shape, np.nan), np.zeros(gap.shape, np.int64)
            most, seen = np.fmax(most, gap), seen + ~np.isnan(gap)
    if most is not None:
        i, j = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(seen[i, j]), pa.array(most[i, j])], names=["feature_at", "other_at", "n_pairs", "max_gap"])


def shifted_pairs(features: DataFrame, columns: list[str] | None = None, min_pairs: int = 15, tolerance: float = 1e-6) -> DataFrame:
    """Column pairs (feature, other) and whether feature equals other one date later on every date.

    The table is reduced to one row per date, whose columns are one array. A task keeps one
    matrix of the largest gaps of all pairs over its dates, so the plan grows with the columns
    and not with their pairs.
    """
    columns = columns or double_columns(features, {"date", "symbol"})
    daily = stored(daily_values(features, columns), "daily")
    packed = daily.select("date", F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("now"))
    ahead = packed.withColumn("later", F.lead("now").over(by_date())).where("later is not null")
    tasks = daily.sparkSession.sparkContext.defaultParallelism
    gaps = ahead.repartition(tasks).select("now", "later").mapInArrow(_gaps, GAPS).groupBy("feature_at", "other_at").agg(F.sum("n_pairs").alias("n_pairs"), F.max("max_gap").alias("max_gap"))
    each = [
        F.struct(F.lit(c).alias("name"), F.stddev_samp(c).alias("sd"), F.min_by(F.abs(c), F.when(F.col(c).isNotNull(), F.col("date"))).alias("first"))
        for c in columns
    ]
    stats = daily.agg(F.array(*each).alias("s")).select(F.posexplode("s").alias("at", "s")).select("at", "s.*")
    n = len(columns)
    pairs = daily.sparkSession.range(n * n).select((F.col("id") / n).cast("int").alias("feature_at"), (F.col("id") % n).cast("int").alias("other_at")).where("feature_at <> other_at")
    one, two = (stats.select(F.col("at").alias(f"{side}_at"), F.col("name").alias(side), F.col("sd").alias(f"{side}_sd"), F.col("first").alias(f"{side}_first")) for side in ("feature", "other"))
    found = pairs.join(gaps, ["feature_at", "other_at"], "left").join(one, "feature_at").join(two, "other_at")
    count = F.coalesce("n_pairs", F.lit(0))
    varies = (F.col("feature_sd") > 0) & (F.col("other_sd") > 0) & (count >= min_pairs)
    near = F.col("max_gap") < tolerance * F.greatest(F.col("feature_first"), F.lit(1e-9))
    return found.select("feature", "other", count.alias("n_pairs"), "max_gap", F.coalesce(varies & near, F.lit(False)).alias("is_leak"))


def future_dependence(build: Callable[[DataFrame], DataFrame], source: DataFrame, cut: str, columns: list[str], sentinel: float = 1e6) -> DataFrame:
    """Rebuild the features with every source number after ``cut`` changed, and compare.

    Returns per column the number of rows up to the cut whose value changed; a feature
    without look-ahead has none.
    """
    after = F.col("date") > F.lit(cut).cast("date")
    numeric = double_columns(source, {"date", "symbol"})
    spoiled = source.withColumns({c: F.when(after, F.col(c) + sentinel).otherwise(F.col(c)) for c in numeric})
    keys = [k for k in ("symbol", "date") if k in build(source).columns]
    before = build(source).where(~after).select(*keys, *columns)
    changed = build(spoiled).where(~after).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    both = before.join(changed, keys)
    one = both.agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"_new_{c}"))).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_changed")) for c in columns]))
    return one.select(pairs.alias("p")).select("p.*")


def assert_no_lookahead(features: DataFrame, columns: list[str] | None = None) -> None:
    leaks = shifted_pairs(features, columns).where("is_leak").select("feature", "other").collect()  # column pairs only
    if leaks:
        raise AssertionError("look-ahead: " + ", ".join(f"{r.feature} equals {r.other} one date later" for r in leaks))
