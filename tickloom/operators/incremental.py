"""Incremental feature refresh: only dates after the newest feature date are added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import upsert


def new_dates(live: DataFrame, features: DataFrame) -> DataFrame:
    """Live rows strictly after the newest feature date.

    The date is one scalar read from one column; as a literal it prunes the live files.
    """
    cutoff = features.agg(F.max("date")).first()[0]
    return live if cutoff is None else live.where(F.col("date") > F.lit(cutoff))


def refresh_features(history: DataFrame, live: DataFrame, features: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Feature rows of the new dates, in the schema of the feature table.

    Only symbols that have both history and new rows are rebuilt; ``build`` makes the
    features from full series (history with live rows winning). Running it again after
    the rows were stored returns nothing.
    """
    fresh = new_dates(live, features)
    touched = fresh.select("symbol").distinct().join(history.select("symbol").distinct(), "symbol", "left_semi")
    series = upsert(
        history.join(touched, "symbol", "left_semi"), live.join(touched, "symbol", "left_semi"), ["symbol", "date"]
    )
    built = build(series).join(fresh.select("date").distinct(), "date", "left_semi")
    missing = [f for f in features.schema.fields if f.name not in built.columns]
    return built.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}).select(*features.columns)
