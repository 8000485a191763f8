"""Keep-one-row-per-key operators and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_best(df: DataFrame, key: list[str], by: Column) -> DataFrame:
    """The row with the greatest ``by`` per key.

    An aggregate, not a window: copies of one key are reduced before the shuffle, so
    a group of any size costs one row per map task. ``by`` should end in columns that
    make it unique; equal maxima are equal rows as far as ``by`` can tell.
    """
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("_row"))
    return picked.select(*key, "_row.*").select(*df.columns)


def keep_last(df: DataFrame, key: list[str], sequence: str) -> DataFrame:
    return keep_best(df, key, F.col(sequence))


def keep_highest_volume(df: DataFrame, key: tuple[str, ...] = ("symbol", "date"), tie: tuple[str, ...] = ()) -> DataFrame:
    """Per key the row with the highest volume (a real session beats an adjustment row)."""
    return keep_best(df, list(key), F.struct("volume", *tie))


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], tie: list[str] | None = None) -> DataFrame:
    """Rows of both; on equal keys the incoming row wins, ``tie`` orders within a side.

    Columns the incoming rows lack become NULL, columns unknown to the existing table
    are dropped, so the table keeps its schema.
    """
    newer = incoming.select(*[c for c in incoming.columns if c in existing.columns]).withColumn("_seq", F.lit(1))
    both = existing.withColumn("_seq", F.lit(0)).unionByName(newer, allowMissingColumns=True)
    return keep_best(both, key, F.struct("_seq", *(tie or []))).drop("_seq")


def upsert_stats(existing: DataFrame, incoming: DataFrame, key: list[str], date: str = "date") -> DataFrame:
    """new, replaced, total and last date of an upsert, from the keys alone."""
    sides = existing.select(*key, F.lit(0).alias("_new")).unionByName(incoming.select(*key, F.lit(1).alias("_new")))
    per_key = sides.groupBy(*key).agg(F.sum("_new").alias("n_new"), F.count("*").alias("n_all"))
    return per_key.agg(
        F.sum("n_new").alias("new_rows"),
        (F.sum("n_all") - F.count("*")).alias("replaced"),
        F.count("*").alias("total"),
        F.max(date).alias("max_date"),
    )
