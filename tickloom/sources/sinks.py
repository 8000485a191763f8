"""Writers: partitioned panels, upserts and incremental feature tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import upsert
from ..session import stored

PART = "year"


def write_panel(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by year, each file sorted by symbol so that symbol filters skip row groups."""
    out = df.withColumn(PART, F.year("date"))
    # a task holds a range of (year, symbol), so it writes into one year or two, however many tasks there are
    out = out.repartitionByRange(PART, "symbol").sortWithinPartitions(PART, "symbol", "date")
    out.write.mode(mode).partitionBy(PART).parquet(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)


def upsert_panel(spark: SparkSession, path: str, incoming: DataFrame, key: tuple[str, ...] = ("date", "symbol"), tie: tuple[str, ...] = ()) -> None:
    """Merge rows into a panel table; incoming wins. Only the touched years are rewritten.

    The merged rows are first written to the shared folder, then replace their
    partitions through Spark's commit protocol, so a failed job leaves the old files.
    """
    years = [r[0] for r in incoming.select(F.year("date").alias(PART)).distinct().collect()]  # a few calendar years
    if not years:
        return
    existing = spark.read.parquet(path)
    touched = existing.where(F.col(PART).isin(years)).drop(PART)
    merged = stored(upsert(touched, incoming, list(key), list(tie)), "upsert")
    out = merged.withColumn(PART, F.year("date")).repartitionByRange(PART, "symbol").sortWithinPartitions(PART, "symbol", "date")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def write_tables(df: DataFrame, path: str, formats: tuple[str, ...] = ("parquet", "csv")) -> None:
    """The same rows as parquet, csv and/or json folders below ``path``."""
    for kind in formats:
        writer = df.write.mode("overwrite")
        if kind == "csv":
            writer = writer.option("header", True)
        writer.format(kind).save(f"{path}/{kind}")


def write_metadata(spark: SparkSession, path: str, metadata: dict) -> None:
    """A one-row JSON table next to the data."""
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True, default=str),)], "value string").write.mode("overwrite").text(path)
