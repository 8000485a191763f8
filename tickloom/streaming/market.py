"""Streaming forms of the roll-ups, quote upserts and feature refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import in_market_hours, ratio
from ..operators.bars import merge_candles, partial_candles
from ..operators.incremental import refresh_features
from ..session import work_folder
from ..sources.sinks import read_panel, upsert_panel
from .log import log_schema, newest, read_log, write_log

WIDTHS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes", "60m": "60 minutes", "1d": "1 day"}


def read_folder(spark: SparkSession, folder: str, schema: T.StructType | str, fmt: str = "parquet", glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A file stream over a folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(folder)


def run_candles(spark: SparkSession, ticks: DataFrame, width: str = "5 minutes", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Process all available ticks, return the candles.

    Each micro-batch is rolled up by itself into its own part of the log (a retry adds
    nothing), and the parts of a candle are merged when it is read. No tick is ever too
    late, no state is kept, and the order of arrival does not matter.
    """
    folder = work_folder(spark, "stream")
    parts = log_schema(partial_candles(ticks, width, list(order)))  # a schema only: nothing runs here
    write_log(ticks, f"{folder}/log", f"{folder}/checkpoint", transform=lambda rows: partial_candles(rows, width, list(order))).awaitTermination()
    return merge_candles(read_log(spark, f"{folder}/log", parts))


def run_upsert(spark: SparkSession, stream: DataFrame, key: list[str], tie: list[str] | None = None, mode: str = "append") -> DataFrame:
    """Keep-newest upsert of a stream by key: all available input, then the current state."""
    folder = work_folder(spark, "stream")
    write_log(stream, f"{folder}/log", f"{folder}/checkpoint", mode, key=key, tie=tie).awaitTermination()
    return newest(spark, f"{folder}/log", log_schema(stream), key, tie)


def latest_quotes(stream: DataFrame, seq: str = "seq", price: str = "px") -> DataFrame:
    """Newest price per symbol (update mode): one state row per symbol."""
    last = F.max_by(F.struct(F.col("ts"), F.col(price).alias("last_price")), F.struct("ts", seq))
    return stream.groupBy("symbol").agg(last.alias("r")).select("symbol", "r.*")


def with_change(quotes: DataFrame, closes: DataFrame) -> DataFrame:
    """Change against the previous close (symbol, prev_close); also valid stream to table."""
    change = F.col("last_price") - F.col("prev_close")
    return quotes.join(closes, "symbol", "left").withColumns(
        {"change": change, "change_percent": ratio(change, "prev_close") * 100.0}
    )


def session_only(ticks: DataFrame, zone: str = "UTC") -> DataFrame:
    return ticks.where(in_market_hours("ts", zone))


def refresh_stream(daily: DataFrame, bars_path: str, features_path: str, checkpoint: str, build: Callable[[DataFrame], DataFrame]) -> object:
    """Daily live bars into the bar and feature tables, batch by batch.

    A retried batch finds its dates at or below the cutoff and adds nothing; late dates
    are left to a full rebuild, as in the batch form.
    """

    def apply(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        live = rows.persist()
        try:
            fresh = refresh_features(read_panel(spark, bars_path), live, read_panel(spark, features_path), build)
            upsert_panel(spark, features_path, fresh)
            upsert_panel(spark, bars_path, live)
        finally:
            live.unpersist()

    return (
        daily.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
