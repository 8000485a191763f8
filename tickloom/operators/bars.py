"""Roll-ups of ticks and candles into bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_last(price_first: str, price_last: str, order: list[str]) -> tuple[Column, Column]:
    """First and last price by ``order``.

    One order column must be unique within the key and keeps the aggregation hashed.
    Several columns are compared left to right with the price as the last tie-breaker,
    so the result never depends on the arrival of rows.
    """
    if len(order) == 1:
        return F.min_by(price_first, order[0]), F.max_by(price_last, order[0])
    low = F.min(F.struct(*order, F.col(price_first).alias("_price")))
    high = F.max(F.struct(*order, F.col(price_last).alias("_price")))
    return low["_price"], high["_price"]


def roll_up(
    ticks: DataFrame,
    keys: list[Column | str],
    order: list[str],
    open_: str = "px",
    high: str = "px",
    low: str = "px",
    close: str = "px",
    volume: str = "qty",
) -> DataFrame:
    """open = first, high = max, low = min, close = last, volume = sum per key.

    One aggregate: every map task keeps one partial row per key, so a symbol with a
    third of all ticks still ships one row per day and task to the shuffle.
    """
    first, last = first_last(open_, close, order)
    return ticks.groupBy(*keys).agg(
        first.alias("open"),
        F.max(high).alias("high"),
        F.min(low).alias("low"),
        last.alias("close"),
        F.sum(volume).alias("volume"),
    )


SHIFT, BEFORE = 32, 1_000_000  # a DATE is at most 719,162 days before 1970


def pack_day(symbol_id: Column, date: Column) -> Column:
    """Integer symbol and day as one long.

    First and last by several columns need a sorted aggregation; with one long as the
    key that is a radix sort, about twice as fast as sorting by (symbol, date).
    """
    return F.shiftleft(symbol_id.cast("bigint"), SHIFT) + F.unix_date(date) + F.lit(BEFORE)


def unpack_day(key: Column) -> tuple[Column, Column]:
    days = key.bitwiseAND(F.lit((1 << SHIFT) - 1)).cast("int") - F.lit(BEFORE)
    return F.shiftright(key, SHIFT), F.date_from_unix_date(days)


def candles(ticks: DataFrame, width: str, order: list[str], ts: str = "ts", price: str = "px", volume: str = "volume") -> DataFrame:
    """Tumbling candles of any width; also valid on a stream."""
    bars = roll_up(ticks, [F.window(ts, width), F.col("symbol")], order, price, price, price, price, volume)
    return bars.select(F.col("window.start").alias("ts"), "symbol", "open", "high", "low", "close", "volume")


def partial_candles(ticks: DataFrame, width: str, order: list[str], ts: str = "ts", price: str = "px", volume: str = "volume") -> DataFrame:
    """What some of the ticks add to each candle; ``merge_candles`` puts parts together."""
    at = F.struct(*order, price)
    parts = ticks.groupBy(F.window(ts, width).alias("w"), "symbol").agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.max(price).alias("high"), F.min(price).alias("low"), F.sum(volume).alias("volume")
    )
    return parts.select(F.col("w.start").alias("ts"), "symbol", "first", "last", "high", "low", "volume")


def merge_candles(parts: DataFrame, price: str = "px") -> DataFrame:
    return parts.groupBy("symbol", "ts").agg(
        F.min("first")[price].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last")[price].alias("close"), F.sum("volume").alias("volume")
    )


def daily_from_candles(candles_: DataFrame, ts: str = "ts") -> DataFrame:
    """Candles of a day to one daily bar per symbol."""
    day = F.to_date(ts).alias("date")
    return roll_up(candles_, ["symbol", day], [ts], "open", "high", "low", "close", "volume")
