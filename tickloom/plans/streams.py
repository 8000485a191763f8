"""Structured Streaming forms, run over all available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import in_session
from ..session import stored, work_folder
from ..streaming import market as SM
from ..streaming.refresh import FeaturePanel, refresh_panel
from .base import cte, query


def event_stream(m):
    """The events table as a stream of four files, a micro-batch each, shaped like ticks.

    The events are dealt to the files by a hash, so every batch brings old and new ones.
    """
    events = m.table("events")
    folder = work_folder(m.spark, "events")
    events.repartition(4, "event_id").write.parquet(folder)
    raw = SM.read_folder(m.spark, folder, events.schema, files_per_batch=1)
    return raw.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.lit(100.0) + F.col("value") / F.lit(10.0)).alias("px"),
        (1 + F.col("event_id") % 100).cast("double").alias("volume"),
        F.col("event_id").alias("seq"),
    )


BAR = "open:f9 high:f9 low:f9 close:f9 volume:f6"


@query("stream_candles", "symbol ts:t " + BAR, "SELECT * FROM candles_5m", ("candles_5m",))
def stream_candles(m):
    return SM.run_candles(m.spark, event_stream(m))


@query(
    "stream_daily_bars",
    "symbol ts:t " + BAR,
    """SELECT event_type AS symbol, date_trunc('day', ts) AS ts, min_by(px, event_id) AS open, max(px) AS high, min(px) AS low, max_by(px, event_id) AS "close", sum(v) AS volume
       FROM (SELECT *, 100.0E0 + value / 10.0E0 AS px, cast(1 + event_id % 100 AS double) AS v FROM events) GROUP BY 1, 2""",
)
def stream_daily_bars(m):
    return SM.run_candles(m.spark, event_stream(m), "1 day")


cte(
    "ev",
    "SELECT event_type AS symbol, ts, 100.0E0 + value / 10.0E0 AS px, event_id AS seq FROM events",
)


@query(
    "stream_upsert_quotes",
    "symbol minute:t px:f9 seq:i",
    "SELECT symbol, date_trunc('minute', ts) AS minute, max_by(px, seq) AS px, max(seq) AS seq FROM ev GROUP BY 1, 2",
    ("ev",),
)
def stream_upsert_quotes(m):
    """Keep the newest quote per (symbol, minute)."""
    quotes = event_stream(m).select("symbol", F.date_trunc("minute", "ts").alias("minute"), "px", "seq")
    return SM.run_upsert(m.spark, quotes, ["symbol", "minute"], tie=["seq"])


@query(
    "stream_latest_quotes",
    "symbol ts:t last_price:f9 prev_close:f9 change:f9 change_percent:f8",
    """SELECT symbol, strftime(max(ts), '%Y-%m-%d %H:%M:%S')::timestamp AS ts, max_by(px, seq) AS last_price, any_value(c) AS prev_close, max_by(px, seq) - any_value(c) AS change, (max_by(px, seq) - any_value(c)) / any_value(c) * 100 AS change_percent
       FROM ev JOIN (SELECT symbol, max_by(px, seq) AS c FROM ev WHERE ts < (SELECT date_trunc('day', max(ts)) FROM ev) GROUP BY 1) USING (symbol) GROUP BY 1""",
    ("ev",),
)
def stream_latest_quotes(m):
    """Newest price per symbol against the close of the day before."""
    latest = SM.run_upsert(m.spark, SM.latest_quotes(event_stream(m)), ["symbol"], mode="update")
    today = m.event_ticks.agg(F.max("ts")).first()[0].date()
    closes = m.event_ticks.where(F.col("ts") < F.lit(today).cast("timestamp")).groupBy("symbol").agg(
        F.max_by("px", "seq").alias("prev_close")
    )
    return SM.with_change(latest, closes)


@query(
    "stream_session_candles",
    "symbol ts:t " + BAR,
    """SELECT symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, min_by(px, seq) AS open, max(px) AS high, min(px) AS low, max_by(px, seq) AS "close", sum(1 + seq % 100) AS volume FROM ev
       WHERE cast(ts AS time) BETWEEN TIME '09:15:00' AND TIME '15:30:00' GROUP BY 1, 2""",
    ("ev",),
)
def stream_session_candles(m):
    return SM.run_candles(m.spark, event_stream(m).where(in_session("ts")), "15 minutes")


def panel_stream(m):
    """Daily bars as a stream of three files: history, then two files of new days, the second with late bars of some symbols."""
    late = F.col("symbol").isin("3", "7") & F.col("date").between(F.lit("2001-06-20").cast("date"), F.lit("2001-07-10").cast("date"))
    at = F.when(late, 2).when(F.col("date") <= F.lit("2001-06-30").cast("date"), 0).when(F.col("date") <= F.lit("2001-08-31").cast("date"), 1).otherwise(2)
    folder = work_folder(m.spark, "daily")
    bars = stored(m.bars, "bars")
    for k in range(3):
        bars.where(at == k).coalesce(1).write.mode("append").parquet(folder)
    return SM.read_folder(m.spark, folder, bars.schema, files_per_batch=1)


@query(
    "stream_refresh",
    "symbol date:d ret_20d:f9 dist_sma_200:f8 ema_26:f6 rsi_14:f6 macd_hist:f8 adx:f6 atr_14:f6 stoch_d:f6 obv_normalised:f6 pct_52w_range:f6 bb_squeeze:f1",
    "SELECT * FROM feat WHERE date >= date '2001-06-15'",
    ("feat",),
)
def stream_refresh(m):
    """Feature rows kept up to date from states, late bars included; equal to a rebuild."""
    folder = work_folder(m.spark, "panel")
    refresh_panel(panel_stream(m), folder, f"{folder}/checkpoint").awaitTermination()
    return FeaturePanel(m.spark, folder).read(since="2001-06-15")
