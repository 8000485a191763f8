"""Provider formats: the tables are written in a provider's shape and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.technical import forward_return
from ..session import work_folder
from ..sources import readers, sinks
from .base import query

KEY = "symbol date:d "
BAR = "open:f9 high:f9 low:f9 close:f9 volume:f6"


@query("source_provider_bars", KEY + BAR + " source", "SELECT *, 'provider' AS source FROM bars", ("bars",))
def provider_bars(m):
    """Upper-case headers, day-month-year dates, ``mva`` for close, a thin duplicate per day."""
    raw = m.bars.select(
        F.date_format("date", "dd-MMM-yyyy").alias(" DATE "),
        F.col("symbol").alias("SYMBOL"),
        *[F.col(c).cast("string").alias(c.upper()) for c in ("open", "high", "low")],
        F.col("close").cast("string").alias("mva"),
        F.explode(F.array(F.col("volume"), F.lit(0.5))).alias("VOLUME"),
    )
    return readers.provider_bars(raw, None, "provider")


@query("source_ohlcv_csv", KEY + BAR, """SELECT 'MARKET' AS symbol, date, max(open) AS open, max(high) AS high, min(low) AS low, max("close") AS "close", sum(volume) AS volume
    FROM bars GROUP BY date""", ("bars",))
def ohlcv_csv(m):
    folder = work_folder(m.spark, "csv")
    market = m.bars.groupBy("date").agg(
        F.max("open").alias("Open"),
        F.max("high").alias("HIGH"),
        F.min("low").alias("Low"),
        F.max("close").alias("close"),
        F.sum("volume").alias("Volume"),
    )
    market.withColumnRenamed("date", " Date").write.option("header", True).csv(folder)
    return readers.ohlcv_csv(m.spark, folder, "MARKET")


@query(
    "source_exchange_file",
    KEY + BAR,
    """SELECT * FROM bars WHERE date = date '1999-06-15' AND symbol::int < 20 AND volume - 3 >= 0""",
    ("bars",),
)
def exchange_file(m):
    """One day's exchange file: bad rows and symbols outside the universe drop out."""
    day = m.bars.where(F.col("date") == F.lit("1999-06-15").cast("date"))
    raw = day.select(
        F.concat(F.lit(" "), F.col("symbol")).alias("SYMBOL"),
        *[F.col(c).cast("string").alias(f" {c.upper()}") for c in ("open", "high", "low", "close")],
        F.when(F.col("volume") >= 3, F.col("volume").cast("string")).otherwise("n/a").alias("TOTTRDQTY"),
    )
    universe = readers.symbols(m.table("nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("symbol")))
    return readers.exchange_bars(raw, "1999-06-15", universe)


@query(
    "source_delivery_file",
    KEY + "close:f9 volume:f6 delivery_qty:f6 delivery_pct:f6",
    """SELECT symbol, date, "close", volume, delivery_qty, delivery_qty / volume * 100 AS delivery_pct FROM delivery WHERE month(date) <> 2""",
    ("delivery",),
)
def delivery_file(m):
    """Two date formats, other series removed, the share derived from the quantities."""
    odd = F.dayofmonth("date") % 2 == 1
    raw = m.delivery.select(
        F.col("symbol").alias(" SYMBOL"),
        F.when(F.month("date") == 2, "BE").otherwise("EQ").alias("SERIES"),
        F.col("close").cast("string").alias("CLOSE"),
        F.col("volume").cast("string").alias("TOTTRDQTY"),
        F.when(odd, F.date_format("date", "dd-MMM-yyyy")).otherwise(F.date_format("date", "yyyy-MM-dd")).alias("TIMESTAMP"),
        F.col("delivery_qty").cast("string").alias("DELIVERY_QTY"),
    )
    return readers.delivery_file(raw)


@query(
    "source_flows_csv",
    "date:d fii_gross_buy:f9 fii_gross_sell:f9 fii_net:f9 dii_net:f9",
    "SELECT date, fii_gross_buy, fii_gross_buy - fii_net AS fii_gross_sell, fii_gross_buy - (fii_gross_buy - fii_net) AS fii_net, dii_net FROM flows",
    ("flows",),
)
def flows_csv(m):
    """Free-form headers; the missing net is bought minus sold."""
    folder = work_folder(m.spark, "flows")
    m.flows.select(
        F.col("date").alias("Trade Date"),
        F.col("fii_gross_buy").alias("FII Gross Buy Value"),
        (F.col("fii_gross_buy") - F.col("fii_net")).alias("FII Gross Sell Value"),
        F.col("dii_net").alias("DII Net"),
    ).write.option("header", True).csv(folder)
    return readers.flows_csv(m.spark, folder)


@query("source_flows_json", "date:d fii_net:f9 dii_net:f9 fii_gross_buy:f9", "SELECT * FROM flows", ("flows",))
def flows_json(m):
    folder = work_folder(m.spark, "json")
    m.flows.select(
        F.date_format("date", "dd-MMM-yyyy").alias("d"),
        F.col("fii_net").alias("fn"),
        F.col("dii_net").alias("dn"),
        F.col("fii_gross_buy").alias("fb"),
    ).write.json(folder)
    return readers.flows_json(m.spark, folder, multiline=False)


@query(
    "source_panel_table",
    KEY + "close:f9 next_ret:f10",
    """SELECT symbol, date, "close", lead("close") OVER (PARTITION BY symbol ORDER BY date) / "close" - 1 AS next_ret FROM bars
       WHERE date BETWEEN date '1997-01-15' AND date '1998-03-31'""",
    ("bars",),
)
def panel_table(m):
    """Write the panel by year, read a date range of three columns back."""
    folder = work_folder(m.spark, "panel")
    sinks.write_panel(m.bars, folder)
    part = readers.parquet(m.spark, folder, ["symbol", "date", "close"], "1997-01-15", "1998-03-31")
    return forward_return(part)


@query(
    "source_upsert_panel",
    KEY + "close:f9 source",
    """SELECT symbol, date, CASE WHEN date >= date '2000-10-01' THEN "close" + 1 ELSE "close" END AS "close",
       CASE WHEN date >= date '2000-10-01' THEN 'live' ELSE 'historical' END AS source FROM bars""",
    ("bars",),
)
def upsert_panel(m):
    """Merge re-ingested and new dates into a stored panel; only their years are rewritten."""
    folder = work_folder(m.spark, "panel")
    bars = m.bars.select("symbol", "date", "close")
    known = F.col("date") <= F.lit("2000-12-31").cast("date")
    sinks.write_panel(bars.where(known).withColumn("source", F.lit("historical")), folder)
    fresh = bars.where(F.col("date") >= F.lit("2000-10-01").cast("date"))
    fresh = fresh.select("symbol", "date", (F.col("close") + 1).alias("close"), F.lit("live").alias("source"))
    sinks.upsert_panel(m.spark, folder, fresh)
    return sinks.read_panel(m.spark, folder)


@query(
    "source_candle_files",
    KEY + BAR,
    """SELECT symbol, cast(ts AS date) AS date, min_by(open, ts) AS open, max(high) AS high, min(low) AS low, max_by("close", ts) AS "close", sum(volume) AS volume
       FROM candles_5m GROUP BY 1, 2""",
    ("candles_5m",),
)
def candle_files(m):
    """Candles in files (here folders, as a Spark job names its files itself) of one symbol and day."""
    folder = work_folder(m.spark, "candles")
    rows = m.candles_5m.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "open", "high", "low", "close", "volume",
        F.concat("symbol", F.lit("_"), F.date_format("ts", "yyyyMMdd")).alias("file"),
    )
    rows.repartition("file").write.partitionBy("file").option("header", True).csv(folder)
    return readers.daily_from_candle_files(m.spark, folder)


@query(
    "tables_round_trip",
    "format symbol date:d close:f9 volume:f6",
    "SELECT format, symbol, date, \"close\", volume FROM bars, (VALUES ('parquet'), ('csv'), ('json')) f(format)",
    ("bars",),
)
def tables_round_trip(m):
    """The same rows written in three formats and read back."""
    folder = work_folder(m.spark, "tables")
    bars = m.bars.select("symbol", "date", "close", "volume")
    sinks.write_tables(bars, folder, ("parquet", "csv", "json"))
    read = m.spark.read.schema(bars.schema)
    parts = [read.parquet(f"{folder}/parquet"), read.option("header", True).csv(f"{folder}/csv"), read.json(f"{folder}/json")]
    named = [p.withColumn("format", F.lit(n)) for p, n in zip(parts, ("parquet", "csv", "json"), strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])
