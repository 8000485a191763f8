"""Readers for the file formats of the data providers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import parse_date, ratio
from ..operators.bars import roll_up
from ..operators.dedup import keep_highest_volume, keep_last

BAR_SCHEMA = "date date, symbol string, open double, high double, low double, close double, volume double, source string"
PRICES = ["open", "high", "low", "close"]


def _headers(df: DataFrame, upper: bool = False) -> DataFrame:
    return df.toDF(*[c.strip().upper() if upper else c.strip().lower() for c in df.columns])


def _number(name: str) -> Column:
    return F.col(f"`{name}`").try_cast("double")


def _text_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text: the types are decided by the caller, bad numbers become NULL."""
    return spark.read.csv(path, header=True, inferSchema=False)


def ohlcv_csv(spark: SparkSession, path: str, symbol: str = "series") -> DataFrame:
    """Single-series CSV: any header case, five required columns, last row per date."""
    df = _headers(_text_csv(spark, path))
    missing = sorted({*PRICES, "volume"} - set(df.columns))
    if missing or "date" not in df.columns:
        raise ValueError(f"missing columns: {missing or ['date']}")
    # rows of one date are ordered by file name, then by their position in the file
    place = F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    rows = df.withColumn("_seq", place)
    rows = rows.select(
        F.to_date(parse_date("date", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")).alias("date"),
        F.lit(symbol).alias("symbol"),
        *[_number(c).alias(c) for c in [*PRICES, "volume"]],
        "_seq",
    ).where(F.col("date").isNotNull())
    return keep_last(rows, ["symbol", "date"], "_seq").drop("_seq")


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Panel scan with column pruning and an inclusive date range, both pushed to the files."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    return date_range(df, start, end)


def date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def provider_bars(df: DataFrame, symbol: str | None, source: str) -> DataFrame:
    """Provider columns to the bar schema; the highest volume wins among rows of one date."""
    df = _headers(df)
    df = df.withColumnsRenamed({k: v for k, v in {"mva": "close", "prev. close": "prev_close"}.items() if k in df.columns and v not in df.columns})
    missing = sorted({"date", *PRICES, "volume"} - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    kind = dict(df.dtypes)["date"]
    date = F.col("date").cast("date") if kind in ("date", "timestamp", "timestamp_ntz") else parse_date("date", "dd-MMM-yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")
    bars = df.select(
        date.alias("date"),
        (F.lit(symbol) if symbol else F.col("symbol")).alias("symbol"),
        *[_number(c).alias(c) for c in [*PRICES, "volume"]],
        F.lit(source).alias("source"),
    )
    return keep_highest_volume(bars, tie=("close", "open", "high", "low"))


def flow_columns(names: Iterable[str]) -> dict[str, str]:
    """Map header names to date / fii_* / dii_* by the words they contain."""
    found: dict[str, str] = {}
    for name in names:
        n = name.strip().lower().replace(" ", "_")
        side = "fii" if "fii" in n else "dii" if "dii" in n else None
        if "date" in n:
            target = "date"
        elif side and "net" in n:
            target = f"{side}_net"
        elif side and "buy" in n and ("gross" in n or "purchas" in n):
            target = f"{side}_gross_buy"
        elif side and "sell" in n and ("gross" in n or "sales" in n):
            target = f"{side}_gross_sell"
        else:
            continue
        found.setdefault(target, name)
    return found


def flows_from(df: DataFrame) -> DataFrame:
    """Flow table from any header spelling; net = buy - sell where it is not given."""
    columns = flow_columns(df.columns)
    if "date" not in columns:
        raise ValueError("no date column")
    out = {"date": parse_date(F.col(f"`{columns['date']}`"), "yyyy-MM-dd", "dd-MMM-yyyy", "dd/MM/yyyy")}
    for side in ("fii", "dii"):
        for part in ("gross_buy", "gross_sell"):
            if f"{side}_{part}" in columns:
                out[f"{side}_{part}"] = _number(columns[f"{side}_{part}"])
        if f"{side}_net" in columns:
            out[f"{side}_net"] = _number(columns[f"{side}_net"])
        elif {f"{side}_gross_buy", f"{side}_gross_sell"} <= set(out):
            out[f"{side}_net"] = out[f"{side}_gross_buy"] - out[f"{side}_gross_sell"]
    return df.select(*[c.alias(n) for n, c in out.items()]).where(F.col("date").isNotNull())


def flows_csv(spark: SparkSession, path: str) -> DataFrame:
    return flows_from(_text_csv(spark, path))


def flows_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """JSON records d, fb, fs, fn, db, ds, dn with dates like 05-Jan-2024."""
    raw = spark.read.schema("d string, fb double, fs double, fn double, db double, ds double, dn double").json(path, multiLine=multiline)
    names = {"fb": "fii_gross_buy", "fs": "fii_gross_sell", "fn": "fii_net", "db": "dii_gross_buy", "ds": "dii_gross_sell", "dn": "dii_net"}
    out = raw.select(parse_date("d", "dd-MMM-yyyy").alias("date"), *[F.col(k).alias(v) for k, v in names.items()])
    return out.where(F.col("date").isNotNull())


def exchange_bars(df: DataFrame, date: str, universe: DataFrame, source: str = "exchange_eod") -> DataFrame:
    """End-of-day exchange file of one date: valid bars of the universe's symbols."""
    df = _headers(df, upper=True)
    missing = sorted({"SYMBOL", "OPEN", "HIGH", "LOW", "CLOSE"} - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    volume = "TOTTRDQTY" if "TOTTRDQTY" in df.columns else "VOLUME"
    bars = df.select(
        F.lit(date).cast("date").alias("date"),
        F.upper(F.trim("SYMBOL")).alias("symbol"),
        *[_number(c.upper()).alias(c) for c in PRICES],
        _number(volume).alias("volume"),
        F.lit(source).alias("source"),
    )
    valid = (F.col("volume") >= 0) & (F.col("high") >= F.col("low"))
    for p in PRICES:
        valid = valid & (F.col(p) > 0)
    return bars.where(valid).join(universe.select("symbol"), "symbol", "left_semi").select(*bars.columns)


DELIVERY_NAMES = {
    "SYMBOL": "symbol", "SERIES": "series", "OPEN": "open", "HIGH": "high", "LOW": "low", "CLOSE": "close",
    "LAST": "last", "PREVCLOSE": "prev_close", "TOTTRDQTY": "volume", "TOTTRDVAL": "turnover",
    "TIMESTAMP": "date", "TOTALTRADES": "trades", "ISIN": "isin", "DELIVERY_QTY": "delivery_qty",
    "DELIVERY_PERCENT": "delivery_pct",
}


def delivery_file(df: DataFrame) -> DataFrame:
    """Exchange file with delivery columns: equity series only, share derived if absent."""
    df = _headers(df, upper=True).withColumnsRenamed(DELIVERY_NAMES)
    missing = sorted({"symbol", "date", "close", "volume"} - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if "series" in df.columns:
        df = df.where(F.trim("series") == "EQ")
    numeric = [c for c in (*PRICES, "volume", "delivery_qty", "delivery_pct") if c in df.columns]
    out = df.withColumns({c: _number(c) for c in numeric} | {"date": parse_date("date", "dd-MMM-yyyy", "yyyy-MM-dd")})
    if "delivery_pct" not in df.columns and "delivery_qty" in df.columns:
        out = out.withColumn("delivery_pct", ratio("delivery_qty", "volume") * 100.0)
    return out.where(F.col("date").isNotNull())


def with_name_keys(df: DataFrame, name: Column) -> DataFrame:
    """symbol and date from names <symbol>_YYYYMMDD or <symbol>_YYYY-MM-DD; others drop out."""
    day = F.regexp_extract(name, r"_([^_]*)$", 1)
    out = df.withColumns({"symbol": F.regexp_extract(name, r"^(.*)_[^_]*$", 1), "date": parse_date(day, "yyyyMMdd", "yyyy-MM-dd")})
    return out.where((F.col("symbol") != "") & F.col("date").isNotNull())


def with_file_keys(df: DataFrame) -> DataFrame:
    """symbol and date from the names of the files the rows come from."""
    return with_name_keys(df, F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1))


CANDLE_SCHEMA = "timestamp string, open double, high double, low double, close double, volume double"


def candle_files(spark: SparkSession, folder: str) -> DataFrame:
    """Intraday candle files, one per symbol and day.

    The keys come from the name <symbol>_<day>, of the file or of the folder that a
    distributed writer made of it (<symbol>_<day>/part-..., key=<symbol>_<day>/part-...).
    """
    raw = spark.read.schema(CANDLE_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder, header=True)
    path = F.regexp_replace(F.url_decode("_metadata.file_path"), r"/part-[^/]*$", "")
    out = with_name_keys(raw, F.regexp_extract(path, r"([^/=]*?)(?:\.csv)?$", 1))
    return out.withColumn("ts", F.try_to_timestamp("timestamp"))


def daily_from_candle_files(spark: SparkSession, folder: str, source: str = "live") -> DataFrame:
    rows = candle_files(spark, folder)
    bars = roll_up(rows, ["symbol", "date"], ["ts"], "open", "high", "low", "close", "volume")
    return bars.withColumn("source", F.lit(source))


def symbols(df: DataFrame) -> DataFrame:
    """Universe: the symbol column (or the first), trimmed, without empty entries."""
    name = "symbol" if "symbol" in df.columns else df.columns[0]
    return df.select(F.trim(F.col(f"`{name}`").cast("string")).alias("symbol")).where(F.col("symbol") != "").distinct()


def symbols_csv(spark: SparkSession, path: str) -> DataFrame:
    return symbols(_text_csv(spark, path))
