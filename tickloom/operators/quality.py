"""Data-quality checks, cleaning rules and panel statistics."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import flag, ratio
from .calendar import join_daily
from .dedup import keep_best

RULES = ["invalid_date", "bad_price", "high_below_low", "high_below_body", "negative_volume"]


def failed_rule(dates: str = "date") -> Column:
    """Name of the first rule a bar breaks, in the order the checks run; NULL when clean."""
    prices = ["open", "high", "low", "close"]
    bad = F.lit(False)
    for p in prices:
        bad = bad | F.col(p).isNull() | (F.col(p) <= 0)
    return (
        F.when(F.col(dates).isNull(), "invalid_date")
        .when(bad, "bad_price")
        .when(F.col("high") < F.col("low"), "high_below_low")
        .when(F.col("high") < F.greatest("open", "close"), "high_below_body")
        .when(F.col("volume") < 0, "negative_volume")
    )


def clean_bars(bars: DataFrame, sequence: str) -> DataFrame:
    """Bars that pass every rule, the last written row per (symbol, date)."""
    ok = bars.withColumn("_rule", failed_rule()).where(F.col("_rule").isNull()).drop("_rule")
    return keep_best(ok, ["symbol", "date"], F.col(sequence))


def quality_report(bars: DataFrame) -> DataFrame:
    """Rows before, rows removed per rule (duplicates last), rows after."""
    tagged = bars.withColumn("_rule", failed_rule())
    per_key = tagged.groupBy(
        F.when(F.col("_rule").isNull(), F.col("symbol")).alias("symbol"),
        F.when(F.col("_rule").isNull(), F.col("date")).alias("date"),
        "_rule",
    ).agg(F.count("*").alias("n"))
    ok = F.col("_rule").isNull()
    report = per_key.agg(
        F.sum("n").alias("rows_before"),
        *[F.coalesce(F.sum(F.when(F.col("_rule") == r, F.col("n"))), F.lit(0)).alias(f"{r}_removed") for r in RULES],
        F.coalesce(F.sum(F.when(ok, F.col("n") - 1)), F.lit(0)).alias("duplicate_removed"),
        F.count_if(ok).alias("rows_after"),
    )
    return report


def plausible_returns(df: DataFrame, *returns: str, limit: float = 0.5) -> DataFrame:
    """Rows whose returns are all known and at most ``limit`` in size."""
    keep = F.lit(True)
    for r in returns:
        keep = keep & (F.abs(F.col(r)) <= limit)
    return df.where(keep)


def drop_empty_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows with at least one known feature."""
    return df.dropna(how="all", subset=features)


def prediction_checks(preds: DataFrame) -> DataFrame:
    """One row of checks over a prediction table."""
    per_key = preds.groupBy("date", "symbol").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("actual_direction").isNull() | F.col("actual_return").isNull()).alias("open"),
        F.count_if(~F.coalesce(F.col("predicted_probability").between(0, 1), F.lit(False))).alias("bad_prob"),
        F.count_if(~F.coalesce(F.col("predicted_direction").isin(0, 1), F.lit(False))).alias("bad_dir"),
    )
    return per_key.agg(
        F.sum("n").alias("n_rows"),
        F.sum("open").alias("rows_missing_outcome"),
        F.sum(F.col("n") - 1).alias("duplicate_rows"),
        F.sum("bad_prob").alias("probabilities_out_of_range"),
        F.sum("bad_dir").alias("directions_not_binary"),
    )


def outlier_flags(panel: DataFrame) -> DataFrame:
    """Returns beyond the symbol's own 1st/99th percentile, unusual volume ratios."""
    own = Window.partitionBy("symbol")
    return panel.withColumns(
        {
            "extreme_return_up": flag(F.col("ret_1d") > F.percentile("ret_1d", F.lit(0.99)).over(own)),
            "extreme_return_down": flag(F.col("ret_1d") < F.percentile("ret_1d", F.lit(0.01)).over(own)),
            "extreme_volume": flag(F.col("volume_ratio_20d") > 5.0),
            "low_volume": flag(F.col("volume_ratio_20d") < 0.2),
        }
    )


def _scaled(x: str, mean: Column, sd: Column) -> Column:
    """(x - mean) / sd with sd 0 read as 1."""
    return (F.col(x) - mean) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)


def symbol_zscores(panel: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``new -> old`` z-scores over the full history of the symbol (sample deviation)."""
    own = Window.partitionBy("symbol")
    return panel.withColumns({n: _scaled(x, F.avg(x).over(own), F.stddev_samp(x).over(own)) for n, x in columns.items()})


def date_zscores(panel: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``new -> old`` z-scores within the date; the date's moments are aggregated, not windowed."""
    olds = list(dict.fromkeys(columns.values()))
    moments = panel.groupBy("date").agg(
        *[F.avg(x).alias(f"_mean_{x}") for x in olds], *[F.stddev_samp(x).alias(f"_sd_{x}") for x in olds]
    )
    out = join_daily(panel, moments)
    return out.select(
        *panel.columns, *[_scaled(x, F.col(f"_mean_{x}"), F.col(f"_sd_{x}")).alias(n) for n, x in columns.items()]
    )


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, rows) for the listed columns from one aggregate."""
    one = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("nulls")) for i, c in enumerate(columns)]))
    return one.select("n_rows", pairs.alias("p")).select("p.column_name", "p.nulls", "n_rows")


def symbol_stats(panel: DataFrame, target: str = "target_direction") -> DataFrame:
    return panel.groupBy("symbol").agg(
        F.count("*").alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_if(F.col(target).isNull()).alias("null_targets"),
        F.avg(target).alias("up_share"),
    )


def calendar_coverage(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Business days in [start, end] a symbol has no bar for, never below zero."""
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    days = (last - first).days + 1
    full, rest = divmod(max(days, 0), 7)
    expected = full * 5 + sum((first + dt.timedelta(days=i)).weekday() < 5 for i in range(rest))
    per_day = bars.groupBy("symbol", "date").agg(F.count("*").alias("n"))
    return per_day.groupBy("symbol").agg(
        F.sum("n").alias("n_rows"),
        F.greatest(F.lit(expected) - F.count("*"), F.lit(0)).alias("missing_business_days"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def freshness(bars: DataFrame, today: str) -> DataFrame:
    """Age of the newest date against the last weekday on or before ``today``."""
    day = dt.date.fromisoformat(today)
    weekday = day - dt.timedelta(days=max(0, day.weekday() - 4))
    out = bars.agg(F.max("date").alias("max_date")).withColumn("last_trading_day", F.lit(weekday))
    age = F.date_diff("last_trading_day", "max_date")
    return out.withColumns({"age_days": age, "is_stale": F.coalesce(age > 1, F.lit(True))})


# how a feature's name says what it is: pattern, category, description (\\1, \\2: parts of the name)
FEATURE_RULES = [
    (r"ret_(\d+)d", "returns", r"change of the close over \1 rows"),
    (r"log_ret_(\d+)d", "returns", r"logarithm of the close against \1 rows before"),
    (r"hl_range", "price", "range of the day as a share of the close"),
    (r"co_return", "price", "close against the open of the day"),
    (r"gap_return", "price", "open against the close before"),
    (r"sma_(\d+)", "trend", r"mean close of \1 rows"),
    (r"ema_(\d+)", "trend", r"exponentially smoothed close, span \1"),
    (r"dist_(sma|ema)_(\d+)", "trend", r"distance of the close from \1_\2"),
    (r"sma_(\d+)_(\d+)_cross", "trend", r"flag: the mean of \1 rows is above that of \2"),
    (r"rsi_(\d+)", "momentum", r"relative strength index of \1 rows"),
    (r"rsi_(overbought|oversold)", "momentum", r"flag: the relative strength index is \1"),
    (r"(rsi|macd|volume)_momentum", "momentum", r"change of \1 from the row before"),
    (r"macd(_signal|_hist|_cross)?", "momentum", r"difference of smoothed closes by the close\1"),
    (r"stoch_(k|d)", "momentum", r"stochastic oscillator, line \1"),
    (r"stoch_(cross|extreme_high|extreme_low)", "momentum", r"flag: stochastic oscillator, \1"),
    (r"(plus|minus)_di", "trend", r"directional indicator, \1"),
    (r"adx", "trend", "average directional index"),
    (r"adx_strong", "trend", "flag: the average directional index is above 25"),
    (r"volatility_(\d+)d", "volatility", r"deviation of daily returns over \1 rows"),
    (r"(vol_regime|high_vol_regime|low_vol_regime)", "volatility", r"short against long volatility: \1"),
    (r"atr_(\d+)", "volatility", r"average true range of \1 rows"),
    (r"bb_(upper|lower|position|width)", "volatility", r"Bollinger band, \1"),
    (r"bb_(squeeze|breakout_up|breakout_dn)", "volatility", r"flag: Bollinger band, \1"),
    (r"avg_volume_(\d+)d", "volume", r"mean volume of \1 rows"),
    (r"(volume_pct_change|volume_ratio_20d|volume_spike)", "volume", r"volume against earlier rows: \1"),
    (r"obv(_normalised)?", "volume", r"running total of signed volume\1"),
    (r"(mean_reversion|price_accel|ret_5d_ma|trend_alignment)", "momentum", r"derived from returns and means: \1"),
    (r"(dist_52w_high|dist_52w_low|pct_52w_range)", "range", r"place of the close in its year: \1"),
    (r"target_direction", "label", "1 if the next close is higher, else 0"),
    (r"(symbol|date)", "key", r"\1 of the row"),
    (r"(open|high|low|close|volume)", "bar", r"\1 of the day"),
]


def described(df: DataFrame, extra: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """The columns with category and description as metadata, which plans and files carry along.

    The first rule whose pattern fits the whole name counts; ``extra`` rules go first. A column
    that no rule knows keeps the metadata it has.
    """
    rules = [*(extra or []), *FEATURE_RULES]
    out = []
    for f in df.schema.fields:
        known = next(((c, re.fullmatch(p, f.name).expand(t)) for p, c, t in rules if re.fullmatch(p, f.name)), None)
        metadata = f.metadata | ({"category": known[0], "description": known[1]} if known else {})
        out.append(F.col(f"`{f.name}`").alias(f.name, metadata=metadata))
    return df.select(*out)


def column_catalogue(df: DataFrame) -> DataFrame:
    """One row per column: name, position, type, category and description from its metadata (other: none given)."""
    rows = [(i, f.name, f.dataType.simpleString(), f.metadata.get("category", "other"), f.metadata.get("description", "")) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, category string, description string")


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def feature_columns(df: DataFrame, exclude: set[str], forbidden: set[str], expect: int | None = None) -> list[str]:
    """Numeric columns minus the excluded; labels must not be among them."""
    numeric = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType)
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, numeric) and f.name not in exclude]
    leaks = sorted(set(names) & forbidden)
    if leaks:
        raise ValueError(f"label columns among the features: {leaks}")
    if expect is not None and len(names) != expect:
        raise ValueError(f"{len(names)} feature columns, expected {expect}")
    return names
