"""Daily microstructure measures from intraday candles.

Windows are per (symbol, day): at most one row per candle of a session.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.scalar import in_session, minute_of_day, ratio

YEARLY = math.sqrt(252 * 78)  # 78 five-minute candles in a session
DAY = ["symbol", "date"]


def intraday_features(candles: DataFrame, start: str = "09:15", end: str = "15:30", min_bars: int = 10) -> DataFrame:
    session = candles.where(in_session("ts", start, end)).withColumn("date", F.to_date("ts"))
    w = Window.partitionBy(*DAY).orderBy("ts")
    before = F.lag("close").over(w)
    bars = session.withColumns(
        {
            "_r": F.ln(ratio("close", before)),
            "_d": F.col("close") - before,
            "_pct": ratio("close", before) - 1.0,
            "_minute": minute_of_day("ts"),
            "_hour": F.hour("ts"),
            "_no": F.row_number().over(w),
        }
    )
    hour = Window.partitionBy(*DAY, "_hour")
    bars = bars.withColumns(
        {
            "_r_before": F.lag("_r").over(w),
            "_hour_sd": F.stddev_samp("_pct").over(hour),
            "_hour_first": F.min("_no").over(hour) == F.col("_no"),
        }
    )
    later = F.col("_no") > 1
    signed = F.when(later, F.col("volume") * F.signum("_d"))

    def vol(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("volume"))), F.lit(0.0))

    def stretch(cond: Column) -> Column:
        first = F.min_by(F.when(cond, F.col("open")), F.when(cond, F.col("ts")))
        last = F.max_by(F.when(cond, F.col("close")), F.when(cond, F.col("ts")))
        return F.when(F.count_if(cond) > 1, ratio(last - first, first))

    def hourly(lo: int, hi: int) -> Column:
        return F.avg(F.when(F.col("_hour_first") & F.col("_hour").between(lo, hi), F.col("_hour_sd")))

    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    both = F.col("_r").isNotNull() & F.col("_r_before").isNotNull()
    day = bars.groupBy(*DAY).agg(
        F.count("*").alias("num_trades"),
        F.sum("volume").alias("total_volume"),
        F.sum(typical * F.col("volume")).alias("_pv"),
        F.min_by("open", "ts").alias("_open"),
        F.max_by("close", "ts").alias("_close"),
        F.max("high").alias("_high"),
        F.min("low").alias("_low"),
        F.sum(F.col("_r") * F.col("_r")).alias("_r2"),
        F.sum(F.pow(F.ln(ratio("high", "low")), F.lit(2.0))).alias("_hl2"),
        stretch(F.col("_minute") * 60 + F.second("ts") <= (10 * 60 + 15) * 60).alias("first_hour_return"),
        stretch(F.col("_minute") >= 14 * 60 + 30).alias("last_hour_return"),
        vol(F.col("_minute") < 12 * 60).alias("_am"),
        vol(F.col("_minute") >= 12 * 60).alias("_pm"),
        vol(later).alias("_later_volume"),
        F.sum(F.col("_d") * F.col("volume")).alias("_dv"),
        F.avg("_d").alias("_d_mean"),
        vol(F.col("_d") > 0).alias("_up"),
        vol(F.col("_d") < 0).alias("_down"),
        F.covar_samp(F.when(both, F.col("_r_before")), F.when(both, F.col("_r"))).alias("_roll"),
        F.covar_samp("_r", signed).alias("_impact"),
        F.var_pop(signed).alias("_signed_var"),
        hourly(9, 11).alias("morning_volatility"),
        hourly(13, 15).alias("afternoon_volatility"),
    )
    day = day.where(F.col("num_trades") >= min_bars).withColumn("vwap", ratio("_pv", "total_volume"))
    ret = ratio(F.col("_close") - F.col("_open"), "_open")
    weighted = F.when(F.col("_later_volume") > 0, ratio("_dv", "_later_volume")).otherwise(F.col("_d_mean"))
    return day.select(
        *DAY,
        "vwap",
        ratio(F.col("_close") - F.col("vwap"), "vwap").alias("vwap_deviation"),
        ratio(F.col("_high") - F.col("_low"), "_close").alias("intraday_range"),
        (F.sqrt("_r2") * YEARLY).alias("realized_volatility"),
        (F.sqrt(F.col("_hl2") / (4.0 * math.log(2.0) * F.col("num_trades"))) * YEARLY).alias("parkinson_volatility"),
        "first_hour_return",
        "last_hour_return",
        F.when(F.col("_pm") > 0, ratio("_am", "_pm")).alias("am_pm_volume_ratio"),
        ratio(weighted, "_close").alias("volume_weighted_momentum"),
        ratio(F.col("_up") - F.col("_down"), F.col("_up") + F.col("_down")).alias("order_flow_imbalance"),
        F.when((F.col("num_trades") > 11) & (F.col("_roll") < 0), 2.0 * F.sqrt(-F.col("_roll"))).alias("roll_spread"),
        F.when(F.col("num_trades") > 10, ratio("_impact", "_signed_var")).alias("kyle_lambda"),
        ratio(F.abs(ret), "total_volume").alias("amihud_illiquidity"),
        "morning_volatility",
        "afternoon_volatility",
        F.when(F.col("afternoon_volatility") > 0, ratio("morning_volatility", "afternoon_volatility")).alias(
            "vol_ratio_morning_afternoon"
        ),
        ret.alias("close_to_close_return"),
        ret.alias("open_to_close_return"),
        "total_volume",
        "num_trades",
    )


ROLLED = [
    "vwap_deviation", "realized_volatility", "order_flow_imbalance", "roll_spread", "kyle_lambda",
    "amihud_illiquidity", "first_hour_return", "last_hour_return", "am_pm_volume_ratio",
]


def intraday_rolling(daily: DataFrame) -> DataFrame:
    w = R.series()
    cols = {}
    for x in ROLLED:
        cols |= {
            f"{x}_5d_ma": R.mean(x, w, 5),
            f"{x}_20d_ma": R.mean(x, w, 20),
            f"{x}_zscore_20d": R.zscore(x, w, 20, 10),
        }
    cols["realized_vol_regime"] = ratio("realized_volatility", R.mean("realized_volatility", w, 60, 20))
    cols["ofi_regime"] = ratio("order_flow_imbalance", R.std("order_flow_imbalance", w, 20, 10))
    return daily.withColumns(cols)
