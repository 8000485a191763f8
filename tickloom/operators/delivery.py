"""Delivery-share features per symbol and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.scalar import flag, ratio
from .flows import add_streaks


def delivery_features(daily: DataFrame) -> DataFrame:
    """Needs symbol, date, close, volume, delivery_qty, delivery_pct."""
    w = R.series()
    x = F.col("delivery_pct")
    out = daily.select("symbol", "date", "close", "volume", "delivery_pct", "delivery_qty", F.row_number().over(w).alias("_no"))
    out = out.withColumn("_year", R.window_values(x, w, 252))  # shared by the rank and both quantiles
    year = F.col("_year")
    cols = {
        "delivery_value": F.col("delivery_qty") * F.col("close"),
        "delivery_to_volume": ratio("delivery_qty", "volume"),
        "delivery_pct_rank_252d": R.rank_pct_of(year, x, 100),
        "delivery_pct_trend_20d": R.slope(x, "_no", w, 20),
        "high_delivery_flag": flag(x > R.quantile_of(year, 0.7, 100)),
        "low_delivery_flag": flag(x < R.quantile_of(year, 0.3, 100)),
    }
    cols |= {f"delivery_pct_{n}d_ma": R.mean(x, w, n) for n in (5, 10, 20, 50)}
    cols |= {f"delivery_pct_zscore_{n}d": R.zscore(x, w, n, n // 2) for n in (20, 50, 252)}
    cols |= {f"delivery_pct_momentum_{n}d": R.change(x, w, n) for n in (5, 20)}
    out = out.withColumns(cols).drop("_no", "_year", "close", "volume")
    runs = {
        f"consecutive_{side}_delivery": (F.col(f"{side}_delivery_flag") == 1, F.col(f"{side}_delivery_flag") == 0)
        for side in ("high", "low")
    }
    return add_streaks(out, runs, "symbol")
