"""Cross-section of the panel per date, market state and sector state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.scalar import flag, ratio
from ..session import stored
from .calendar import by_date, join_daily
from .ranking import percent_ranks


def cross_section(panel: DataFrame) -> DataFrame:
    """Percent ranks of return and volume ratio, excess return, relative volatility.

    Give a stored panel: the ranks and the daily means each read their columns of it.
    """
    universe = panel.groupBy("date").agg(
        F.avg("ret_1d").alias("_mean_ret"), F.avg("volatility_20d").alias("_mean_vol")
    )
    out = percent_ranks(panel, ["date"], {"rank_return": "ret_1d", "rank_volume_ratio": "volume_ratio_20d"})
    out = join_daily(out, universe)
    return out.withColumns(
        {
            "excess_return": F.col("ret_1d") - F.col("_mean_ret"),
            "rel_volatility": ratio("volatility_20d", "_mean_vol"),
        }
    ).drop("_mean_ret", "_mean_vol")


def share(cond: Column) -> Column:
    """Share of rows for which the condition holds; undefined counts as not holding."""
    return F.avg(flag(cond))


def market_state(panel: DataFrame) -> DataFrame:
    """Breadth, dispersion, momentum and volatility regime of the universe, one row per date."""
    daily = panel.groupBy("date").agg(
        share(F.col("ret_1d") > 0).alias("mkt_breadth_1d"),
        share(F.col("dist_sma_20") > 0).alias("mkt_breadth_20d"),
        share(F.col("dist_sma_50") > 0).alias("mkt_breadth_50d"),
        F.stddev_samp("ret_1d").alias("mkt_cs_disp_1d"),
        F.avg("ret_5d").alias("mkt_mom_5d"),
        F.avg("ret_20d").alias("mkt_mom_20d"),
        F.avg("volatility_20d").alias("_vol"),
    )
    regime = ratio("_vol", R.mean("_vol", by_date(), 250, 100))
    return daily.withColumn("mkt_vol_regime", regime).drop("_vol")


def with_market_state(panel: DataFrame) -> DataFrame:
    return join_daily(panel, market_state(panel))


def with_sector(df: DataFrame, sectors: DataFrame, default: str = "Other") -> DataFrame:
    """Sector of the symbol from a (symbol, sector) dimension, ; Spark broadcasts it if its size allows."""
    return df.join(sectors.select("symbol", "sector"), "symbol", "left").withColumn(
        "sector", F.coalesce("sector", F.lit(default))
    )


def with_sector_state(panel: DataFrame) -> DataFrame:
    """Sector momentum, breadth and dispersion per date, and the symbol relative to it.

    The state has one row per date and sector. It is stored, so the planner sees its
    real size and broadcasts it only below its own threshold.
    """
    state = panel.groupBy("date", "sector").agg(
        F.avg("ret_5d").alias("sect_mom_5d"),
        F.avg("ret_20d").alias("sect_mom_20d"),
        share(F.col("ret_1d") > 0).alias("sect_breadth_1d"),
        F.stddev_samp("ret_20d").alias("sect_disp_20d"),
    )
    return panel.join(stored(state, "sectors"), ["date", "sector"]).withColumns(
        {
            "rel_mom_5d": F.col("ret_5d") - F.col("sect_mom_5d"),
            "rel_mom_20d": F.col("ret_20d") - F.col("sect_mom_20d"),
        }
    )
