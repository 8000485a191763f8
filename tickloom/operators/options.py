"""Option-chain features per underlying and day.

A chain holds the listed contracts of one underlying and day (strikes x expiries x 2),
so windows inside a chain stay small whatever the number of trades.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.scalar import ratio

CHAIN = ["symbol", "date"]


def _near_chain(chain: DataFrame) -> DataFrame:
    w = Window.partitionBy(*CHAIN).orderBy("expiry")
    return chain.withColumn("_exp", F.dense_rank().over(w))


def max_pain(chain: DataFrame, mode: str = "reference") -> DataFrame:
    """Strike at which option holders of the near expiry lose most; the lowest on ties.

    ``reference``: total open interest times summed distances. ``per_strike``: open
    interest times distance, summed by strike. Prefix sums over the strikes replace
    the comparison of every strike with every other.
    """
    if mode not in ("reference", "per_strike"):
        raise ValueError(mode)
    near = F.col("_exp") == 1
    call, put = near & (F.col("option_type") == "CE"), near & (F.col("option_type") == "PE")
    zero = F.lit(0.0)
    by_strike = _near_chain(chain).groupBy(*CHAIN, "strike").agg(
        *[
            agg
            for side, cond in (("c", call), ("p", put))
            for agg in (
                F.sum(F.when(cond, F.col("open_interest")).otherwise(zero)).alias(f"{side}_oi"),
                F.sum(F.when(cond, F.lit(1.0)).otherwise(zero)).alias(f"{side}_n"),
            )
        ]
    )
    up = R.running(Window.partitionBy(*CHAIN).orderBy("strike"))
    down = R.running(Window.partitionBy(*CHAIN).orderBy(F.desc("strike")))
    k = F.col("strike")

    def pain(side: str, w, sign: float):
        oi = F.sum(f"{side}_oi").over(w)
        if mode == "reference":
            return oi * (sign * (k * F.sum(f"{side}_n").over(w) - F.sum(F.col(f"{side}_n") * k).over(w)))
        return sign * (k * oi - F.sum(F.col(f"{side}_oi") * k).over(w))

    valued = by_strike.withColumn("pain", pain("c", up, 1.0) + pain("p", down, -1.0))
    return valued.groupBy(*CHAIN).agg(
        F.min_by("strike", F.struct("pain", "strike")).alias("max_pain"), F.min("pain").alias("min_pain")
    )


def option_features(chain: DataFrame, mode: str = "reference") -> DataFrame:
    """Daily measures; days without two expiries or without both option types drop out."""
    tagged = _near_chain(chain)
    near = F.col("_exp") == 1
    call, put = near & (F.col("option_type") == "CE"), near & (F.col("option_type") == "PE")
    distance = F.struct(F.abs(F.col("strike") - F.col("spot_price")), F.col("strike"))
    own = Window.partitionBy(*CHAIN)
    tagged = tagged.withColumn("_atm", F.min_by(F.when(call, F.col("strike")), F.when(call, distance)).over(own))
    atm = F.col("strike") == F.col("_atm")

    def total(cond, col):
        return F.sum(F.when(cond, F.col(col)))

    daily = tagged.groupBy(*CHAIN).agg(
        F.max("_exp").alias("_expiries"),
        F.min("spot_price").alias("_spot"),
        F.min(F.when(near, F.col("expiry"))).alias("_near"),
        total(call, "open_interest").alias("total_call_oi"),
        total(put, "open_interest").alias("total_put_oi"),
        total(call, "volume").alias("total_call_volume"),
        total(put, "volume").alias("total_put_volume"),
        F.max(F.when(call & atm, F.col("iv"))).alias("_call_iv"),
        F.max(F.when(put & atm, F.col("iv"))).alias("_put_iv"),
        F.max(F.when(call & atm, F.col("last_price"))).alias("_call_px"),
        F.max(F.when(put & atm, F.col("last_price"))).alias("_put_px"),
        F.avg(F.when(near & atm, F.col("iv"))).alias("_near_iv"),
        F.avg(F.when((F.col("_exp") == 2) & atm, F.col("iv"))).alias("_far_iv"),
    )
    complete = (F.col("_expiries") >= 2) & F.col("total_call_oi").isNotNull() & F.col("total_put_oi").isNotNull()
    daily = daily.where(complete).join(max_pain(chain, mode).drop("min_pain"), CHAIN)
    return daily.select(
        *CHAIN,
        ((F.col("_call_iv") + F.col("_put_iv")) / 2.0).alias("atm_iv"),
        F.when(F.col("total_call_oi") > 0, ratio("total_put_oi", "total_call_oi")).alias("pcr_oi"),
        F.when(F.col("total_call_volume") > 0, ratio("total_put_volume", "total_call_volume")).alias("pcr_volume"),
        "max_pain",
        ratio(F.col("max_pain") - F.col("_spot"), "_spot").alias("max_pain_distance"),
        (F.coalesce("_call_px", F.lit(0.0)) + F.coalesce("_put_px", F.lit(0.0))).alias("atm_straddle_price"),
        (F.col("_near_iv") - F.col("_far_iv")).alias("iv_term_structure"),
        F.date_diff("_near", "date").alias("near_expiry_days"),
        "total_call_oi",
        "total_put_oi",
        "total_call_volume",
        "total_put_volume",
    )


def option_rolling(daily: DataFrame) -> DataFrame:
    w = R.series()
    return daily.withColumns(
        {
            "iv_percentile_20d": R.rank_pct("atm_iv", w, 20, 10),
            "iv_percentile_60d": R.rank_pct("atm_iv", w, 60, 20),
            "iv_zscore_20d": R.zscore("atm_iv", w, 20, 10),
            "pcr_oi_5d_ma": R.mean("pcr_oi", w, 5),
            "pcr_oi_momentum": R.change("pcr_oi", w, 5),
            "max_pain_dist_5d_ma": R.mean("max_pain_distance", w, 5),
            "straddle_return_1d": R.growth("atm_straddle_price", w),
        }
    )
