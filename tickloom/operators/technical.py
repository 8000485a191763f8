"""Technical indicators of one symbol's daily bars.

A family is a list of stages. Families asked for together run stage by stage, so all
windows share one sort by (symbol, date) and all smoothed series share two scans.
Input: one row per (symbol, date) with open, high, low, close, volume.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.scalar import clamp, flag, ratio
from ..functions.smoothing import smooth, span, wilder

Stage = Callable[[WindowSpec], dict]
STAGES = ("base", "second", "smooth", "third", "smooth_again", "fourth", "last")
HORIZONS = (1, 2, 3, 5, 10, 20)
AVERAGES = (5, 10, 20, 50, 200)


def _prev(name: str, w: WindowSpec, n: int = 1) -> Column:
    return F.lag(name, n).over(w)


def _true_range(w: WindowSpec) -> Column:
    """greatest() skips NULL, so the first bar has high - low."""
    before = _prev("close", w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def _returns(w):
    return {f"ret_{d}d": R.growth("close", w, d) for d in HORIZONS} | {
        f"log_ret_{d}d": F.ln(ratio("close", _prev("close", w, d))) for d in HORIZONS
    }


def _price(w):
    before = _prev("close", w)
    return {
        "hl_range": ratio(F.col("high") - F.col("low"), "close"),
        "co_return": ratio(F.col("close") - F.col("open"), "open"),
        "gap_return": ratio(F.col("open") - before, before),
    }


def _distance(x: str, to: str) -> Column:
    return ratio(F.col(x) - F.col(to), to)


def _directional(w):
    up = F.greatest(F.col("high") - _prev("high", w), F.lit(0.0))
    down = F.greatest(_prev("low", w) - F.col("low"), F.lit(0.0))
    known = _prev("high", w).isNotNull()
    return {
        "_tr": _true_range(w),
        "_up": F.when(known, F.when(up < down, 0.0).otherwise(up)),
        "_down": F.when(known, F.when(down < up, 0.0).otherwise(down)),
    }


def _di(side: str) -> Column:
    return 100.0 * ratio(side, "_atr")


def _signed_volume(w):
    return F.coalesce(F.signum(F.col("close") - _prev("close", w)), F.lit(0.0)) * F.col("volume")


def _long_averages(w):
    return {
        "sma_50": R.chain("_sum_10", w, 50, 10, R.total) / 50.0,
        "sma_200": R.chain("_sum_20", w, 200, 20, R.total) / 200.0,
    }


EMA = {"ema_12": ("close", span(12), 1), "ema_26": ("close", span(26), 1)}
ATR = {"_atr": ("_tr", wilder(14), 14)}

FAMILIES: dict[str, dict[str, object]] = {
    "returns": {"base": _returns},
    "price": {"base": _price},
    "trend": {
        "base": lambda w: {f"sma_{n}": R.mean("close", w, n) for n in (5, 10, 20)}
        | {f"_sum_{n}": R.rolling(F.sum, "close", w, n) for n in (10, 20)},
        "second": _long_averages,
        "smooth": EMA,
        "third": lambda w: {f"dist_ema_{n}": _distance("close", f"ema_{n}") for n in (12, 26)}
        | {f"dist_sma_{n}": _distance("close", f"sma_{n}") for n in AVERAGES}
        | {f"sma_{a}_{b}_cross": R.above(f"sma_{a}", f"sma_{b}") for a, b in zip(AVERAGES, AVERAGES[1:])},
    },
    "rsi": {
        "base": lambda w: {
            "_gain": F.greatest(R.change("close", w), F.lit(0.0)) * F.when(_prev("close", w).isNotNull(), 1.0),
            "_loss": F.greatest(-R.change("close", w), F.lit(0.0)) * F.when(_prev("close", w).isNotNull(), 1.0),
        },
        "smooth": {"_avg_gain": ("_gain", wilder(14), 14), "_avg_loss": ("_loss", wilder(14), 14)},
        # warm-up rows and rows without any loss are 100
        "third": lambda w: {
            "rsi_14": F.coalesce(100.0 - 100.0 / (1.0 + ratio("_avg_gain", "_avg_loss")), F.lit(100.0))
        },
        "fourth": lambda w: {
            "rsi_momentum": R.change("rsi_14", w),
            "rsi_overbought": flag(F.col("rsi_14") > 70),
            "rsi_oversold": flag(F.col("rsi_14") < 30),
        },
    },
    "macd": {
        "smooth": EMA,
        "third": lambda w: {"_macd_line": F.col("ema_12") - F.col("ema_26")},
        "smooth_again": {"_macd_signal": ("_macd_line", span(9), 1)},
        "fourth": lambda w: {
            "macd": ratio("_macd_line", "close"),
            "macd_signal": ratio("_macd_signal", "close"),
            "macd_hist": ratio(F.col("_macd_line") - F.col("_macd_signal"), "close"),
        },
        "last": lambda w: {
            "macd_momentum": R.change("macd_hist", w),
            "macd_cross": R.above("macd", "macd_signal"),
        },
    },
    "stochastic": {
        "base": lambda w: {"_low_14": R.low("low", w, 14), "_high_14": R.high("high", w, 14)},
        "second": lambda w: {
            "stoch_k": clamp(ratio(100.0 * (F.col("close") - F.col("_low_14")), F.col("_high_14") - F.col("_low_14")))
        },
        "third": lambda w: {"stoch_d": R.mean("stoch_k", w, 3)},
        "fourth": lambda w: {
            "stoch_cross": R.above("stoch_k", "stoch_d"),
            "stoch_extreme_high": flag(F.col("stoch_k") > 80),
            "stoch_extreme_low": flag(F.col("stoch_k") < 20),
        },
    },
    "adx": {
        "base": _directional,
        "smooth": ATR | {"_di_up": ("_up", wilder(14), 14), "_di_down": ("_down", wilder(14), 14)},
        "third": lambda w: {
            "plus_di": _di("_di_up"),
            "minus_di": _di("_di_down"),
            "_dx": 100.0 * ratio(F.abs(_di("_di_up") - _di("_di_down")), _di("_di_up") + _di("_di_down")),
        },
        "smooth_again": {"adx": ("_dx", wilder(14), 14)},
        "fourth": lambda w: {"adx_strong": flag(F.col("adx") > 25)},
    },
    "volatility": {
        "base": lambda w: {"_ret": R.growth("close", w, 1)},
        "second": lambda w: {f"volatility_{n}d": R.std("_ret", w, n) for n in (5, 10, 20, 50)},
        "third": lambda w: {"vol_regime": ratio("volatility_5d", "volatility_20d")},
        "fourth": lambda w: {
            "high_vol_regime": flag(F.col("vol_regime") > 1.5),
            "low_vol_regime": flag(F.col("vol_regime") < 0.5),
        },
    },
    "atr": {
        "base": lambda w: {"_tr": _true_range(w)},
        "smooth": ATR,
        "third": lambda w: {"atr_14": F.col("_atr")},
    },
    "bollinger": {
        "base": lambda w: {"_mid": R.mean("close", w, 20), "_sd": R.std("close", w, 20)},
        "second": lambda w: {
            "bb_upper": F.col("_mid") + 2.0 * F.col("_sd"),
            "bb_lower": F.col("_mid") - 2.0 * F.col("_sd"),
        },
        "third": lambda w: {
            "bb_position": ratio(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")),
            "bb_width": F.when(F.col("bb_upper") != F.col("bb_lower"), ratio(F.col("bb_upper") - F.col("bb_lower"), "_mid")),
        },
        "fourth": lambda w: {
            "bb_squeeze": flag(F.col("bb_width") < R.quantile("bb_width", 0.1, w, 20)),
            "bb_breakout_up": flag(F.col("bb_position") > 0.95),
            "bb_breakout_dn": flag(F.col("bb_position") < 0.05),
        },
    },
    "volume": {
        "base": lambda w: {
            "volume_pct_change": ratio(F.col("volume") - _prev("volume", w), F.abs(_prev("volume", w))),
            "_signed_volume": _signed_volume(w),
        }
        | {f"avg_volume_{n}d": R.mean("volume", w, n) for n in (5, 10, 20)},
        "second": lambda w: {
            "volume_ratio_20d": ratio("volume", "avg_volume_20d"),
            "obv": F.sum("_signed_volume").over(R.running(w)),
        },
        "third": lambda w: {
            "obv_normalised": ratio("obv", R.std("obv", w, 20)),
            "volume_spike": flag(F.col("volume_ratio_20d") > 2.0),
            "volume_momentum": R.change("volume_ratio_20d", w),
        },
    },
    "momentum": {
        "base": lambda w: {f"_m{d}": R.growth("close", w, d) for d in (1, 5)}
        | {f"_a{n}": R.mean("close", w, n) for n in (5, 20)}
        | {"_sum_10": R.rolling(F.sum, "close", w, 10)},
        "second": lambda w: {
            "mean_reversion": F.col("_m1") - F.col("_m5") / 5.0,
            "price_accel": R.change("_m5", w),
            "ret_5d_ma": R.mean("_m5", w, 5),
            "_a50": R.chain("_sum_10", w, 50, 10, R.total) / 50.0,
        },
        "third": lambda w: {
            "trend_alignment": sum((flag(F.col("close") > F.col(f"_a{n}")) for n in (5, 20, 50)), F.lit(0.0)) / 3.0
        },
    },
    "range_52w": {
        "base": lambda w: {"_top_21": R.high("close", w, 21), "_floor_21": R.low("close", w, 21)},
        "second": lambda w: {
            "_top": R.chain("_top_21", w, 252, 21, lambda p: F.greatest(*p)),
            "_floor": R.chain("_floor_21", w, 252, 21, lambda p: F.least(*p)),
        },
        "third": lambda w: {
            "dist_52w_high": _distance("close", "_top"),
            "dist_52w_low": _distance("close", "_floor"),
            "pct_52w_range": ratio(F.col("close") - F.col("_floor"), F.col("_top") - F.col("_floor")),
        },
    },
}


# what a series carries on from row to row: its smoothed values and its running total
CARRIED = ("ema_12", "ema_26", "_avg_gain", "_avg_loss", "_atr", "_di_up", "_di_down", "_macd_signal", "adx", "obv")


def indicators(bars: DataFrame, *families: str, seeds: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The bars plus the columns of the chosen families (default: all).

    ``seeds`` (a column of ``CARRIED`` -> the input column that holds it in the first row of a
    symbol) lets a series go on where an earlier run left it; ``keep`` names inner columns to return.
    """
    chosen = [FAMILIES[f] for f in (families or FAMILIES)]
    w = R.series()
    out = bars
    for stage in STAGES:
        merged: dict = {}
        for family in chosen:
            part = family.get(stage, {})
            merged |= part(w) if callable(part) else part
        if not merged:
            continue
        if stage.startswith("smooth"):
            out = smooth(out, merged, seeds=seeds)
        else:
            out = out.withColumns(merged)
            if "obv" in merged and "obv" in (seeds or {}):
                out = out.withColumn("obv", F.col("obv") + F.coalesce(F.first(seeds["obv"]).over(R.running(w)), F.lit(0.0)))
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in keep])


def label(bars: DataFrame, horizon: int = 1, name: str = "target_direction") -> DataFrame:
    """1 when the close ``horizon`` rows ahead is higher, 0 when not, NULL without a future row."""
    if horizon < 1:
        raise ValueError("horizon must be >= 1")
    ahead = F.lead("close", horizon).over(R.series())
    return bars.withColumn(name, F.when(ahead.isNotNull(), (ahead > F.col("close")).cast("double")))


def forward_return(bars: DataFrame, horizon: int = 1, name: str = "next_ret") -> DataFrame:
    return bars.withColumn(name, ratio(F.lead("close", horizon).over(R.series()), "close") - 1.0)


def feature_panel(bars: DataFrame) -> DataFrame:
    """Every per-symbol feature and the next-day label."""
    return label(indicators(bars))


COMPACT = [
    "ret_1d", "ret_5d", "log_ret_1d", "sma_20_ratio", "sma_50_ratio", "ema_20_ratio", "sma_20_50_cross",
    "rsi_14", "macd", "macd_signal", "macd_hist", "bb_position", "bb_width", "atr_14_ratio",
    "volatility_10", "volatility_20", "volume_ratio", "volume_change",
]


def compact_features(bars: DataFrame) -> DataFrame:
    """The 18-column single-series feature set; its ``sma_20_50_cross`` is a ratio, not a flag."""
    w = R.series()
    out = indicators(bars, "rsi", "macd", "atr", "bollinger").withColumns(
        {
            "ret_1d": R.growth("close", w, 1),
            "ret_5d": R.growth("close", w, 5),
            "log_ret_1d": F.ln(ratio("close", _prev("close", w))),
            "_s20": R.mean("close", w, 20),
            "_s50": R.mean("close", w, 50),
            "_v20": R.mean("volume", w, 20),
            "_v": _prev("volume", w),
        }
    )
    out = smooth(out, {"_e20": ("close", span(20), 1)})
    out = out.withColumns(
        {
            "sma_20_ratio": ratio("close", "_s20") - 1.0,
            "sma_50_ratio": ratio("close", "_s50") - 1.0,
            "ema_20_ratio": ratio("close", "_e20") - 1.0,
            "sma_20_50_cross": ratio("_s20", "_s50") - 1.0,
            "bb_width": ratio(F.col("bb_upper") - F.col("bb_lower"), "_s20"),
            "atr_14_ratio": ratio("atr_14", "close"),
            "volatility_10": R.std("ret_1d", w, 10),
            "volatility_20": R.std("ret_1d", w, 20),
            "volume_ratio": ratio("volume", "_v20"),
            "volume_change": ratio(F.col("volume") - F.col("_v"), F.abs("_v")),
        }
    )
    return out.select(*bars.columns, *COMPACT)


def model_ready(bars: DataFrame, horizon: int = 1) -> DataFrame:
    """Compact features and label, rows with any missing value dropped."""
    out = label(compact_features(bars), horizon, "label")
    return out.dropna(subset=[*COMPACT, "label"])
