"""Market-wide daily series: institutional flows and macro series (one row per date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.scalar import flag, ratio
from .asof import asof_daily
from .calendar import by_date


def add_streaks(df: DataFrame, streaks: dict[str, tuple[Column, Column]], *partition: str) -> DataFrame:
    """``name -> (hit, reset)``: hits counted since the last reset row."""
    w = R.series(*partition) if partition else by_date()
    islands = {f"_island_{n}": R.streak_island(reset, w) for n, (_, reset) in streaks.items()}
    out = df.withColumns(islands)
    lengths = {
        n: R.streak_length(hit, f"_island_{n}", *partition) if partition else R.streak_length(hit, f"_island_{n}", f"_island_{n}")
        for n, (hit, _) in streaks.items()
    }
    return out.withColumns(lengths).drop(*islands)


def flow_features(flows: DataFrame, windows: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    """Features of foreign (fii) and domestic (dii) net flows."""
    w = by_date()
    base: dict[str, Column] = {}
    for side in ("fii", "dii"):
        x = f"{side}_net"
        base |= {f"{x}_{n}d_ma": R.mean(x, w, n) for n in windows}
        base |= {f"{x}_zscore_{n}d": R.zscore(x, w, n) for n in (20, 50)}
        base |= {f"{side}_momentum_{n}d": R.change(x, w, n) for n in (5, 20)}
        base[f"{x}_positive"] = flag(F.col(x) > 0)
    base["fii_dii_net_spread"] = F.col("fii_net") - F.col("dii_net")
    base |= {f"fii_dii_corr_{n}d": R.correlation("fii_net", "dii_net", w, n, m) for n, m in ((20, 10), (50, 20))}
    gross = {"fii_gross_buy", "dii_gross_buy"} <= set(flows.columns)
    if gross:
        base["fii_dii_buy_ratio"] = ratio("fii_gross_buy", "dii_gross_buy")
    out = flows.withColumns(base)
    later = {f"fii_dii_net_spread_{n}d_ma": R.mean("fii_dii_net_spread", w, n) for n in (5, 20)}
    later["fii_dii_same_direction"] = flag(F.col("fii_net_positive") == F.col("dii_net_positive"))
    if gross:
        later["fii_dii_buy_ratio_5d_ma"] = R.mean("fii_dii_buy_ratio", w, 5)
    out = out.withColumns(later)
    runs = {}
    for side in ("fii", "dii"):
        x = F.col(f"{side}_net")
        runs[f"{side}_consecutive_buy"] = (x > 0, x <= 0)
        runs[f"{side}_consecutive_sell"] = (x < 0, x >= 0)
    out = add_streaks(out, runs)
    return out.drop(*[c for c in flows.columns if c != "date"])


MACRO = {"spx": (1, 5), "usdinr": (1,), "crude": (1, 5)}


def macro_features(dates: DataFrame, vix: DataFrame, foreign: dict[str, DataFrame], lags: dict[str, tuple[int, ...]] = MACRO) -> DataFrame:
    """Volatility index level, change, z-score and regime; lagged foreign returns.

    The domestic index may be known on the day itself, a foreign close only the day
    after, so foreign returns use the latest date strictly before.
    """
    w = by_date()
    out = asof_daily(dates, vix.where(F.col("close").isNotNull()).select("date", F.col("close").alias("vix_level")), ["vix_level"])
    out = out.withColumns(
        {
            "vix_chg1d": R.growth("vix_level", w),
            "vix_z20": R.zscore("vix_level", w, 20, 10, ddof=1),
            "vix_high_regime": flag(F.col("vix_level") > R.quantile("vix_level", 0.5, w, 60, 20)),
        }
    )
    for name, series in foreign.items():
        for lag in lags[name]:
            col = f"{name}_ret{lag}d_lag"
            returns = series.where(F.col("close").isNotNull()).select("date", R.growth("close", w, lag).alias(col))
            out = asof_daily(out, returns.where(F.col(col).isNotNull()), [col], inclusive=False)
    return out


def coverage(df: DataFrame, columns: list[str], at_least: float = 0.99) -> DataFrame:
    """Share of known values per column and whether it reaches ``at_least``."""
    one = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("coverage")) for c in columns]))
    return one.select(pairs.alias("p")).select("p.*", (F.col("p.coverage") >= at_least).alias("enough"))
