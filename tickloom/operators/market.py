"""Questions a market screen asks: quotes, movers, symbol pages, index proxy, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.scalar import ratio
from ..functions.smoothing import smooth, span
from .calendar import one_row
from .ranking import percent_ranks, row_numbers
from .scoring import latest_rows, regime_label, sentiment_label


def last_two_dates(bars: DataFrame) -> DataFrame:
    """The newest date of the table (number 1) and the newest date below it (number 2)."""
    newest = Window.partitionBy(F.lit(0)).orderBy(F.desc("date"))  # one row per date
    dates = bars.select("date").distinct().withColumn("_no", F.row_number().over(newest))
    return dates.where(F.col("_no") <= 2)


def quotes(bars: DataFrame) -> DataFrame:
    """Last close, change and change percent against the previous session of the market.

    The previous session is one date for all symbols; a symbol that did not trade on
    it has no change.
    """
    rows = bars.join(F.broadcast(last_two_dates(bars)), "date")  # at most two rows
    now, before = F.col("_no") == 1, F.col("_no") == 2
    per_symbol = rows.groupBy("symbol").agg(
        F.max(F.when(now, F.col("close"))).alias("last"),
        F.max(F.when(before, F.col("close"))).alias("prev_close"),
        F.max(F.when(now, F.col("volume"))).alias("volume"),
        F.max(F.when(now, F.col("date"))).alias("as_of"),
    )
    change = F.col("last") - F.col("prev_close")
    return per_symbol.where(F.col("last").isNotNull()).withColumns(
        {"change": change, "change_percent": ratio(change, "prev_close") * 100.0}
    )


def movers(bars: DataFrame, n: int = 5) -> DataFrame:
    """The n largest gains and losses."""
    known = quotes(bars).where(F.col("change_percent").isNotNull()).select("symbol", "last", "change_percent")
    up = known.orderBy(F.desc("change_percent"), "symbol").limit(n).withColumn("side", F.lit("gainer"))
    down = known.orderBy("change_percent", "symbol").limit(n).withColumn("side", F.lit("loser"))
    return up.unionByName(down)


def advance_decline(bars: DataFrame) -> DataFrame:
    """Advancers, decliners and the rest, which includes symbols without a change."""
    up, down = F.count_if(F.col("change_percent") > 0), F.count_if(F.col("change_percent") < 0)
    return quotes(bars).agg(
        up.alias("advancers"), down.alias("decliners"), (F.count("*") - up - down).alias("unchanged"), F.max("as_of").alias("as_of")
    )


def last_rows_per_symbol(bars: DataFrame, n: int) -> DataFrame:
    """The n newest rows per symbol; Spark applies the rank limit before the shuffle."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return bars.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= n)


def symbol_pages(bars: DataFrame) -> DataFrame:
    """Per symbol: last bar, change, averages and ranges of the last rows, 30-row history."""
    rows = last_rows_per_symbol(bars, 252)
    age = F.col("_age")

    def at(k: int, c: str) -> Column:
        return F.max(F.when(age == k, F.col(c)))

    history = F.array_sort(F.collect_list(F.when(age <= 30, F.struct("date", "close"))))  # at most 30 entries
    out = rows.groupBy("symbol").agg(
        at(1, "date").alias("as_of"),
        *[at(1, c).alias(n) for n, c in {"open": "open", "high": "high", "low": "low", "last_close": "close", "volume": "volume"}.items()],
        F.coalesce(at(2, "close"), at(1, "close")).alias("previous_close"),
        F.avg(F.when(age <= 20, F.col("close"))).alias("sma_20"),
        F.avg(F.when(age <= 50, F.col("close"))).alias("sma_50"),
        F.max("close").alias("high_52w"),
        F.min("close").alias("low_52w"),
        history.alias("history"),
    )
    change = F.col("last_close") - F.col("previous_close")
    return out.withColumns({"change": change, "change_percent": ratio(change, "previous_close") * 100.0})


def index_proxy(bars: DataFrame, n: int = 50) -> DataFrame:
    """Mean close per date of the n symbols with the highest mean volume (ties by symbol)."""
    top = bars.groupBy("symbol").agg(F.avg("volume").alias("_v")).orderBy(F.desc("_v"), "symbol").limit(n)
    members = bars.join(F.broadcast(top.select("symbol")), "symbol", "left_semi")  # at most n rows
    return members.groupBy("date").agg(F.avg("close").alias("index_value"), F.count("*").alias("n_members"))


def index_snapshot(bars: DataFrame, n: int = 50) -> DataFrame:
    """Newest proxy value and its change (the proxy has one row per date)."""
    newest = Window.partitionBy(F.lit(0)).orderBy(F.desc("date"))
    daily = index_proxy(bars, n).withColumn("_no", F.row_number().over(newest)).where(F.col("_no") <= 2)
    one = daily.agg(
        F.max("date").alias("as_of"),
        F.max(F.when(F.col("_no") == 1, F.col("index_value"))).alias("value"),
        F.max(F.when(F.col("_no") == 2, F.col("index_value"))).alias("_prev"),
    ).withColumn("previous_close", F.coalesce("_prev", "value")).drop("_prev")
    change = F.col("value") - F.col("previous_close")
    return one.withColumns({"change": change, "change_percent": F.coalesce(ratio(change, "previous_close") * 100.0, F.lit(0.0))})


def latest_signal(scored: DataFrame, prob: str = "prob") -> DataFrame:
    """Newest scored row per symbol, ranked by probability."""
    last = scored.groupBy("symbol").agg(F.max_by(F.struct("date", "close", F.col(prob).alias("prob_up")), "date").alias("r"))
    return row_numbers(last.select("symbol", "r.*"), "prob_up", "symbol", "signal_rank")


def live_overlay(signal: DataFrame, live: DataFrame) -> DataFrame:
    """Replace close and date where a live price (symbol, date, last_close) is as new or newer."""
    newest = live.groupBy("symbol").agg(
        F.max("date").alias("_live_date"), F.max_by("last_close", "date").alias("_live_close")
    )
    fresh = F.col("_live_date") >= F.col("date")
    joined = signal.join(newest, "symbol", "left")
    return joined.withColumns(
        {
            "close": F.when(fresh, F.col("_live_close")).otherwise(F.col("close")),
            "date": F.when(fresh, F.col("_live_date")).otherwise(F.col("date")),
            "is_live": F.coalesce(fresh, F.lit(False)),
        }
    ).drop("_live_date", "_live_close")


def market_signal(signal: DataFrame) -> DataFrame:
    breadth = F.avg("prob_up")
    return signal.agg(
        F.max("date").alias("as_of"),
        F.count("*").alias("n_symbols"),
        breadth.alias("market_breadth_prob"),
        F.when(breadth >= 0.5, "UP").otherwise("DOWN").alias("direction"),
    )


def screen(signal: DataFrame, direction: str = "ALL", limit: int = 0) -> DataFrame:
    """Ranked signal of a direction; UP includes 0.5."""
    p = F.col("prob_up")
    out = {"UP": signal.where(p >= 0.5), "DOWN": signal.where(p < 0.5)}.get(direction.upper(), signal)
    return out.orderBy("signal_rank").limit(limit) if limit > 0 else out


def technicals(today: DataFrame, bars: DataFrame) -> DataFrame:
    """Per symbol of the newest date: trend class, breakout, ranges, averages, ranks.

    ``today``: feature rows of the newest date with excess_return. The exponential
    averages run over the symbol's whole history, ranges over its last 252, 60 and
    20 rows.
    """
    w = R.series()
    ema = smooth(
        bars.select("symbol", "date", "close", "high", "low"),
        {f"ema_{n}": ("close", span(n), 1) for n in (20, 50, 200)},
    )
    ranges = {}
    for n, label in ((252, "52w"), (60, "60d"), (20, "20d")):
        ranges |= {f"high_{label}": F.max("high").over(R.trailing(w, n)), f"low_{label}": F.min("low").over(R.trailing(w, n))}
    ema = latest_rows(ema.withColumns(ranges | {"prev_close": F.lag("close").over(w)}).drop("close", "high", "low"))
    today = percent_ranks(today, ["date"], {"_rs": "excess_return", "_vr": "volume_ratio_20d"}, strict=True)
    out = today.join(ema, ["symbol", "date"])
    close, high, low = F.col("close"), F.col("high"), F.col("low")
    up = {n: close > F.col(f"ema_{n}") for n in (20, 50, 200)}
    trend = (
        F.when(up[20] & up[50] & up[200], "Strong Uptrend")
        .when(up[20] & up[50], "Uptrend")
        .when(~up[20] & ~up[50] & ~up[200], "Strong Downtrend")
        .when(~up[20] & ~up[50], "Downtrend")
        .otherwise("Sideways")
    )
    breakout = (
        F.when(high >= F.col("high_20d") * 0.999, "Breaking 20d high")
        .when(low <= F.col("low_20d") * 1.001, "Breaking 20d low")
        .otherwise("Inside 20d range")
    )
    return out.select(
        "symbol",
        F.col("date").alias("as_of"),
        close.alias("last_close"),
        "prev_close",
        (ratio(close - F.col("prev_close"), "prev_close") * 100).alias("change_pct"),
        *[f"ema_{n}" for n in (20, 50, 200)],
        *[f"sma_{n}" for n in (20, 50, 200)],
        "rsi_14", "macd", "macd_signal", "macd_hist", "stoch_k", "stoch_d", "adx", "plus_di", "minus_di",
        "atr_14", "bb_upper", "bb_lower", "bb_width", "bb_position", "volume_ratio_20d", "avg_volume_20d",
        "avg_volume_5d", "volatility_20d", "obv_normalised",
        trend.alias("trend"),
        breakout.alias("breakout"),
        ratio("volume", "avg_volume_20d").alias("volume_surge"),
        "high_20d", "low_20d",
        F.col("low_60d").alias("support_2"),
        F.col("high_60d").alias("resistance_2"),
        (F.col("_rs") * 100).alias("relative_strength_rank_pct"),
        (F.col("_vr") * 100).alias("volume_rank_pct"),
        "high_52w", "low_52w",
        (ratio(F.col("high_52w") - close, close) * 100).alias("target_52w_pct"),
        (ratio(close - F.col("low_52w"), "low_52w") * 100).alias("dist_from_52w_low_pct"),
        (-ratio(F.col("atr_14") * 1.5 * 3, close) * 100).alias("downside_risk_pct"),
    )


def dashboard(bars: DataFrame, signal: DataFrame, summary: DataFrame) -> DataFrame:
    """One row: breadth, sentiment, advance/decline and score summary."""
    joined = one_row(
        signal.agg(F.coalesce(F.avg("prob_up"), F.lit(0.5)).alias("breadth_prob"), F.max("date").alias("signal_date")),
        advance_decline(bars).drop("as_of"),
        index_snapshot(bars).select(F.col("value").alias("index_value"), F.col("change_percent").alias("index_change_pct")),
        summary.select("n_symbols", "mean_overall", "bulls", "bears"),
    )
    return joined.withColumns(
        {"sentiment": sentiment_label(F.col("breadth_prob")), "regime": regime_label(F.col("breadth_prob"))}
    )


def headline(cards: DataFrame, base_accuracy: DataFrame, long_short: DataFrame) -> DataFrame:
    """One row of headline figures: symbols scanned, breadth, daily edge, success rate."""
    scanned = cards.agg(
        F.count("*").alias("stocks_scanned"),
        (F.coalesce(F.avg("prob_up"), F.lit(0.5)) * 100).alias("winning_signals_pct"),
        F.max("as_of").alias("as_of"),
    )
    edge = long_short.agg((F.avg("gross_spread") * 100).alias("avg_return_pct"))
    return one_row(scanned, edge, base_accuracy.select((F.col("accuracy") * 100).alias("success_rate_pct")))
