"""Earnings, analyst estimates and company fundamentals brought to daily rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.scalar import flag, ratio
from .asof import asof, neighbours, within_days
from .dedup import keep_best
from .ranking import percent_ranks


def earnings_features(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Days to/since earnings, surprise, drift and surprise history per trading day.

    ``events``: symbol, date, estimated_eps, surprise_pct, revenue_surprise_pct and
    optionally guidance_next_quarter; unique per (symbol, date).
    """
    extra = [c for c in ("guidance_next_quarter",) if c in events.columns]
    w = R.series()
    history = events.withColumn("_step", R.change("surprise_pct", w)).withColumns(
        {
            "_n": F.count("*").over(R.trailing(w, 4)),
            "_trend": F.avg("_step").over(R.trailing(w, 3)),
            "_share": F.avg(flag(F.col("surprise_pct") > 0)).over(R.trailing(w, 4)),
        }
    )
    at_event = bars.select("symbol", "date", F.col("close").alias("_event_close"))
    history = history.join(at_event, ["symbol", "date"], "left").withColumn("_event_date", F.col("date"))
    covered = bars.select("symbol", "date", "close").join(events.select("symbol").distinct(), "symbol", "left_semi")
    out = neighbours(
        covered,
        history,
        ["symbol"],
        previous={
            "_last_date": "_event_date",
            "last_earnings_surprise": "surprise_pct",
            "last_revenue_surprise": "revenue_surprise_pct",
            "_close_then": "_event_close",
            "_n_events": "_n",
            "_trend": "_trend",
            "_share": "_share",
        }
        | {c: c for c in extra},
        following={"_next_date": "_event_date", "next_estimated_eps": "estimated_eps"},
    )
    enough = F.col("_n_events") >= 2
    out = out.withColumns(
        {
            "days_to_earnings": F.date_diff("_next_date", "date"),
            "days_since_earnings": F.date_diff("date", "_last_date"),
            "post_earnings_return": ratio(F.col("close") - F.col("_close_then"), "_close_then"),
            "earnings_surprise_trend": F.when(enough, F.col("_trend")),
            "earnings_surprise_consistency": F.when(enough, F.col("_share")),
        }
    )
    out = out.withColumns(
        {
            "earnings_announcement_week": flag(F.col("days_to_earnings").between(0, 5)),
            "post_earnings_week": flag(F.col("days_since_earnings").between(0, 5)),
            "surprise_4q_avg": R.mean("last_earnings_surprise", w, 4, 1),
            "surprise_4q_std": R.std("last_earnings_surprise", w, 4, 2),
            "earnings_season": flag(F.month("date").isin(1, 4, 7, 10)),
        }
    )
    return out.drop("close", *[c for c in out.columns if c.startswith("_")])


def estimate_features(bars: DataFrame, estimates: DataFrame) -> DataFrame:
    """Latest next-year EPS estimate, its dispersion and 30/90-day revisions."""
    eps = estimates.where(F.lower("estimate_type").rlike("eps_fy1|eps_1y"))
    eps = keep_best(eps, ["symbol", "date"], F.struct("estimate_type", "mean_estimate"))
    columns = ["mean_estimate", "high_estimate", "low_estimate", "num_analysts", "target_price_mean"]
    daily = asof(bars.select("symbol", "date", "close"), eps, ["symbol"], columns)
    daily = daily.where(F.col("mean_estimate").isNotNull() | F.col("num_analysts").isNotNull())
    daily = within_days(daily, eps, ["symbol"], "mean_estimate", {"_m1": 30, "_m3": 90})

    def revision(p: str):
        return F.when(F.col(f"{p}_n") >= 2, ratio(F.col(f"{p}_last") - F.col(f"{p}_first"), F.abs(f"{p}_first")))

    out = daily.withColumns(
        {
            "eps_dispersion": ratio(F.col("high_estimate") - F.col("low_estimate"), F.abs("mean_estimate")),
            "eps_revision_1m": revision("_m1"),
            "eps_revision_3m": revision("_m3"),
            "target_price_vs_current": ratio(F.col("target_price_mean") - F.col("close"), "close"),
        }
    ).withColumn("eps_revision_1m_ma", R.mean("eps_revision_1m", R.series(), 5, 3))
    return out.select(
        "symbol",
        "date",
        F.col("mean_estimate").alias("eps_estimate"),
        F.col("high_estimate").alias("eps_high"),
        F.col("low_estimate").alias("eps_low"),
        "eps_dispersion",
        "eps_revision_1m",
        "eps_revision_3m",
        "num_analysts",
        F.col("target_price_mean").alias("target_price"),
        "eps_revision_1m_ma",
        "target_price_vs_current",
    )


RATIOS = [
    "pe_ratio", "pb_ratio", "ps_ratio", "ev_ebitda", "roe", "roa", "roic", "debt_to_equity", "current_ratio",
    "profit_margin", "operating_margin", "revenue_growth_yoy", "earnings_growth_yoy", "dividend_yield",
]
RANKED = [
    "pe_ratio", "pb_ratio", "ps_ratio", "ev_ebitda", "earnings_yield", "roe", "roic", "profit_margin",
    "revenue_growth_yoy", "earnings_growth_yoy",
]


def fundamental_features(bars: DataFrame, reports: DataFrame) -> DataFrame:
    """Ratios as of the last report, earnings yield and the eight-point health score.

    Ratios the reports do not carry are NULL; a NULL ratio scores no point.
    """
    have = [c for c in RATIOS if c in reports.columns]
    covered = bars.select("symbol", "date").join(reports.select("symbol").distinct(), "symbol", "left_semi")
    daily = asof(covered, reports, ["symbol"], have, each_column=True)
    daily = daily.withColumns({c: F.lit(None).cast("double") for c in RATIOS if c not in have})
    points = [F.col(c) > 0 for c in ("roe", "roa", "profit_margin", "operating_margin")]
    points += [F.col("debt_to_equity") < 1, F.col("current_ratio") > 1]
    points += [F.col(c) > 0 for c in ("revenue_growth_yoy", "earnings_growth_yoy")]
    score = sum((F.coalesce(p, F.lit(False)).cast("int") for p in points), F.lit(0))
    return daily.withColumns(
        {
            "earnings_yield": F.when(F.col("pe_ratio") > 0, 1.0 / F.col("pe_ratio")),
            "f_score_proxy": score,
        }
    )


def fundamental_ranks(features: DataFrame, columns: list[str] = RANKED) -> DataFrame:
    """Percent rank per date of each column (give a stored table: every rank reads it)."""
    return percent_ranks(features, ["date"], {f"{c}_rank": c for c in columns})
