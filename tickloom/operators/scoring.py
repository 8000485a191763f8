"""Score cards, trade plans, action labels and reasoning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp, ratio
from .cross import with_sector
from .ranking import percent_ranks

col, when, lit = F.col, F.when, F.lit


def _or_zero(points: Column) -> Column:
    """An unknown input gives no points."""
    return F.coalesce(points, lit(0.0))


def _bounded(x: Column, size: float) -> Column:
    return _or_zero(clamp(x, -size, size))


def _cross_bonus(name: str, points: float) -> Column:
    return when(col(name) > 0, lit(points)).otherwise(lit(0.0))


def technical_score() -> Column:
    rsi, adx, bb = col("rsi_14"), col("adx"), col("bb_position")
    rsi_points = when(rsi.between(50, 70), 15.0).when(rsi.between(40, 80), 0.0).when(rsi > 80, -10.0).when(rsi < 40, -5.0)
    return clamp(
        lit(50.0)
        + _bounded(col("dist_sma_20") * 1000, 25)
        + _bounded(col("dist_sma_50") * 1000, 20)
        + _bounded(col("dist_sma_200") * 600, 15)
        + _or_zero(rsi_points)
        + _bounded(col("macd_hist") * 200, 10)
        + _or_zero(when(adx >= 25, 8.0).when(adx >= 20, 4.0))
        + _or_zero(when(bb.between(0.4, 0.7), 5.0))
        + _cross_bonus("sma_20_50_cross", 5.0)
        + _cross_bonus("sma_50_200_cross", 3.0)
    )


def momentum_score() -> Column:
    vr = col("volume_ratio_20d")
    return clamp(
        lit(50.0)
        + _bounded(col("ret_5d") * 1500, 20)
        + _bounded(col("ret_10d") * 800, 20)
        + _bounded(col("ret_20d") * 400, 20)
        + _or_zero(when(vr >= 1.5, 10.0).when(vr >= 1.0, 5.0))
        + _bounded(col("obv_normalised") * 30, 8)
    )


def risk_score() -> Column:
    """Higher is calmer."""
    v20, v50 = col("volatility_20d"), col("volatility_50d")
    level = when(v20 < 0.008, 20.0).when(v20 < 0.013, 10.0).when(v20 < 0.020, 0.0).when(v20 < 0.030, -10.0)
    level = when(v20.isNotNull(), F.coalesce(level, lit(-20.0)))
    trend = ratio(v20, when(v50 > 0, v50))
    noise = ratio("atr_14", when(col("close") > 0, col("close")))
    return clamp(
        lit(50.0)
        + _or_zero(level)
        + _or_zero(when(trend < 0.9, 5.0).when(trend > 1.2, -5.0))
        + _or_zero(when(noise < 0.02, 8.0).when(noise > 0.04, -8.0))
        + _or_zero(when(col("adx") > 40, -4.0))
    )


def valuation_score() -> Column:
    return clamp(
        lit(50.0) + _bounded((0.5 - col("bb_position")) * 60, 25) + _bounded(-col("dist_sma_200") * 400, 20)
    )


def fundamental_score() -> Column:
    """A proxy from durability, consistency and volume, in the absence of accounts."""
    d, r5, r10, r20, vr = (col(c) for c in ("dist_sma_200", "ret_5d", "ret_10d", "ret_20d", "volume_ratio_20d"))
    durable = when(d > 0.10, 15.0).when(d > 0, 8.0).when(d > -0.10, 0.0).when(d.isNotNull(), -8.0)
    known = r5.isNotNull() & r10.isNotNull() & r20.isNotNull()
    steady = (
        when((r5 > 0) & (r10 > 0) & (r20 > 0), 12.0)
        .when((r5 > 0) & (r10 > 0), 6.0)
        .when((r5 < 0) & (r10 < 0) & (r20 < 0), -8.0)
    )
    return clamp(
        lit(50.0) + _or_zero(durable) + _or_zero(when(known, steady)) + _or_zero(when(vr.between(0.7, 1.5), 5.0))
    )


def ai_score() -> Column:
    """Probability pushed away from 50 by its own confidence; 50 without a probability."""
    base = col("prob_up") * 100.0
    return F.coalesce(clamp(50.0 + (base - 50.0) * (0.5 + col("confidence"))), lit(50.0))


WEIGHTS = {
    "ai_score": 0.25,
    "technical_score": 0.20,
    "momentum_score": 0.15,
    "fundamental_score": 0.15,
    "valuation_score": 0.15,
    "risk_score": 0.10,
}


def overall_score() -> Column:
    return sum((col(c) * w for c, w in WEIGHTS.items()), lit(0.0))


def kpis() -> dict[str, Column]:
    close, atr, vr = col("close"), col("atr_14"), col("volume_ratio_20d")
    trend = F.coalesce(clamp(col("adx") * 1.7), lit(50.0))
    trend = clamp(trend + _cross_bonus("sma_20_50_cross", 5.0))
    trend = clamp(trend + _cross_bonus("sma_50_200_cross", 3.0))
    edge = (col("prob_up") - 0.5) * 2.0 * 0.012 * 100
    momentum = F.coalesce(col("ret_5d") * 0.05, lit(0.0)) + F.coalesce(col("ret_10d") * 0.025, lit(0.0))
    downside = F.bround(-ratio(atr * 1.5 * 3, when(close > 0, close)) * 100, 2)
    expected = F.bround((edge + momentum) * 100, 2) / 100
    institutional = F.coalesce(clamp(50 + (vr - 1.0) * 50), lit(50.0))
    money = col("avg_volume_20d") * close
    liquidity = when(money > 5e9, 95.0).when(money > 1e9, 80.0).when(money > 5e8, 65.0).when(money > 1e8, 50.0)
    liquidity = liquidity.when(money > 5e7, 35.0).when(money.isNotNull(), 20.0).otherwise(50.0)
    win = 50 + (col("prob_up") * 100 - 50) * (0.6 + 0.4 * col("confidence"))
    return {
        "trend_strength": trend,
        "expected_return_pct": expected,
        "downside_risk_pct": downside,
        "rr_ratio": when(downside < 0, F.bround(ratio(expected, F.abs(downside)), 2)),
        "win_probability_pct": F.bround(clamp(win, 5, 95), 1),
        "sector_strength": clamp(50 + (col("_sector_base") - 50) * 1.2),
        "relative_strength": clamp(col("_exret_rank") * 100),
        "institutional_activity": institutional,
        "delivery_volume_strength": institutional,
        "earnings_growth_trend": clamp(col("fundamental_score")),
        "revenue_growth_trend": clamp(col("fundamental_score") - 5 + when(col("ret_20d") > 0, 10.0).otherwise(0.0)),
        "debt_quality": F.coalesce(clamp(50 + col("dist_sma_200") * 200), lit(50.0)),
        "liquidity_score": liquidity,
        "confidence_pct": F.bround(col("confidence") * 100, 1),
    }


def trade_plan() -> dict[str, Column]:
    """Entry, stop, targets, risk level and holding period from close, ATR and probability."""
    close, atr, p = when(col("close") > 0, col("close")), col("atr_14"), col("prob_up")
    room = when(atr > 0, F.greatest(atr * 2, close * 0.015)).otherwise(close * 0.02)
    risk = ratio(room, close) * 100
    holding = when(p > 0.55, "10-20 sessions").when(p < 0.45, "1-3 sessions").otherwise("5-15 sessions")
    return {
        "entry_price": F.bround(close, 2),
        "stop_loss": F.bround(close - room, 2),
        "target_1": F.bround(close * 1.015, 2),
        "target_2": F.bround(close * 1.030, 2),
        "risk_level": when(risk < 1.5, "Low").when(risk < 2.5, "Medium").when(risk.isNotNull(), "High").otherwise("Medium"),
        "holding_period": when(close.isNotNull(), holding).otherwise("5-15 sessions"),
    }


def action_label(overall: Column, prob: Column) -> Column:
    return (
        when((overall >= 75) & (prob >= 0.55), "STRONG BUY")
        .when((overall >= 60) & (prob >= 0.52), "BUY")
        .when((overall >= 45) & (prob >= 0.48), "HOLD")
        .when((overall <= 30) & (prob <= 0.45), "STRONG SELL")
        .otherwise("SELL")
    )


def signal_label(action: Column) -> Column:
    return when(action.isin("STRONG BUY", "BUY"), "UP").when(action == "HOLD", "NEUTRAL").otherwise("DOWN")


def overall_action(overall: Column) -> Column:
    """The coarser ladder used next to the reasoning."""
    return (
        when(overall >= 70, "STRONG BUY")
        .when(overall >= 60, "BUY")
        .when(overall <= 30, "STRONG SELL")
        .when(overall <= 40, "SELL")
        .otherwise("HOLD")
    )


def confidence_level(pct: Column) -> Column:
    return when(pct >= 30, "High").when(pct >= 10, "Moderate").when(pct.isNotNull(), "Low").otherwise("Unknown")


def sentiment_label(breadth: Column) -> Column:
    return when(breadth >= 0.55, "Bullish").when(breadth <= 0.45, "Bearish").otherwise("Neutral")


def regime_label(breadth: Column) -> Column:
    return when(breadth >= 0.55, "Risk-On").when(breadth <= 0.45, "Risk-Off").otherwise("Range-Bound")


# tag, column, upper bound (bull), lower bound (bear), texts for bull / bear / neutral
REASONS = [
    ("TREND", "technical_score", 70, 30, ("price above its averages", "price below its averages", "mixed trend signals")),
    ("MOMENTUM", "momentum_score", 70, 30, ("returns and volume trend are rising", "returns and volume trend are falling", None)),
    ("RISK", "risk_score", 70, 30, ("calm: low realised volatility", "high realised volatility", None)),
    ("VALUATION", "valuation_score", 60, 40, ("near the floor of its recent band", "near the ceiling of its recent band", None)),
    ("RELATIVE STRENGTH", "relative_strength", 65, 35, ("outperforms the universe", "underperforms the universe", None)),
    ("INSTITUTIONAL", "institutional_activity", 60, 40, ("volume above its average", "volume below its average", None)),
    ("SECTOR", "sector_strength", 60, 40, ("sector in the upper half", "sector in the lower half", None)),
    ("AI MODEL", "ai_score", 60, 40, ("model leans up", "model leans down", "model is neutral")),
]


def reasoning() -> Column:
    """Array of (tag, text, tone) for every rule that speaks, in a fixed order."""
    bullets = []
    for tag, name, hi, lo, (bull, bear, neutral) in REASONS:
        x = F.bround(col(name), 1)

        def bullet(text: str, tone: str) -> Column:
            return F.struct(lit(tag).alias("tag"), lit(text).alias("text"), lit(tone).alias("tone"))

        rule = when(x >= hi, bullet(bull, "bull")).when(x <= lo, bullet(bear, "bear"))
        bullets.append(rule.otherwise(bullet(neutral, "neutral")) if neutral else rule)
    return F.array_compact(F.array(*bullets))


def latest_rows(panel: DataFrame) -> DataFrame:
    """Rows of the newest date; the date is a one-row aggregate, not a sort."""
    newest = panel.agg(F.max("date").alias("date"))
    return panel.join(F.broadcast(newest), "date", "left_semi")


def score_cards(today: DataFrame, sectors: DataFrame, signal: DataFrame) -> DataFrame:
    """One card per symbol.

    ``today``: feature rows of the newest date with excess_return (see ``latest_rows``);
    ``signal``: symbol, prob_up, signal_rank.
    """
    today = with_sector(percent_ranks(today, ["date"], {"_rank": "excess_return"}), sectors)
    by_sector = today.groupBy("sector").agg(F.avg("excess_return").alias("_sector_mean"))
    today = today.join(by_sector, "sector", "left").join(signal.select("symbol", "prob_up", "signal_rank"), "symbol", "left")
    today = today.withColumns(
        {
            "_sector_base": clamp(50 + F.coalesce("_sector_mean", lit(0.0)) * 1500),
            "_exret_rank": F.coalesce("_rank", lit(0.5)),
            "confidence": F.abs(col("prob_up") - 0.5) * 2,
        }
    )
    today = today.withColumns(
        {
            "ai_score": ai_score(),
            "technical_score": technical_score(),
            "momentum_score": momentum_score(),
            "risk_score": risk_score(),
            "valuation_score": valuation_score(),
            "fundamental_score": fundamental_score(),
        }
    )
    limited = F.array_compact(
        F.array(
            when(col("prob_up").isNull(), lit("model_prob_up")),
            when(col("ret_5d").isNull(), lit("momentum_5d")),
        )
    )
    cards = today.withColumns({"overall": overall_score()} | kpis() | trade_plan()).withColumn("data_limited", limited)
    return cards.select(
        "symbol",
        "sector",
        col("date").alias("as_of"),
        col("close").alias("last_close"),
        "prob_up",
        "confidence",
        "confidence_pct",
        "signal_rank",
        *WEIGHTS,
        "overall",
        *[k for k in kpis() if k != "confidence_pct"],
        *trade_plan(),
        "data_limited",
    )


def nested_cards(cards: DataFrame) -> DataFrame:
    """The cards with scores, KPIs and plan grouped into structs, scores to one decimal."""
    groups = {
        "scores": [*WEIGHTS, "overall"],
        "kpis": [k for k in kpis() if k != "confidence_pct"],
        "trade_plan": list(trade_plan()),
    }
    rounded = {c: F.bround(col(c), 1) for c in groups["scores"]}
    out = cards.withColumns(rounded)
    flat = [c for c in cards.columns if not any(c in g for g in groups.values())]
    return out.select(*flat, *[F.struct(*g).alias(name) for name, g in groups.items()])


def score_summary(cards: DataFrame) -> DataFrame:
    n = F.count("*")
    bulls = F.count_if(F.coalesce(col("prob_up"), lit(0.0)) > 0.5)
    return cards.agg(
        n.alias("n_symbols"),
        F.avg("overall").alias("mean_overall"),
        bulls.alias("bulls"),
        (n - bulls).alias("bears"),
        F.coalesce(F.avg("prob_up"), lit(0.5)).alias("breadth_prob"),
        F.max("as_of").alias("as_of"),
    )


def sector_summary(cards: DataFrame) -> DataFrame:
    """Average score and size per sector."""
    return cards.groupBy("sector").agg(F.avg("overall").alias("avg_score"), F.count("*").alias("n"))


def sector_members(cards: DataFrame) -> DataFrame:
    """The symbols of each sector as rows; a large sector is never gathered into one list."""
    return cards.select("sector", "symbol", "overall")


def screener(cards: DataFrame, direction: str = "ALL", limit: int = 10) -> DataFrame:
    """The best cards of a direction with action, signal and risk/reward of the plan."""
    p0 = F.coalesce(col("prob_up"), lit(0.0))
    chosen = {"UP": cards.where(p0 > 0.5), "DOWN": cards.where(p0 < 0.5)}.get(direction.upper(), cards)
    top = chosen.orderBy(F.desc("overall"), "symbol").limit(max(1, limit))
    prob = F.when(p0 == 0, lit(0.5)).otherwise(p0)
    action = action_label(F.bround("overall", 1), prob)
    risk, reward = col("entry_price") - col("stop_loss"), col("target_1") - col("entry_price")
    return top.select(
        "symbol",
        "sector",
        col("last_close").alias("cmp"),
        signal_label(action).alias("signal"),
        action.alias("action"),
        "ai_score",
        col("overall").alias("overall_score"),
        "confidence_pct",
        col("expected_return_pct").alias("expected_upside_pct"),
        "downside_risk_pct",
        F.bround(when((risk > 0) & (reward > 0), ratio(reward, risk)), 2).alias("risk_reward"),
        "risk_level",
        "entry_price",
        "stop_loss",
        "target_1",
        "target_2",
        "holding_period",
        "win_probability_pct",
        "trend_strength",
        "liquidity_score",
        "as_of",
    )


def reasons(cards: DataFrame) -> DataFrame:
    return cards.select(
        "symbol",
        "sector",
        "as_of",
        overall_action(F.bround("overall", 1)).alias("action"),
        col("overall").alias("overall_score"),
        confidence_level(col("confidence_pct")).alias("confidence_level"),
        "confidence_pct",
        reasoning().alias("bullets"),
    )
