"""Portfolio weights and accounting on long (date, symbol) tables.

Weights stay long: an absent row is weight 0. Nothing is pivoted and no
dates x symbols grid is built; a position that ends emits one closing row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.scalar import flag, ratio
from .calendar import date_ordinals, join_daily, one_row
from .ranking import percent_ranks

COST_RATE = 0.001  # per unit of turnover
YEAR = 252.0


# --- weights ---------------------------------------------------------------


def normalise(raw: DataFrame) -> DataFrame:
    """w / sum of w per date; a date whose weights sum to zero is in cash."""
    sums = raw.groupBy("date").agg(F.sum("w").alias("_sum"))
    out = join_daily(raw, sums).withColumn("w", F.coalesce(ratio("w", "_sum"), F.lit(0.0)))
    return out.select("date", "symbol", "w")


def raw_weights(preds: DataFrame, w: Column) -> DataFrame:
    return preds.select("date", "symbol", w.cast("double").alias("w"))


def threshold_weights(preds: DataFrame, theta: float, prob: str = "prob") -> DataFrame:
    """Equal weight on names with probability >= theta."""
    return normalise(raw_weights(preds, flag(F.col(prob) >= theta)))


def naive_weights(preds: DataFrame) -> DataFrame:
    return normalise(raw_weights(preds, F.lit(1.0)))


def top_k_weights(preds: DataFrame, k: int, prob: str = "prob") -> DataFrame:
    """Equal weight on the k highest probabilities >= 0.5 of the date, ties by symbol.

    The rank filter is pushed below the shuffle by Spark, which keeps k rows per date
    and task.
    """
    order = Window.partitionBy("date").orderBy(F.desc(prob), "symbol")
    best = preds.where(F.col(prob) >= 0.5).withColumn("_rk", F.row_number().over(order)).where(F.col("_rk") <= k)
    return normalise(raw_weights(best, F.lit(1.0)))


def band_weights(preds: DataFrame, enter: float, leave: float, prob: str = "prob") -> DataFrame:
    """Hysteresis: in from p >= enter until p < leave. The state is the last decisive signal."""
    p = F.col(prob)
    signal = F.when(p >= enter, F.lit(1.0)).when(p < leave, F.lit(0.0))
    state = F.coalesce(F.last(signal, ignorenulls=True).over(R.running(R.series())), F.lit(0.0))
    return normalise(raw_weights(preds, state))


def held_band_weights(preds: DataFrame, enter: float, leave: float, min_hold: int, hard_stop: float | None = None, prob: str = "prob") -> DataFrame:
    """The band with a minimum holding time and a hard stop.

    How long a name has been held depends on its whole path, so the state is carried along
    the symbol's days (an array bounded by the calendar) inside the JVM: days held so far,
    0 when out.
    """
    rows = preds.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", F.col(prob).alias("p")))).alias("rows"))

    def below(p: Column, bound: float | None) -> Column:
        return F.lit(False) if bound is None else F.coalesce(p < bound, F.lit(False))

    def next_day(path: Column, row: Column) -> Column:
        p, days = row["p"], F.coalesce(F.element_at(path, -1), F.lit(0))
        kept = (days > 0) & ~below(p, hard_stop) & ((days < min_hold) | ~below(p, leave))
        return F.array_append(path, F.when(kept, days + 1).when(p >= enter, F.lit(1)).otherwise(F.lit(0)))

    path = F.slice(F.aggregate("rows", F.array(F.lit(0)), next_day), 2, 2**31 - 2)  # without the state before the first day
    days = rows.select("symbol", F.explode(F.arrays_zip("rows", path.alias("days"))).alias("day"))
    return normalise(days.select("day.rows.date", "symbol", (F.col("day.days") > 0).cast("double").alias("w")))


def tilt_weights(preds: DataFrame, strength: float = 0.5, prob: str = "prob") -> DataFrame:
    """1 + t (2p - 1), at least 0.1, normalised."""
    return normalise(raw_weights(preds, F.greatest(1.0 + strength * (2.0 * F.col(prob) - 1.0), F.lit(0.1))))


def static_weights(preds: DataFrame, ret: str = "next_ret") -> DataFrame:
    """Buy and hold: the growth of each name before the date."""
    past = R.series().rowsBetween(Window.unboundedPreceding, -1)
    growth = F.coalesce(F.product(1.0 + F.coalesce(F.col(ret), F.lit(0.0))).over(past), F.lit(1.0))
    return normalise(raw_weights(preds, growth))


def tercile_level(rank: Column) -> Column:
    """1.5 in the upper third of ranks, 0.5 in the lower third, else 1."""
    return F.when(rank >= 2.0 / 3.0, 1.5).when(rank <= 1.0 / 3.0, 0.5).otherwise(1.0)


def tercile_raw(preds: DataFrame, prob: str = "prob") -> DataFrame:
    ranked = percent_ranks(preds.select("date", "symbol", prob), ["date"], {"_rk": prob})
    return ranked.select("date", "symbol", tercile_level(F.col("_rk")).alias("w"))


def tercile_weights(preds: DataFrame, prob: str = "prob") -> DataFrame:
    return normalise(tercile_raw(preds, prob))


def freeze(raw: DataFrame, every: int, default: float | None, dates: DataFrame | None = None) -> DataFrame:
    """Hold the raw weights of every ``every``-th date until the next such date.

    A name keeps its frozen weight on the days it is traded. A name absent on the
    sampled date gets ``default``; with None it keeps its value of the last sampled
    date it was present on.
    """
    numbered = join_daily(raw, dates if dates is not None else date_ordinals(raw)).withColumn(
        "_block", F.floor(F.col("day_no") / every)
    )
    first = F.col("day_no") == F.col("_block") * every
    sampled = F.when(first, F.col("w"))
    if default is None:
        value = F.last(sampled, ignorenulls=True).over(R.running(R.series()))
    else:
        block = Window.partitionBy("symbol", "_block")
        value = F.coalesce(F.max(sampled).over(block), F.lit(float(default)))
    return numbered.select("date", "symbol", value.alias("w"))


def frozen_weights(raw: DataFrame, every: int, default: float | None) -> DataFrame:
    return normalise(freeze(raw, every, default).where(F.col("w").isNotNull()))


# --- accounting ------------------------------------------------------------


def daily_accounts(returns: DataFrame, weights: DataFrame, cost_rate: float = COST_RATE, ret: str = "next_ret", variants: list[str] | None = None) -> DataFrame:
    """Per date: gross, turnover, cost, net, exposure, active names, entries.

    With ``variants`` the weights have a column ``variant`` with these values, and all of them
    are accounted for in one pass, a row per variant and date.

    turnover is half the sum of |change of weight| over all names, 0 on the first
    date. Each held row is compared with the same name's weight on the date before;
    a row not followed by the next date closes there.
    """
    dates = date_ordinals(returns)
    last = Window.partitionBy(F.lit(0)).orderBy(F.desc("day_no"))  # one row per date
    dates = dates.withColumn("_last", F.first("day_no").over(last))
    held = join_daily(weights.where(F.col("w") > 0), dates, "inner")
    rets = returns.select("date", "symbol", F.col(ret).alias("_r"))
    held = held.join(rets, ["date", "symbol"], "left")
    keys = ["variant"] if variants else []
    w = Window.partitionBy(*keys, "symbol").orderBy("day_no")
    before = F.when(F.lag("day_no").over(w) == F.col("day_no") - 1, F.lag("w").over(w))
    goes_on = F.coalesce(F.lead("day_no").over(w) == F.col("day_no") + 1, F.lit(False))
    held = held.withColumns({"_before": before, "_goes_on": goes_on})
    opening = F.struct(
        F.col("day_no").alias("day_no"),
        (F.col("w") * F.coalesce("_r", F.lit(0.0))).alias("gross"),
        F.abs(F.col("w") - F.coalesce("_before", F.lit(0.0))).alias("moved"),
        F.col("w").alias("exposure"),
        F.lit(1).alias("active"),
        F.col("_before").isNull().cast("int").alias("entries"),
    )
    closing = F.struct(
        (F.col("day_no") + 1).alias("day_no"),
        F.lit(0.0).alias("gross"),
        F.col("w").alias("moved"),
        F.lit(0.0).alias("exposure"),
        F.lit(0).alias("active"),
        F.lit(0).alias("entries"),
    )
    closes = ~F.col("_goes_on") & (F.col("day_no") < F.col("_last"))
    moves = held.select(*keys, F.explode(F.array_compact(F.array(opening, F.when(closes, closing)))).alias("m")).select(*keys, "m.*")
    names = ["gross", "moved", "exposure", "active", "entries"]
    per_day = moves.groupBy(*keys, "day_no").agg(*[F.sum(c).alias(c) for c in names])
    if variants:
        dates = dates.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    daily = dates.drop("_last").join(per_day, [*keys, "day_no"], "left").na.fill(0, names)
    turnover = F.when(F.col("day_no") > 0, 0.5 * F.col("moved")).otherwise(F.lit(0.0))
    return with_costs(
        daily.select(*keys, "date", "gross", turnover.alias("turnover"), "exposure", F.col("active").alias("n_active"), "entries"),
        F.lit(cost_rate),
    )


def with_costs(daily: DataFrame, rate: Column) -> DataFrame:
    cost = rate * F.col("turnover")
    return daily.withColumns({"cost": cost, "net": F.col("gross") - cost})


def equity_curve(daily: DataFrame, ret: str = "net", keys: list[str] = ()) -> DataFrame:
    """Growth of one unit and drawdown from its peak (one row per date and key)."""
    w = R.running(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date"))
    out = daily.withColumn("equity", F.product(1.0 + F.col(ret)).over(w))
    return out.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1.0)


def summary(daily: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Cumulative return, drawdown, Sharpe ratio, turnover and activity per key."""
    curve = equity_curve(daily, "net", list(keys))
    sd = F.stddev_pop("net")
    return curve.groupBy(*keys).agg(
        F.count("*").alias("n_days"),
        (F.product(1.0 + F.col("gross")) - 1.0).alias("cumulative_return_gross"),
        (F.product(1.0 + F.col("net")) - 1.0).alias("cumulative_return_net"),
        F.min("drawdown").alias("max_drawdown"),
        F.when(sd > 0, F.avg("net") / sd * YEAR**0.5).alias("sharpe_net"),
        F.sum("turnover").alias("total_turnover"),
        F.sum("entries").alias("n_entries"),
        F.sum("n_active").alias("n_position_days"),
        F.avg(flag(F.col("exposure") > 0)).alias("pct_days_in_market"),
        F.avg("n_active").alias("n_active_mean"),
    )


def assert_accounts(daily: DataFrame, returns: DataFrame | None = None, ret: str = "next_ret", max_net: float = 0.5) -> DataFrame:
    """Fail on implausible accounts; returns the daily table unchanged."""
    curve = equity_curve(daily)
    row = curve.agg(
        F.max(F.abs("net")).alias("net"),
        F.count_if(F.isnan("net") | F.col("net").isNull()).alias("undefined"),
        F.max("exposure").alias("exposure"),
        F.min("equity").alias("equity"),
        F.min("drawdown").alias("drawdown"),
        F.sum("turnover").alias("turnover"),
    ).first()
    problems = []
    if row.net is not None:
        checks = {
            "daily return undefined": row.undefined > 0,
            f"daily return beyond {max_net}": row.net > max_net + 1e-12,
            "exposure above 1": row.exposure > 1.0 + 1e-9,
            "equity not positive": row.equity <= 0,
            "drawdown outside [-1, 0]": not -1.0 <= row.drawdown <= 0.0,
            "turnover implausible": row.turnover >= 5000,
        }
        problems = [name for name, bad in checks.items() if bad]
    if returns is not None and returns.where(F.abs(F.col(ret)) > 0.5 + 1e-12).limit(1).count():
        problems.append("a symbol return beyond 0.5")
    if problems:
        raise ValueError("; ".join(problems))
    return daily


def cost_sensitivity(daily: DataFrame, basis_points: list[float], keys: list[str] = ()) -> DataFrame:
    """Net results at several cost rates from one pass of gross returns and turnover."""
    rates = F.explode(F.array(*[F.lit(float(b)) for b in basis_points]))
    swept = daily.select(*keys, "date", "gross", "turnover", "exposure", "n_active", "entries", rates.alias("bps"))
    return summary(with_costs(swept, F.col("bps") / 10000.0), [*keys, "bps"])


def yearly_returns(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.year("date").alias("year")).agg((F.product(1.0 + F.col("net")) - 1.0).alias("net_return"))


def contributions(returns: DataFrame, weights: DataFrame, n: int = 12, ret: str = "next_ret") -> DataFrame:
    """The n symbols with the largest sum of w * r, and their return statistics."""
    joined = returns.join(weights.where(F.col("w") > 0), ["date", "symbol"], "left")
    return (
        joined.groupBy("symbol")
        .agg(
            F.sum(F.coalesce("w", F.lit(0.0)) * F.col(ret)).alias("total_contribution"),
            F.avg(F.abs(ret)).alias("mean_abs_ret"),
            F.max(ret).alias("max_ret"),
            F.count("*").alias("n_rows"),
        )
        .orderBy(F.desc("total_contribution"), "symbol")
        .limit(n)
    )


def held_accuracy(preds: DataFrame, weights: DataFrame, actual: str = "actual") -> DataFrame:
    """Share of up moves among held position-days."""
    held = preds.join(weights.where(F.col("w") > 0), ["date", "symbol"])
    return held.agg(F.avg(F.col(actual).cast("double")).alias("held_accuracy"), F.count("*").alias("n_held"))


def holdout_verdict(results: DataFrame, reference: str) -> DataFrame:
    """Per variant: net return and Sharpe above the reference at every cost level.

    ``results``: variant, bps, cumulative_return_net, sharpe_net.
    """
    ref = results.where(F.col("variant") == reference).select(
        "bps", F.col("cumulative_return_net").alias("_net"), F.col("sharpe_net").alias("_sharpe")
    )
    better = (F.col("cumulative_return_net") > F.col("_net")) & (F.col("sharpe_net") > F.col("_sharpe"))
    return (
        results.where(F.col("variant") != reference)
        .join(ref, "bps")
        .groupBy("variant")
        .agg(F.coalesce(F.bool_and(better), F.lit(False)).alias("passes"), F.count("*").alias("n_levels"))
    )


# --- long / short legs -----------------------------------------------------


def long_short_daily(preds: DataFrame, cost: float, decile: int = 1, cap: int = 10, prob: str = "prob", ret: str = "next_ret") -> DataFrame:
    """Top and bottom legs by probability per date; half the spread of their mean returns.

    A leg has max(1, min(n // 10 * decile, cap)) names. Rows beyond the cap are cut by
    a rank filter that Spark applies before the shuffle, so no date is collected whole.
    Ties are ordered by symbol; the short leg is the tail of that order.
    """
    known = preds.where(F.col(prob).isNotNull() & F.col(ret).isNotNull())
    universe = known.groupBy("date").agg(F.count("*").alias("n_universe"), F.avg(ret).alias("naive_ret"))
    size = F.greatest(F.lit(1), F.least(F.floor(F.col("n_universe") / 10) * decile, F.lit(cap)))
    universe = universe.withColumn("n_leg", size)
    down = Window.partitionBy("date").orderBy(F.desc(prob), "symbol")
    up = Window.partitionBy("date").orderBy(prob, F.desc("symbol"))

    def leg(order, name: str) -> DataFrame:
        best = known.withColumn("_rk", F.row_number().over(order)).where(F.col("_rk") <= max(cap, 1))
        best = join_daily(best, universe.select("date", "n_leg"), "inner").where(F.col("_rk") <= F.col("n_leg"))
        return best.groupBy("date").agg(F.avg(ret).alias(name))

    daily = universe.join(leg(down, "long_leg_ret"), "date").join(leg(up, "_short"), "date")
    gross = 0.5 * (F.col("long_leg_ret") - F.col("_short"))
    return daily.select(
        "date",
        "n_universe",
        F.col("n_leg").alias("n_long"),
        F.col("n_leg").alias("n_short"),
        "long_leg_ret",
        (-F.col("_short")).alias("short_leg_ret"),
        gross.alias("gross_spread"),
        (gross - 2.0 * cost).alias("net_spread"),
        F.lit(2.0).alias("turnover_pct"),
        "naive_ret",
    )


def long_short_summary(daily: DataFrame, risk_free_pct: float = 6.0) -> DataFrame:
    """Zeros instead of NULLs when there are no days."""
    curve = equity_curve(daily.withColumn("net", F.col("net_spread")))
    zero = F.lit(0.0)
    daily_rf = risk_free_pct / 100.0 / YEAR
    sd = F.stddev_pop("net_spread")
    cum = {c: F.coalesce(F.product(1.0 + F.col(c)) - 1.0, zero) * 100.0 for c in ("gross_spread", "net_spread", "naive_ret")}
    return curve.agg(
        F.count("*").alias("n_days"),
        F.coalesce(F.avg("n_universe"), zero).alias("n_universe_avg"),
        cum["gross_spread"].alias("gross_cum_return_pct"),
        cum["net_spread"].alias("net_cum_return_pct"),
        cum["naive_ret"].alias("naive_equal_weight_cum_return_pct"),
        (cum["net_spread"] - cum["naive_ret"]).alias("edge_vs_naive_pct"),
        F.coalesce(F.avg("net_spread") * 1e4, zero).alias("net_daily_mean_bps"),
        F.coalesce(sd * 1e4, zero).alias("net_daily_std_bps"),
        F.coalesce(F.when(sd > 0, (F.avg("net_spread") - daily_rf) / sd * YEAR**0.5), zero).alias("net_sharpe"),
        F.coalesce(F.min("drawdown") * 100.0, zero).alias("max_drawdown_pct"),
        F.coalesce(F.avg(flag(F.col("net_spread") > 0)) * 100.0, zero).alias("hit_rate_pct"),
        F.coalesce(F.avg("turnover_pct") * 100.0, zero).alias("turnover_pct_per_day"),
    )


# --- simple signal accounting ----------------------------------------------


def signal_portfolio(preds: DataFrame, pred: str = "pred", ret: str = "next_ret", actual: str = "actual", cost_rate: float = COST_RATE) -> DataFrame:
    """Equal weight on predicted-up names: summary with trades and hit rate."""
    weights = normalise(raw_weights(preds, flag(F.col(pred) == 1)))
    totals = summary(daily_accounts(preds, weights, cost_rate, ret))
    trades = preds.where(F.col(pred) == 1).agg(
        F.count("*").alias("n_trades"),
        F.avg(ret).alias("avg_trade_return"),
        F.avg((F.col(pred) == F.col(actual)).cast("double")).alias("hit_rate"),
    )
    return one_row(totals, trades)


def position_audit(preds: DataFrame, threshold: float = 0.55, cost: float = 0.0015, prob: str = "prob", ret: str = "next_ret") -> DataFrame:
    """Daily mean net return over positions, cost on each symbol's own position changes."""
    w = R.series()
    signal = flag(F.col(prob) >= threshold)
    rows = preds.select("date", "symbol", F.col(ret).alias("_r"), signal.alias("_s"))
    moved = F.abs(F.col("_s") - F.coalesce(F.lag("_s").over(w), F.lit(0.0)))
    rows = rows.withColumn("_m", moved)
    daily = rows.groupBy("date").agg(
        F.sum("_s").cast("long").alias("n_positions"),
        F.sum(F.col("_s") * F.col("_r") - cost * F.col("_m")).alias("_net"),
        F.sum("_m").cast("long").alias("n_changes"),
    )
    net = F.coalesce(ratio("_net", "n_positions"), F.lit(0.0))
    return daily.select("date", "n_positions", "n_changes", F.greatest(F.least(net, F.lit(0.5)), F.lit(-0.5)).alias("net"))


def symbol_trading(preds: DataFrame, pred: str = "pred", ret: str = "next_ret") -> DataFrame:
    """Long-when-up results per symbol, returns limited to +-0.5."""
    r = F.greatest(F.least(F.coalesce(F.col(ret), F.lit(0.0)), F.lit(0.5)), F.lit(-0.5))
    rows = preds.select("symbol", "date", (F.col(pred) * r).alias("net"), r.alias("_r"), F.col(pred).alias("_s"))
    curve = equity_curve(rows, "net", ["symbol"])
    sd = F.stddev_pop("net")
    return curve.groupBy("symbol").agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("net") != 0, flag(F.col("net") > 0))).alias("hit_rate"),
        F.avg(F.when(F.col("_s") == 1, F.col("_r"))).alias("avg_return_on_buy"),
        (F.product(1.0 + F.col("net")) - 1.0).alias("cumulative_return"),
        F.min("drawdown").alias("max_drawdown"),
        F.when(sd > 0, F.avg("net") / sd * YEAR**0.5).alias("sharpe"),
    )
