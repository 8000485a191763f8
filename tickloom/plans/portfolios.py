"""Weights, accounting and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.costs import CostRates, round_trip_fraction, round_trip_pct
from ..operators import portfolio as P
from ..session import stored
from .base import columns, cte, query
from .external import prank

KEY = "symbol date:d "


def preds(m, *more: str):
    return stored(m.predictions.select("date", "symbol", "next_ret", "actual", "prob", "pred", *more), "preds")


def norm_sql(inner: str) -> str:
    return f"SELECT symbol, date, coalesce(w / nullif(sum(w) OVER (PARTITION BY date), 0), 0) AS w FROM ({inner})"


cte("w_naive", norm_sql("SELECT symbol, date, 1E0 AS w FROM preds"), "preds")
cte("w_thr", norm_sql("SELECT symbol, date, (prob >= 0.55E0)::int AS w FROM preds"), "preds")
cte(
    "w_topk",
    norm_sql("SELECT symbol, date, 1E0 AS w FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY prob DESC, symbol) AS rk FROM preds WHERE prob >= 0.5E0) WHERE rk <= 5"),
    "preds",
)
cte(
    "w_band",
    norm_sql(
        """SELECT symbol, date, coalesce(last_value(CASE WHEN prob >= 0.55E0 THEN 1 WHEN prob < 0.5E0 THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date), 0) AS w FROM preds"""
    ),
    "preds",
)
cte("prn", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM preds", "preds")
_OUT = "(p.prob < 0.45E0 OR (h.held >= 5 AND p.prob < 0.5E0))"
cte(
    "held",
    f"""SELECT symbol, rn, date, (prob >= 0.55E0)::int AS held FROM prn WHERE rn = 1
       UNION ALL SELECT p.symbol, p.rn, p.date, CASE WHEN h.held > 0 AND NOT {_OUT} THEN h.held + 1 WHEN p.prob >= 0.55E0 THEN 1 ELSE 0 END
       FROM held h JOIN prn p ON p.symbol = h.symbol AND p.rn = h.rn + 1""",
    "prn",
    recursive=True,
)
cte("w_held", norm_sql("SELECT symbol, date, (held > 0)::int AS w FROM held"), "held")
cte("w_tilt", norm_sql("SELECT symbol, date, greatest(1 + 0.5E0 * (2 * prob - 1), 0.1E0) AS w FROM preds"), "preds")
cte(
    "w_static",
    norm_sql("SELECT symbol, date, coalesce(exp(sum(ln(1 + next_ret)) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS w FROM preds"),
    "preds",
)
cte(
    "t_raw",
    f"SELECT symbol, date, CASE WHEN rk >= 2 / 3E0 THEN 1.5E0 WHEN rk <= 1 / 3E0 THEN 0.5E0 ELSE 1E0 END AS w FROM (SELECT symbol, date, {prank('prob')} AS rk FROM preds)",
    "preds",
)
cte("w_tercile", norm_sql("SELECT * FROM t_raw"), "t_raw")


def frozen_sql(raw: str, every: int, default: str) -> str:
    return norm_sql(
        f"""SELECT p.symbol, p.date, coalesce(s.w, {default}) AS w FROM preds p JOIN days d USING (date)
            LEFT JOIN (SELECT r.symbol, r.w, x.day_no FROM ({raw}) r JOIN days x USING (date) WHERE x.day_no % {every} = 0) s ON s.symbol = p.symbol AND s.day_no = d.day_no - d.day_no % {every}"""
    )


cte("w_fz5", frozen_sql("SELECT * FROM t_raw", 5, "1E0"), "preds", "days", "t_raw")
cte("w_fz21", frozen_sql("SELECT symbol, date, (prob >= 0.5E0)::int AS w FROM preds", 21, "0E0"), "preds", "days")
cte(
    "w_hold5",
    norm_sql(
        """SELECT symbol, date, w FROM (SELECT symbol, date, last_value(CASE WHEN day_no % 5 = 0 THEN 1E0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS w
           FROM preds JOIN days USING (date)) WHERE w IS NOT NULL"""
    ),
    "preds",
    "days",
)

WEIGHTS = {
    "naive": ("w_naive", lambda p: P.naive_weights(p)),
    "threshold": ("w_thr", lambda p: P.threshold_weights(p, 0.55)),
    "topk": ("w_topk", lambda p: P.top_k_weights(p, 5)),
    "hysteresis": ("w_band", lambda p: P.band_weights(p, 0.55, 0.50)),
    "hysteresis_hold": ("w_held", lambda p: P.held_band_weights(p, 0.55, 0.50, 5, 0.45)),
    "tilt": ("w_tilt", lambda p: P.tilt_weights(p)),
    "static": ("w_static", lambda p: P.static_weights(p)),
    "tilt_tercile": ("w_tercile", lambda p: P.tercile_weights(p)),
    "frozen_tercile_5": ("w_fz5", lambda p: P.frozen_weights(P.tercile_raw(p), 5, 1.0)),
    "frozen_binary_21": ("w_fz21", lambda p: P.frozen_weights(P.raw_weights(p, (F.col("prob") >= 0.5).cast("double")), 21, 0.0)),
    "frozen_naive_5": ("w_hold5", lambda p: P.frozen_weights(P.raw_weights(p, F.lit(1.0)), 5, None)),
}


def _register(name: str, table: str, build) -> None:
    @query(f"weights_{name}", KEY + "w:f8", f"SELECT * FROM {table}", (table,))
    def plan(m):
        return build(preds(m))


for _name, (_table, _build) in WEIGHTS.items():
    _register(_name, _table, _build)


# --- accounting ------------------------------------------------------------


def account_ctes(table: str) -> str:
    """Daily accounts of a weight table over a full dates x symbols grid."""
    name = f"acc_{table}"
    cte(
        name,
        f"""SELECT date, sum(w * r) AS gross, CASE WHEN min(day_no) = 0 THEN 0 ELSE 0.5E0 * sum(abs(w - w0)) END AS turnover, sum(w) AS exposure,
            count(*) FILTER (w > 0) AS n_active, count(*) FILTER (w > 0 AND w0 = 0) AS entries FROM (
            SELECT g.date, g.day_no, coalesce(t.w, 0) AS w, coalesce(p.next_ret, 0) AS r, coalesce(lag(coalesce(t.w, 0)) OVER (PARTITION BY g.symbol ORDER BY g.day_no), 0) AS w0
            FROM (SELECT d.date, d.day_no, s.symbol FROM days d, (SELECT DISTINCT symbol FROM preds) s) g
            LEFT JOIN {table} t ON t.symbol = g.symbol AND t.date = g.date LEFT JOIN preds p ON p.symbol = g.symbol AND p.date = g.date) GROUP BY date""",
        "preds", "days", table,
    )
    return name


for _table in ("w_naive", "w_thr", "w_topk", "w_band", "w_fz5"):
    account_ctes(_table)

DAILY = "date:d gross:f9 turnover:f8 exposure:f8 n_active:i entries:i cost:f9 net:f9"


def daily_sql(acc: str, rate: str = "0.001E0") -> str:
    return f"SELECT *, {rate} * turnover AS cost, gross - {rate} * turnover AS net FROM {acc}"


@query("portfolio_daily", DAILY, daily_sql("acc_w_topk"), ("acc_w_topk",))
def portfolio_daily(m):
    p = preds(m)
    return P.daily_accounts(p, P.top_k_weights(p, 5))


def summary_sql(daily: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}count(*) AS n_days, exp(sum(ln(1 + gross))) - 1 AS cumulative_return_gross, exp(sum(ln(1 + net))) - 1 AS cumulative_return_net, min(eq / peak - 1) AS max_drawdown,
       avg(net) / nullif(stddev_pop(net), 0) * sqrt(252) AS sharpe_net, sum(turnover) AS total_turnover, sum(entries) AS n_entries, sum(n_active) AS n_position_days,
       avg((exposure > 0)::int) AS pct_days_in_market, avg(n_active) AS n_active_mean FROM (SELECT *, max(eq) OVER ({part}ORDER BY date) AS peak FROM (
       SELECT *, exp(sum(ln(1 + net)) OVER ({part}ORDER BY date)) AS eq FROM ({daily}))) {group}"""


SUMMARY = "n_days:i cumulative_return_gross:f5 cumulative_return_net:f5 max_drawdown:f7 sharpe_net:f6 total_turnover:f6 n_entries:i n_position_days:i pct_days_in_market:f8 n_active_mean:f7"


@query("portfolio_summary", SUMMARY, summary_sql(daily_sql("acc_w_band")), ("acc_w_band",))
def portfolio_summary(m):
    p = preds(m)
    return P.summary(P.daily_accounts(p, P.band_weights(p, 0.55, 0.50)))


VARIANTS = {"naive": "w_naive", "threshold": "w_thr", "topk": "w_topk", "frozen_tercile_5": "w_fz5"}
BPS = [5, 10, 25, 50]
_all = " UNION ALL ".join(f"SELECT '{v}' AS variant, * FROM acc_{t}" for v, t in VARIANTS.items())
cte("variants", f"SELECT v.*, bps, bps / 10000E0 * turnover AS cost, gross - bps / 10000E0 * turnover AS net FROM ({_all}) v, (SELECT unnest([5, 10, 25, 50]) AS bps)", *[f"acc_{t}" for t in VARIANTS.values()])
cte("sens", summary_sql("SELECT * FROM variants", "variant, bps"), "variants")


def variant_days(m) -> DataFrame:
    p = preds(m)
    parts = [WEIGHTS[v][1](p).select(F.lit(v).alias("variant"), "date", "symbol", "w") for v in VARIANTS]
    accounts = P.daily_accounts(p, reduce(DataFrame.unionByName, parts), variants=list(VARIANTS))
    return accounts.select("variant", "date", "gross", "turnover", "exposure", "n_active", "entries")


@query("cost_sensitivity", "variant bps:i " + SUMMARY, "SELECT * FROM sens", ("sens",))
def cost_sensitivity(m):
    return P.cost_sensitivity(variant_days(m), BPS, ["variant"])


cte("holdout", summary_sql("SELECT * FROM variants WHERE date > date '2000-12-31' AND bps IN (10, 25)", "variant, bps"), "variants")


@query(
    "holdout_verdict",
    "variant passes n_levels:i",
    """SELECT h.variant, bool_and(h.cumulative_return_net > n.cumulative_return_net AND h.sharpe_net > n.sharpe_net) AS passes, count(*) AS n_levels
       FROM holdout h JOIN holdout n ON n.variant = 'naive' AND n.bps = h.bps WHERE h.variant <> 'naive' GROUP BY 1""",
    ("holdout",),
)
def holdout_verdict(m):
    days = variant_days(m).where(F.col("date") > F.lit("2000-12-31").cast("date"))
    return P.holdout_verdict(P.cost_sensitivity(days, [10, 25], ["variant"]), "naive")


@query(
    "yearly_returns",
    "year:i net_return:f8",
    f"SELECT year(date) AS year, exp(sum(ln(1 + net))) - 1 AS net_return FROM ({daily_sql('acc_w_thr')}) GROUP BY 1",
    ("acc_w_thr",),
)
def yearly_returns(m):
    p = preds(m)
    return P.yearly_returns(P.daily_accounts(p, P.threshold_weights(p, 0.55)))


@query(
    "equity_curve",
    "date:d net:f9 equity:f7 drawdown:f7",
    f"""SELECT date, net, eq AS equity, eq / max(eq) OVER (ORDER BY date) - 1 AS drawdown FROM (
        SELECT *, exp(sum(ln(1 + net)) OVER (ORDER BY date)) AS eq FROM ({daily_sql('acc_w_thr')}))""",
    ("acc_w_thr",),
)
def equity_curve(m):
    p = preds(m)
    return P.equity_curve(P.daily_accounts(p, P.threshold_weights(p, 0.55)))


@query(
    "checked_accounts",
    DAILY,
    daily_sql("acc_w_naive"),
    ("acc_w_naive",),
)
def checked_accounts(m):
    p = preds(m)
    daily = stored(P.daily_accounts(p, P.naive_weights(p)), "daily")
    return P.assert_accounts(daily, p, max_net=0.15)


@query(
    "top_contributors",
    "symbol total_contribution:f8 mean_abs_ret:f8 max_ret:f8 n_rows:i",
    """SELECT symbol, sum(coalesce(w, 0) * next_ret) AS total_contribution, avg(abs(next_ret)) AS mean_abs_ret, max(next_ret) AS max_ret, count(*) AS n_rows
       FROM preds LEFT JOIN w_band USING (symbol, date) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""",
    ("preds", "w_band"),
)
def top_contributors(m):
    p = preds(m)
    return P.contributions(p, P.band_weights(p, 0.55, 0.50))


@query(
    "held_accuracy",
    "held_accuracy:f9 n_held:i",
    "SELECT avg(actual) AS held_accuracy, count(*) AS n_held FROM preds JOIN w_band USING (symbol, date) WHERE w > 0",
    ("preds", "w_band"),
)
def held_accuracy(m):
    p = preds(m)
    return P.held_accuracy(p, P.band_weights(p, 0.55, 0.50))


COST = round_trip_fraction(CostRates())
cte(
    "ls",
    f"""SELECT date, n_universe, n_leg AS n_long, n_leg AS n_short, avg(next_ret) FILTER (a <= n_leg) AS long_leg_ret, -avg(next_ret) FILTER (b <= n_leg) AS short_leg_ret,
       0.5E0 * (avg(next_ret) FILTER (a <= n_leg) - avg(next_ret) FILTER (b <= n_leg)) AS gross_spread,
       0.5E0 * (avg(next_ret) FILTER (a <= n_leg) - avg(next_ret) FILTER (b <= n_leg)) - 2 * {COST!r}E0 AS net_spread, 2.0E0 AS turnover_pct, avg(next_ret) AS naive_ret FROM (
       SELECT *, count(*) OVER (PARTITION BY date) AS n_universe, greatest(1, least(count(*) OVER (PARTITION BY date) // 10, 10)) AS n_leg,
       row_number() OVER (PARTITION BY date ORDER BY prob DESC, symbol) AS a, row_number() OVER (PARTITION BY date ORDER BY prob, symbol DESC) AS b FROM preds) GROUP BY 1, 2, 3, 4""",
    "preds",
)


@query("long_short_daily", "date:d n_universe:i n_long:i n_short:i long_leg_ret:f9 short_leg_ret:f9 gross_spread:f9 net_spread:f9 turnover_pct:f1 naive_ret:f9", "SELECT * FROM ls", ("ls",))
def long_short_daily(m):
    return P.long_short_daily(preds(m), COST)


LS = ["gross_cum_return_pct", "net_cum_return_pct", "naive_equal_weight_cum_return_pct", "edge_vs_naive_pct", "net_daily_mean_bps", "net_daily_std_bps", "net_sharpe", "max_drawdown_pct", "hit_rate_pct", "turnover_pct_per_day"]


@query(
    "long_short_summary",
    "n_days:i n_universe_avg:f7 " + columns(LS, "f5"),
    """SELECT count(*) AS n_days, avg(n_universe) AS n_universe_avg, (exp(sum(ln(1 + gross_spread))) - 1) * 100 AS gross_cum_return_pct, (exp(sum(ln(1 + net_spread))) - 1) * 100 AS net_cum_return_pct,
       (exp(sum(ln(1 + naive_ret))) - 1) * 100 AS naive_equal_weight_cum_return_pct, (exp(sum(ln(1 + net_spread))) - exp(sum(ln(1 + naive_ret)))) * 100 AS edge_vs_naive_pct,
       avg(net_spread) * 1e4 AS net_daily_mean_bps, stddev_pop(net_spread) * 1e4 AS net_daily_std_bps, (avg(net_spread) - 0.06 / 252) / stddev_pop(net_spread) * sqrt(252) AS net_sharpe,
       min(eq / peak - 1) * 100 AS max_drawdown_pct, avg((net_spread > 0)::int) * 100 AS hit_rate_pct, 200E0 AS turnover_pct_per_day
       FROM (SELECT *, max(eq) OVER (ORDER BY date) AS peak FROM (SELECT *, exp(sum(ln(1 + net_spread)) OVER (ORDER BY date)) AS eq FROM ls))""",
    ("ls",),
)
def long_short_summary(m):
    return P.long_short_summary(P.long_short_daily(preds(m), COST))


cte("w_sig", norm_sql("SELECT symbol, date, pred AS w FROM preds"), "preds")
account_ctes("w_sig")


@query(
    "signal_portfolio",
    SUMMARY + " n_trades:i avg_trade_return:f9 hit_rate:f9",
    f"SELECT * FROM ({summary_sql(daily_sql('acc_w_sig'))}), (SELECT count(*) AS n_trades, avg(next_ret) AS avg_trade_return, avg(actual) AS hit_rate FROM preds WHERE pred = 1)",
    ("acc_w_sig",),
)
def signal_portfolio(m):
    return P.signal_portfolio(preds(m))


@query(
    "position_audit",
    "date:d n_positions:i n_changes:i net:f9",
    """SELECT date, sum(s) AS n_positions, sum(c) AS n_changes, least(greatest(coalesce(sum(s * next_ret - c * 0.0015E0) / nullif(sum(s), 0), 0), -0.5), 0.5) AS net FROM (
       SELECT *, abs(s - coalesce(lag(s) OVER (PARTITION BY symbol ORDER BY date), 0)) AS c FROM (SELECT *, (prob >= 0.55E0)::int AS s FROM preds)) GROUP BY 1""",
    ("preds",),
)
def position_audit(m):
    return P.position_audit(m.predictions)


FLOOR = "0.03E0 * v / 100 < 20"
BROKER = f"CASE WHEN v > 0 AND {FLOOR} THEN greatest(0.03E0, 2000 / greatest(v, 1)) ELSE 0.03E0 END"


@query(
    "round_trip_cost",
    "bucket:i n:i mean_cost_pct:f8 max_cost_pct:f8",
    f"""SELECT cast(floor(log10(v)) AS int) AS bucket, count(*) AS n, avg(c) AS mean_cost_pct, max(c) AS max_cost_pct FROM (
        SELECT v, (b + 2 * 0.00325E0 + 2 * 0.0001E0) * 1.18E0 + 0.025E0 + 0.015E0 + 0.1E0 AS c FROM (SELECT v, {BROKER} AS b FROM (SELECT l_extendedprice AS v FROM lineitem))) GROUP BY 1""",
)
def round_trip_cost(m):
    v = F.col("l_extendedprice")
    rows = m.table("lineitem").select(v.alias("v"), round_trip_pct(CostRates(), 1.0, v, v).alias("c"))
    return rows.groupBy(F.floor(F.log10("v")).alias("bucket")).agg(
        F.count("*").alias("n"), F.avg("c").alias("mean_cost_pct"), F.max("c").alias("max_cost_pct")
    )
