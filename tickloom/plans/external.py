"""External data: flows, delivery, macro, options, intraday, news, earnings, fundamentals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.scalar import ratio
from ..functions.text import ANNOUNCEMENT_PATTERNS, SECTOR_KEYWORDS, announcement_flags, mentions, sector_of, sentiment
from ..operators import fundamentals as FU
from ..operators import news as N
from ..operators.asof import asof
from ..operators.audit import shifted_pairs
from ..operators.calendar import by_date
from ..operators.delivery import delivery_features
from ..operators.flows import add_streaks, coverage, flow_features, macro_features
from ..operators.intraday import ROLLED, intraday_features, intraday_rolling
from ..operators.options import max_pain, option_features, option_rolling
from ..operators.registry import exogenous_features, join_sources, merge_sources
from ..session import stored
from .base import columns, cte, query
from .tables_sql import NEG, POS, avg_n

KEY = "symbol date:d "


def roll(x: str, n: int, at_least: int | None = None, fn: str = "avg", by: str = "", order: str = "date") -> str:
    part = f"PARTITION BY {by} " if by else ""
    frame = f"({part}ORDER BY {order} ROWS {n - 1} PRECEDING)"
    call = fn.replace("$", x) if "$" in fn else f"{fn}({x})"
    return f"CASE WHEN count({x}) OVER {frame} >= {at_least or n} THEN {call} OVER {frame} END"


def zed(x: str, n: int, at_least: int | None = None, by: str = "", sd: str = "stddev_pop") -> str:
    return f"({x} - {roll(x, n, at_least, by=by)}) / nullif({roll(x, n, at_least, sd, by)}, 0)"


def diff(x: str, n: int, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"{x} - lag({x}, {n}) OVER ({part}ORDER BY date)"


# --- flows -----------------------------------------------------------------


def _flow_sql() -> tuple[str, list[str]]:
    cols: dict[str, str] = {}
    for side in ("fii", "dii"):
        x = f"{side}_net"
        cols |= {f"{x}_{n}d_ma": roll(x, n) for n in (5, 10, 20, 50)}
        cols |= {f"{x}_zscore_{n}d": zed(x, n) for n in (20, 50)}
        cols |= {f"{side}_momentum_{n}d": diff(x, n) for n in (5, 20)}
        cols[f"{x}_positive"] = f"CASE WHEN {x} > 0 THEN 1 ELSE 0 END"
        for word, op, reset in (("buy", ">", "<="), ("sell", "<", ">=")):
            cols[f"{side}_consecutive_{word}"] = (
                f"sum(CASE WHEN {x} {op} 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {side}_{word}_i ORDER BY date)"
            )
    cols["fii_dii_net_spread"] = "fii_net - dii_net"
    cols |= {f"fii_dii_net_spread_{n}d_ma": roll("(fii_net - dii_net)", n) for n in (5, 20)}
    cols["fii_dii_buy_ratio"] = "ratio"
    cols["fii_dii_buy_ratio_5d_ma"] = roll("ratio", 5)
    for n, k in ((20, 10), (50, 20)):
        frame = f"(ORDER BY date ROWS {n - 1} PRECEDING)"
        cols[f"fii_dii_corr_{n}d"] = f"CASE WHEN count(fii_net) OVER {frame} >= {k} THEN corr(fii_net, dii_net) OVER {frame} END"
    cols["fii_dii_same_direction"] = "CASE WHEN (fii_net > 0) = (dii_net > 0) THEN 1 ELSE 0 END"
    islands = ", ".join(
        f"sum(CASE WHEN {s}_net {r} 0 THEN 1 ELSE 0 END) OVER (ORDER BY date) AS {s}_{wd}_i"
        for s in ("fii", "dii")
        for wd, r in (("buy", "<="), ("sell", ">="))
    )
    sel = ", ".join(f"{v} AS {k}" for k, v in cols.items())
    return f"SELECT date, {sel} FROM (SELECT *, fii_gross_buy / nullif(dii_gross_buy, 0) AS ratio, {islands} FROM flows)", list(cols)


FLOW_SQL, FLOW_COLS = _flow_sql()


@query("flow_features", "date:d " + " ".join(f"{c}:f6" if "zscore" in c or "corr" in c else f"{c}:f9" for c in FLOW_COLS), FLOW_SQL, ("flows",))
def flow_features_(m):
    return flow_features(m.flows)


@query(
    "streaks",
    KEY + "up_days:i down_days:i",
    """SELECT symbol, date, sum(CASE WHEN "close" > pc THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, iu ORDER BY date) AS up_days,
       sum(CASE WHEN "close" < pc THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, idn ORDER BY date) AS down_days FROM (
       SELECT *, sum(CASE WHEN "close" <= pc THEN 1 ELSE 0 END) OVER w AS iu, sum(CASE WHEN "close" >= pc THEN 1 ELSE 0 END) OVER w AS idn
       FROM rows WINDOW w AS (PARTITION BY symbol ORDER BY date))""",
    ("rows",),
)
def streaks(m):
    before = F.lag("close").over(R.series())
    bars = m.bars.withColumn("_before", before)
    up, down = F.col("close") > F.col("_before"), F.col("close") < F.col("_before")
    rise, fall = F.col("close") >= F.col("_before"), F.col("close") <= F.col("_before")
    return add_streaks(bars, {"up_days": (up, fall), "down_days": (down, rise)}, "symbol")


@query(
    "rolling_corr",
    KEY + "corr_20:f5 corr_50:f5",
    """SELECT symbol, date, CASE WHEN count(volume) OVER a >= 10 THEN corr("close", volume) OVER a END AS corr_20,
       CASE WHEN count(volume) OVER b >= 20 THEN corr("close", volume) OVER b END AS corr_50 FROM bars
       WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), b AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING)""",
    ("bars",),
)
def rolling_corr(m):
    w = R.series()
    return m.bars.withColumns(
        {"corr_20": R.correlation("close", "volume", w, 20, 10), "corr_50": R.correlation("close", "volume", w, 50, 20)}
    )


@query(
    "rolling_slope",
    KEY + "slope_20:f8",
    """SELECT symbol, date, CASE WHEN count("close") OVER a >= 20 THEN regr_slope("close", rn::double) OVER a END AS slope_20 FROM rows
       WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)""",
    ("rows",),
)
def rolling_slope(m):
    w = R.series()
    numbered = m.bars.withColumn("_no", F.row_number().over(w))
    return numbered.withColumn("slope_20", R.slope("close", "_no", w, 20))


def rank_sql(x: str, n: int, at_least: int) -> str:
    frame = f"(PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"
    a = f"list({x}) FILTER ({x} IS NOT NULL) OVER {frame}"
    return (
        f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER {frame} >= {at_least} THEN (len(list_filter({a}, lambda v: v < {x})) "
        f"+ (len(list_filter({a}, lambda v: v = {x})) + 1) / 2E0) / count({x}) OVER {frame} END"
    )


@query(
    "rolling_rank",
    KEY + "rank_20:f8 rank_252:f8",
    f"""SELECT symbol, date, {rank_sql('volume', 20, 10)} AS rank_20, {rank_sql('volume', 252, 100)} AS rank_252 FROM bars""",
    ("bars",),
)
def rolling_rank(m):
    w = R.series()
    return m.bars.withColumns({"rank_20": R.rank_pct("volume", w, 20, 10), "rank_252": R.rank_pct("volume", w, 252, 100)})


# --- delivery --------------------------------------------------------------


def _delivery_sql() -> tuple[str, list[str]]:
    x = "delivery_pct"
    cols = {"delivery_pct": x, "delivery_value": 'delivery_qty * "close"', "delivery_to_volume": "delivery_qty / nullif(volume, 0)"}
    cols |= {f"delivery_pct_{n}d_ma": roll(x, n, by="symbol") for n in (5, 10, 20, 50)}
    cols |= {f"delivery_pct_zscore_{n}d": zed(x, n, n // 2, by="symbol") for n in (20, 50, 252)}
    cols |= {f"delivery_pct_momentum_{n}d": diff(x, n, "symbol") for n in (5, 20)}
    cols["delivery_pct_rank_252d"] = rank_sql(x, 252, 100)
    cols["delivery_pct_trend_20d"] = (
        "CASE WHEN count(delivery_pct) OVER a >= 20 THEN regr_slope(delivery_pct, rn::double) OVER a END"
    )
    hi, lo = (roll(x, 252, 100, f"quantile_cont($, {q})", "symbol") for q in (0.7, 0.3))
    cols["high_delivery_flag"] = f"CASE WHEN {x} > ({hi}) THEN 1 ELSE 0 END"
    cols["low_delivery_flag"] = f"CASE WHEN {x} < ({lo}) THEN 1 ELSE 0 END"
    sel = ", ".join(f"{v} AS {k}" for k, v in cols.items() if k != x)
    inner = f"""SELECT symbol, date, delivery_pct, {sel} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM delivery)
        WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)"""
    isl = ", ".join(
        f"sum(CASE WHEN {s}_delivery_flag = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date) AS {s}_i" for s in ("high", "low")
    )
    runs = ", ".join(
        f"sum({s}_delivery_flag) OVER (PARTITION BY symbol, {s}_i ORDER BY date) AS consecutive_{s}_delivery" for s in ("high", "low")
    )
    return f"SELECT *, {runs} FROM (SELECT *, {isl} FROM ({inner}))", [*cols, "consecutive_high_delivery", "consecutive_low_delivery"]


DELIVERY_SQL, DELIVERY_COLS = _delivery_sql()


@query("delivery_features", KEY + " ".join(f"{c}:f9" if c == "delivery_value" else f"{c}:f6" for c in DELIVERY_COLS), DELIVERY_SQL, ("delivery",))
def delivery_features_(m):
    return delivery_features(m.delivery)


# --- as-of and macro -------------------------------------------------------

cte("sparse", "SELECT cast(date_trunc('month', date) AS date) AS date, sum(fii_net) AS v FROM flows GROUP BY 1", "flows")


def _sparse(m):
    """A monthly series."""
    return m.flows.groupBy(F.to_date(F.date_trunc("month", "date")).alias("date")).agg(F.sum("fii_net").alias("v"))


def _keys(m):
    return stored(m.ticks.select("symbol", "date").distinct(), "keys")


@query(
    "asof_inclusive",
    KEY + "v:f9",
    "SELECT b.symbol, b.date, s.v FROM bars b ASOF LEFT JOIN sparse s ON b.date >= s.date",
    ("bars", "sparse"),
)
def asof_inclusive(m):
    return asof(_keys(m), _sparse(m), [], ["v"])


@query(
    "asof_exclusive",
    KEY + "v:f9",
    "SELECT b.symbol, b.date, s.v FROM bars b ASOF LEFT JOIN sparse s ON b.date > s.date",
    ("bars", "sparse"),
)
def asof_exclusive(m):
    return asof(_keys(m), _sparse(m), [], ["v"], inclusive=False)


@query(
    "asof_by_symbol",
    KEY + "pe_ratio:f6 roe:f6",
    "SELECT b.symbol, b.date, f.pe_ratio, f.roe FROM bars b ASOF LEFT JOIN fundamentals f ON b.symbol = f.symbol AND b.date >= f.date",
    ("bars", "fundamentals"),
)
def asof_by_symbol(m):
    return asof(m.bars, m.fundamentals, ["symbol"], ["pe_ratio", "roe"])




cte("stamps", "SELECT event_type AS symbol, ts, event_id AS seq, 100.0E0 + value / 10.0E0 AS px FROM events")


def marks_sql(by: str) -> str:
    """A seventh of the events, the greatest price of each time stamp."""
    return f"(SELECT {by}ts, max(px) AS mark FROM stamps WHERE seq % 7 = 0 GROUP BY ALL)"


@query("asof_time", "seq:i ts:t mark:f9", f"SELECT e.seq, e.ts, k.mark FROM stamps e ASOF LEFT JOIN {marks_sql('')} k ON e.ts >= k.ts", ("stamps",))
def asof_time(m):
    """The latest mark at or before every event, over all symbols: a key that is no date."""
    events, marks = _stamps(m)
    return asof(events, marks, [], ["mark"], on="ts")


@query(
    "asof_time_by_symbol",
    "symbol seq:i ts:t mark:f9",
    f"SELECT e.symbol, e.seq, e.ts, k.mark FROM stamps e ASOF LEFT JOIN {marks_sql('symbol, ')} k ON e.symbol = k.symbol AND e.ts > k.ts",
    ("stamps",),
)
def asof_time_by_symbol(m):
    """The latest mark of the same symbol before every event; one symbol may hold most of them."""
    events, marks = _stamps(m)
    return asof(events, marks, ["symbol"], ["mark"], on="ts", inclusive=False)


def _stamps(m):
    events = stored(m.event_ticks.select("symbol", "ts", "seq", "px"), "events")
    return events, events.where("seq % 7 = 0").select("symbol", "ts", F.col("px").alias("mark"))


def _session_sql(last: int) -> str:
    """The date, or the next Monday if the weekday is after ``last``: every row belongs to a session."""
    return f"CASE WHEN isodow(date) <= {last} THEN date ELSE date + (8 - isodow(date))::integer END"


def _session(last: int):
    day = F.weekday("date") + 1
    return F.when(day <= last, F.col("date")).otherwise(F.date_add("date", 8 - day))


cte("vix", f"SELECT {_session_sql(5)} AS date, max(10 + abs(fii_net) % 20) AS c FROM flows GROUP BY 1", "flows")
# value, last trading weekday (Monday = 1), lags
FOREIGN = {"spx": ("fii_gross_buy", 5, (1, 5)), "usdinr": ("dii_gross_buy", 6, (1,)), "crude": ("fii_gross_buy + dii_gross_buy", 4, (1, 5))}
for _name, (_expr, _last, _lags) in FOREIGN.items():
    cte(
        _name,
        "SELECT date, "
        + ", ".join(f"c / lag(c, {lag}) OVER (ORDER BY date) - 1 AS r{lag}" for lag in _lags)
        + f" FROM (SELECT {_session_sql(_last)} AS date, max(50 + {_expr}) AS c FROM flows GROUP BY 1)",
        "flows",
    )
MACRO_COLS = ["vix_level", "vix_chg1d", "vix_z20", "vix_high_regime", "spx_ret1d_lag", "spx_ret5d_lag", "usdinr_ret1d_lag", "crude_ret1d_lag", "crude_ret5d_lag"]
cte(
    "macro",
    f"""SELECT *, vix_level / lag(vix_level) OVER (ORDER BY date) - 1 AS vix_chg1d, {zed('vix_level', 20, 10, sd='stddev_samp')} AS vix_z20,
       CASE WHEN vix_level > ({roll('vix_level', 60, 20, 'quantile_cont($, 0.5)')}) THEN 1 ELSE 0 END AS vix_high_regime FROM (
       SELECT d.date, v.c AS vix_level, s1.r1 AS spx_ret1d_lag, s5.r5 AS spx_ret5d_lag, u.r1 AS usdinr_ret1d_lag, c1.r1 AS crude_ret1d_lag, c5.r5 AS crude_ret5d_lag
       FROM (SELECT DISTINCT date FROM bars) d ASOF LEFT JOIN vix v ON d.date >= v.date
       ASOF LEFT JOIN (SELECT * FROM spx WHERE r1 IS NOT NULL) s1 ON d.date > s1.date
       ASOF LEFT JOIN (SELECT * FROM spx WHERE r5 IS NOT NULL) s5 ON d.date > s5.date
       ASOF LEFT JOIN (SELECT * FROM usdinr WHERE r1 IS NOT NULL) u ON d.date > u.date
       ASOF LEFT JOIN (SELECT * FROM crude WHERE r1 IS NOT NULL) c1 ON d.date > c1.date
       ASOF LEFT JOIN (SELECT * FROM crude WHERE r5 IS NOT NULL) c5 ON d.date > c5.date)""",
    "bars", "vix", "spx", "usdinr", "crude",
)


def _macro(m):
    flows = stored(m.flows, "flows")

    def series(last, value):
        return flows.groupBy(_session(last).alias("date")).agg(F.max(value).alias("close"))

    vix = series(5, 10 + F.abs("fii_net") % 20)
    exprs = {"spx": F.col("fii_gross_buy"), "usdinr": F.col("dii_gross_buy"), "crude": F.col("fii_gross_buy") + F.col("dii_gross_buy")}
    foreign = {n: series(FOREIGN[n][1], 50 + e) for n, e in exprs.items()}
    return macro_features(m.ticks.select("date").distinct(), vix, foreign)


@query("macro_features", "date:d " + columns(MACRO_COLS, "f10").replace("z20:f10", "z20:f6"), "SELECT * FROM macro", ("macro",))
def macro_features_(m):
    return _macro(m)


@query(
    "macro_coverage",
    "column_name coverage:f8 enough",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) / count(*)::double AS coverage, count({c}) / count(*)::double >= 0.99 AS enough FROM macro" for c in MACRO_COLS),
    ("macro",),
)
def macro_coverage(m):
    return coverage(_macro(m), MACRO_COLS)


cte(
    "sidecar",
    f"""SELECT {_session_sql(5)} AS date, max(fii_net) AS fii_net_cr, max(dii_net) AS dii_net_cr, max(fii_gross_buy) AS nifty100_adv_cr, max(10 + abs(fii_net) % 20) AS india_vix,
       max(dii_gross_buy / nullif(fii_gross_buy, 0)) AS pcr_oi, max(fii_gross_buy + dii_gross_buy) AS total_oi, max(fii_net / nullif(dii_gross_buy, 0)) AS us_futures_pct_change_overnight,
       max(CASE WHEN day(date) = 15 THEN 1 END) AS earnings_event_flag FROM flows GROUP BY 1""",
    "flows",
)


def _sidecar(m):
    """One row per session; orders of a weekend count for the Monday after."""
    values = {
        "fii_net_cr": F.col("fii_net"),
        "dii_net_cr": F.col("dii_net"),
        "nifty100_adv_cr": F.col("fii_gross_buy"),
        "india_vix": 10 + F.abs("fii_net") % 20,
        "pcr_oi": ratio("dii_gross_buy", "fii_gross_buy"),  # null without purchases; the day stays
        "total_oi": F.col("fii_gross_buy") + F.col("dii_gross_buy"),
        "us_futures_pct_change_overnight": ratio("fii_net", "dii_gross_buy"),
        "earnings_event_flag": F.when(F.dayofmonth("date") == 15, 1),
    }
    return m.flows.groupBy(_session(5).alias("date")).agg(*[F.max(v).alias(k) for k, v in values.items()])


@query(
    "exogenous_features",
    KEY + "fii_dii_net_flow:f9 dii_net_flow:f9 fii_dii_net_flow_pct_adv:f8 india_vix_level:f9 india_vix_change_5d:f9 put_call_ratio:f9 oi_change_pct:f8 global_overnight_cue:f9 earnings_event_flag:f1 sector_momentum_5d:f9 sector_momentum_20d:f9",
    """SELECT b.symbol, b.date, s.*, lag("close") OVER w / lag("close", 6) OVER w - 1 AS sector_momentum_5d,
       lag("close") OVER w / lag("close", 21) OVER w - 1 AS sector_momentum_20d
       FROM bars b ASOF LEFT JOIN (SELECT date AS sdate,
         last_value(fii_net_cr IGNORE NULLS) OVER o AS fii_dii_net_flow, last_value(dii_net_cr IGNORE NULLS) OVER o AS dii_net_flow,
         last_value(pct IGNORE NULLS) OVER o AS fii_dii_net_flow_pct_adv, india_vix AS india_vix_level, last_value(ch5 IGNORE NULLS) OVER o AS india_vix_change_5d, last_value(pcr_oi IGNORE NULLS) OVER o AS put_call_ratio,
         last_value(oi IGNORE NULLS) OVER o AS oi_change_pct, last_value(us_futures_pct_change_overnight IGNORE NULLS) OVER o AS global_overnight_cue,
         coalesce(earnings_event_flag, 0) AS earnings_event_flag FROM (
         SELECT *, fii_net_cr / nullif(nifty100_adv_cr, 0) AS pct, india_vix - lag(india_vix, 5) OVER (ORDER BY date) AS ch5,
           total_oi / nullif(lag(total_oi) OVER (ORDER BY date), 0) - 1 AS oi FROM sidecar)
         WINDOW o AS (ORDER BY date)) s ON b.date >= s.sdate WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    ("bars", "sidecar"),
)
def exogenous(m):
    return exogenous_features(stored(m.bars, "bars"), _sidecar(m))


LAGS = {"fii_net_cr": 1, "dii_net_cr": 1, "pct": 1, "india_vix": 1, "ch5": 5, "pcr_oi": 1, "oi": 1, "us_futures_pct_change_overnight": 1}


@query(
    "exogenous_lookback",
    KEY + "fii_dii_net_flow:f9 fii_dii_net_flow_pct_adv:f8 india_vix_level:f9 india_vix_change_5d:f9 put_call_ratio:f9 oi_change_pct:f8 global_overnight_cue:f9 earnings_event_flag:f1",
    f"""SELECT b.symbol, b.date, s.* FROM bars b ASOF LEFT JOIN (SELECT date AS sdate,
         last_value(fii_net_cr IGNORE NULLS) OVER o AS fii_dii_net_flow, last_value(pct IGNORE NULLS) OVER o AS fii_dii_net_flow_pct_adv,
         last_value(india_vix IGNORE NULLS) OVER o AS india_vix_level, last_value(ch5 IGNORE NULLS) OVER o AS india_vix_change_5d, last_value(pcr_oi IGNORE NULLS) OVER o AS put_call_ratio,
         last_value(oi IGNORE NULLS) OVER o AS oi_change_pct, last_value(us_futures_pct_change_overnight IGNORE NULLS) OVER o AS global_overnight_cue,
         coalesce(earnings_event_flag, 0) AS earnings_event_flag FROM (
         SELECT date, earnings_event_flag, {", ".join(f"lag({c}, {k}) OVER (ORDER BY date) AS {c}" for c, k in LAGS.items())} FROM (
           SELECT *, fii_net_cr / nullif(nifty100_adv_cr, 0) AS pct, india_vix - lag(india_vix, 5) OVER (ORDER BY date) AS ch5,
             total_oi / nullif(lag(total_oi) OVER (ORDER BY date), 0) - 1 AS oi FROM sidecar))
         WINDOW o AS (ORDER BY date)) s ON b.date >= s.sdate""",
    ("bars", "sidecar"),
)
def exogenous_lookback(m):
    """Every daily feature shifted back by its declared lookback."""
    return exogenous_features(stored(m.bars, "bars"), _sidecar(m), apply_lookback=True)


@query(
    "external_join",
    KEY + "close:f9 fii_net:f9 pe_ratio:f6 close_intraday:f6",
    """SELECT b.symbol, b.date, b."close", f.fii_net, p.pe_ratio, p.roe AS close_intraday FROM bars b
       ASOF LEFT JOIN flows f ON b.date >= f.date ASOF LEFT JOIN fundamentals p ON b.symbol = p.symbol AND b.date >= p.date""",
    ("bars", "flows", "fundamentals"),
)
def external_join(m):
    reports = stored(m.fundamentals, "reports")
    own = reports.select("symbol", "date", "pe_ratio")
    clash = reports.select("symbol", "date", F.col("roe").alias("close"))
    sources = {"flows": m.flows.select("date", "fii_net"), "fundamentals": own, "options": None, "intraday": clash}
    return join_sources(stored(m.bars, "bars"), sources)


@query(
    "merge_sources",
    KEY + "close:f9 pe_ratio:f6 surprise_pct:f6 close_b:f6",
    """SELECT b.symbol, b.date, b."close", f.pe_ratio, e.surprise_pct, f.roe AS close_b FROM bars b
       LEFT JOIN fundamentals f USING (symbol, date) LEFT JOIN earnings e USING (symbol, date)""",
    ("bars", "fundamentals", "earnings"),
)
def merge_sources_(m):
    return merge_sources(
        m.bars,
        {
            "a": m.earnings.select("symbol", "date", "surprise_pct"),
            "b": m.fundamentals.select("symbol", "date", "pe_ratio", F.col("roe").alias("close")),
            "c": None,
        },
        ["symbol", "date"],
    )


PAIR_COLS = ["fii_net", "dii_net", "planted", "fii_gross_buy"]


@query(
    "lookahead_pairs",
    "feature other n_pairs:i max_gap:f6 is_leak",
    "WITH p AS (SELECT *, lead(dii_net) OVER (ORDER BY date) AS planted FROM flows), n AS (SELECT *, "
    + ", ".join(f"lead({c}) OVER (ORDER BY date) AS n_{c}" for c in PAIR_COLS)
    + " FROM p) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature, '{b}' AS other, count(abs({a} - n_{b})) AS n_pairs, max(abs({a} - n_{b})) AS max_gap, "
        f"max(abs({a} - n_{b})) < 1e-6 * greatest(min_by(abs({a}), date), 1e-9) AS is_leak FROM n"
        for a in PAIR_COLS
        for b in PAIR_COLS
        if a != b
    ),
    ("flows",),
)
def lookahead_pairs(m):
    planted = m.flows.withColumn("planted", F.lead("dii_net").over(by_date())).withColumn("symbol", F.lit("ALL"))
    return shifted_pairs(planted, PAIR_COLS)


# --- options ---------------------------------------------------------------

cte("tagged", "SELECT *, dense_rank() OVER (PARTITION BY symbol, date ORDER BY expiry) AS e FROM chain", "chain")


def pain_sql(per_strike: bool) -> str:
    if per_strike:
        call, put = "sum(open_interest * (k - strike)) FILTER (option_type = 'CE' AND strike <= k)", "sum(open_interest * (strike - k)) FILTER (option_type = 'PE' AND strike >= k)"
    else:
        call = "sum(open_interest) FILTER (option_type = 'CE' AND strike <= k) * sum(k - strike) FILTER (option_type = 'CE' AND strike <= k)"
        put = "sum(open_interest) FILTER (option_type = 'PE' AND strike >= k) * sum(strike - k) FILTER (option_type = 'PE' AND strike >= k)"
    return f"""SELECT symbol, date, min_by(k, pain * 1000 + k) AS max_pain, min(pain) AS min_pain FROM (
      SELECT a.symbol, a.date, k, coalesce({call}, 0) + coalesce({put}, 0) AS pain
      FROM (SELECT DISTINCT symbol, date, strike AS k FROM chain) a LEFT JOIN (SELECT * FROM tagged WHERE e = 1) t USING (symbol, date)
      GROUP BY 1, 2, 3) GROUP BY 1, 2"""


cte("pain", pain_sql(False), "chain", "tagged")
cte("pain2", pain_sql(True), "chain", "tagged")


@query("max_pain", KEY + "max_pain:f2 min_pain:f4", "SELECT * FROM pain", ("pain",))
def max_pain_(m):
    return max_pain(m.option_chain)


@query("max_pain_per_strike", KEY + "max_pain:f2 min_pain:f4", "SELECT * FROM pain2", ("pain2",))
def max_pain_per_strike(m):
    return max_pain(m.option_chain, "per_strike")


OPTION_COLS = ["atm_iv", "pcr_oi", "pcr_volume", "max_pain", "max_pain_distance", "atm_straddle_price", "iv_term_structure", "near_expiry_days", "total_call_oi", "total_put_oi", "total_call_volume", "total_put_volume"]
OPTION_ROLLING = ["iv_percentile_20d", "iv_percentile_60d", "iv_zscore_20d", "pcr_oi_5d_ma", "pcr_oi_momentum", "max_pain_dist_5d_ma", "straddle_return_1d"]
cte(
    "optday",
    """SELECT o.symbol, o.date, (civ + piv) / 2 AS atm_iv, poi / nullif(coi, 0) AS pcr_oi, pv / nullif(cv, 0) AS pcr_volume, max_pain, (max_pain - 102) / 102 AS max_pain_distance,
       coalesce(cpx, 0) + coalesce(ppx, 0) AS atm_straddle_price, niv - fiv AS iv_term_structure, near - o.date AS near_expiry_days,
       coi AS total_call_oi, poi AS total_put_oi, cv AS total_call_volume, pv AS total_put_volume FROM (
       SELECT symbol, date, max(e) AS ne, min(expiry) FILTER (e = 1) AS near,
         sum(open_interest) FILTER (e = 1 AND option_type = 'CE') AS coi, sum(open_interest) FILTER (e = 1 AND option_type = 'PE') AS poi,
         sum(volume) FILTER (e = 1 AND option_type = 'CE') AS cv, sum(volume) FILTER (e = 1 AND option_type = 'PE') AS pv,
         max(iv) FILTER (e = 1 AND option_type = 'CE' AND strike = atm) AS civ, max(iv) FILTER (e = 1 AND option_type = 'PE' AND strike = atm) AS piv,
         max(last_price) FILTER (e = 1 AND option_type = 'CE' AND strike = atm) AS cpx, max(last_price) FILTER (e = 1 AND option_type = 'PE' AND strike = atm) AS ppx,
         avg(iv) FILTER (e = 1 AND strike = atm) AS niv, avg(iv) FILTER (e = 2 AND strike = atm) AS fiv
       FROM tagged LEFT JOIN (SELECT symbol, date, min_by(strike, abs(strike - spot_price) * 100000 + strike) AS atm FROM tagged
         WHERE e = 1 AND option_type = 'CE' GROUP BY 1, 2) USING (symbol, date) GROUP BY 1, 2) o JOIN pain p ON p.symbol = o.symbol AND p.date = o.date
       WHERE ne >= 2 AND coi IS NOT NULL AND poi IS NOT NULL""",
    "tagged", "pain",
)


@query("option_features", KEY + columns(OPTION_COLS, "f9"), "SELECT * FROM optday", ("optday",))
def option_features_(m):
    return option_features(stored(m.option_chain, "chain"))


@query(
    "option_rolling",
    KEY + columns(OPTION_ROLLING, "f6"),
    f"""SELECT symbol, date, {rank_sql('atm_iv', 20, 10)} AS iv_percentile_20d, {rank_sql('atm_iv', 60, 20)} AS iv_percentile_60d,
        {zed('atm_iv', 20, 10, 'symbol')} AS iv_zscore_20d, {roll('pcr_oi', 5, by='symbol')} AS pcr_oi_5d_ma, {diff('pcr_oi', 5, 'symbol')} AS pcr_oi_momentum,
        {roll('max_pain_distance', 5, by='symbol')} AS max_pain_dist_5d_ma,
        atm_straddle_price / nullif(lag(atm_straddle_price) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS straddle_return_1d FROM optday""",
    ("optday",),
)
def option_rolling_(m):
    return option_rolling(option_features(stored(m.option_chain, "chain")))


# --- intraday --------------------------------------------------------------

INTRADAY_COLS = [
    "vwap", "vwap_deviation", "intraday_range", "realized_volatility", "parkinson_volatility", "first_hour_return", "last_hour_return",
    "am_pm_volume_ratio", "volume_weighted_momentum", "order_flow_imbalance", "roll_spread", "kyle_lambda", "amihud_illiquidity",
    "morning_volatility", "afternoon_volatility", "vol_ratio_morning_afternoon", "close_to_close_return", "open_to_close_return",
    "total_volume", "num_trades",
]
cte(
    "sess",
    """SELECT *, ln("close" / pc) AS r, "close" - pc AS d, "close" / pc - 1 AS pct, lag(ln("close" / pc)) OVER w AS r0 FROM (
       SELECT *, cast(ts AS date) AS date, hour(ts) AS h, lag("close") OVER (PARTITION BY symbol, cast(ts AS date) ORDER BY ts) AS pc
       FROM candles_5m WHERE cast(ts AS time) BETWEEN TIME '09:15:00' AND TIME '15:30:00') WINDOW w AS (PARTITION BY symbol, date ORDER BY ts)""",
    "candles_5m",
)
cte("hourly", "SELECT symbol, date, avg(sd) FILTER (h BETWEEN 9 AND 11) AS am, avg(sd) FILTER (h BETWEEN 13 AND 15) AS pm FROM (SELECT symbol, date, h, stddev_samp(pct) AS sd FROM sess GROUP BY 1, 2, 3) GROUP BY 1, 2", "sess")


def _stretch(cond: str) -> str:
    a, b = f'min_by(open, ts) FILTER ({cond})', f'max_by("close", ts) FILTER ({cond})'
    return f"CASE WHEN count(*) FILTER ({cond}) > 1 THEN ({b} - {a}) / {a} END"


cte(
    "intra",
    f"""SELECT symbol, date, vwap, (cl - vwap) / vwap AS vwap_deviation, (hi - lo) / cl AS intraday_range, sqrt(r2) * sqrt(252 * 78) AS realized_volatility,
       sqrt(hl2 / (4 * ln(2) * n)) * sqrt(252 * 78) AS parkinson_volatility, first_hour_return, last_hour_return, amv / nullif(pmv, 0) AS am_pm_volume_ratio,
       CASE WHEN lv > 0 THEN dv / lv ELSE dm END / cl AS volume_weighted_momentum, (uv - dnv) / nullif(uv + dnv, 0) AS order_flow_imbalance,
       CASE WHEN n > 11 AND cr < 0 THEN 2 * sqrt(-cr) END AS roll_spread, CASE WHEN n > 10 THEN ck / nullif(vk, 0) END AS kyle_lambda,
       abs((cl - op) / op) / vol AS amihud_illiquidity, am AS morning_volatility, pm AS afternoon_volatility, am / nullif(pm, 0) AS vol_ratio_morning_afternoon,
       (cl - op) / op AS close_to_close_return, (cl - op) / op AS open_to_close_return, vol AS total_volume, n AS num_trades FROM (
       SELECT symbol, date, count(*) AS n, sum(volume) AS vol, sum((high + low + "close") / 3 * volume) / sum(volume) AS vwap, min_by(open, ts) AS op,
         max_by("close", ts) AS cl, max(high) AS hi, min(low) AS lo, sum(r * r) AS r2, sum(ln(high / low) * ln(high / low)) AS hl2,
         {_stretch("cast(ts AS time) <= TIME '10:15:00'")} AS first_hour_return, {_stretch("cast(ts AS time) >= TIME '14:30:00'")} AS last_hour_return,
         coalesce(sum(volume) FILTER (h < 12), 0) AS amv, coalesce(sum(volume) FILTER (h >= 12), 0) AS pmv, sum(volume) FILTER (pc IS NOT NULL) AS lv,
         sum(d * volume) AS dv, avg(d) AS dm, coalesce(sum(volume) FILTER (d > 0), 0) AS uv, coalesce(sum(volume) FILTER (d < 0), 0) AS dnv,
         covar_samp(r0, r) AS cr, covar_samp(r, volume * sign(d)) AS ck, var_pop(volume * sign(d)) AS vk FROM sess GROUP BY 1, 2)
       JOIN hourly USING (symbol, date) WHERE n >= 10""",
    "sess", "hourly",
)


@query("intraday_features", KEY + columns(INTRADAY_COLS, "f7"), "SELECT * FROM intra", ("intra",))
def intraday(m):
    return intraday_features(m.candles_5m)


INTRADAY_ROLL = [f"{x}_{k}" for x in ROLLED for k in ("5d_ma", "20d_ma", "zscore_20d")] + ["realized_vol_regime", "ofi_regime"]


@query(
    "intraday_rolling",
    KEY + columns(INTRADAY_ROLL, "f6"),
    "SELECT symbol, date, "
    + ", ".join(f"{roll(x, 5, by='symbol')} AS {x}_5d_ma, {roll(x, 20, by='symbol')} AS {x}_20d_ma, {zed(x, 20, 10, 'symbol')} AS {x}_zscore_20d" for x in ROLLED)
    + f", realized_volatility / ({roll('realized_volatility', 60, 20, by='symbol')}) AS realized_vol_regime, order_flow_imbalance / nullif({roll('order_flow_imbalance', 20, 10, 'stddev_pop', 'symbol')}, 0) AS ofi_regime FROM intra",
    ("intra",),
)
def intraday_roll(m):
    return intraday_rolling(intraday_features(m.candles_5m))


# --- news and text ---------------------------------------------------------


def _scored(m):
    return N.score_articles(m.news, scorer=lambda t: sentiment(t, [POS], [NEG])).drop("text")


@query("lexicon_sentiment", "doc_id:i date:d symbol sentiment:f8", "SELECT * FROM news", ("news",))
def lexicon_sentiment(m):
    return _scored(m)


DAILY_NEWS = ["sentiment_mean", "sentiment_median", "sentiment_std", "article_count", "positive_count", "negative_count", "positive_ratio", "negative_ratio", "neutral_ratio"]
NEWS_ROLL = ["sentiment_5d_ma", "sentiment_20d_ma", "article_count_5d_ma", "article_count_20d_ma", "news_volume_zscore_20d", "positive_ratio_5d_ma", "negative_ratio_5d_ma", "sentiment_momentum_5d", "sentiment_momentum_20d", "sentiment_zscore_20d", "sentiment_zscore_60d"]
cte(
    "dnews",
    """SELECT *, positive_count / article_count::double AS positive_ratio, negative_count / article_count::double AS negative_ratio,
       1 - positive_count / article_count::double - negative_count / article_count::double AS neutral_ratio FROM (
       SELECT symbol, date, avg(sentiment) AS sentiment_mean, median(sentiment) AS sentiment_median, stddev_samp(sentiment) AS sentiment_std, count(*) AS article_count,
       count(*) FILTER (sentiment > 0.1) AS positive_count, count(*) FILTER (sentiment < -0.1) AS negative_count FROM news GROUP BY 1, 2)""",
    "news",
)


@query(
    "daily_sentiment",
    KEY + columns(DAILY_NEWS + NEWS_ROLL, "f6"),
    f"""SELECT *, {roll('sentiment_mean', 5, 3, by='symbol')} AS sentiment_5d_ma, {roll('sentiment_mean', 20, 10, by='symbol')} AS sentiment_20d_ma,
       {roll('article_count', 5, 3, by='symbol')} AS article_count_5d_ma, {roll('article_count', 20, 10, by='symbol')} AS article_count_20d_ma,
       {zed('article_count', 20, 10, 'symbol')} AS news_volume_zscore_20d, {roll('positive_ratio', 5, 3, by='symbol')} AS positive_ratio_5d_ma,
       {roll('negative_ratio', 5, 3, by='symbol')} AS negative_ratio_5d_ma, {diff('sentiment_mean', 5, 'symbol')} AS sentiment_momentum_5d,
       {diff('sentiment_mean', 20, 'symbol')} AS sentiment_momentum_20d, {zed('sentiment_mean', 20, 10, 'symbol')} AS sentiment_zscore_20d,
       {zed('sentiment_mean', 60, 30, 'symbol')} AS sentiment_zscore_60d FROM dnews""",
    ("dnews",),
)
def daily_sentiment(m):
    return N.daily_sentiment(_scored(m))


@query(
    "sector_sentiment",
    "sector date:d " + columns(["sector_sentiment_mean", "sector_sentiment_median", "sector_article_count", "sector_positive_ratio", "sector_negative_ratio", "unique_symbols", "sector_sentiment_5d_ma", "sector_sentiment_20d_ma", "sector_news_volume_zscore"], "f6"),
    f"""SELECT *, {roll('sector_sentiment_mean', 5, 3, by='sector')} AS sector_sentiment_5d_ma, {roll('sector_sentiment_mean', 20, 10, by='sector')} AS sector_sentiment_20d_ma,
       {zed('sector_article_count', 20, 10, 'sector')} AS sector_news_volume_zscore FROM (
       SELECT sector, date, avg(sentiment) AS sector_sentiment_mean, median(sentiment) AS sector_sentiment_median, count(*) AS sector_article_count,
       avg((sentiment > 0.1)::int) AS sector_positive_ratio, avg((sentiment < -0.1)::int) AS sector_negative_ratio, count(DISTINCT symbol) AS unique_symbols FROM news GROUP BY 1, 2)""",
    ("news",),
)
def sector_sentiment(m):
    return N.sector_sentiment(_scored(m))


@query(
    "market_sentiment",
    "date:d " + columns(["market_sentiment_mean", "market_sentiment_median", "market_article_count", "market_positive_ratio", "market_negative_ratio", "unique_symbols", "market_breadth_positive", "symbols_with_news", "market_sentiment_5d_ma", "market_sentiment_20d_ma", "market_breadth_5d_ma", "market_sentiment_zscore_20d", "market_sentiment_zscore_60d"], "f6"),
    f"""SELECT *, {roll('market_sentiment_mean', 5, 3)} AS market_sentiment_5d_ma, {roll('market_sentiment_mean', 20, 10)} AS market_sentiment_20d_ma,
       {roll('market_breadth_positive', 5, 3)} AS market_breadth_5d_ma, {zed('market_sentiment_mean', 20, 10)} AS market_sentiment_zscore_20d,
       {zed('market_sentiment_mean', 60, 30)} AS market_sentiment_zscore_60d FROM (
       SELECT date, avg(sentiment) AS market_sentiment_mean, median(sentiment) AS market_sentiment_median, count(*) AS market_article_count,
       avg((sentiment > 0.1)::int) AS market_positive_ratio, avg((sentiment < -0.1)::int) AS market_negative_ratio, count(DISTINCT symbol) AS unique_symbols FROM news GROUP BY 1)
       JOIN (SELECT date, avg((s > 0.1)::int) AS market_breadth_positive, count(*) AS symbols_with_news FROM (
       SELECT date, symbol, avg(sentiment) AS s FROM news GROUP BY 1, 2) GROUP BY 1) USING (date)""",
    ("news",),
)
def market_sentiment(m):
    return N.market_sentiment(stored(_scored(m), "scored"))


@query(
    "keyword_sector",
    "doc_id:i keyword_sector",
    "SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{k}') THEN '{v}'" for k, v in SECTOR_KEYWORDS) + " END AS keyword_sector FROM documents",
)
def keyword_sector(m):
    return m.news.select("doc_id", sector_of("text").alias("keyword_sector"))


@query(
    "announcement_flags",
    "doc_id:i " + columns(list(ANNOUNCEMENT_PATTERNS), "s"),
    "SELECT doc_id, " + ", ".join(f"regexp_matches(lower(text), '{p}') AS {n}" for n, p in ANNOUNCEMENT_PATTERNS.items()) + " FROM documents",
)
def announcement(m):
    return m.news.select("doc_id", *[c.alias(n) for n, c in announcement_flags("text").items()])


@query(
    "symbol_mentions",
    "doc_id:i listed",
    """SELECT DISTINCT doc_id, listed FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(upper(text), '[\\p{L}\\p{N}_]+'))) AS w FROM documents)
       JOIN (SELECT DISTINCT upper(split_part(p_name, ' ', 1)) AS listed FROM part UNION SELECT upper(p_brand) FROM part
             UNION SELECT unnest(['THE', 'WITH', 'LES', 'QUE', 'UND', 'DER', 'EL', 'POUR'])) ON w = listed""",
)
def symbol_mentions(m):
    part = m.table("part")
    named = part.select(F.upper(F.split("p_name", " ")[0]).alias("listed")).union(part.select(F.upper("p_brand")))
    words = m.spark.createDataFrame([(w,) for w in "THE WITH LES QUE UND DER EL POUR".split()], "listed string")
    return mentions(m.news.select("doc_id", "text"), named.union(words), key="listed")


# --- earnings, estimates, fundamentals -------------------------------------

EARN = ["days_to_earnings", "days_since_earnings", "last_earnings_surprise", "last_revenue_surprise", "post_earnings_return", "next_estimated_eps", "earnings_surprise_trend", "earnings_surprise_consistency", "earnings_announcement_week", "post_earnings_week", "surprise_4q_avg", "surprise_4q_std", "earnings_season"]


@query(
    "earnings_features",
    KEY + columns(EARN, "f6"),
    f"""SELECT *, CASE WHEN days_to_earnings BETWEEN 0 AND 5 THEN 1 ELSE 0 END AS earnings_announcement_week, CASE WHEN days_since_earnings BETWEEN 0 AND 5 THEN 1 ELSE 0 END AS post_earnings_week,
       {roll('last_earnings_surprise', 4, 1, by='symbol')} AS surprise_4q_avg, {roll('last_earnings_surprise', 4, 2, 'stddev_pop', 'symbol')} AS surprise_4q_std,
       CASE WHEN month(date) IN (1, 4, 7, 10) THEN 1 ELSE 0 END AS earnings_season FROM (
       SELECT b.symbol, b.date, n.date - b.date AS days_to_earnings, b.date - p.date AS days_since_earnings, p.surprise_pct AS last_earnings_surprise, p.revenue_surprise_pct AS last_revenue_surprise,
       (b."close" - p.c) / p.c AS post_earnings_return, n.estimated_eps AS next_estimated_eps, CASE WHEN p.k >= 2 THEN p.trend END AS earnings_surprise_trend, CASE WHEN p.k >= 2 THEN p.cons END AS earnings_surprise_consistency
       FROM bars b SEMI JOIN earnings z ON z.symbol = b.symbol
       ASOF LEFT JOIN (SELECT e.*, x."close" AS c, avg(st) OVER (PARTITION BY e.symbol ORDER BY e.date ROWS 2 PRECEDING) AS trend, count(*) OVER q AS k, avg((surprise_pct > 0)::int) OVER q AS cons
         FROM (SELECT *, surprise_pct - lag(surprise_pct) OVER (PARTITION BY symbol ORDER BY date) AS st FROM earnings) e LEFT JOIN bars x ON x.symbol = e.symbol AND x.date = e.date
         WINDOW q AS (PARTITION BY e.symbol ORDER BY e.date ROWS 3 PRECEDING)) p ON p.symbol = b.symbol AND b.date >= p.date
       ASOF LEFT JOIN earnings n ON n.symbol = b.symbol AND b.date < n.date)""",
    ("bars", "earnings"),
)
def earnings(m):
    return FU.earnings_features(stored(m.bars.select("symbol", "date", "close"), "bars"), stored(m.earnings, "events"))


@query(
    "estimate_revisions",
    KEY + columns(["eps_estimate", "eps_high", "eps_low", "eps_dispersion", "eps_revision_1m", "eps_revision_3m", "num_analysts", "target_price", "eps_revision_1m_ma", "target_price_vs_current"], "f6"),
    f"""SELECT *, {roll('eps_revision_1m', 5, 3, by='symbol')} AS eps_revision_1m_ma FROM (
       SELECT l.symbol, l.date, any_value(l.mean_estimate) AS eps_estimate, any_value(l.high_estimate) AS eps_high, any_value(l.low_estimate) AS eps_low,
       any_value((l.high_estimate - l.low_estimate) / abs(l.mean_estimate)) AS eps_dispersion, any_value(l.num_analysts) AS num_analysts, any_value(l.target_price_mean) AS target_price,
       any_value((l.target_price_mean - l."close") / l."close") AS target_price_vs_current,
       CASE WHEN count(e.date) FILTER (e.date >= l.date - 30) >= 2 THEN (max_by(e.mean_estimate, e.date) FILTER (e.date >= l.date - 30) - min_by(e.mean_estimate, e.date) FILTER (e.date >= l.date - 30))
         / abs(min_by(e.mean_estimate, e.date) FILTER (e.date >= l.date - 30)) END AS eps_revision_1m,
       CASE WHEN count(e.date) >= 2 THEN (max_by(e.mean_estimate, e.date) - min_by(e.mean_estimate, e.date)) / abs(min_by(e.mean_estimate, e.date)) END AS eps_revision_3m
       FROM (SELECT b.symbol, b.date, b."close", s.* EXCLUDE (symbol, date) FROM bars b ASOF JOIN estimates s ON s.symbol = b.symbol AND b.date >= s.date) l
       LEFT JOIN estimates e ON e.symbol = l.symbol AND e.date <= l.date AND e.date >= l.date - 90 GROUP BY l.symbol, l.date)""",
    ("bars", "estimates"),
)
def estimates(m):
    return FU.estimate_features(m.bars, stored(m.estimates, "estimates"))


FUND = ["pe_ratio", "roe", "roa", "current_ratio", "earnings_yield", "f_score_proxy"]
cte(
    "fundday",
    """SELECT b.symbol, b.date, f.pe_ratio, f.roe, f.roa, f.current_ratio, CASE WHEN f.pe_ratio > 0 THEN 1 / f.pe_ratio END AS earnings_yield,
       coalesce((f.roe > 0)::int, 0) + coalesce((f.roa > 0)::int, 0) + coalesce((f.current_ratio > 1)::int, 0) AS f_score_proxy
       FROM bars b SEMI JOIN fundamentals z ON z.symbol = b.symbol ASOF LEFT JOIN fundamentals f ON f.symbol = b.symbol AND b.date >= f.date""",
    "bars", "fundamentals",
)


def prank(x: str, by: str = "date") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2E0) / count({x}) OVER (PARTITION BY {by}) END"


@query("fundamental_features", KEY + columns(FUND, "f6"), "SELECT * FROM fundday", ("fundday",))
def fundamentals(m):
    return FU.fundamental_features(m.bars, stored(m.fundamentals, "reports"))


@query(
    "fundamental_ranks",
    KEY + "pe_ratio_rank:f8 earnings_yield_rank:f8 roe_rank:f8",
    f"SELECT symbol, date, {prank('pe_ratio')} AS pe_ratio_rank, {prank('earnings_yield')} AS earnings_yield_rank, {prank('roe')} AS roe_rank FROM fundday",
    ("fundday",),
)
def fundamental_ranks(m):
    daily = FU.fundamental_features(m.bars, stored(m.fundamentals, "reports")).select("symbol", "date", "pe_ratio", "earnings_yield", "roe")
    return FU.fundamental_ranks(stored(daily, "daily"), ["pe_ratio", "earnings_yield", "roe"])
