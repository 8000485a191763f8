"""SQL of the derived market tables, shared by the oracle queries."""

from __future__ import annotations

from .base import cte

cte(
    "ticks",
    """SELECT cast(s_nationkey AS varchar) AS symbol, cast(l_shipdate AS date) AS date,
       100.0E0 + l_extendedprice / 10000.0E0 AS px, l_quantity AS qty,
       row_number() OVER (PARTITION BY s_nationkey, cast(l_shipdate AS date)
         ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS seq
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
)
cte(
    "bars",
    """SELECT symbol, date, min_by(px, seq) AS open, max(px) AS high, min(px) AS low,
       max_by(px, seq) AS "close", sum(qty) AS volume FROM ticks GROUP BY symbol, date""",
    "ticks",
)
cte(
    "sectors",
    """SELECT cast(n_nationkey AS varchar) AS symbol, r_name AS sector
       FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
PROB = "cast((volume * 7919 + day(date) * 104729) % 1000 AS double) / 1000.0E0"
PROB_EXT = "cast((volume * 104729 + day(date) * 7919) % 1000 AS double) / 1000.0E0"
cte("signal", f"SELECT *, {PROB} AS prob FROM bars", "bars")
cte(
    "preds",
    f"""SELECT *, cast(next_ret > 0 AS int) AS actual, cast(prob >= 0.5 AS int) AS pred FROM (
       SELECT symbol, date, "close", volume,
         lead("close") OVER w / "close" - 1.0E0 AS next_ret,
         lead("close", 5) OVER w / "close" - 1.0E0 AS ret_5d_fwd,
         {PROB} AS prob, {PROB_EXT} AS prob_ext
       FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE next_ret IS NOT NULL""",
    "bars",
)
cte("days", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS day_no FROM (SELECT DISTINCT date FROM preds)", "preds")
cte(
    "flows",
    """SELECT cast(o_orderdate AS date) AS date,
       sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice ELSE -o_totalprice END) / 1e5 AS fii_net,
       sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END) / 1e5 AS dii_net,
       sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice ELSE 0E0 END) / 1e5 AS fii_gross_buy,
       sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0E0 END) / 1e5 AS dii_gross_buy
       FROM orders GROUP BY 1""",
)
cte(
    "candles_5m",
    """SELECT event_type AS symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS ts,
       min_by(px, event_id) AS open, max(px) AS high, min(px) AS low, max_by(px, event_id) AS "close", sum(v) AS volume
       FROM (SELECT *, 100.0E0 + value / 10.0E0 AS px, cast(1 + event_id % 100 AS double) AS v FROM events)
       GROUP BY 1, 2""",
)
cte(
    "delivery",
    """SELECT *, round(delivery_qty / volume * 100.0E0, 6) AS delivery_pct FROM (
       SELECT *, volume * (0.2E0 + 0.6E0 * ((day(date) * 37 + month(date) * 11) % 100) / 100.0E0) AS delivery_qty FROM bars)""",
    "bars",
)
cte(
    "custorders",
    """SELECT cast(c_nationkey AS varchar) AS symbol, cast(o_orderdate AS date) AS date, o_totalprice, c_acctbal
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
cte(
    "earnings",
    """SELECT symbol, date, estimated_eps, n % 7 - 3 + 0.5E0 AS surprise_pct, (n % 7 - 3 + 0.5E0) / 2E0 AS revenue_surprise_pct
       FROM (SELECT symbol, cast(date_trunc('quarter', date) AS date) + 14 AS date, max(o_totalprice) / 1000E0 AS estimated_eps, count(*) AS n
             FROM custorders GROUP BY 1, 2)""",
    "custorders",
)
cte(
    "estimates",
    """SELECT symbol, cast(date_trunc('month', date) AS date) + (4 + 10 * least((day(date) - 1) // 10, 2))::integer AS date, max(o_totalprice) / 1000E0 AS high_estimate, min(o_totalprice) / 1000E0 AS low_estimate,
       max(o_totalprice) / 2000E0 + min(o_totalprice) / 2000E0 AS mean_estimate, count(*) AS num_analysts,
       max(c_acctbal) / 100E0 AS target_price_mean
       FROM custorders GROUP BY 1, 2""",
    "custorders",
)
cte(
    "fundamentals",
    """SELECT symbol, cast(date_trunc('month', date) AS date) + 9 AS date, max(o_totalprice) / 1e4 AS pe_ratio, max(c_acctbal) / 1e3 AS roe, min(c_acctbal) / 1e3 AS roa,
       count(*) * 0.5E0 AS current_ratio FROM custorders GROUP BY 1, 2""",
    "custorders",
)
cte(
    "chain",
    """SELECT r_name AS symbol, cast(date_trunc('month', l_shipdate) AS date) AS date,
       cast(date_trunc('month', l_shipdate) + to_months(cast(l_linenumber % 2 + 1 AS int)) AS date) AS expiry,
       cast(90 + 5 * (cast(l_quantity AS int) % 6) AS double) AS strike,
       CASE WHEN l_returnflag = 'A' THEN 'CE' ELSE 'PE' END AS option_type,
       sum(l_quantity) AS open_interest, cast(sum(cast(l_quantity AS int) % 10) AS double) AS volume,
       avg(10.0E0 + l_discount * 100.0E0) AS iv, avg(l_extendedprice / 1e4) AS last_price, 102.0E0 AS spot_price
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4, 5""",
)
POS, NEG = ["the", "for", "with", "les"], ["was", "are", "from", "des"]


def _count(words: list[str]) -> str:
    return "len(list_intersect(w, [" + ", ".join(f"'{x}'" for x in words) + "]))"


cte(
    "news",
    f"""SELECT doc_id, date, symbol, sector,
       CASE WHEN p + n = 0 THEN 0E0 ELSE (p - n)::double / (p + n)::double END AS sentiment FROM (
       SELECT *, {_count(POS)} AS p, {_count(NEG)} AS n FROM (
       SELECT doc_id, date '2024-01-01' + cast(doc_id % 60 AS int) AS date, source AS symbol, lang AS sector,
       list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents))""",
)

# --- indicators: the smoothed series by their literal recursion --------------

cte(
    "rows",
    """SELECT *, row_number() OVER w AS rn, lag("close") OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl
       FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "bars",
)
cte(
    "moves",
    """SELECT *, greatest("close" - pc, 0E0) AS gain, greatest(pc - "close", 0E0) AS loss,
       CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
       CASE WHEN greatest(high - ph, 0E0) < greatest(pl - low, 0E0) THEN 0E0 ELSE greatest(high - ph, 0E0) END AS up,
       CASE WHEN greatest(pl - low, 0E0) < greatest(high - ph, 0E0) THEN 0E0 ELSE greatest(pl - low, 0E0) END AS down
       FROM rows""",
    "rows",
)
cte(
    "ew",
    """SELECT symbol, rn, "close" AS e12, "close" AS e26, "close" AS e20, "close" AS e50, "close" AS e200, 0E0 AS sig,
         cast(NULL AS double) AS ag, cast(NULL AS double) AS al, tr AS atr, cast(NULL AS double) AS su, cast(NULL AS double) AS sd
       FROM moves WHERE rn = 1
       UNION ALL
       SELECT m.symbol, m.rn, e12 + (m."close" - e12) * 2 / 13E0, e26 + (m."close" - e26) * 2 / 27E0,
         e20 + (m."close" - e20) * 2 / 21E0, e50 + (m."close" - e50) * 2 / 51E0, e200 + (m."close" - e200) * 2 / 201E0,
         sig + ((e12 + (m."close" - e12) * 2 / 13E0) - (e26 + (m."close" - e26) * 2 / 27E0) - sig) * 0.2E0,
         CASE WHEN m.rn = 2 THEN gain ELSE ag + (gain - ag) / 14E0 END, CASE WHEN m.rn = 2 THEN loss ELSE al + (loss - al) / 14E0 END,
         e.atr + (m.tr - e.atr) / 14E0,
         CASE WHEN m.rn = 2 THEN up ELSE su + (up - su) / 14E0 END, CASE WHEN m.rn = 2 THEN down ELSE sd + (down - sd) / 14E0 END
       FROM ew e JOIN moves m ON m.symbol = e.symbol AND m.rn = e.rn + 1""",
    "moves",
    recursive=True,
)
cte(
    "di",
    """SELECT m.*, e12, e26, e20, e50, e200, sig, ag, al, CASE WHEN m.rn >= 14 THEN atr END AS atr,
       CASE WHEN m.rn >= 15 THEN 100 * su / nullif(atr, 0) END AS plus_di,
       CASE WHEN m.rn >= 15 THEN 100 * sd / nullif(atr, 0) END AS minus_di
       FROM moves m JOIN ew USING (symbol, rn)""",
    "moves",
    "ew",
)
cte("dx", "SELECT symbol, rn, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM di WHERE rn >= 15", "di")
cte(
    "adxs",
    """SELECT symbol, rn, dx AS a FROM dx WHERE rn = 15
       UNION ALL SELECT d.symbol, d.rn, a + (d.dx - a) / 14E0 FROM adxs x JOIN dx d ON d.symbol = x.symbol AND d.rn = x.rn + 1""",
    "dx",
    recursive=True,
)


def avg_n(x: str, n: int, at_least: int | None = None, fn: str = "avg") -> str:
    frame = f"(PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) OVER {frame} >= {at_least or n} THEN {fn}({x}) OVER {frame} END"


def _family_sql() -> str:
    r = {d: f'"close" / lag("close", {d}) OVER w - 1' for d in (1, 2, 3, 5, 10, 20)}
    one = ", ".join(f"{x} AS ret_{d}d" for d, x in r.items())
    logs = ", ".join(f'ln("close" / lag("close", {d}) OVER w) AS log_ret_{d}d' for d in r)
    c, v = '"close"', "volume"
    smas = ", ".join(f"{avg_n(c, n)} AS sma_{n}" for n in (5, 10, 20, 50, 200))
    vols = ", ".join(f"{avg_n(v, n)} AS avg_volume_{n}d" for n in (5, 10, 20))
    return f"""SELECT *, {one}, {logs}, {smas}, {vols},
       (high - low) / "close" AS hl_range, ("close" - open) / open AS co_return, (open - pc) / pc AS gap_return,
       {avg_n('low', 14, fn='min')} AS l14, {avg_n('high', 14, fn='max')} AS h14,
       {avg_n(c, 20, fn='stddev_pop')} AS sd20,
       (volume - lag(volume) OVER w) / abs(lag(volume) OVER w) AS volume_pct_change,
       coalesce(sign("close" - pc), 0) * volume AS sv,
       {avg_n(c, 252, fn='max')} AS top, {avg_n(c, 252, fn='min')} AS floor_,
       (e12 - e26) AS line
       FROM di WINDOW w AS (PARTITION BY symbol ORDER BY date)"""


cte("feat0", _family_sql(), "di")


def _flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1E0 ELSE 0E0 END"


def _second_sql() -> str:
    dist = ", ".join(f'("close" - sma_{n}) / sma_{n} AS dist_sma_{n}' for n in (5, 10, 20, 50, 200))
    cross = ", ".join(f"{_flag(f'sma_{a} > sma_{b}')} AS sma_{a}_{b}_cross" for a, b in ((5, 10), (10, 20), (20, 50), (50, 200)))
    vols = ", ".join(f"{avg_n('ret_1d', n, fn='stddev_pop')} AS volatility_{n}d" for n in (5, 10, 20, 50))
    return f"""SELECT f.*, {dist}, {cross}, {vols}, x.a AS adx_raw,
       ("close" - e12) / e12 AS dist_ema_12, ("close" - e26) / e26 AS dist_ema_26,
       CASE WHEN rn < 15 OR al = 0 THEN 100E0 ELSE 100 - 100 / (1 + ag / al) END AS rsi_14,
       line / "close" AS macd, sig / "close" AS macd_signal, (line - sig) / "close" AS macd_hist,
       least(greatest(100 * ("close" - l14) / nullif(h14 - l14, 0), 0), 100) + 0 * (h14 - l14) AS stoch_k0, h14 - l14 AS hl14,
       sma_20 + 2 * sd20 AS bb_upper, sma_20 - 2 * sd20 AS bb_lower,
       volume / nullif(avg_volume_20d, 0) AS volume_ratio_20d,
       sum(sv) OVER w AS obv, ret_1d - ret_5d / 5E0 AS mean_reversion,
       ("close" - top) / top AS dist_52w_high, ("close" - floor_) / floor_ AS dist_52w_low,
       ("close" - floor_) / nullif(top - floor_, 0) AS pct_52w_range,
       ({_flag('"close" > sma_5')} + {_flag('"close" > sma_20')} + {_flag('"close" > sma_50')}) / 3E0 AS trend_alignment
       FROM feat0 f LEFT JOIN adxs x USING (symbol, rn)
       WINDOW w AS (PARTITION BY symbol ORDER BY date)"""


cte("feat1", _second_sql(), "feat0", "adxs")
cte(
    "feat2",
    f"""SELECT *, CASE WHEN hl14 > 0 THEN stoch_k0 END AS stoch_k, CASE WHEN rn >= 28 THEN adx_raw END AS adx, atr AS atr_14, e12 AS ema_12, e26 AS ema_26,
       ("close" - bb_lower) / nullif(bb_upper - bb_lower, 0) AS bb_position,
       CASE WHEN bb_upper <> bb_lower THEN (bb_upper - bb_lower) / sma_20 END AS bb_width,
       obv / nullif({avg_n('obv', 20, fn='stddev_pop')}, 0) AS obv_normalised,
       {_flag('volume_ratio_20d > 2')} AS volume_spike, volume_ratio_20d - lag(volume_ratio_20d) OVER w AS volume_momentum,
       rsi_14 - lag(rsi_14) OVER w AS rsi_momentum, {_flag('rsi_14 > 70')} AS rsi_overbought, {_flag('rsi_14 < 30')} AS rsi_oversold,
       macd_hist - lag(macd_hist) OVER w AS macd_momentum, {_flag('macd > macd_signal')} AS macd_cross,
       volatility_5d / nullif(volatility_20d, 0) AS vol_regime,
       ret_5d - lag(ret_5d) OVER w AS price_accel, {avg_n('ret_5d', 5)} AS ret_5d_ma
       FROM feat1 WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "feat1",
)
cte(
    "feat",
    f"""SELECT *, {avg_n('stoch_k', 3)} AS stoch_d, {_flag('adx > 25')} AS adx_strong,
       {_flag('bb_width < (' + avg_n('bb_width', 20, fn='quantile_cont').replace('quantile_cont(bb_width)', 'quantile_cont(bb_width, 0.1)') + ')')} AS bb_squeeze,
       {_flag('bb_position > 0.95')} AS bb_breakout_up, {_flag('bb_position < 0.05')} AS bb_breakout_dn,
       {_flag('stoch_k > (' + avg_n('stoch_k', 3) + ')')} AS stoch_cross, {_flag('stoch_k > 80')} AS stoch_extreme_high, {_flag('stoch_k < 20')} AS stoch_extreme_low,
       {_flag('vol_regime > 1.5')} AS high_vol_regime, {_flag('vol_regime < 0.5')} AS low_vol_regime,
       CASE WHEN lead("close") OVER w IS NOT NULL THEN {_flag('lead("close") OVER w > "close"')} END AS target_direction
       FROM feat2 WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "feat2",
)
cte(
    "cross_",
    """SELECT f.*, ret_1d - avg(ret_1d) OVER d AS excess_return, volatility_20d / nullif(avg(volatility_20d) OVER d, 0) AS rel_volatility,
       CASE WHEN ret_1d IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY ret_1d) + (count(*) OVER (PARTITION BY date, ret_1d) - 1) / 2E0)
         / count(ret_1d) OVER d END AS rank_return,
       CASE WHEN volume_ratio_20d IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY volume_ratio_20d)
         + (count(*) OVER (PARTITION BY date, volume_ratio_20d) - 1) / 2E0) / count(volume_ratio_20d) OVER d END AS rank_volume_ratio
       FROM feat f WINDOW d AS (PARTITION BY date)""",
    "feat",
)
