"""Bars, data quality and technical features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.scalar import in_session, ratio
from ..operators import audit, dedup, quality
from ..operators import technical as T
from ..operators.bars import candles, daily_from_candles
from ..operators.calendar import by_date, join_daily
from ..operators.cross import cross_section, with_market_state, with_sector, with_sector_state
from ..operators.incremental import refresh_features
from ..session import stored, work_folder
from .base import columns, cte, query
from .tables_sql import avg_n

KEY = "symbol date:d "

# --- bars ------------------------------------------------------------------


@query("daily_bars", KEY + "open:f9 high:f9 low:f9 close:f9 volume:f6", "SELECT * FROM bars", ("bars",))
def daily_bars(m):
    return m.bars


@query("candles_5m", "symbol ts:t open:f9 high:f9 low:f9 close:f9 volume:f6", "SELECT * FROM candles_5m", ("candles_5m",))
def candles_5m(m):
    return m.candles_5m


cte(
    "candles_60m",
    """SELECT symbol, time_bucket(INTERVAL 60 MINUTE, ts) AS ts, min_by(open, ts) AS open, max(high) AS high, min(low) AS low,
       max_by("close", candles_5m.ts) AS "close", sum(volume) AS volume FROM candles_5m GROUP BY 1, 2""",
    "candles_5m",
)


@query("candles_60m", "symbol ts:t open:f9 high:f9 low:f9 close:f9 volume:f6", "SELECT * FROM candles_60m", ("candles_60m",))
def candles_60m(m):
    return candles(m.event_ticks, "60 minutes", ["seq"])


@query(
    "daily_from_candles",
    KEY + "open:f9 high:f9 low:f9 close:f9 volume:f6",
    """SELECT symbol, cast(ts AS date) AS date, min_by(open, ts) AS open, max(high) AS high, min(low) AS low,
       max_by("close", ts) AS "close", sum(volume) AS volume FROM candles_5m GROUP BY 1, 2""",
    ("candles_5m",),
)
def daily_from_candles_(m):
    return daily_from_candles(m.candles_5m)


@query(
    "session_filter",
    "symbol n_ticks:i first_ts:t last_ts:t",
    """SELECT event_type AS symbol, count(*) AS n_ticks, min(ts) AS first_ts, max(ts) AS last_ts FROM events
       WHERE cast(ts AS time) BETWEEN TIME '09:15:00' AND TIME '15:30:00' AND isodow(ts) < 6 GROUP BY 1""",
)
def session_filter(m):
    t = m.event_ticks.where(in_session("ts") & (F.weekday("ts") < 5))
    return t.groupBy("symbol").agg(F.count("*").alias("n_ticks"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# --- quality ---------------------------------------------------------------

cte(
    "dirty",
    """SELECT cast(l_suppkey % 50 AS varchar) AS symbol, CASE WHEN l_linenumber = 7 THEN NULL ELSE cast(l_shipdate AS date) END AS date,
       l_extendedprice / l_quantity AS open, l_extendedprice / l_quantity + l_tax * 10 AS high,
       l_extendedprice / l_quantity - l_discount * 100 + 4 AS low,
       CASE WHEN l_partkey % 97 = 0 THEN -1E0 ELSE l_extendedprice / l_quantity + 0.1E0 END AS "close",
       l_quantity - 2 AS volume, l_orderkey * 8 + l_linenumber AS seq FROM lineitem""",
)


def _dirty(m):
    """Raw price rows with every kind of defect, symbols by supplier."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return m.table("lineitem").select(
        (F.col("l_suppkey") % 50).cast("string").alias("symbol"),
        F.when(F.col("l_linenumber") != 7, F.to_date("l_shipdate")).alias("date"),
        px.alias("open"),
        (px + F.col("l_tax") * 10).alias("high"),
        (px - F.col("l_discount") * 100 + 4).alias("low"),
        F.when(F.col("l_partkey") % 97 == 0, F.lit(-1.0)).otherwise(px + 0.1).alias("close"),
        (F.col("l_quantity") - 2).alias("volume"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )


RULE_SQL = """CASE WHEN date IS NULL THEN 'invalid_date'
  WHEN open <= 0 OR high <= 0 OR low <= 0 OR "close" <= 0 OR open IS NULL OR high IS NULL OR low IS NULL OR "close" IS NULL THEN 'bad_price'
  WHEN high < low THEN 'high_below_low' WHEN high < greatest(open, "close") THEN 'high_below_body'
  WHEN volume < 0 THEN 'negative_volume' END"""


@query(
    "quality_report",
    "rows_before:i " + columns([f"{r}_removed" for r in quality.RULES], "i") + " duplicate_removed:i rows_after:i",
    "SELECT count(*) AS rows_before, "
    + ", ".join(f"count(*) FILTER (rule = '{r}') AS {r}_removed" for r in quality.RULES)
    + """, count(*) FILTER (rule IS NULL) - count(DISTINCT (symbol, date)) FILTER (rule IS NULL) AS duplicate_removed,
       count(DISTINCT (symbol, date)) FILTER (rule IS NULL) AS rows_after FROM (SELECT *, """
    + RULE_SQL
    + " AS rule FROM dirty)",
    ("dirty",),
)
def quality_report(m):
    return quality.quality_report(_dirty(m))


@query(
    "clean_bars",
    KEY + "close:f9 seq:i",
    f"""SELECT symbol, date, max("close") AS "close", seq FROM (
       SELECT *, max(seq) OVER (PARTITION BY symbol, date) AS m FROM dirty WHERE ({RULE_SQL}) IS NULL) WHERE seq = m
       GROUP BY symbol, date, seq""",
    ("dirty",),
)
def clean_bars(m):
    ok = _dirty(m).withColumn("_rule", quality.failed_rule()).where(F.col("_rule").isNull()).drop("_rule")
    return dedup.keep_best(ok, ["symbol", "date"], F.struct("seq", "close"))


@query(
    "dedup_keep_max_volume",
    "symbol date:d volume:f6 px:f9",
    """SELECT symbol, date, volume, max(px) AS px FROM (SELECT symbol, date, qty AS volume, px, max(qty) OVER (PARTITION BY symbol, date) AS m FROM ticks)
       WHERE volume = m GROUP BY 1, 2, 3""",
    ("ticks",),
)
def dedup_keep_max_volume(m):
    rows = m.ticks.select("symbol", "date", F.col("qty").alias("volume"), "px")
    return dedup.keep_highest_volume(rows, tie=("px",))


def _known():
    """Dates of the existing table."""
    return F.col("date") <= F.lit("2000-12-31").cast("date")


def _fresh():
    """Dates that arrive: some again, some new."""
    return F.col("date") >= F.lit("2000-10-01").cast("date")


@query(
    "upsert_keep_last",
    KEY + "close:f9 source",
    """SELECT symbol, date, CASE WHEN date >= date '2000-10-01' THEN "close" + 1 ELSE "close" END AS "close",
       CASE WHEN date >= date '2000-10-01' THEN 'live' ELSE 'historical' END AS source FROM bars""",
    ("bars",),
)
def upsert_keep_last(m):
    bars = stored(m.bars.select("symbol", "date", "close"), "bars")
    old = bars.where(_known()).withColumn("source", F.lit("historical"))
    new = bars.where(_fresh()).select("symbol", "date", (F.col("close") + 1).alias("close"), F.lit("live").alias("source"))
    return dedup.upsert(old, new, ["symbol", "date"])


@query(
    "upsert_stats",
    "new_rows:i replaced:i total:i max_date:d",
    """SELECT count(*) FILTER (n) AS new_rows, count(*) FILTER (n AND o) AS replaced, count(*) FILTER (n OR o) AS total,
       max(date) FILTER (n OR o) AS max_date FROM (SELECT date, date >= date '2000-10-01' AS n, date <= date '2000-12-31' AS o FROM bars)""",
    ("bars",),
)
def upsert_stats(m):
    bars = stored(m.bars.select("symbol", "date"), "keys")
    return dedup.upsert_stats(bars.where(_known()), bars.where(_fresh()), ["symbol", "date"])


@query(
    "calendar_coverage",
    "symbol n_rows:i missing_business_days:i first_date:d last_date:d",
    """SELECT symbol, count(*) AS n_rows, greatest((SELECT count(*) FROM range(date '1996-01-01', date '2001-12-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6)
       - count(DISTINCT date), 0) AS missing_business_days, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY 1""",
    ("bars",),
)
def calendar_coverage(m):
    return quality.calendar_coverage(m.bars, "1996-01-01", "2001-11-30")


@query(
    "freshness",
    "max_date:d last_trading_day:d age_days:i is_stale",
    """SELECT max(date) AS max_date, date '2002-03-01' AS last_trading_day, date '2002-03-01' - max(date) AS age_days,
       (date '2002-03-01' - max(date)) > 1 AS is_stale FROM bars""",
    ("bars",),
)
def freshness(m):
    return quality.freshness(m.ticks, "2002-03-03")


@query(
    "plausible_returns",
    "symbol n_kept:i mean_ret:f8",
    """SELECT symbol, count(*) AS n_kept, avg(r) AS mean_ret FROM (
       SELECT symbol, lead(px) OVER (PARTITION BY symbol ORDER BY date) / px - 1 AS r FROM (
       SELECT symbol, date, max(open) AS px FROM dirty WHERE date IS NOT NULL GROUP BY 1, 2)) WHERE abs(r) <= 0.5 GROUP BY 1""",
    ("dirty",),
)
def plausible_returns(m):
    daily = _dirty(m).where(F.col("date").isNotNull()).groupBy("symbol", "date").agg(F.max("open").alias("close"))
    kept = quality.plausible_returns(T.forward_return(daily), "next_ret")
    return kept.groupBy("symbol").agg(F.count("*").alias("n_kept"), F.avg("next_ret").alias("mean_ret"))


@query(
    "null_counts",
    "column_name nulls:i n_rows:i",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count(*) AS n_rows FROM feat"
        for c in ("ret_1d", "ret_20d", "sma_20", "sma_200", "stoch_d", "adx", "rsi_14", "target_direction")
    ),
    ("feat",),
)
def null_counts(m):
    panel = T.label(T.indicators(m.bars, "returns", "trend", "stochastic", "adx", "rsi"))
    return quality.null_counts(panel, ["ret_1d", "ret_20d", "sma_20", "sma_200", "stoch_d", "adx", "rsi_14", "target_direction"])


@query(
    "symbol_stats",
    "symbol n_rows:i first_date:d last_date:d null_targets:i up_share:f8",
    """SELECT symbol, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,
       count(*) - count(t) AS null_targets, avg(t) AS up_share FROM (SELECT *, CASE WHEN lead("close") OVER w IS NOT NULL
       THEN cast(lead("close") OVER w > "close" AS int) END AS t FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) GROUP BY 1""",
    ("bars",),
)
def symbol_stats(m):
    return quality.symbol_stats(T.label(m.bars))


@query(
    "prediction_checks",
    "n_rows:i rows_missing_outcome:i duplicate_rows:i probabilities_out_of_range:i directions_not_binary:i",
    """SELECT count(*) AS n_rows, count(*) FILTER (next_ret IS NULL) AS rows_missing_outcome,
       count(*) - count(DISTINCT (symbol, date)) AS duplicate_rows, count(*) FILTER (prob < 0 OR prob > 1) AS probabilities_out_of_range,
       0 AS directions_not_binary FROM preds""",
    ("preds",),
)
def prediction_checks(m):
    named = m.predictions.select(
        "date",
        "symbol",
        F.col("actual").alias("actual_direction"),
        F.col("next_ret").alias("actual_return"),
        F.col("prob").alias("predicted_probability"),
        F.col("pred").alias("predicted_direction"),
    )
    return quality.prediction_checks(named)


@query(
    "outlier_flags",
    KEY + "extreme_return_up:f1 extreme_return_down:f1 extreme_volume:f1 low_volume:f1",
    """SELECT symbol, date, CASE WHEN ret_1d > quantile_cont(ret_1d, 0.99) OVER s THEN 1 ELSE 0 END AS extreme_return_up,
       CASE WHEN ret_1d < quantile_cont(ret_1d, 0.01) OVER s THEN 1 ELSE 0 END AS extreme_return_down,
       CASE WHEN volume_ratio_20d > 5 THEN 1 ELSE 0 END AS extreme_volume, CASE WHEN volume_ratio_20d < 0.2 THEN 1 ELSE 0 END AS low_volume
       FROM feat1 WINDOW s AS (PARTITION BY symbol)""",
    ("feat1",),
)
def outlier_flags(m):
    return quality.outlier_flags(T.indicators(m.bars, "returns", "volume"))


@query(
    "zscores",
    KEY + "ret_zscore:f7 vol_zscore:f7 ret_cs_zscore:f7 bb_cs_zscore:f7",
    """SELECT symbol, date, (ret_1d - avg(ret_1d) OVER s) / stddev_samp(ret_1d) OVER s AS ret_zscore,
       (volume_ratio_20d - avg(volume_ratio_20d) OVER s) / stddev_samp(volume_ratio_20d) OVER s AS vol_zscore,
       (ret_1d - avg(ret_1d) OVER d) / stddev_samp(ret_1d) OVER d AS ret_cs_zscore,
       (bb_position - avg(bb_position) OVER d) / stddev_samp(bb_position) OVER d AS bb_cs_zscore
       FROM feat2 WINDOW s AS (PARTITION BY symbol), d AS (PARTITION BY date)""",
    ("feat2",),
)
def zscores(m):
    panel = T.indicators(m.bars, "returns", "volume", "bollinger").select("symbol", "date", "ret_1d", "volume_ratio_20d", "bb_position")
    panel = stored(panel, "panel")
    panel = quality.symbol_zscores(panel, {"ret_zscore": "ret_1d", "vol_zscore": "volume_ratio_20d"})
    return quality.date_zscores(panel, {"ret_cs_zscore": "ret_1d", "bb_cs_zscore": "bb_position"})


# --- technical features ----------------------------------------------------

RETURNS = [f"ret_{d}d" for d in T.HORIZONS] + [f"log_ret_{d}d" for d in T.HORIZONS]


FEATURES: dict[str, str] = {}  # every technical feature, and the rounding of its column


def family(name: str, spec: str, *families: str):
    FEATURES.update(part.split(":") for part in spec.split())

    @query(name, KEY + spec, "SELECT * FROM feat", ("feat",))
    def plan(m):
        return T.indicators(m.bars, *families)

    return plan


family("returns", columns(RETURNS, "f10") + " hl_range:f10 co_return:f10 gap_return:f10", "returns", "price")
family(
    "sma_family",
    columns([f"sma_{n}" for n in T.AVERAGES], "f9")
    + " "
    + columns([f"dist_sma_{n}" for n in T.AVERAGES], "f9")
    + " sma_5_10_cross:f1 sma_10_20_cross:f1 sma_20_50_cross:f1 sma_50_200_cross:f1",
    "trend",
)
family("ema_family", "ema_12:f6 ema_26:f6 dist_ema_12:f8 dist_ema_26:f8", "trend")
family("rsi", "rsi_14:f6 rsi_momentum:f6 rsi_overbought:f1 rsi_oversold:f1", "rsi")
family("macd", "macd:f9 macd_signal:f9 macd_hist:f9 macd_momentum:f9 macd_cross:f1", "macd")
family("stochastic", "stoch_k:f6 stoch_d:f6 stoch_cross:f1 stoch_extreme_high:f1 stoch_extreme_low:f1", "stochastic")
family("adx", "plus_di:f6 minus_di:f6 adx:f6 adx_strong:f1", "adx")
family("rolling_vol", columns([f"volatility_{n}d" for n in (5, 10, 20, 50)], "f9") + " vol_regime:f7 high_vol_regime:f1 low_vol_regime:f1", "volatility")
family("atr", "atr_14:f7", "atr")
family("bollinger", "bb_upper:f7 bb_lower:f7 bb_position:f6 bb_width:f8 bb_breakout_up:f1 bb_breakout_dn:f1", "bollinger")
family("bb_squeeze", "bb_width:f8 bb_squeeze:f1", "bollinger")
family(
    "volume_obv",
    "volume_pct_change:f8 avg_volume_5d:f6 avg_volume_10d:f6 avg_volume_20d:f6 volume_ratio_20d:f8 obv:f4 obv_normalised:f6 volume_spike:f1 volume_momentum:f8",
    "volume",
)
family("range_52w", "dist_52w_high:f9 dist_52w_low:f9 pct_52w_range:f8", "range_52w")
family("derived_flags", "mean_reversion:f9 price_accel:f9 ret_5d_ma:f9 trend_alignment:f6", "momentum")

PANEL_DIGITS = {
    "f9": [c for c in RETURNS] + ["hl_range", "co_return", "gap_return", "sma_20", "sma_200", "dist_sma_200", "macd", "macd_hist", "volatility_20d"],
    "f6": ["ema_12", "ema_26", "rsi_14", "stoch_k", "stoch_d", "adx", "plus_di", "minus_di", "atr_14", "bb_position", "obv_normalised", "volume_ratio_20d", "pct_52w_range"],
    "f1": ["bb_squeeze", "macd_cross", "rsi_overbought", "adx_strong", "volume_spike", "high_vol_regime", "target_direction"],
}


@query("feature_panel", KEY + " ".join(columns(v, k) for k, v in PANEL_DIGITS.items()), "SELECT * FROM feat", ("feat",))
def feature_panel(m):
    return T.feature_panel(m.bars)


COMPACT_SQL = f"""SELECT symbol, date, ret_1d, ret_5d, log_ret_1d, "close" / sma_20 - 1 AS sma_20_ratio, "close" / sma_50 - 1 AS sma_50_ratio,
  "close" / e20 - 1 AS ema_20_ratio, sma_20 / sma_50 - 1 AS sma_20_50_cross, rsi_14, macd, macd_signal, macd_hist, bb_position,
  (bb_upper - bb_lower) / sma_20 AS bb_width, atr_14 / "close" AS atr_14_ratio,
  {avg_n('ret_1d', 10, fn='stddev_pop')} AS volatility_10, {avg_n('ret_1d', 20, fn='stddev_pop')} AS volatility_20,
  volume_ratio_20d AS volume_ratio, volume_pct_change AS volume_change, target_direction AS label FROM feat2"""
cte("feat2l", 'SELECT *, CASE WHEN lead("close") OVER w IS NOT NULL THEN cast(lead("close") OVER w > "close" AS int) END AS target_direction FROM feat2 WINDOW w AS (PARTITION BY symbol ORDER BY date)', "feat2")


@query(
    "compact_features",
    KEY + columns(T.COMPACT, "f6"),
    COMPACT_SQL.replace("FROM feat2", "FROM feat2l"),
    ("feat2l",),
)
def compact_features(m):
    return T.compact_features(m.bars)


@query(
    "model_ready",
    "symbol n_rows:i up_share:f8 mean_rsi:f6",
    f"SELECT symbol, count(*) AS n_rows, avg(label) AS up_share, avg(rsi_14) AS mean_rsi FROM ({COMPACT_SQL.replace('FROM feat2', 'FROM feat2l')}) "
    f"WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*T.COMPACT, 'label'])} GROUP BY 1",
    ("feat2l",),
)
def model_ready(m):
    return T.model_ready(m.bars).groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.avg("label").alias("up_share"), F.avg("rsi_14").alias("mean_rsi")
    )


@query(
    "labels_h1_h5",
    KEY + "next_ret:f10 ret_5d_fwd:f10 label_1:i label_5:i",
    """SELECT symbol, date, lead("close") OVER w / "close" - 1 AS next_ret, lead("close", 5) OVER w / "close" - 1 AS ret_5d_fwd,
       cast(lead("close") OVER w > "close" AS int) AS label_1, cast(lead("close", 5) OVER w > "close" AS int) AS label_5
       FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    ("bars",),
)
def labels(m):
    out = T.forward_return(T.forward_return(m.bars), 5, "ret_5d_fwd")
    return T.label(T.label(out, 1, "label_1"), 5, "label_5")


# --- cross-section, market and sector state --------------------------------


def small_panel(m):
    """The features the cross-sectional operators read, stored once."""
    cols = ["symbol", "date", "ret_1d", "ret_5d", "ret_20d", "volatility_20d", "volume_ratio_20d", "dist_sma_20", "dist_sma_50"]
    return stored(T.indicators(m.bars, "returns", "trend", "volatility", "volume").select(*cols), "panel")


@query(
    "cross_sectional",
    KEY + "rank_return:f8 rank_volume_ratio:f8 excess_return:f9 rel_volatility:f7",
    "SELECT * FROM cross_",
    ("cross_",),
)
def cross_sectional(m):
    return cross_section(small_panel(m))


MARKET = ["mkt_breadth_1d", "mkt_breadth_20d", "mkt_breadth_50d", "mkt_cs_disp_1d", "mkt_mom_5d", "mkt_mom_20d", "mkt_vol_regime"]
cte(
    "mkt",
    """SELECT *, mvol / CASE WHEN count(mvol) OVER r >= 100 THEN avg(mvol) OVER r END AS mkt_vol_regime FROM (
       SELECT date, avg(CASE WHEN ret_1d > 0 THEN 1E0 ELSE 0E0 END) AS mkt_breadth_1d, avg(CASE WHEN dist_sma_20 > 0 THEN 1E0 ELSE 0E0 END) AS mkt_breadth_20d,
       avg(CASE WHEN dist_sma_50 > 0 THEN 1E0 ELSE 0E0 END) AS mkt_breadth_50d, stddev_samp(ret_1d) AS mkt_cs_disp_1d, avg(ret_5d) AS mkt_mom_5d,
       avg(ret_20d) AS mkt_mom_20d, avg(volatility_20d) AS mvol FROM feat1 GROUP BY 1)
       WINDOW r AS (ORDER BY date ROWS 249 PRECEDING)""",
    "feat1",
)


@query("market_state", KEY + columns(MARKET, "f7"), "SELECT f.symbol, m.* FROM feat1 f JOIN mkt m USING (date)", ("feat1", "mkt"))
def market_state(m):
    return with_market_state(small_panel(m))


@query(
    "sector_state",
    KEY + "sector sect_mom_5d:f8 sect_mom_20d:f8 sect_breadth_1d:f8 sect_disp_20d:f8 rel_mom_5d:f8 rel_mom_20d:f8",
    """SELECT symbol, date, sector, avg(ret_5d) OVER s AS sect_mom_5d, avg(ret_20d) OVER s AS sect_mom_20d,
       avg(CASE WHEN ret_1d > 0 THEN 1E0 ELSE 0E0 END) OVER s AS sect_breadth_1d, stddev_samp(ret_20d) OVER s AS sect_disp_20d,
       ret_5d - avg(ret_5d) OVER s AS rel_mom_5d, ret_20d - avg(ret_20d) OVER s AS rel_mom_20d
       FROM feat1 JOIN sectors USING (symbol) WINDOW s AS (PARTITION BY date, sector)""",
    ("feat1", "sectors"),
)
def sector_state(m):
    return with_sector_state(with_sector(small_panel(m), m.sectors))


@query(
    "lagged_cross_return",
    KEY + "past_5:f10 past_20:f10",
    """SELECT symbol, date, lag("close") OVER w / lag("close", 6) OVER w - 1 AS past_5, lag("close") OVER w / lag("close", 21) OVER w - 1 AS past_20
       FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    ("bars",),
)
def lagged_cross_return(m):
    w = R.series()
    return m.bars.withColumns(
        {f"past_{n}": ratio(F.lag("close", 1).over(w), F.lag("close", 1 + n).over(w)) - 1.0 for n in (5, 20)}
    )


@query(
    "incremental_features",
    KEY + "ret_1d:f10 ema_12:f6 rsi_14:f6 macd:f9",
    "SELECT * FROM feat WHERE date > date '2001-06-30'",
    ("feat",),
)
def incremental_features(m):
    """Feature rows that a refresh adds after a cutoff; equal to a full rebuild of those dates."""
    bars = stored(m.bars, "bars")
    keep = ["symbol", "date", "ret_1d", "ema_12", "rsi_14", "macd"]

    def build(b):
        return T.indicators(b, "returns", "trend", "rsi", "macd").select(*keep)

    old = bars.where(F.col("date") <= F.lit("2001-06-30").cast("date"))
    return refresh_features(old, bars.where(F.col("date") > F.lit("2001-06-01").cast("date")), stored(build(old), "features"), build)


# --- audits of all features ------------------------------------------------

AUDITED = [*FEATURES, "planted"]


def audited(m):
    """Every feature, and one column that gives tomorrow's daily value of another away."""
    panel = T.indicators(m.bars).select("date", "symbol", *FEATURES)
    ahead = audit.daily_values(panel, ["hl_range"]).withColumn("planted", F.lead("hl_range").over(by_date())).select("date", "planted")
    return join_daily(panel, ahead, "left")


cte(
    "daily_features",
    f"SELECT date, {', '.join(f'min_by(\"{c}\", symbol) FILTER (\"{c}\" IS NOT NULL) AS \"{c}\"' for c in FEATURES)} FROM feat GROUP BY 1",
    "feat",
)
cte(
    "daily_long",
    f"""SELECT date, feature, v, rank_ FROM (SELECT *, dense_rank() OVER (ORDER BY date) AS rank_ FROM (SELECT *, lead(hl_range) OVER (ORDER BY date) AS planted FROM daily_features))
       UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(f'"{c}"' for c in AUDITED)}))""",
    "daily_features",
)


@query(
    "lookahead_features",
    "feature other n_pairs:i max_gap:f5 is_leak",
    """WITH s AS (SELECT feature, stddev_samp(v) AS sd, min_by(abs(v), date) FILTER (v IS NOT NULL) AS first_ FROM daily_long GROUP BY 1),
       g AS (SELECT a.feature, b.feature AS other, count(abs(a.v - b.v)) AS n_pairs, max(abs(a.v - b.v)) AS max_gap
             FROM daily_long a JOIN daily_long b ON b.rank_ = a.rank_ + 1 AND a.feature <> b.feature GROUP BY 1, 2)
       SELECT g.*, coalesce(f.sd > 0 AND o.sd > 0 AND n_pairs >= 15 AND max_gap < 1e-6 * greatest(f.first_, 1e-9), false) AS is_leak
       FROM g JOIN s f ON f.feature = g.feature JOIN s o ON o.feature = g.other""",
    ("daily_long",),
)
def lookahead_features(m):
    """Every pair of all features: does one give the other's next value away?"""
    return audit.shifted_pairs(audited(m), AUDITED)


@query(
    "future_dependence",
    "feature n_changed:i",
    f"""SELECT unnest([{', '.join(f"'{c}'" for c in FEATURES)}]) AS feature, 0 AS n_changed
       UNION ALL SELECT 'planted', count(*) FROM (SELECT symbol FROM bars GROUP BY 1 HAVING min(date) <= date '2000-12-31' AND max(date) > date '2000-12-31')""",
    ("bars",),
)
def future_dependence(m):
    """Rows up to a date that change when everything after it does: none, but for a column that looks one bar ahead."""
    bars = stored(m.bars, "bars")

    def build(b):
        return T.indicators(b).withColumn("planted", F.lead("close").over(R.series()))

    return audit.future_dependence(build, bars, "2000-12-31", AUDITED)


# --- catalogue -------------------------------------------------------------

CATALOGUED = ["symbol", "date", "open", "high", "low", "close", "volume", *FEATURES, "target_direction"]


def _rule(column: int) -> str:
    cases = " ".join(f"WHEN regexp_full_match(name, '{r[0]}') THEN " + (f"'{r[1]}'" if column == 1 else f"regexp_replace(name, '^(?:{r[0]})$', '{r[2]}')") for r in quality.FEATURE_RULES)
    return f"CASE {cases} ELSE '{'other' if column == 1 else ''}' END"


@query(
    "feature_catalogue",
    "position:i name type category description",
    f"""SELECT no - 1 AS position, name, CASE name WHEN 'symbol' THEN 'string' WHEN 'date' THEN 'date' ELSE 'double' END AS type, {_rule(1)} AS category, {_rule(2)} AS description
       FROM (SELECT unnest([{", ".join(f"'{c}'" for c in CATALOGUED)}]) AS name, unnest(range(1, {len(CATALOGUED) + 1})) AS no)""",
)
def feature_catalogue(m):
    """What the stored feature panel says about its columns: the metadata went through a plan and a file."""
    panel = quality.described(T.feature_panel(m.bars)).where("close > 0").select(*CATALOGUED)
    folder = work_folder(m.spark, "catalogue")
    panel.write.parquet(folder)
    return quality.column_catalogue(m.spark.read.parquet(folder))


@query(
    "finite_inputs",
    "column_name nulls:i n_rows:i",
    """SELECT unnest(['ratio', 'drift', 'l_discount']) AS column_name, unnest([n, n, 0]) AS nulls, n_rows FROM (SELECT count(*) FILTER (l_discount = 0) AS n, count(*) AS n_rows FROM lineitem)""",
)
def finite_inputs(m):
    """Infinite and undefined quotients become NULL; rows without any value go."""
    from ..functions.scalar import finite_columns

    rows = m.table("lineitem").select(F.try_divide(F.lit(1.0), F.lit(1.0)).alias("one"), "l_discount")
    zero = F.col("l_discount") == 0
    wild = rows.withColumns({"ratio": F.when(zero, F.lit(float("inf"))).otherwise(F.col("one")), "drift": F.when(zero, F.lit(float("nan"))).otherwise(F.col("one"))})
    return quality.null_counts(quality.drop_empty_rows(finite_columns(wild), ["ratio", "drift", "l_discount"]), ["ratio", "drift", "l_discount"])
