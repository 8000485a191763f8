"""Score cards, screens and market pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import market as K
from ..operators import scoring as S
from ..operators import technical as T
from ..operators.cross import cross_section
from ..operators.metrics import significance
from ..operators.portfolio import long_short_daily
from ..session import stored, work_folder
from ..streaming.refresh import FeaturePanel
from .base import columns, cte, query
from .portfolios import COST


def bars(m):
    """The bars, aggregated from the ticks once per query."""
    if not hasattr(m, "_stored_bars"):
        m._stored_bars = stored(m.bars, "bars")
    return m._stored_bars


def signal(m):
    return K.latest_signal(bars(m).withColumn("prob", m.probability(7919, 104729)))


SCORED = ("returns", "trend", "rsi", "macd", "stochastic", "adx", "volatility", "atr", "bollinger", "volume")


def today(m):
    """Newest feature row per symbol of the market, with its cross-section.

    Windows need the whole history, but only the newest date goes on from there.
    """
    newest = S.latest_rows(T.indicators(bars(m), *SCORED))
    return cross_section(stored(newest, "today"))


# --- quotes and movers -----------------------------------------------------

cte(
    "quotes",
    """SELECT *, last - prev_close AS change, (last - prev_close) / prev_close * 100 AS change_percent FROM (
       SELECT l.symbol, l."close" AS last, p."close" AS prev_close, l.volume, l.date AS as_of FROM bars l
       LEFT JOIN bars p ON p.symbol = l.symbol AND p.date = (SELECT max(date) FROM bars WHERE date < (SELECT max(date) FROM bars))
       WHERE l.date = (SELECT max(date) FROM bars))""",
    "bars",
)


@query("quotes_change", "symbol last:f9 prev_close:f9 volume:f6 as_of:d change:f9 change_percent:f8", "SELECT * FROM quotes", ("quotes",))
def quotes_change(m):
    return K.quotes(bars(m))


@query(
    "movers",
    "side symbol last:f9 change_percent:f8",
    """SELECT 'gainer' AS side, * FROM (SELECT symbol, last, change_percent FROM quotes WHERE change_percent IS NOT NULL ORDER BY change_percent DESC, symbol LIMIT 5)
       UNION ALL SELECT 'loser', * FROM (SELECT symbol, last, change_percent FROM quotes WHERE change_percent IS NOT NULL ORDER BY change_percent, symbol LIMIT 5)""",
    ("quotes",),
)
def movers(m):
    return K.movers(bars(m))


@query(
    "advance_decline",
    "advancers:i decliners:i unchanged:i as_of:d",
    """SELECT count(*) FILTER (change_percent > 0) AS advancers, count(*) FILTER (change_percent < 0) AS decliners,
       count(*) FILTER (change_percent IS NULL OR change_percent = 0) AS unchanged, max(as_of) AS as_of FROM quotes""",
    ("quotes",),
)
def advance_decline(m):
    return K.advance_decline(bars(m))


cte(
    "aged",
    """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS age FROM bars QUALIFY age <= 252""",
    "bars",
)


@query(
    "symbol_deep_dive",
    "symbol as_of:d open:f9 high:f9 low:f9 last_close:f9 volume:f6 previous_close:f9 sma_20:f9 sma_50:f9 high_52w:f9 low_52w:f9 change:f9 change_percent:f8 history",
    """SELECT *, last_close - previous_close AS change, (last_close - previous_close) / previous_close * 100 AS change_percent FROM (
       SELECT symbol, max(date) AS as_of, max(open) FILTER (age = 1) AS open, max(high) FILTER (age = 1) AS high, max(low) FILTER (age = 1) AS low, max("close") FILTER (age = 1) AS last_close,
       max(volume) FILTER (age = 1) AS volume, coalesce(max("close") FILTER (age = 2), max("close") FILTER (age = 1)) AS previous_close, avg("close") FILTER (age <= 20) AS sma_20,
       avg("close") FILTER (age <= 50) AS sma_50, max("close") AS high_52w, min("close") AS low_52w,
       string_agg(strftime(date, '%Y-%m-%d') || '=' || cast(round("close" * 1000000)::bigint AS varchar), ',' ORDER BY date) FILTER (age <= 30) AS history FROM aged GROUP BY 1)""",
    ("aged",),
)
def symbol_deep_dive(m):
    shown = F.array_join(
        F.transform("history", lambda h: F.concat(h["date"].cast("string"), F.lit("="), F.round(h["close"] * 1000000).cast("long").cast("string"))), ","
    )
    return K.symbol_pages(m.bars).withColumn("history", shown)


cte(
    "proxy",
    """SELECT date, avg("close") AS index_value, count(*) AS n_members FROM bars
       WHERE symbol IN (SELECT symbol FROM bars GROUP BY 1 ORDER BY avg(volume) DESC, symbol LIMIT 50) GROUP BY 1""",
    "bars",
)


@query("index_proxy", "date:d index_value:f9 n_members:i", "SELECT * FROM proxy", ("proxy",))
def index_proxy(m):
    return K.index_proxy(bars(m), 50)


@query(
    "index_snapshot",
    "as_of:d value:f9 previous_close:f9 change:f9 change_percent:f8",
    """SELECT date AS as_of, index_value AS value, p AS previous_close, index_value - p AS change, (index_value - p) / p * 100 AS change_percent FROM (
       SELECT *, lag(index_value) OVER (ORDER BY date) AS p FROM proxy) ORDER BY date DESC LIMIT 1""",
    ("proxy",),
)
def index_snapshot(m):
    return K.index_snapshot(bars(m), 50)


# --- signal ----------------------------------------------------------------

cte(
    "sig",
    """SELECT symbol, date, "close", prob AS prob_up, row_number() OVER (ORDER BY prob DESC, symbol) AS signal_rank FROM (
       SELECT * FROM signal QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)""",
    "signal",
)


@query("signal_rank", "symbol date:d close:f9 prob_up:f4 signal_rank:i", "SELECT * FROM sig", ("sig",))
def signal_rank(m):
    return signal(m)


@query(
    "signal_rank_all_rows",
    "symbol date:d prob:f4 rank:i",
    """SELECT symbol, date, prob, row_number() OVER (ORDER BY prob DESC, symbol || strftime(date, '%Y-%m-%d')) AS rank FROM signal""",
    ("signal",),
)
def signal_rank_all_rows(m):
    """A total order of every scored row, numbered without one global sort."""
    from ..operators.ranking import row_numbers

    keyed = m.signal.select("symbol", "date", "prob", F.concat("symbol", F.col("date").cast("string")).alias("k"))
    return row_numbers(stored(keyed, "signal"), "prob", "k")


@query(
    "market_signal",
    "as_of:d n_symbols:i market_breadth_prob:f9 direction",
    "SELECT max(date) AS as_of, count(*) AS n_symbols, avg(prob_up) AS market_breadth_prob, CASE WHEN avg(prob_up) >= 0.5 THEN 'UP' ELSE 'DOWN' END AS direction FROM sig",
    ("sig",),
)
def market_signal(m):
    return K.market_signal(signal(m))


@query("screen_up", "symbol prob_up:f4 signal_rank:i", "SELECT * FROM sig WHERE prob_up >= 0.5", ("sig",))
def screen_up(m):
    return K.screen(signal(m), "UP")


@query("screen_down_5", "symbol prob_up:f4 signal_rank:i", "SELECT * FROM sig WHERE prob_up < 0.5 ORDER BY signal_rank LIMIT 5", ("sig",))
def screen_down(m):
    return K.screen(signal(m), "DOWN", 5)


@query(
    "live_overlay",
    "symbol date:d close:f9 prob_up:f4 signal_rank:i is_live",
    """SELECT s.symbol, CASE WHEN l.d >= s.date THEN l.d ELSE s.date END AS date, CASE WHEN l.d >= s.date THEN l.c ELSE s."close" END AS "close", prob_up, signal_rank,
       coalesce(l.d >= s.date, false) AS is_live FROM sig s LEFT JOIN (SELECT symbol, max(date) AS d, max_by("close" + 1, date) AS c FROM bars WHERE date < (SELECT max(date) FROM bars) GROUP BY 1) l USING (symbol)""",
    ("sig", "bars"),
)
def live_overlay(m):
    newest = bars(m).agg(F.max("date")).first()[0]
    live = bars(m).where(F.col("date") < F.lit(newest))  # symbols of the newest date have no newer live row
    return K.live_overlay(signal(m), live.select("symbol", "date", (F.col("close") + 1).alias("last_close")))


# --- score cards -----------------------------------------------------------


def _clamp(x: str, lo: float = 0, hi: float = 100) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END"


def _pm(x: str, size: float) -> str:
    return f"coalesce({_clamp(x, -size, size)}, 0)"


TECH = _clamp(
    f"50 + {_pm('dist_sma_20 * 1000', 25)} + {_pm('dist_sma_50 * 1000', 20)} + {_pm('dist_sma_200 * 600', 15)}"
    " + CASE WHEN rsi_14 BETWEEN 50 AND 70 THEN 15 WHEN rsi_14 BETWEEN 40 AND 80 THEN 0 WHEN rsi_14 > 80 THEN -10 WHEN rsi_14 < 40 THEN -5 ELSE 0 END"
    f" + {_pm('macd_hist * 200', 10)} + CASE WHEN adx >= 25 THEN 8 WHEN adx >= 20 THEN 4 ELSE 0 END + CASE WHEN bb_position BETWEEN 0.4 AND 0.7 THEN 5 ELSE 0 END"
    " + CASE WHEN sma_20_50_cross > 0 THEN 5 ELSE 0 END + CASE WHEN sma_50_200_cross > 0 THEN 3 ELSE 0 END"
)
MOM = _clamp(
    f"50 + {_pm('ret_5d * 1500', 20)} + {_pm('ret_10d * 800', 20)} + {_pm('ret_20d * 400', 20)}"
    f" + CASE WHEN volume_ratio_20d >= 1.5 THEN 10 WHEN volume_ratio_20d >= 1 THEN 5 ELSE 0 END + {_pm('obv_normalised * 30', 8)}"
)
RISK = _clamp(
    "50 + CASE WHEN volatility_20d IS NULL THEN 0 WHEN volatility_20d < 0.008 THEN 20 WHEN volatility_20d < 0.013 THEN 10 WHEN volatility_20d < 0.02 THEN 0 WHEN volatility_20d < 0.03 THEN -10 ELSE -20 END"
    " + CASE WHEN volatility_50d > 0 AND volatility_20d / volatility_50d < 0.9 THEN 5 WHEN volatility_50d > 0 AND volatility_20d / volatility_50d > 1.2 THEN -5 ELSE 0 END"
    """ + CASE WHEN atr_14 / "close" < 0.02 THEN 8 WHEN atr_14 / "close" > 0.04 THEN -8 ELSE 0 END + CASE WHEN adx > 40 THEN -4 ELSE 0 END"""
)
VAL = _clamp(f"50 + {_pm('(0.5 - bb_position) * 60', 25)} + {_pm('-dist_sma_200 * 400', 20)}")
FUND = _clamp(
    "50 + CASE WHEN dist_sma_200 > 0.1 THEN 15 WHEN dist_sma_200 > 0 THEN 8 WHEN dist_sma_200 > -0.1 THEN 0 WHEN dist_sma_200 IS NOT NULL THEN -8 ELSE 0 END"
    " + CASE WHEN ret_5d IS NULL OR ret_10d IS NULL OR ret_20d IS NULL THEN 0 WHEN ret_5d > 0 AND ret_10d > 0 AND ret_20d > 0 THEN 12 WHEN ret_5d > 0 AND ret_10d > 0 THEN 6"
    " WHEN ret_5d < 0 AND ret_10d < 0 AND ret_20d < 0 THEN -8 ELSE 0 END + CASE WHEN volume_ratio_20d BETWEEN 0.7 AND 1.5 THEN 5 ELSE 0 END"
)
AI = f"coalesce({_clamp('50 + (prob_up * 100 - 50) * (0.5 + conf)')}, 50)"
TREND0 = f"coalesce({_clamp('adx * 1.7')}, 50)"
TREND1 = f"least({TREND0} + CASE WHEN sma_20_50_cross > 0 THEN 5 ELSE 0 END, 100)"
MONEY = 'avg_volume_20d * "close"'
cte(
    "cards0",
    f"""SELECT c.*, sector, s.prob_up, s.signal_rank, abs(s.prob_up - 0.5) * 2 AS conf, coalesce((rank() OVER (ORDER BY excess_return) + (count(*) OVER (PARTITION BY excess_return) - 1) / 2E0)
         / count(excess_return) OVER (), 0.5) AS exr, avg(excess_return) OVER (PARTITION BY sector) AS smean
       FROM (SELECT * FROM cross_ WHERE date = (SELECT max(date) FROM bars)) c LEFT JOIN sectors USING (symbol) LEFT JOIN sig s USING (symbol)""",
    "cross_", "sectors", "sig", "bars",
)
cte(
    "cards1",
    f"""SELECT *, {AI} AS ai_score, {TECH} AS technical_score, {MOM} AS momentum_score, {RISK} AS risk_score, {VAL} AS valuation_score, {FUND} AS fundamental_score,
       round(((prob_up - 0.5) * 2.0E0 * 0.012E0 * 100 + coalesce(ret_5d * 0.05E0, 0) + coalesce(ret_10d * 0.025E0, 0)) * 100, 2) / 100 AS expected_return_pct,
       round(-((atr_14 * 1.5E0 * 3) / "close") * 100, 2) AS downside_risk_pct,
       CASE WHEN atr_14 > 0 THEN greatest(atr_14 * 2, "close" * 0.015E0) ELSE "close" * 0.02E0 END AS room FROM cards0""",
    "cards0",
)
cte(
    "cards",
    f"""SELECT symbol, sector, date AS as_of, "close" AS last_close, prob_up, conf AS confidence, round(conf * 100, 1) AS confidence_pct, signal_rank,
       ai_score, technical_score, momentum_score, risk_score, valuation_score, fundamental_score,
       ai_score * 0.25E0 + technical_score * 0.2E0 + momentum_score * 0.15E0 + fundamental_score * 0.15E0 + valuation_score * 0.15E0 + risk_score * 0.1E0 AS overall,
       least({TREND1} + CASE WHEN sma_50_200_cross > 0 THEN 3 ELSE 0 END, 100) AS trend_strength, expected_return_pct, downside_risk_pct,
       CASE WHEN downside_risk_pct < 0 THEN round(expected_return_pct / abs(downside_risk_pct), 2) END AS rr_ratio,
       round(least(greatest(50 + (prob_up * 100 - 50) * (0.6E0 + 0.4E0 * conf), 5), 95), 1) AS win_probability_pct,
       {_clamp('50 + (least(greatest(50 + coalesce(smean, 0) * 1500, 0), 100) - 50) * 1.2E0')} AS sector_strength, {_clamp('exr * 100')} AS relative_strength,
       coalesce({_clamp('50 + (volume_ratio_20d - 1) * 50')}, 50) AS institutional_activity, coalesce({_clamp('50 + (volume_ratio_20d - 1) * 50')}, 50) AS delivery_volume_strength,
       fundamental_score AS earnings_growth_trend, {_clamp('fundamental_score - 5 + CASE WHEN ret_20d > 0 THEN 10 ELSE 0 END')} AS revenue_growth_trend,
       coalesce({_clamp('50 + dist_sma_200 * 200')}, 50) AS debt_quality,
       CASE WHEN {MONEY} > 5e9 THEN 95 WHEN {MONEY} > 1e9 THEN 80 WHEN {MONEY} > 5e8 THEN 65 WHEN {MONEY} > 1e8 THEN 50 WHEN {MONEY} > 5e7 THEN 35 WHEN {MONEY} IS NOT NULL THEN 20 ELSE 50 END AS liquidity_score,
       round("close", 2) AS entry_price, round("close" - room, 2) AS stop_loss, round("close" * 1.015E0, 2) AS target_1, round("close" * 1.03E0, 2) AS target_2,
       CASE WHEN room / "close" * 100 < 1.5 THEN 'Low' WHEN room / "close" * 100 < 2.5 THEN 'Medium' ELSE 'High' END AS risk_level,
       CASE WHEN prob_up > 0.55 THEN '10-20 sessions' WHEN prob_up < 0.45 THEN '1-3 sessions' ELSE '5-15 sessions' END AS holding_period FROM cards1""",
    "cards1",
)
SCORES = ["prob_up", "confidence", *S.WEIGHTS, "overall", "sector_strength", "relative_strength", "institutional_activity", "delivery_volume_strength", "earnings_growth_trend", "revenue_growth_trend", "debt_quality", "trend_strength"]
ROUNDED = ["confidence_pct", "expected_return_pct", "downside_risk_pct", "rr_ratio", "win_probability_pct", "liquidity_score"]
PLAN = "entry_price:f2 stop_loss:f2 target_1:f2 target_2:f2 risk_level holding_period"


def cards(m):
    return S.score_cards(today(m), m.sectors, signal(m))


@query("score_cards", "symbol sector as_of:d last_close:f9 signal_rank:i " + columns(SCORES, "f6") + " " + columns(ROUNDED, "f4"), "SELECT * FROM cards", ("cards",))
def score_cards(m):
    return cards(m)


@query("panel_score_cards", "symbol sector as_of:d last_close:f9 signal_rank:i " + columns(SCORES, "f6") + " " + columns(ROUNDED, "f4"), "SELECT * FROM cards", ("cards",))
def panel_score_cards(m):
    """The cards from a maintained panel: two refreshes, then the newest date alone is read."""
    panel = FeaturePanel(m.spark, work_folder(m.spark, "panel"))
    last = bars(m).agg(F.max("date")).first()[0]
    for batch, part in enumerate((F.col("date") < F.lit(last), F.col("date") == F.lit(last))):
        panel.refresh(bars(m).where(part), batch)
    ranked = K.latest_signal(panel.last_bars().withColumn("prob", m.probability(7919, 104729)))
    return S.score_cards(cross_section(stored(panel.today(), "today")), m.sectors, ranked)


@query("trade_plan", "symbol as_of:d " + PLAN, "SELECT * FROM cards", ("cards",))
def trade_plan(m):
    return cards(m)


@query(
    "score_summary",
    "n_symbols:i mean_overall:f6 bulls:i bears:i breadth_prob:f9 as_of:d",
    """SELECT count(*) AS n_symbols, avg(overall) AS mean_overall, count(*) FILTER (prob_up > 0.5) AS bulls, count(*) FILTER (prob_up IS NULL OR prob_up <= 0.5) AS bears,
       avg(prob_up) AS breadth_prob, max(as_of) AS as_of FROM cards""",
    ("cards",),
)
def score_summary(m):
    return S.score_summary(cards(m))


@query(
    "sector_summary",
    "sector avg_score:f6 n:i",
    "SELECT sector, avg(overall) AS avg_score, count(*) AS n FROM cards GROUP BY 1",
    ("cards",),
)
def sector_summary(m):
    return S.sector_summary(cards(m))


@query("sector_members", "sector symbol overall:f6", "SELECT * FROM cards", ("cards",))
def sector_members(m):
    return S.sector_members(cards(m))


ACTION = """CASE WHEN round(overall, 1) >= 75 AND prob_up >= 0.55 THEN 'STRONG BUY' WHEN round(overall, 1) >= 60 AND prob_up >= 0.52 THEN 'BUY' WHEN round(overall, 1) >= 45 AND prob_up >= 0.48 THEN 'HOLD'
  WHEN round(overall, 1) <= 30 AND prob_up <= 0.45 THEN 'STRONG SELL' ELSE 'SELL' END"""


@query(
    "screener",
    "symbol sector cmp:f9 signal action ai_score:f6 overall_score:f6 risk_reward:f2 risk_level entry_price:f2 stop_loss:f2 target_1:f2 target_2:f2 holding_period win_probability_pct:f2 as_of:d",
    f"""SELECT *, CASE WHEN action IN ('STRONG BUY', 'BUY') THEN 'UP' WHEN action = 'HOLD' THEN 'NEUTRAL' ELSE 'DOWN' END AS signal FROM (
        SELECT *, last_close AS cmp, overall AS overall_score, {ACTION} AS action, CASE WHEN entry_price > stop_loss AND target_1 > entry_price THEN round((target_1 - entry_price) / (entry_price - stop_loss), 2) END AS risk_reward
        FROM cards ORDER BY overall DESC, symbol LIMIT 10)""",
    ("cards",),
)
def screener(m):
    return S.screener(cards(m))


@query(
    "screener_up",
    "symbol overall_score:f6 action",
    f"SELECT symbol, overall AS overall_score, {ACTION} AS action FROM cards WHERE prob_up > 0.5 ORDER BY overall DESC, symbol LIMIT 5",
    ("cards",),
)
def screener_up(m):
    return S.screener(cards(m), "UP", 5)


def _bullet(tag: str, x: str, hi: float, lo: float, neutral: bool) -> str:
    rest = f"ELSE '{tag}:neutral'" if neutral else ""
    return f"CASE WHEN round({x}, 1) >= {hi} THEN '{tag}:bull' WHEN round({x}, 1) <= {lo} THEN '{tag}:bear' {rest} END"


@query(
    "reasoning",
    "symbol sector as_of:d action overall_score:f6 confidence_level confidence_pct:f2 bullets",
    "SELECT symbol, sector, as_of, CASE WHEN round(overall, 1) >= 70 THEN 'STRONG BUY' WHEN round(overall, 1) >= 60 THEN 'BUY' WHEN round(overall, 1) <= 30 THEN 'STRONG SELL' "
    "WHEN round(overall, 1) <= 40 THEN 'SELL' ELSE 'HOLD' END AS action, overall AS overall_score, CASE WHEN confidence_pct >= 30 THEN 'High' WHEN confidence_pct >= 10 THEN 'Moderate' ELSE 'Low' END AS confidence_level, "
    "confidence_pct, concat_ws(',', " + ", ".join(_bullet(t, x, hi, lo, n is not None) for t, x, hi, lo, (_, _, n) in S.REASONS) + ") AS bullets FROM cards",
    ("cards",),
)
def reasoning(m):
    shown = F.array_join(F.transform("bullets", lambda b: F.concat(b["tag"], F.lit(":"), b["tone"])), ",")
    return S.reasons(cards(m)).withColumn("bullets", shown)


TECH_COLS = ["ema_20", "ema_50", "ema_200", "sma_20", "sma_50", "sma_200", "rsi_14", "macd", "macd_hist", "stoch_k", "stoch_d", "adx", "plus_di", "minus_di", "atr_14", "bb_upper", "bb_lower", "bb_position", "volume_surge", "relative_strength_rank_pct", "volume_rank_pct", "target_52w_pct", "dist_from_52w_low_pct", "downside_risk_pct", "change_pct"]
RANGES = ["high_20d", "low_20d", "support_2", "resistance_2", "high_52w", "low_52w"]


@query(
    "technicals",
    "symbol as_of:d last_close:f9 trend breakout " + columns(TECH_COLS, "f6") + " " + columns(RANGES, "f9"),
    """SELECT *, date AS as_of, "close" AS last_close, ("close" - pc) / pc * 100 AS change_pct, e20 AS ema_20, e50 AS ema_50, e200 AS ema_200, volume / avg_volume_20d AS volume_surge,
       CASE WHEN "close" > e20 AND "close" > e50 AND "close" > e200 THEN 'Strong Uptrend' WHEN "close" > e20 AND "close" > e50 THEN 'Uptrend'
         WHEN "close" <= e20 AND "close" <= e50 AND "close" <= e200 THEN 'Strong Downtrend' WHEN "close" <= e20 AND "close" <= e50 THEN 'Downtrend' ELSE 'Sideways' END AS trend,
       CASE WHEN high >= high_20d * 0.999 THEN 'Breaking 20d high' WHEN low <= low_20d * 1.001 THEN 'Breaking 20d low' ELSE 'Inside 20d range' END AS breakout,
       (high_52w - "close") / "close" * 100 AS target_52w_pct, ("close" - low_52w) / low_52w * 100 AS dist_from_52w_low_pct, -(atr_14 * 1.5 * 3 / "close") * 100 AS downside_risk_pct,
       (rank() OVER (ORDER BY excess_return) - 1) / count(excess_return) OVER () * 100 AS relative_strength_rank_pct,
       (rank() OVER (ORDER BY volume_ratio_20d) - 1) / count(volume_ratio_20d) OVER () * 100 AS volume_rank_pct FROM (
       SELECT *, max(high) OVER a AS high_52w, min(low) OVER a AS low_52w, max(high) OVER b AS resistance_2, min(low) OVER b AS support_2, max(high) OVER c AS high_20d, min(low) OVER c AS low_20d FROM cross_
       WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING), b AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING), c AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING))
       WHERE date = (SELECT max(date) FROM bars)""",
    ("cross_", "bars"),
)
def technicals(m):
    return K.technicals(today(m), bars(m))


@query(
    "market_dashboard",
    "breadth_prob:f9 advancers:i decliners:i unchanged:i index_value:f8 n_symbols:i mean_overall:f6 bulls:i bears:i sentiment regime",
    """SELECT b AS breadth_prob, a.*, index_value, c.*, CASE WHEN b >= 0.55 THEN 'Bullish' WHEN b <= 0.45 THEN 'Bearish' ELSE 'Neutral' END AS sentiment,
       CASE WHEN b >= 0.55 THEN 'Risk-On' WHEN b <= 0.45 THEN 'Risk-Off' ELSE 'Range-Bound' END AS regime FROM (SELECT avg(prob_up) AS b FROM sig),
       (SELECT count(*) FILTER (change_percent > 0) AS advancers, count(*) FILTER (change_percent < 0) AS decliners, count(*) FILTER (change_percent IS NULL OR change_percent = 0) AS unchanged FROM quotes) a,
       (SELECT avg("close") AS index_value FROM bars WHERE date = (SELECT max(date) FROM bars)),
       (SELECT count(*) AS n_symbols, avg(overall) AS mean_overall, count(*) FILTER (prob_up > 0.5) AS bulls, count(*) FILTER (prob_up <= 0.5) AS bears FROM cards) c""",
    ("sig", "quotes", "bars", "cards"),
)
def market_dashboard(m):
    return K.dashboard(bars(m), signal(m), S.score_summary(cards(m)))


@query(
    "kpi_header",
    "as_of:d stocks_scanned:i winning_signals_pct:f6 avg_return_pct:f8 success_rate_pct:f7",
    """SELECT max(as_of) AS as_of, count(*) AS stocks_scanned, avg(prob_up) * 100 AS winning_signals_pct, (SELECT avg(gross_spread) * 100 FROM ls) AS avg_return_pct,
       (SELECT avg((pred = actual)::int) * 100 FROM preds) AS success_rate_pct FROM cards""",
    ("cards", "ls", "preds"),
)
def kpi_header(m):
    m.bars = bars(m)
    p = stored(m.predictions.select("date", "symbol", "next_ret", "actual", "prob", "pred"), "preds")
    return K.headline(cards(m), significance(p), long_short_daily(p, COST))
