import datetime as dt

import pytest
from pyspark.sql import functions as F

from data import bars, price_frame, to_pandas
from tickloom.functions.scalar import finite_columns
from tickloom.operators import market as K
from tickloom.operators import quality
from tickloom.operators import scoring as S
from tickloom.operators import technical as T
from tickloom.operators import walkforward as W
from tickloom.operators.cross import cross_section, with_sector
from tickloom.session import stored
from tickloom.sources import sinks

D = dt.date


@pytest.fixture(scope="module")
def history(spark):
    return bars(spark, price_frame(("AAA", "BBB", "CCC", "DDD"), 300)).cache()


@pytest.fixture(scope="module")
def cards(spark, history):
    today = cross_section(stored(S.latest_rows(T.indicators(history))))
    sectors = spark.createDataFrame([("AAA", "IT"), ("BBB", "IT"), ("CCC", "Banks")], "symbol string, sector string")
    signal = spark.createDataFrame([("AAA", 0.7, 1), ("BBB", 0.5, 2), ("CCC", 0.3, 3)], "symbol string, prob_up double, signal_rank int")
    return S.score_cards(today, sectors, signal).cache()


def test_cards(cards):
    rows = {r.symbol: r for r in cards.collect()}
    assert rows["DDD"].sector == "Other" and rows["DDD"].ai_score == 50.0 and rows["DDD"].data_limited == ["model_prob_up"]
    assert rows["AAA"].ai_score == pytest.approx(50 + 20 * (0.5 + 0.4)) and rows["AAA"].data_limited == []
    for r in rows.values():
        assert all(0 <= r[c] <= 100 for c in [*S.WEIGHTS, "overall", "trend_strength", "relative_strength"])
        assert r.stop_loss < r.entry_price < r.target_1 < r.target_2
    assert rows["AAA"].holding_period == "10-20 sessions" and rows["CCC"].holding_period == "1-3 sessions"


def test_cards_without_history_are_neutral(spark):
    """Unknown inputs give no points."""
    names = "dist_sma_20 dist_sma_50 dist_sma_200 rsi_14 macd_hist adx bb_position sma_20_50_cross sma_50_200_cross ret_5d ret_10d ret_20d volume_ratio_20d obv_normalised volatility_20d volatility_50d atr_14 close"
    row = spark.range(1).select(*[F.lit(None).cast("double").alias(n) for n in names.split()])
    scores = [S.technical_score(), S.momentum_score(), S.risk_score(), S.valuation_score(), S.fundamental_score()]
    assert list(row.select(*[s.alias(f"s{i}") for i, s in enumerate(scores)]).first()) == [50.0] * 5


def test_nested_cards_and_json(cards, spark, tmp_path):
    nested = S.nested_cards(cards)
    row = nested.where("symbol = 'AAA'").first()
    assert row.scores.overall == round(row.scores.overall, 1) and row.trade_plan.risk_level in ("Low", "Medium", "High")
    sinks.write_tables(nested, str(tmp_path / "cards"), ("parquet", "json"))
    back = spark.read.schema(nested.schema).json(str(tmp_path / "cards" / "json"))
    assert back.where("symbol = 'AAA'").first() == row
    sinks.write_metadata(spark, str(tmp_path / "meta"), {"rows": 4})
    assert spark.read.text(str(tmp_path / "meta")).first()[0] == '{"rows": 4}'


def test_screener_and_reasons(cards):
    up, down, every = (S.screener(cards, d).collect() for d in ("UP", "DOWN", "ALL"))
    assert [r.symbol for r in up] == ["AAA"]
    assert {r.symbol for r in down} == {"CCC", "DDD"}  # no probability counts as 0 here
    assert [r.overall_score for r in every] == sorted((r.overall_score for r in every), reverse=True)
    for r in S.reasons(cards).collect():
        tags = [b.tag for b in r.bullets]
        assert tags[0] == "TREND" and tags[-1] == "AI MODEL" and len(tags) == len(set(tags))
    s = S.score_summary(cards).first()
    assert (s.n_symbols, s.bulls, s.bears) == (4, 1, 3) and s.breadth_prob == pytest.approx(0.5)


@pytest.mark.parametrize("overall, prob, want", [(80, 0.6, "STRONG BUY"), (65, 0.53, "BUY"), (50, 0.5, "HOLD"), (25, 0.4, "STRONG SELL"), (25, 0.5, "SELL"), (80, 0.4, "SELL")])
def test_action_ladder(spark, overall, prob, want):
    assert spark.range(1).select(S.action_label(F.lit(overall), F.lit(prob))).first()[0] == want


def test_quotes_use_the_market_session(spark):
    """The previous session is global: a symbol that missed it has no change."""
    rows = [(D(2024, 1, 2), "A", 10.0), (D(2024, 1, 3), "A", 11.0), (D(2024, 1, 4), "A", 12.0), (D(2024, 1, 2), "B", 5.0), (D(2024, 1, 4), "B", 6.0), (D(2024, 1, 3), "C", 7.0)]
    df = spark.createDataFrame([(d, s, c, c, c, c, 1.0) for d, s, c in rows], "date date, symbol string, open double, high double, low double, close double, volume double")
    got = {r.symbol: (r.last, r.prev_close, r.change) for r in K.quotes(df).collect()}
    assert got == {"A": (12.0, 11.0, 1.0), "B": (6.0, None, None)}
    a = K.advance_decline(df).first()
    assert (a.advancers, a.decliners, a.unchanged) == (1, 0, 1)
    single = K.quotes(df.where("date = '2024-01-02'")).collect()
    assert all(r.change is None for r in single)


def test_pages_and_technicals(history):
    page = {r.symbol: r for r in K.symbol_pages(history).collect()}["AAA"]
    closes = to_pandas(history.where("symbol = 'AAA'"), "date").close
    assert page.last_close == closes.iloc[-1] and page.sma_20 == pytest.approx(closes.tail(20).mean())
    assert page.high_52w == closes.tail(252).max() and len(page.history) == 30
    today = cross_section(stored(S.latest_rows(T.indicators(history))))
    row = {r.symbol: r for r in K.technicals(today, history).collect()}["AAA"]
    assert row.ema_50 == pytest.approx(closes.ewm(span=50, adjust=False).mean().iloc[-1])
    assert row.trend in ("Strong Uptrend", "Uptrend", "Sideways", "Downtrend", "Strong Downtrend")


def test_cleaning_helpers(spark, history):
    df = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), 2.0), (3.0, None)], "a double, b double")
    assert [tuple(r) for r in finite_columns(df).collect()] == [(None, 1.0), (None, 2.0), (3.0, None)]
    empty = spark.createDataFrame([(None, None), (1.0, None)], "a double, b double")
    assert quality.drop_empty_rows(empty, ["a", "b"]).count() == 1
    panel = quality.described(T.feature_panel(history), [("rsi_14", "mine", "own words")]).select("date", "rsi_14", F.col("symbol"), "target_direction", "adx")
    names = {r["name"]: (r["position"], r["category"]) for r in quality.column_catalogue(panel).collect()}
    assert names == {"date": (0, "key"), "rsi_14": (1, "mine"), "symbol": (2, "key"), "target_direction": (3, "label"), "adx": (4, "trend")}
    names = {r["name"]: r["category"] for r in quality.column_catalogue(quality.described(T.feature_panel(history))).collect()}
    assert "other" not in names.values()
    assert names["rsi_14"] == "momentum" and names["target_direction"] == "label" and len(names) > 85
    sized = with_sector(history, spark.createDataFrame([("AAA", "IT")], "symbol string, sector string"))
    assert sized.where("sector = 'Other'").count() == 900


def test_sparse_blocks(history):
    dense, sparse = W.retrain_blocks(history, 100, 50), W.retrain_blocks(history, 100, 50, 1)
    assert [b.train_end for b in dense] == [b.train_end for b in sparse] and len(dense) == 4
    assert all(a.test_end < b.test_end for a, b in zip(sparse, dense))
    assert W.retrain_blocks(history, 1000) == []
