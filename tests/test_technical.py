import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from data import bars, business_days, price_frame, to_pandas
from tickloom.functions.smoothing import _blocks, smooth, span, wilder
from tickloom.operators import technical as T


@pytest.fixture(scope="module")
def pdf():
    return price_frame()


@pytest.fixture(scope="module")
def panel(spark, pdf):
    return to_pandas(T.feature_panel(bars(spark, pdf)), "symbol", "date")


def one(pdf, symbol="AAA"):
    return pdf[pdf.symbol == symbol].reset_index(drop=True)


def same(got, want, tol=1e-9):
    got, want = np.asarray(got, dtype=float), np.asarray(want, dtype=float)
    assert (np.isnan(got) == np.isnan(want)).all()
    np.testing.assert_allclose(got, want, rtol=tol, atol=tol, equal_nan=True)


def wilder_mean(x, n=14):
    return x.ewm(alpha=1 / n, min_periods=n, adjust=False).mean()


@pytest.mark.parametrize("symbol", ["AAA", "BBB"])
def test_against_pandas(panel, pdf, symbol):
    p, got = one(pdf, symbol), one(panel, symbol)
    c = p.close
    for d in T.HORIZONS:
        same(got[f"ret_{d}d"], c.pct_change(d))
        same(got[f"log_ret_{d}d"], np.log(c / c.shift(d)))
    for n in T.AVERAGES:
        same(got[f"sma_{n}"], c.rolling(n).mean())
    for n in (12, 26):
        same(got[f"ema_{n}"], c.ewm(span=n, adjust=False).mean())
    line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    signal = line.ewm(span=9, adjust=False).mean()
    same(got.macd_hist, (line - signal) / c)
    move = c.diff()
    gain, loss = wilder_mean(move.clip(lower=0)), wilder_mean(-move.clip(upper=0))
    same(got.rsi_14, (100 - 100 / (1 + gain / loss)).fillna(100))
    tr = pd.concat([p.high - p.low, (p.high - c.shift()).abs(), (p.low - c.shift()).abs()], axis=1).max(axis=1)
    same(got.atr_14, wilder_mean(tr))
    up, down = p.high.diff().clip(lower=0), (-p.low.diff()).clip(lower=0)
    plus = up.where(~(up < down), 0.0)
    minus = down.where(~(down < plus), 0.0)
    pdi, mdi = 100 * wilder_mean(plus) / wilder_mean(tr), 100 * wilder_mean(minus) / wilder_mean(tr)
    same(got.plus_di, pdi)
    same(got.adx, wilder_mean(100 * (pdi - mdi).abs() / (pdi + mdi)), 1e-8)
    same(got.volatility_20d, c.pct_change().rolling(20).std(ddof=0))
    mid, sd = c.rolling(20).mean(), c.rolling(20).std(ddof=0)
    same(got.bb_position, (c - (mid - 2 * sd)) / (4 * sd), 1e-7)
    width = 4 * sd / mid
    same(got.bb_squeeze, (width < width.rolling(20).quantile(0.1)).astype(float))
    k = (100 * (c - p.low.rolling(14).min()) / (p.high.rolling(14).max() - p.low.rolling(14).min())).clip(0, 100)
    same(got.stoch_k, k, 1e-8)
    same(got.stoch_d, k.rolling(3).mean(), 1e-8)
    obv = (np.sign(c.diff()).fillna(0) * p.volume).cumsum()
    same(got.obv, obv)
    same(got.obv_normalised, obv / obv.rolling(20).std(ddof=0), 1e-7)
    top, floor = c.rolling(252).max(), c.rolling(252).min()
    same(got.pct_52w_range, (c - floor) / (top - floor))


def test_ranges_and_missing(panel):
    assert panel.rsi_14.between(0, 100).all()
    assert panel.stoch_k.dropna().between(0, 100).all()
    assert (panel.atr_14.dropna() >= 0).all()
    numbers = panel.select_dtypes("number")
    assert not np.isinf(numbers.to_numpy(dtype=float)).any()
    assert panel.groupby("symbol").target_direction.apply(lambda s: s.isna().sum()).eq(1).all()


def test_no_nan_is_stored(spark, pdf):
    out = T.feature_panel(bars(spark, pdf))
    doubles = [f.name for f in out.schema.fields if f.dataType.simpleString() == "double"]
    row = out.agg(*[F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in doubles]).first()
    assert not any(row)


def test_symbols_do_not_mix(spark, pdf, panel):
    alone = to_pandas(T.feature_panel(bars(spark, one(pdf, "BBB"))), "symbol", "date")
    pd.testing.assert_frame_equal(alone, one(panel, "BBB"), rtol=1e-12)


def test_rsi_extremes(spark):
    days = business_days(40)
    rows = []
    for s, step in (("UP", 1.0), ("DOWN", -1.0)):
        close = 100 + step * np.arange(40)
        rows.append(pd.DataFrame(dict(date=days, symbol=s, open=close, high=close + 1, low=close - 1, close=close, volume=1e6)))
    got = to_pandas(T.indicators(bars(spark, pd.concat(rows)), "rsi"), "symbol", "date")
    assert got[got.symbol == "UP"].rsi_14.eq(100).all()
    assert got[got.symbol == "DOWN"].rsi_14.iloc[20:].abs().max() < 1e-9
    assert got[got.symbol == "DOWN"].rsi_14.iloc[:13].eq(100).all()  # warm-up


def test_labels(spark):
    def labels(prices, h=1):
        days = business_days(len(prices))
        p = pd.DataFrame(dict(date=days, symbol="X", open=prices, high=prices, low=prices, close=prices, volume=1.0)).astype(
            {c: float for c in ("open", "high", "low", "close")}
        )
        got = to_pandas(T.label(bars(spark, p), h, "y"), "date").y
        return [None if pd.isna(v) else int(v) for v in got]

    assert labels([1, 2, 3]) == [1, 1, None]
    assert labels([3, 2, 1]) == [0, 0, None]
    assert labels([1, 1, 1]) == [0, 0, None]
    assert labels([1, 5, 2, 3], 2) == [1, 0, None, None]
    with pytest.raises(ValueError):
        T.label(bars(spark, price_frame(("A",), 3)), 0)


def test_compact_set(spark, pdf):
    got = T.model_ready(bars(spark, pdf))
    assert len(T.COMPACT) == 18 and set(T.COMPACT) <= set(got.columns)
    assert got.dropna().count() == got.count() > 400


@pytest.mark.parametrize("alpha", [span(9), span(50), span(200), wilder(14), 0.5, 0.9])
def test_smoothing_over_many_blocks(spark, alpha):
    n = 9000
    x = np.random.default_rng(3).normal(100, 5, n)
    x[:3] = np.nan
    frame = pd.DataFrame(dict(symbol="X", date=np.arange(n), x=x))
    df = spark.createDataFrame(frame).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = to_pandas(smooth(df, {"y": ("x", alpha, 5)}), "date").y
    want = pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=5).mean()
    same(got, want, 1e-11)


def test_blocks_keep_powers_finite():
    for size, members in _blocks([span(9), span(200), wilder(14), 0.9]):
        for i in members:
            a = [span(9), span(200), wilder(14), 0.9][i]
            assert np.isfinite((1 - a) ** -float(size)) and (1 - a) ** size < 1e-17
