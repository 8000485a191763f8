import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from data import bars, business_days, price_frame, to_pandas
from tickloom.functions import rolling as R
from tickloom.functions.costs import CostRates, round_trip_fraction, round_trip_pct
from tickloom.functions.scalar import in_market_hours, in_session
from tickloom.functions.text import mentions, sector_of, sentiment
from tickloom.operators import audit, dedup, fundamentals, quality
from tickloom.operators.asof import asof
from tickloom.operators.metrics import exact_quantiles
from tickloom.operators.options import max_pain
from tickloom.operators.ranking import percent_ranks, row_numbers
from tickloom.operators.registry import Feature, Registry, default_registry, exogenous_features

D = dt.date


# --- ranks -----------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """One date holds a third of the rows and one value a third of that date's rows."""
    rng = np.random.default_rng(5)
    n = 3000
    day = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    value = np.where(rng.random(n) < 0.3, 0.25, rng.normal(0, 1, n).round(2))
    value[rng.random(n) < 0.05] = np.nan
    pdf = pd.DataFrame(dict(g=day, v=value, k=[f"K{i:05d}" for i in range(n)]))
    return pdf, spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def test_percent_ranks(skewed):
    pdf, df = skewed
    got = to_pandas(percent_ranks(df, ["g"], {"r": "v"}), "k")
    np.testing.assert_allclose(got.r, pdf.sort_values("k").groupby("g").v.rank(pct=True), equal_nan=True)


def test_strict_ranks(skewed):
    pdf, df = skewed
    got = to_pandas(percent_ranks(df, ["g"], {"r": "v"}, strict=True), "k")
    want = (pdf.groupby("g").v.rank(method="min") - 1) / pdf.groupby("g").v.transform("count")
    np.testing.assert_allclose(got.r, want, equal_nan=True)


def test_row_numbers_are_a_permutation(skewed):
    pdf, df = skewed
    got = row_numbers(df, "v", "k").toPandas().sort_values("rank")
    assert got["rank"].tolist() == list(range(1, len(pdf) + 1))
    want = pdf.assign(nv=-pdf.v).sort_values(["nv", "k"], na_position="last")
    assert got.k.tolist() == want.k.tolist()


def test_exact_quantiles(skewed):
    pdf, df = skewed
    row = exact_quantiles(df, "v", {"a": 0.1, "b": 1 / 3, "c": 0.5, "d": 0.999}).first()
    np.testing.assert_allclose([row.a, row.b, row.c, row.d], pdf.v.quantile([0.1, 1 / 3, 0.5, 0.999]), rtol=1e-12)


# --- rolling ---------------------------------------------------------------


def test_rolling_against_pandas(spark):
    pdf = price_frame(("A",), 120)
    w = R.series()
    df = bars(spark, pdf).withColumn("no", F.row_number().over(w))
    out = df.withColumns(
        {
            "q": R.quantile("close", 0.7, w, 30, 10),
            "rk": R.rank_pct("volume", w, 20, 10),
            "cr": R.correlation("close", "volume", w, 20, 10),
            "sl": R.slope("close", "no", w, 20),
            "z": R.zscore("close", w, 20, 10),
        }
    )
    got, c, v = to_pandas(out, "date"), pdf.close, pdf.volume
    np.testing.assert_allclose(got.q, c.rolling(30, min_periods=10).quantile(0.7), equal_nan=True)
    np.testing.assert_allclose(got.rk, v.rolling(20, min_periods=10).rank(pct=True), equal_nan=True)
    np.testing.assert_allclose(got.cr, c.rolling(20, min_periods=10).corr(v), equal_nan=True, rtol=1e-6)
    slopes = c.rolling(20).apply(lambda y: np.polyfit(np.arange(20), y, 1)[0], raw=True)
    np.testing.assert_allclose(got.sl, slopes, equal_nan=True, rtol=1e-8)
    z = (c - c.rolling(20, min_periods=10).mean()) / c.rolling(20, min_periods=10).std(ddof=0)
    np.testing.assert_allclose(got.z, z, equal_nan=True, rtol=1e-7)


# --- as-of -----------------------------------------------------------------


def test_asof_against_pandas(spark):
    rng = np.random.default_rng(2)
    days = business_days(60)
    left = pd.DataFrame([(d, s) for d in days for s in ("A", "B")], columns=["date", "symbol"])
    right = pd.DataFrame([(d, s, rng.random()) for d in days[5::7] for s in ("A", "B")], columns=["date", "symbol", "v"])
    l, r = spark.createDataFrame(left, "date date, symbol string"), spark.createDataFrame(right, "date date, symbol string, v double")
    as_time = lambda p: p.assign(date=pd.to_datetime(p.date)).sort_values("date")
    for inclusive in (True, False):
        got = to_pandas(asof(l, r, ["symbol"], ["v"], inclusive=inclusive), "date", "symbol")
        want = pd.merge_asof(as_time(left), as_time(right), on="date", by="symbol", allow_exact_matches=inclusive)
        np.testing.assert_allclose(got.v, want.sort_values(["date", "symbol"]).v, equal_nan=True)


# --- dedup, quality --------------------------------------------------------


def test_dedup_and_upsert(spark):
    rows = spark.createDataFrame([("A", D(2024, 1, 1), 5e6, 10.0), ("A", D(2024, 1, 1), 1.0, 11.0)], "symbol string, date date, volume double, close double")
    assert dedup.keep_highest_volume(rows).first().close == 10.0
    old = spark.createDataFrame([("t1", 1), ("t2", 2)], "timestamp string, px int")
    new = spark.createDataFrame([("t2", 99), ("t3", 3)], "timestamp string, px int")
    merged = dedup.upsert(old, new, ["timestamp"])
    assert sorted(map(tuple, merged.collect())) == [("t1", 1), ("t2", 99), ("t3", 3)]
    again = dedup.upsert(merged, new, ["timestamp"])
    assert again.count() == 3
    stats = dedup.upsert_stats(old, new, ["timestamp"], "timestamp").first()
    assert (stats.new_rows, stats.replaced, stats.total) == (2, 1, 3)


def test_quality_rules_run_in_order(spark):
    d = D(2024, 1, 1)
    rows = [
        (None, "A", 1.0, 1.0, 1.0, 1.0, 1.0, 1),
        (d, "B", -1.0, 1.0, 1.0, 1.0, 1.0, 2),
        (d, "C", 1.0, 1.0, 2.0, 1.0, 1.0, 3),
        (d, "D", 3.0, 2.0, 1.0, 1.0, 1.0, 4),
        (d, "E", 1.0, 2.0, 1.0, 1.0, -1.0, 5),
        (d, "F", 1.0, 2.0, 1.0, 1.0, 1.0, 6),
        (d, "F", 1.0, 2.0, 1.0, 1.5, 1.0, 7),
    ]
    df = spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, volume double, seq long")
    report = quality.quality_report(df).first().asDict()
    assert report["rows_before"] == 7 and report["rows_after"] == 1 and report["duplicate_removed"] == 1
    assert all(report[f"{r}_removed"] == 1 for r in quality.RULES)
    assert quality.clean_bars(df, "seq").first().close == 1.5


def test_coverage_and_freshness(spark):
    b = bars(spark, price_frame(("A",), 10))
    row = quality.calendar_coverage(b, "2020-01-01", "2020-01-31").first()
    assert row.missing_business_days == 13
    assert quality.freshness(b, "2020-01-18").first().age_days == 3  # Saturday counts as Friday
    with pytest.raises(ValueError):
        quality.require_columns(b, ["close", "iv"])
    with pytest.raises(ValueError):
        quality.feature_columns(b.withColumn("target_direction", F.lit(1.0)), {"volume"}, {"target_direction"})


# --- look-ahead ------------------------------------------------------------


def sidecar(spark, n=30):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(dict(date=business_days(n), fii_net_cr=rng.normal(0, 5, n), india_vix=rng.normal(15, 1, n), total_oi=rng.uniform(1, 2, n)))
    return spark.createDataFrame(pdf, "date date, fii_net_cr double, india_vix double, total_oi double")


def test_planted_leak_is_found(spark):
    side = sidecar(spark)
    panel = exogenous_features(bars(spark, price_frame(("A", "B"), 30)), side)
    audit.assert_no_lookahead(panel, ["fii_dii_net_flow", "india_vix_level", "oi_change_pct"])
    from tickloom.operators.calendar import by_date

    ahead = side.select("date", F.lead("fii_net_cr").over(by_date()).alias("planted"))
    with pytest.raises(AssertionError, match="planted"):
        audit.assert_no_lookahead(panel.join(ahead, "date", "left"), ["fii_dii_net_flow", "india_vix_level", "planted"])


def test_recomputed_features_do_not_depend_on_the_future(spark):
    side = sidecar(spark)
    b = bars(spark, price_frame(("A",), 30))
    cols = ["fii_dii_net_flow", "india_vix_change_5d", "oi_change_pct"]
    clean = audit.future_dependence(lambda s: exogenous_features(b, s), side, "2020-01-20", cols)
    assert all(r.n_changed == 0 for r in clean.collect())
    leaky = Registry()
    leaky.register(Feature("peek", lambda w: F.lead("fii_net_cr").over(w), ("fii_net_cr",)))
    found = audit.future_dependence(lambda s: exogenous_features(b, s, leaky), side, "2020-01-20", ["peek"])
    assert found.first().n_changed > 0


def test_registry():
    r = default_registry()
    total = r.total_lookback()
    with pytest.raises(ValueError):
        r.register(Feature("put_call_ratio", lambda w: F.lit(1), ()))
    r.enable("india_vix_change_5d", False)
    assert "india_vix_change_5d" not in r.names() and r.total_lookback() == total - 5


# --- text, options, costs, sessions ----------------------------------------


def test_sentiment(spark):
    df = spark.createDataFrame([("Profit SURGE, but risk!",), ("nothing here",), (None,), ("downgrade loss",), ("dividend dividend",)], "t string")
    assert [r[0] for r in df.select(sentiment("t")).collect()] == pytest.approx([1 / 3, 0.0, 0.0, -1.0, 1.0])


def test_mentions_match_whole_words(spark):
    docs = spark.createDataFrame([(1, "tcs and M&M, not TCSX"), (2, "Bajaj-Auto up; xM&My"), (3, "nothing")], "id int, text string")
    symbols = spark.createDataFrame([("TCS",), ("M&M",), ("BAJAJ-AUTO",), ("AUTO",), (" ",)], "symbol string")
    got = sorted(map(tuple, mentions(docs, symbols).collect()))
    assert got == [(1, "M&M"), (1, "TCS"), (2, "AUTO"), (2, "BAJAJ-AUTO")]


def test_sector_is_the_first_keyword(spark):
    df = spark.createDataFrame([("Steel and banks",), ("unity",), ("none",)], "t string")
    assert [r[0] for r in df.select(sector_of("t")).collect()] == ["Banks", "IT", None]


def test_max_pain_against_pair_loop(spark):
    rng = np.random.default_rng(4)
    rows = [
        ("N", D(2024, 1, 1), D(2024, 1, 25 if near else 28), float(k), t, float(rng.integers(1, 50)))
        for near in (1, 0)
        for k in range(90, 115, 5)
        for t in ("CE", "PE")
    ]
    schema = "symbol string, date date, expiry date, strike double, option_type string, open_interest double"
    chain = spark.createDataFrame(rows, schema)
    near = [r for r in rows if r[2] == D(2024, 1, 25)]

    def pain(k, per_strike):
        calls = [(r[5], k - r[3]) for r in near if r[4] == "CE" and r[3] <= k]
        puts = [(r[5], r[3] - k) for r in near if r[4] == "PE" and r[3] >= k]
        if per_strike:
            return sum(o * x for o, x in calls + puts)
        return sum(sum(o for o, _ in side) * sum(x for _, x in side) for side in (calls, puts))

    for mode, per in (("reference", False), ("per_strike", True)):
        row = max_pain(chain, mode).first()
        best = min(range(90, 115, 5), key=lambda k: (pain(k, per), k))
        assert row.max_pain == best and row.min_pain == pytest.approx(pain(best, per))


def test_costs(spark, monkeypatch):
    base = CostRates()
    assert round_trip_fraction(base) == pytest.approx((0.03 + 2 * 0.00335) * 1.18 / 100 + (0.025 + 0.015 + 0.1) / 100)
    assert CostRates.load({"costs": {"brokerage_pct": "0.1", "stt_sell_pct": "bad"}}).brokerage_pct == 0.1
    monkeypatch.setenv("TICKLOOM_COST_SLIPPAGE_BPS_PER_SIDE", "0")
    assert CostRates.load().slippage_bps_per_side == 0
    zero = CostRates(*[0.0] * 8)
    assert round_trip_fraction(zero) == 0
    row = spark.range(1).select(
        round_trip_pct(base).alias("a"), round_trip_pct(base, 1.0, F.lit(1000.0)).alias("b"), round_trip_pct(base, 1.0, F.lit(1e6), F.lit(1e6)).alias("c")
    ).first()
    assert row.a == pytest.approx(100 * round_trip_fraction(base)) and row.c == pytest.approx(row.a)
    assert row.b - row.a == pytest.approx((2.0 - 0.03) * 1.18)


def test_session_hours(spark):
    times = ["2024-01-05 09:15:00", "2024-01-05 15:30:00", "2024-01-05 15:30:01", "2024-01-05 09:14:59", "2024-01-06 10:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.to_timestamp("t").alias("ts"))
    assert [r[0] for r in df.select(in_session("ts")).collect()] == [True, True, False, False, True]
    assert [r[0] for r in df.select(in_market_hours("ts")).collect()] == [True, True, False, False, False]
    utc = spark.createDataFrame([("2024-01-05 03:45:00",)], "t string").select(F.to_timestamp("t").alias("ts"))
    assert utc.select(in_market_hours("ts", "Asia/Kolkata")).first()[0]


def test_fundamentals_keep_reports_of_closed_days(spark):
    b = bars(spark, price_frame(("A",), 10))  # starts Wednesday 2020-01-01
    reports = spark.createDataFrame([("A", D(2020, 1, 4), 20.0, 1.0), ("A", D(2020, 1, 8), None, 2.0)], "symbol string, date date, pe_ratio double, roe double")
    got = to_pandas(fundamentals.fundamental_features(b, reports), "date")
    assert got.pe_ratio.isna().sum() == 3 and got.pe_ratio.iloc[-1] == 20.0 and got.roe.iloc[-1] == 2.0
    assert got.f_score_proxy.tolist()[:3] == [0, 0, 0] and got.f_score_proxy.iloc[-1] == 1


def test_packed_days_round_trip(spark):
    from tickloom.operators.bars import pack_day, unpack_day

    rows = [(0, D(1, 1, 1)), (7, D(1969, 12, 31)), (2_000_000_000, D(9999, 12, 31)), (24, D(1998, 6, 1))]
    df = spark.createDataFrame(rows, "id int, d date").select("id", "d", pack_day(F.col("id"), F.col("d")).alias("k"))
    symbol, date = unpack_day(F.col("k"))
    assert df.where((symbol != F.col("id")) | (date != F.col("d"))).count() == 0
    assert df.select("k").distinct().count() == len(rows)


def test_bars_break_ties_by_price(spark):
    from tickloom.operators.bars import roll_up

    rows = [("A", 1, 5.0, 1.0), ("A", 1, 3.0, 1.0), ("A", 2, 9.0, 1.0), ("A", 2, 4.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, seq int, px double, qty double").withColumn("part", F.lit(0))
    for shuffled in (df, df.orderBy(F.desc("px")), df.repartition(4)):
        r = roll_up(shuffled, ["symbol"], ["seq", "part"]).first()
        assert (r.open, r.high, r.low, r.close, r.volume) == (3.0, 9.0, 3.0, 9.0, 4.0)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("each", [True, False])
def test_asof_of_any_key(spark, by, inclusive, each):
    """Ties, nulls, a hot key, a hot time, parts that begin inside a series; against a loop."""
    rng = np.random.default_rng(5)
    left = [(i, "a" if i % 3 else "b", None if i % 41 == 0 else (700 if i % 4 == 0 else int(rng.integers(0, 1000)))) for i in range(600)] + [(900, None, 500)]
    right = [("a" if i % 5 else "b", None if i % 37 == 0 else int(rng.integers(0, 1000)), None if i % 6 == 0 else i, None if i % 4 == 0 else -i) for i in range(60)] + [(None, 100, 7, 7)]
    lhs = spark.createDataFrame(left, "id int, k string, t int")
    rhs = spark.createDataFrame(right, "k string, u int, x int, y int")
    got = {r.id: (r.x, r.y) for r in asof(lhs, rhs, by, ["x", "y"], on="t", right_on="u", inclusive=inclusive, each_column=each).collect()}

    def low(v):
        return tuple((x is not None, x or 0) for x in v)

    for i, k, t in left:
        marks = {}
        for rk, u, x, y in right:
            if u is not None and t is not None and (not by or rk == k) and (u < t or inclusive and u == t):
                marks[u] = max(marks.get(u, (x, y)), (x, y), key=low)
        order = [marks[u] for u in sorted(marks)]
        if each:
            want = tuple(next((m[c] for m in reversed(order) if m[c] is not None), None) for c in (0, 1))
        else:
            want = order[-1] if order else (None, None)
        assert got[i] == want, (i, k, t)
    assert len(got) == len(left)
