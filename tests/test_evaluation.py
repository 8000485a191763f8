import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from data import bars, business_days, price_frame, to_pandas
from tickloom.operators import metrics as M
from tickloom.operators import portfolio as P
from tickloom.operators import technical as T
from tickloom.operators import walkforward as W

SCHEMA = "date date, symbol string, prob double, next_ret double, actual int, pred int"


def frame(n_days=30, n_symbols=20, seed=3, ties=True):
    rng = np.random.default_rng(seed)
    rows = []
    for d in business_days(n_days):
        for i in range(n_symbols):
            if rng.random() < 0.1:
                continue
            p = rng.uniform(0.3, 0.7)
            r = rng.normal(0.0005, 0.01)
            rows.append((d, f"SYM{i:03d}", round(p, 2) if ties else p, r, int(r > 0)))
    pdf = pd.DataFrame(rows, columns=["date", "symbol", "prob", "next_ret", "actual"])
    return pdf.assign(pred=(pdf.prob >= 0.5).astype(int))


@pytest.fixture(scope="module")
def pdf():
    return frame()


@pytest.fixture(scope="module")
def preds(spark, pdf):
    return spark.createDataFrame(pdf, SCHEMA).cache()


# --- metrics ---------------------------------------------------------------


def pair_auc(pdf):
    pos, neg = pdf[pdf.actual == 1].prob.to_numpy(), pdf[pdf.actual == 0].prob.to_numpy()
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_auc_against_pair_count(preds, pdf):
    assert M.roc_auc(preds, []).first().roc_auc == pytest.approx(pair_auc(pdf), abs=1e-12)
    one = preds.where("actual = 1")
    assert M.roc_auc(one, []).first().roc_auc is None


def test_classification(preds, pdf):
    row = M.classification(preds, []).first()
    assert row.n == len(pdf) and row.tp + row.fp + row.tn + row.fn == row.n
    assert row.accuracy == pytest.approx((pdf.actual == pdf.pred).mean())
    assert row.brier_score == pytest.approx(((pdf.prob - pdf.actual) ** 2).mean())
    none = M.classification(preds.withColumn("pred", F.lit(0)), []).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.0, 0), (0.1, 1), (0.1000001, 1), (0.3, 0), (1.0, 1)], "prob double, actual int")
    got = {r.bin: r.n for r in M.calibration(df).collect()}
    assert got == {1: 2, 2: 1, 3: 1, 10: 1}


def test_sweep_against_loop(preds, pdf):
    got = {round(r.threshold, 6): r.accuracy for r in M.threshold_sweep(preds).collect()}
    for t in M.THRESHOLDS:
        assert got[round(t, 6)] == pytest.approx(((pdf.prob >= t).astype(int) == pdf.actual).mean())
    best = M.best_threshold(M.threshold_sweep(preds)).first()
    top = max(got.values())
    assert best.threshold == pytest.approx(min(t for t, a in got.items() if a == pytest.approx(top)))


def test_terciles(preds, pdf):
    got = {r.tercile: r.n for r in M.terciles(preds, "next_ret").collect()}
    want = pd.qcut(pdf.prob, 3, labels=["low", "mid", "high"]).value_counts().to_dict()
    assert got == want


def test_mcnemar_names(spark):
    rows = [(1, 0.6, 0.4), (1, 0.4, 0.6), (1, 0.4, 0.7), (0, 0.4, 0.4)]
    df = spark.createDataFrame(rows, "actual int, prob_base double, prob_ext double")
    row = M.mcnemar(df).first()
    assert (row.b_base_only, row.c_ext_only) == (1, 2) and row.z_mcnemar == pytest.approx(1 / np.sqrt(3))


def test_bootstrap_interval(preds, pdf):
    row = M.bootstrap_accuracy(preds).first()
    acc = (pdf.actual == pdf.pred).mean()
    se = np.sqrt(acc * (1 - acc) / len(pdf))
    assert row.lower < acc < row.upper
    assert row.upper - row.lower == pytest.approx(2 * 1.96 * se, rel=0.15)
    assert M.bootstrap_accuracy(preds).first() == row  # seeded


def test_alarm_and_pairs(preds):
    M.sanity_alarm(0.52, 0.53)
    with pytest.raises(ValueError):
        M.sanity_alarm(0.61, 0.5)
    M.check_pairs(M.paired(preds, preds))
    with pytest.raises(ValueError):
        M.check_pairs(M.paired(preds, preds.unionByName(preds.limit(3))))


# --- portfolio -------------------------------------------------------------


def wide_accounts(pdf, w, rate=P.COST_RATE):
    """The accounting on dates x symbols matrices."""
    dates = sorted(pdf.date.unique())
    W_ = w.pivot(index="date", columns="symbol", values="w").reindex(dates).fillna(0.0)
    R_ = pdf.pivot(index="date", columns="symbol", values="next_ret").reindex(dates).fillna(0.0).reindex(columns=W_.columns).fillna(0.0)
    gross = (W_ * R_).sum(axis=1)
    turnover = 0.5 * W_.diff().abs().sum(axis=1)
    held = W_ > 0
    return gross, turnover, gross - rate * turnover, (held & ~held.shift(1, fill_value=False)).sum(axis=1)


BUILDERS = {
    "threshold": lambda p: P.threshold_weights(p, 0.55),
    "topk": lambda p: P.top_k_weights(p, 3),
    "band": lambda p: P.band_weights(p, 0.55, 0.50),
    "held": lambda p: P.held_band_weights(p, 0.6, 0.5, 3, 0.4),
    "static": lambda p: P.static_weights(p),
    "frozen": lambda p: P.frozen_weights(P.tercile_raw(p), 5, 1.0),
}


@pytest.mark.parametrize("name", BUILDERS)
def test_accounts_against_matrices(preds, pdf, name):
    weights = BUILDERS[name](preds)
    got = to_pandas(P.daily_accounts(preds, weights), "date")
    gross, turnover, net, entries = wide_accounts(pdf, weights.toPandas())
    np.testing.assert_allclose(got.gross, gross, atol=1e-14)
    np.testing.assert_allclose(got.turnover, turnover, atol=1e-12)
    np.testing.assert_allclose(got.net, net, atol=1e-14)
    assert got.entries.tolist() == entries.tolist()
    assert got.turnover.iloc[0] == 0 and (got.exposure <= 1 + 1e-9).all()
    P.assert_accounts(P.daily_accounts(preds, weights), preds)
    curve = (1 + net).cumprod()
    row = P.summary(P.daily_accounts(preds, weights)).first()
    assert row.cumulative_return_net == pytest.approx(curve.iloc[-1] - 1)
    assert row.max_drawdown == pytest.approx((curve / curve.cummax() - 1).min())
    assert row.sharpe_net == pytest.approx(net.mean() / net.std(ddof=0) * np.sqrt(252))


def test_hysteresis_against_loop(preds, pdf):
    for enter, leave, hold, stop in ((0.55, 0.5, 0, None), (0.6, 0.5, 4, 0.4)):
        want = {}
        for s, g in pdf.sort_values("date").groupby("symbol"):
            held = 0
            for d, p in zip(g.date, g.prob):
                if held > 0:
                    if (stop is not None and p < stop) or (held >= hold and p < leave):
                        held = 0
                    else:
                        held += 1
                if held == 0 and p >= enter:
                    held = 1
                want[(d, s)] = held > 0
        build = P.band_weights(preds, enter, leave) if hold == 0 else P.held_band_weights(preds, enter, leave, hold, stop)
        assert {(r.date, r.symbol): r.w > 0 for r in build.collect()} == want


def test_signal_portfolio_agrees_with_weights(preds):
    """Two routes to the same accounts."""
    one = P.signal_portfolio(preds).first()
    two = P.summary(P.daily_accounts(preds, P.threshold_weights(preds, 0.5))).first()
    assert one.cumulative_return_net == pytest.approx(two.cumulative_return_net) and one.total_turnover == pytest.approx(two.total_turnover)


def test_accounts_reject_bad_returns(preds):
    bad = preds.withColumn("next_ret", F.when(F.col("symbol") == "SYM001", 0.9).otherwise(F.col("next_ret")))
    with pytest.raises(ValueError, match="beyond"):
        P.assert_accounts(P.daily_accounts(bad, P.naive_weights(bad)), bad)


@pytest.mark.parametrize("n, cap, want", [(100, 10, 10), (50, 10, 5), (300, 20, 20), (7, 10, 1)])
def test_leg_sizes(spark, n, cap, want):
    d = business_days(1)[0]
    df = spark.createDataFrame([(d, f"S{i:03d}", i / n, 0.01 * i / n, 1, 1) for i in range(n)], SCHEMA)
    row = P.long_short_daily(df, 0.001, cap=cap).first()
    assert row.n_long == row.n_short == want and row.long_leg_ret > -row.short_leg_ret


def test_long_short(preds):
    daily = P.long_short_daily(preds, 0.002)
    rows = daily.collect()
    assert len(rows) == 30 and all(r.net_spread <= r.gross_spread for r in rows)
    free = P.long_short_daily(preds, 0.0)
    assert all(r.net_spread == r.gross_spread for r in free.collect())
    empty = P.long_short_summary(daily.limit(0)).first()
    assert empty.n_days == 0 and empty.net_sharpe == 0.0 and empty.net_cum_return_pct == 0.0


def test_verdict(spark):
    rows = [("naive", 10, 0.1, 1.0), ("naive", 25, 0.1, 1.0), ("a", 10, 0.2, 1.1), ("a", 25, 0.2, 1.1), ("b", 10, 0.2, 1.1), ("b", 25, 0.05, 1.1)]
    df = spark.createDataFrame(rows, "variant string, bps int, cumulative_return_net double, sharpe_net double")
    assert {r.variant: r.passes for r in P.holdout_verdict(df, "naive").collect()} == {"a": True, "b": False}


# --- splits and models -----------------------------------------------------


def test_row_splits():
    assert W.row_splits(100, 50, 10) == [(50, 60), (60, 70), (70, 80), (80, 90), (90, 100)]
    assert W.row_splits(55, 50, 10) == [(50, 55)]
    assert W.row_splits(100, 50, 10, 25) == [(50, 60), (75, 85)]
    for bad in ((100, 1, 1, None), (100, 50, 0, None), (100, 50, 1, 0)):
        with pytest.raises(ValueError):
            W.row_splits(*bad)


def test_date_folds(spark):
    df = spark.createDataFrame([(d, "A") for d in business_days(1500, "2015-01-01")], "date date, symbol string")
    folds = W.date_folds(df)
    W.assert_chronological(folds)
    rows = folds.orderBy("fold_id").collect()
    assert [r.fold_id for r in rows] == list(range(len(rows))) and rows[0].n_test == 21
    assert all(a.test_end < b.test_start or a.test_end <= b.train_end for a, b in zip(rows, rows[1:]))


def test_last_rows(preds, pdf):
    for cap in (1, 37, 200, 10_000):
        got = to_pandas(W.last_rows(preds, cap), "date", "symbol")
        want = pdf.sort_values(["date", "symbol"]).tail(cap)
        assert list(zip(got.date, got.symbol)) == list(zip(want.date, want.symbol))


def test_walk_forward(spark):
    b = bars(spark, price_frame(tuple("ABCD"), 300))
    panel = T.label(T.indicators(b, "returns", "rsi"), name="label").select("date", "symbol", "ret_1d", "ret_5d", "rsi_14", "label").cache()
    out = W.walk_forward(panel, ["ret_1d", "ret_5d", "rsi_14"], start=150, every=70)
    assert out.where("date <= train_end").count() == 0
    assert out.groupBy("date", "symbol").count().where("count > 1").count() == 0
    assert out.where("prob < 0 or prob > 1 or prob is null").count() == 0
    assert out.select("block").distinct().count() == 3
    board = W.leaderboard(W.prediction_table(out, "logistic", T.forward_return(b)))
    assert board.first().model_name == "logistic" and 0.3 < board.first().accuracy < 0.7
    newest = panel.where("label is null")
    again = W.latest_scores(panel, newest, ["ret_1d", "ret_5d", "rsi_14"], W.best_model(board), {})
    assert again.count() == newest.count() and again.where("prob is null").count() == 0
    with pytest.raises(ValueError):
        W.walk_forward(panel, ["ret_1d"], "perceptron")
    with pytest.raises(ValueError):
        W.walk_forward(panel, ["ret_1d"], start=10_000)


def test_blocks_train_on_the_newest_rows(spark):
    """A walk-forward by hand: what every block trained on and tested."""
    b = bars(spark, price_frame(tuple("ABC"), 120))
    panel = T.label(T.indicators(b, "returns"), name="label").select("date", "symbol", "ret_1d", "label")
    days = sorted({r[0] for r in panel.where("label is not null").select("date").collect()})
    blocks = W.retrain_blocks(panel.where("label is not null"), 40, 20, train_cap=50, min_train=1)
    assert [(x.train_end, x.test_end) for x in blocks] == [(days[k], days[min(k + 20, len(days) - 1)]) for k in range(40, len(days) - 1, 20)]
    assert all(x.n_train == 50 for x in blocks)
    found = W.fit_checks(panel, ["ret_1d"], {"l": ("logistic", {}), "b": ("boosted", {"trees": 5})}, train_cap=50, start=40, every=20, min_train=1)
    got = {r["block"]: r for r in found.collect()}
    assert all(got[x.number]["n_train"] == 50 and got[x.number]["n_test"] == x.n_test for x in blocks)
    assert all(r["gradient"] < 1e-8 and r["apart"] < 1e-12 for r in got.values())
    assert [x.skipped for x in W.retrain_blocks(panel, 40, 20, min_train=10_000)] == [True] * 4


def test_learners():
    import numpy as np

    from tickloom.operators import learners as L

    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = L.Boosted(trees=60, depth=3, rate=0.2).fit(x[:1000], y[:1000])
    assert ((trees.predict(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95 and set(np.argsort(-trees.gains)[:2]) == {0, 1}
    assert ((L.Forest(trees=40, depth=6).fit(x[:1000], y[:1000]).predict(x[1000:]) > 0.5) == y[1000:]).mean() > 0.85
    slope = (x @ [2, -1, 0, 0, 0, 0.5] + rng.logistic(size=1500) > 0).astype(float)
    fit = L.Linear(c=1e6).fit(x, slope)
    assert fit.gradient < 1e-10 and fit.weights[:2] / fit.spread[:2] == pytest.approx([2, -1], abs=0.35)
    gaps = np.array([[1.0, np.nan], [np.nan, np.nan], [3.0, np.nan], [8.0, np.nan]])
    assert L.medians(gaps).tolist() == [3.0, 0.0]


def _plain_tree(codes, g, h, depth, leaf, least, cuts):
    """Best cuts node by node, every sum by a loop over bins: {node: (feature, bin)}."""
    import numpy as np

    out, todo = {}, [(0, np.arange(len(g)), depth)]
    while todo:
        k, rows, left = todo.pop()
        if not left:
            continue
        best = (1e-9, None)
        for f in range(len(codes)):
            for b in range(cuts[f]):
                low = rows[codes[f][rows] <= b]
                high = rows[codes[f][rows] > b]
                if h[low].sum() < least or h[high].sum() < least:
                    continue
                gain = sum(s * g[r].sum() * leaf(g[r].sum(), h[r].sum()) for s, r in ((1, low), (1, high), (-1, rows)))
                if gain > best[0] + 1e-12:
                    best = (gain, (f, b, low, high))
        if best[1]:
            f, b, low, high = best[1]
            out[k] = (f, b)
            todo += [(2 * k + 1, low, left - 1), (2 * k + 2, high, left - 1)]
    return out


def test_trees_equal_plain_search():
    """Sums that are left over from the smaller child give the cuts that counting gives."""
    import numpy as np

    from tickloom.operators import learners as L

    rng = np.random.default_rng(9)
    for seed in range(4):
        x = np.round(rng.normal(size=(160, 4)), 1)
        y = (x[:, 0] * x[:, 1] + rng.normal(size=160) > 0).astype(float)
        bins = L.cut(x)
        assert all((np.searchsorted(b, column) == code).all() for b, column, code in zip(bins.borders, x.T, bins.codes, strict=True))
        g, h = y - 0.4 + rng.normal(size=160) / 100, rng.uniform(0.1, 0.3, 160)

        def leaf(a, b):
            return a / (b + 1.0)

        growth = L.Growth(bins, 3, leaf, 1.0)
        tree, node = growth.tree(growth.shared(np.arange(4)), g, h)
        want = _plain_tree(bins.codes, g, h, 3, leaf, 1.0, bins.cuts)
        assert {k: (int(f), int(np.searchsorted(bins.borders[f], tree.border[k]))) for k, f in enumerate(tree.feature) if f >= 0} == want
        assert (node == tree.leaf(x)).all()
        for k in set(node.tolist()):
            assert tree.value[k] == pytest.approx(leaf(g[node == k].sum(), h[node == k].sum()))


@pytest.mark.parametrize("kind, params", [("logistic", {}), ("boosted", {"trees": 7}), ("forest", {"trees": 5, "depth": 3})])
def test_models_as_rows(spark, kind, params):
    """A model read back from its rows, in any order, scores as before, in the plan and in the tasks."""
    import numpy as np

    from tickloom.operators import learners as L

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)).astype(np.float32).astype(float)
    y = (x[:, 0] > x[:, 1]).astype(float)
    model = L.KINDS[kind](**params).fit(x, y)
    rows = L.model_rows(kind, model, ["a", "b b", "c"], np.array([0.25, 0.5, 1.0]))
    again, features, middle = L.model_from_rows(rows[:3] + rows[3:][::-1])
    assert features == ["a", "b b", "c"] and (again.predict(x) == model.predict(x)).all()
    table = spark.createDataFrame([tuple(r[c.split()[0]] for c in L.MODEL.split(", ")) for r in rows], L.MODEL)
    gaps = [(i, *(None if (i + j) % 7 == 0 else float(v) for j, v in enumerate(row)), "k") for i, row in enumerate(x)]
    out = W.apply_model(table, spark.createDataFrame(gaps, "id int, a double, `b b` float, c double, kind string"))
    filled = np.array([[m if v is None else v for v, m in zip(r[1:4], middle, strict=True)] for r in gaps])
    got = {r.id: r.prob for r in out.collect()}
    assert out.columns == ["id", "a", "b b", "c", "kind", "prob"]
    assert [got[i] for i in range(300)] == pytest.approx(model.predict(filled).tolist(), abs=1e-12)
    with pytest.raises(ValueError):
        W.apply_model(table.limit(0), out)


def test_one_partition_for_each_block(spark):
    b = bars(spark, price_frame(tuple("AB"), 200))
    panel = T.label(T.indicators(b, "returns"), name="label").select("date", "symbol", "ret_1d", "label").where("label is not null")
    blocks = W.retrain_blocks(panel, 40, 15, min_train=1)
    rows = W.by_block(panel, ["ret_1d"], blocks, "label")
    assert rows.rdd.getNumPartitions() == len(blocks)
    held = rows.select("block", F.spark_partition_id().alias("p")).distinct().collect()
    assert sorted(r["p"] for r in held) == list(range(len(blocks))) == sorted(r["block"] for r in held)


def test_linear_model_in_the_plan(spark):
    """Published medians and scales are those of the rows, and no slope is left at the published weights."""
    b = bars(spark, price_frame(tuple("ABC"), 150))
    panel = T.label(T.indicators(b, "returns", "rsi"), name="label").select("date", "symbol", "ret_1d", "ret_5d", "rsi_14", "label")
    model = W.fit_model(panel, ["ret_1d", "ret_5d", "rsi_14"], "logistic", {"c": 0.1})
    rows = W.linear_slopes(model, panel, 0.1).collect()
    pdf = panel.where("label is not null").toPandas()
    for r in rows:
        column = pdf[r["feature"]].astype("float32").astype(float)
        filled = column.fillna(column.median())
        assert (r["middle"], r["mean"], r["spread"]) == pytest.approx((column.median(), filled.mean(), filled.std(ddof=0)))
        assert abs(r["slope"]) < 1e-9
    assert len(rows) == 3 and model.count() == 4


def test_trees_are_walked_in_every_row():
    """A score that is wrong in the last row only is seen."""
    import numpy as np

    from tickloom.operators import learners as L

    class Wrong(L.Boosted):
        def predict(self, x):
            return super().predict(x) + 0.25 * (np.arange(len(x)) == len(x) - 1)

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    right, wrong = (kind(trees=10).fit(x, (x[:, 0] > 0).astype(float)) for kind in (L.Boosted, Wrong))
    assert W.trees_apart(right, x) < 1e-12 and W.trees_apart(wrong, x) == pytest.approx(0.25)
    assert W.trees_apart(right, x[:0]) == 0


def test_models_per_symbol(spark):
    """Folds by row number for each symbol; short symbols have none; nothing of a fold is trained on."""
    pdf = price_frame(tuple("ABC"), 160)
    pdf = pdf[(pdf.symbol != "C") | (pdf.date >= sorted(pdf.date.unique())[120])]
    panel = T.label(T.indicators(bars(spark, pdf), "returns"), name="label").select("date", "symbol", "ret_1d", "ret_5d", "label")
    out = W.walk_symbols(panel, ["ret_1d", "ret_5d"], {"p": ("logistic", {}), "b": ("boosted", {"trees": 5})}, initial=60, test=25)
    rows = to_pandas(out, "symbol", "date")
    known = panel.dropna().toPandas()
    assert set(rows.symbol) == {"A", "B"}
    for symbol in "AB":
        days = sorted(known.date[known.symbol == symbol])
        mine = rows[rows.symbol == symbol]
        assert list(mine.date) == days[60:]
        folds = mine.groupby("fold").agg(n=("date", "size"), n_train=("n_train", "first"), end=("train_end", "first"), first=("date", "min"))
        splits = W.row_splits(len(days), 60, 25)
        assert folds[["n", "n_train"]].to_numpy().tolist() == [[e - s, s] for s, e in splits]
        assert all(f.end < f["first"] for _, f in folds.iterrows())
    assert rows.gradient.max() < 1e-8 and rows[["p", "b"]].notna().all().all()
    assert W.walk_symbols(panel, ["ret_1d"], {"p": ("logistic", {})}, initial=60, test=25, cap=70).count() == 0


def test_poisson_weights(spark):
    """Mean and variance one, other draws for other units and replicates, and the interval of a loop."""
    df = spark.range(400).selectExpr("id as unit", "explode(sequence(cast(1 as bigint), cast(100 as bigint))) as r").withColumn("w", M.unit_weight(F.col("unit"), F.col("r")))
    pdf = df.toPandas()
    assert pdf.w.mean() == pytest.approx(1, abs=0.02) and pdf.w.var() == pytest.approx(1, abs=0.04)
    table = pdf.pivot(index="unit", columns="r", values="w").to_numpy()
    assert abs(np.corrcoef(table.T)[np.triu_indices(100, 1)]).mean() < 0.06 and abs(np.corrcoef(table)[np.triu_indices(400, 1)]).mean() < 0.11
    rows = spark.createDataFrame([(i % 40, i % 3 % 2, 1) for i in range(400)], "day int, actual int, pred int")
    got = M.poisson_bootstrap(rows, F.col("day"), 100).first()
    n, k = np.full(40, 10), np.array([sum(i % 3 % 2 == 1 for i in range(400) if i % 40 == d) for d in range(40)])
    acc = (table[:40].T @ k) / (table[:40].T @ n)
    assert (got.n, got.units, got.accuracy) == (400, 40, pytest.approx(k.sum() / 400))
    assert (got.lower, got.upper) == pytest.approx(tuple(np.quantile(acc, [0.025, 0.975])))
    assert M.poisson_bootstrap(rows.limit(0), F.col("day"), 10).count() == 0
