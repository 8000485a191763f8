"""Evaluation of predictions, walk-forward folds and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..operators import metrics as M
from ..operators import technical as T
from ..operators import walkforward as W
from ..operators.calendar import date_ordinals, join_daily
from ..operators.cross import cross_section
from ..operators.portfolio import symbol_trading
from ..operators.quality import plausible_returns
from ..operators.ranking import percent_ranks
from ..session import stored
from .base import columns, cte, query
from .features import COMPACT_SQL, FEATURES

COUNTS = "n:i tp:i fp:i tn:i fn:i "
RATES = "accuracy:f9 balanced_accuracy:f9 precision:f9 recall:f9 f1:f9 brier_score:f9 roc_auc:f9"


def preds(m, *names: str):
    """The prediction columns a query reads, stored once."""
    return stored(m.predictions.select("date", "symbol", *names), "preds")


def metric_sql(keys: str, table: str = "preds", by: str | None = None) -> str:
    """Metrics by key; the AUC from average ranks over all rows."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    tie = f"PARTITION BY {k}prob"
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT *, (tp + tn) / n::double AS accuracy,
      coalesce((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0)) AS balanced_accuracy, coalesce(tp / nullif(tp + fp, 0)::double, 0) AS precision,
      coalesce(tp / nullif(tp + fn, 0)::double, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0) AS f1,
      (ranks - (tp + fn) * (tp + fn + 1) / 2.0E0) / nullif((tp + fn) * (tn + fp), 0) AS roc_auc FROM (
      SELECT {k}count(*) AS n, count(*) FILTER (actual = 1 AND pred = 1) AS tp, count(*) FILTER (actual = 0 AND pred = 1) AS fp,
        count(*) FILTER (actual = 0 AND pred = 0) AS tn, count(*) FILTER (actual = 1 AND pred = 0) AS fn, avg((prob - actual) ** 2) AS brier_score,
        sum(CASE WHEN actual = 1 THEN rk END)::double AS ranks
      FROM (SELECT *, rank() OVER ({part}ORDER BY prob) + (count(*) OVER ({tie}) - 1) / 2.0E0 AS rk FROM {table}) {group})"""


@query("classification_metrics", COUNTS + RATES, metric_sql(""), ("preds",))
def classification_metrics(m):
    return M.classification(preds(m, "actual", "pred", "prob"), [])


@query(
    "roc_auc",
    "roc_auc:f9",
    """SELECT sum(CASE WHEN a.p > b.p THEN 1E0 WHEN a.p = b.p THEN 0.5E0 ELSE 0 END * a.n * b.n) / sum(a.n * b.n) AS roc_auc
       FROM (SELECT prob_ext AS p, count(*) AS n FROM preds WHERE actual = 1 GROUP BY 1) a,
            (SELECT prob_ext AS p, count(*) AS n FROM preds WHERE actual = 0 GROUP BY 1) b""",
    ("preds",),
)
def roc_auc(m):
    return M.roc_auc(preds(m, "actual", "prob_ext"), [], prob="prob_ext")


@query("metrics_by_symbol", "symbol " + COUNTS + RATES, metric_sql("symbol"), ("preds",))
def metrics_by_symbol(m):
    return M.classification(preds(m, "actual", "pred", "prob"), ["symbol"])


cte(
    "periods",
    """SELECT 'month' AS period_type, strftime(date, '%Y-%m') AS period, actual, pred, prob FROM preds
       UNION ALL SELECT 'quarter', year(date) || 'Q' || quarter(date), actual, pred, prob FROM preds""",
    "preds",
)


@query("metrics_by_period", "period_type period " + COUNTS + RATES, metric_sql("period_type, period", "periods"), ("periods",))
def metrics_by_period(m):
    return M.by_period(preds(m, "actual", "pred", "prob"))


@query(
    "metrics_by_year",
    "year:i n:i accuracy:f9 base_rate:f9",
    "SELECT year(date) AS year, count(*) AS n, avg((pred = actual)::int) AS accuracy, avg(actual) AS base_rate FROM preds GROUP BY 1",
    ("preds",),
)
def metrics_by_year(m):
    right = (F.col("pred") == F.col("actual")).cast("double")
    return m.predictions.groupBy(F.year("date").alias("year")).agg(
        F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.avg(F.col("actual").cast("double")).alias("base_rate")
    )


cte(
    "models",
    """SELECT symbol, date, 'base' AS model_name, prob, (prob >= 0.5)::int AS pred, actual FROM preds
       UNION ALL SELECT symbol, date, 'extended', prob_ext, (prob_ext >= 0.5)::int, actual FROM preds""",
    "preds",
)
cte("model_years", "SELECT *, year(date) AS year FROM models", "models")


def models(m) -> DataFrame:
    """Both prediction sets in long form: date, symbol, model_name, prob, pred, actual."""
    sets = F.explode(F.array(*[F.struct(F.lit(n).alias("model_name"), F.col(c).alias("prob")) for n, c in (("base", "prob"), ("extended", "prob_ext"))]))
    long = m.predictions.select("date", "symbol", "actual", sets.alias("m")).select("date", "symbol", "actual", "m.*")
    return long.withColumn("pred", (F.col("prob") >= 0.5).cast("int"))


@query("metrics_by_symbol_model", "symbol model_name " + COUNTS + RATES, metric_sql("symbol, model_name", "models"), ("models",))
def metrics_by_symbol_model(m):
    return M.classification(models(m), ["symbol", "model_name"])


@query("metrics_by_year_model", "year:i model_name " + COUNTS + RATES, metric_sql("year, model_name", "model_years"), ("model_years",))
def metrics_by_year_model(m):
    return M.classification(models(m).withColumn("year", F.year("date")), ["year", "model_name"])


@query(
    "mean_accuracy",
    "model_name accuracy:f9",
    "SELECT model_name, sum(a * n) / sum(n) AS accuracy FROM (SELECT model_name, year, avg((pred = actual)::int) AS a, count(*) AS n FROM model_years GROUP BY 1, 2) GROUP BY 1",
    ("model_years",),
)
def mean_accuracy(m):
    """Accuracy of each model over its years, weighted by rows."""
    right = (F.col("pred") == F.col("actual")).cast("double")
    years = models(m).groupBy("model_name", F.year("date").alias("year")).agg(F.avg(right).alias("accuracy"), F.count("*").alias("n"))
    return M.weighted_mean_accuracy(years, keys=["model_name"])


@query(
    "paired_gate",
    "n:i auc_base:f9 auc_extended:f9 better",
    f"""SELECT b.n, b.roc_auc AS auc_base, e.roc_auc AS auc_extended, e.roc_auc > b.roc_auc AS better
        FROM ({metric_sql("model_name", "models")}) b, ({metric_sql("model_name", "models")}) e WHERE b.model_name = 'base' AND e.model_name = 'extended'""",
    ("models",),
)
def paired_gate(m):
    """The extended model passes if its AUC is above the base model's on the same rows."""
    p = stored(m.predictions.select("date", "symbol", "actual", "prob", "prob_ext"), "pairs")
    return M.paired_gate(p.select("date", "symbol", "actual", "prob"), p.select("date", "symbol", "actual", F.col("prob_ext").alias("prob")))


@query(
    "label_classification",
    "n:i tp:i fp:i tn:i fn:i accuracy:f9 balanced_accuracy:f9 precision:f9 recall:f9 f1:f9",
    """SELECT *, (tp + tn) / n::double AS accuracy, (tp / (tp + fn)::double + tn / (tn + fp)::double) / 2 AS balanced_accuracy, tp / (tp + fp)::double AS precision,
       tp / (tp + fn)::double AS recall, 2 * tp / (2 * tp + fp + fn)::double AS f1 FROM (
       SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp,
       count(*) FILTER (quality = 0 AND toxic = 1) AS tn, count(*) FILTER (quality = 1 AND toxic = 1) AS fn FROM labels)""",
)
def label_classification(m):
    rows = m.table("labels").select(F.col("quality").alias("actual"), (1 - F.col("toxic")).alias("pred"))
    return M.classification(rows, [], prob=None)


@query(
    "regression_metrics",
    "mae:f9 rmse:f9 mape:f5 r2:f8",
    """SELECT avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(abs(e) / nullif(abs(next_ret), 0)) * 100 AS mape,
       1 - sum(e * e) / (var_pop(next_ret) * count(*)) AS r2 FROM (SELECT next_ret, prob - 0.5E0 - next_ret AS e FROM preds)""",
    ("preds",),
)
def regression_metrics(m):
    return M.regression(m.predictions.withColumn("p", F.col("prob") - 0.5), "next_ret", "p")


@query(
    "calibration",
    "bin:i n:i observed_up_rate:f9 prob_bin:f4",
    """SELECT 1 + """
    + " + ".join(f"(prob > {i * 0.1!r}E0)::int" for i in range(1, 10))
    + """ AS bin, count(*) AS n, avg(actual) AS observed_up_rate, (bin - 0.5E0) * 0.1E0 AS prob_bin FROM preds GROUP BY 1""",
    ("preds",),
)
def calibration(m):
    return M.calibration(m.predictions)


@query(
    "calibration_verdict",
    "mean_predicted_prob:f9 base_up_rate:f9 brier_score:f9 confidence_gap:f9 verdict",
    """SELECT *, mean_predicted_prob - base_up_rate AS confidence_gap, CASE WHEN abs(mean_predicted_prob - base_up_rate) < 0.02 THEN 'well-calibrated'
       WHEN mean_predicted_prob > base_up_rate THEN 'overconfident' ELSE 'underconfident' END AS verdict FROM (
       SELECT avg(prob) AS mean_predicted_prob, avg(actual) AS base_up_rate, avg((prob - actual) ** 2) AS brier_score FROM preds)""",
    ("preds",),
)
def calibration_verdict(m):
    return M.calibration_verdict(m.predictions)


@query(
    "naive_baselines",
    "always_up_accuracy:f9 majority_class_accuracy:f9",
    "SELECT avg(actual) AS always_up_accuracy, greatest(avg(actual), 1 - avg(actual)) AS majority_class_accuracy FROM preds",
    ("preds",),
)
def naive_baselines(m):
    return M.naive_baselines(m.predictions)


def bucket_sql(buckets) -> str:
    parts = [f"SELECT '{lo:.2f}-{hi:.2f}' AS bucket, * FROM preds WHERE prob >= {lo!r}E0 AND prob < {hi!r}E0" for lo, hi in buckets]
    parts.append("SELECT 'high_confidence' AS bucket, * FROM preds WHERE prob >= 0.6E0 OR prob <= 0.4E0")
    return "SELECT bucket, count(*) AS n, avg((pred = actual)::int) AS accuracy FROM (" + " UNION ALL ".join(parts) + ") GROUP BY 1"


@query("confidence_buckets", "bucket n:i accuracy:f9", bucket_sql(M.BUCKETS), ("preds",))
def confidence_buckets(m):
    return M.confidence_buckets(m.predictions)


@query("confidence_buckets_wide", "bucket n:i accuracy:f9", bucket_sql(M.BUCKETS_WIDE), ("preds",))
def confidence_buckets_wide(m):
    return M.confidence_buckets(m.predictions, M.BUCKETS_WIDE)


cte(
    "five",
    "SELECT * FROM preds WHERE abs(next_ret) <= 0.5 AND abs(ret_5d_fwd) <= 0.5",
    "preds",
)
TERCILE_SQL = """SELECT CASE WHEN prob <= (SELECT quantile_cont(prob, 1 / 3.0E0) FROM five) THEN 'low' WHEN prob <= (SELECT quantile_cont(prob, 2 / 3.0E0) FROM five) THEN 'mid' ELSE 'high' END AS tercile,
       avg(ret_5d_fwd) AS mean_ret, avg(actual) AS mean_dir, count(*) AS n FROM five GROUP BY 1"""
cte("terc", TERCILE_SQL, "five")


def _five(m):
    both = preds(m, "actual", "prob", "next_ret", "ret_5d_fwd")
    return plausible_returns(both, "next_ret", "ret_5d_fwd")


@query("terciles", "tercile mean_ret:f9 mean_dir:f9 n:i", "SELECT * FROM terc", ("terc",))
def terciles(m):
    return M.terciles(_five(m), "ret_5d_fwd")


@query(
    "tercile_spread",
    "spread:f9",
    "SELECT max(mean_ret) FILTER (tercile = 'high') - max(mean_ret) FILTER (tercile = 'low') AS spread FROM terc",
    ("terc",),
)
def tercile_spread(m):
    return M.tercile_spread(M.terciles(_five(m), "ret_5d_fwd"))


@query(
    "exact_quantiles",
    "q01:f9 q50:f9 q99:f9",
    "SELECT quantile_cont(px, 0.01) AS q01, quantile_cont(px, 0.5) AS q50, quantile_cont(px, 0.99) AS q99 FROM ticks",
    ("ticks",),
)
def exact_quantiles(m):
    """Quantiles of every tick price: order statistics without a global sort."""
    return M.exact_quantiles(m.ticks.select("px"), "px", {"q01": 0.01, "q50": 0.5, "q99": 0.99})


@query(
    "percent_rank_ticks",
    "symbol n:i mean_rank:f8 mean_strict:f8",
    """SELECT symbol, count(*) AS n, avg(r) AS mean_rank, avg(s) AS mean_strict FROM (
       SELECT symbol, qty, px, (rank() OVER (PARTITION BY date ORDER BY px) + (count(*) OVER (PARTITION BY date, px) - 1) / 2E0) / count(*) OVER (PARTITION BY date) AS r,
       (rank() OVER (PARTITION BY date ORDER BY qty) - 1) / count(*) OVER (PARTITION BY date)::double AS s FROM ticks) GROUP BY 1""",
    ("ticks",),
)
def percent_rank_ticks(m):
    """Ranks of raw ticks within the day: the groups are large, the ranks exact."""
    rows = m.ticks.select("symbol", "date", "px", "qty")
    out = percent_ranks(rows, ["date"], {"r": "px"})
    out = percent_ranks(out, ["date"], {"s": "qty"}, strict=True)
    return out.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("r").alias("mean_rank"), F.avg("s").alias("mean_strict"))


@query(
    "mcnemar",
    "n:i acc_base:f9 acc_ext:f9 base_rate:f9 b_base_only:i c_ext_only:i z_mcnemar:f7 z_base:f7 z_ext:f7",
    """SELECT *, (c_ext_only - b_base_only) / sqrt(b_base_only + c_ext_only) AS z_mcnemar, (acc_base - base_rate) / sqrt(base_rate * (1 - base_rate) / n) AS z_base,
       (acc_ext - base_rate) / sqrt(base_rate * (1 - base_rate) / n) AS z_ext FROM (
       SELECT count(*) AS n, avg(b::int) AS acc_base, avg(e::int) AS acc_ext, avg(actual) AS base_rate, count(*) FILTER (b AND NOT e) AS b_base_only, count(*) FILTER (e AND NOT b) AS c_ext_only
       FROM (SELECT actual, (prob >= 0.5) = (actual = 1) AS b, (prob_ext >= 0.5) = (actual = 1) AS e FROM preds))""",
    ("preds",),
)
def mcnemar(m):
    both = preds(m, "actual", "prob", "prob_ext")
    ext = both.select("date", "symbol", "actual", F.col("prob_ext").alias("prob"))
    return M.mcnemar(M.paired(both, ext))


@query(
    "significance",
    "n:i accuracy:f9 base_rate:f9 binomial_se:f9 z_vs_coin:f7 z_vs_base:f7 z_overlap_adjusted:f7 edge_vs_naive:f9",
    """SELECT *, sqrt(0.25 / n) AS binomial_se, (accuracy - 0.5) / sqrt(0.25 / n) AS z_vs_coin, (accuracy - base_rate) / sqrt(base_rate * (1 - base_rate) / n) AS z_vs_base,
       (accuracy - base_rate) / sqrt(base_rate * (1 - base_rate) / n) / sqrt(5) AS z_overlap_adjusted, accuracy - base_rate AS edge_vs_naive FROM (
       SELECT count(*) AS n, avg((pred = actual)::int) AS accuracy, avg(actual) AS base_rate FROM preds)""",
    ("preds",),
)
def significance(m):
    return M.significance(m.predictions, horizon=5)


SWEEP_SQL = """SELECT threshold, avg(((prob >= threshold)::int = actual)::int) AS accuracy FROM preds, (SELECT unnest(["""
SWEEP_SQL += ", ".join(f"{t!r}E0" for t in M.THRESHOLDS) + "]) AS threshold) GROUP BY 1"


@query("threshold_sweep", "threshold:f4 accuracy:f9", SWEEP_SQL, ("preds",))
def threshold_sweep(m):
    return M.threshold_sweep(m.predictions)


cte("selday", "SELECT p.*, day_no < 0.6E0 * (SELECT count(*) FROM days) AS is_sel FROM preds p JOIN days USING (date)", "preds", "days")


@query(
    "threshold_selection",
    "threshold:f4 selection_accuracy:f9 eval_accuracy:f9 eval_accuracy_050:f9",
    f"""SELECT any_value(b.threshold) AS threshold, any_value(b.accuracy) AS selection_accuracy, avg(((prob >= b.threshold)::int = actual)::int) AS eval_accuracy,
        avg((pred = actual)::int) AS eval_accuracy_050 FROM selday, (SELECT * FROM ({SWEEP_SQL.replace('FROM preds', 'FROM (SELECT * FROM selday WHERE is_sel)')}) ORDER BY accuracy DESC, threshold LIMIT 1) b WHERE NOT is_sel""",
    ("selday",),
)
def threshold_selection(m):
    rows = preds(m, "actual", "prob", "pred")
    numbered = join_daily(rows, date_ordinals(rows))
    n_days = numbered.agg(F.max("day_no")).first()[0] + 1
    selected = F.col("day_no") < 0.6 * n_days
    best = M.best_threshold(M.threshold_sweep(numbered.where(selected))).first()  # two numbers
    picked = ((F.col("prob") >= F.lit(best.threshold)).cast("int") == F.col("actual")).cast("double")
    return numbered.where(~selected).agg(
        F.lit(best.threshold).alias("threshold"),
        F.lit(best.accuracy).alias("selection_accuracy"),
        F.avg(picked).alias("eval_accuracy"),
        F.avg((F.col("pred") == F.col("actual")).cast("double")).alias("eval_accuracy_050"),
    )


@query(
    "grid_summary",
    "threshold:f2 mean_accuracy:f9 n_configs:i rank:i",
    """SELECT *, row_number() OVER (ORDER BY mean_accuracy DESC, threshold) AS rank FROM (SELECT threshold, avg(a) AS mean_accuracy, count(*) AS n_configs FROM (
       SELECT symbol, threshold, avg(((prob >= threshold)::int = actual)::int) AS a FROM preds, (SELECT unnest([0.45E0, 0.5E0, 0.55E0]) AS threshold) GROUP BY 1, 2) GROUP BY 1)""",
    ("preds",),
)
def grid_summary(m):
    t = F.explode(F.array(*[F.lit(x) for x in (0.45, 0.5, 0.55)])).alias("threshold")
    rows = m.predictions.select("symbol", "actual", "prob", t)
    right = ((F.col("prob") >= F.col("threshold")).cast("int") == F.col("actual")).cast("double")
    return M.grid_summary(rows.groupBy("symbol", "threshold").agg(F.avg(right).alias("accuracy")))


@query(
    "extreme_symbols",
    "side symbol accuracy:f9",
    """SELECT 'best' AS side, * FROM (SELECT symbol, avg((pred = actual)::int) AS accuracy FROM preds GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
       UNION ALL SELECT 'worst', * FROM (SELECT symbol, avg((pred = actual)::int) AS accuracy FROM preds GROUP BY 1 ORDER BY 2, 1 LIMIT 10)""",
    ("preds",),
)
def extreme_symbols(m):
    right = (F.col("pred") == F.col("actual")).cast("double")
    return M.extreme_symbols(m.predictions.groupBy("symbol").agg(F.avg(right).alias("accuracy")))


@query(
    "median_date_split",
    "period n:i accuracy:f9 first_date:d last_date:d",
    """SELECT CASE WHEN d <= (SELECT quantile_cont(date - date '1970-01-01', 0.5) FROM preds) THEN 'validation' ELSE 'out_of_sample_test' END AS period, count(*) AS n,
       avg((pred = actual)::int) AS accuracy, min(date) AS first_date, max(date) AS last_date FROM (SELECT *, date - date '1970-01-01' AS d FROM preds) GROUP BY 1""",
    ("preds",),
)
def median_date_split(m):
    return M.median_date_split(m.predictions)


@query(
    "plausibility",
    "accuracy:f9 verdict suspicious_accuracy suspicious_auc suspicious_r2 suspicious_return",
    """SELECT accuracy, CASE WHEN accuracy < 0.55 THEN 'below 55%' WHEN accuracy < 0.6 THEN '55% to 60%' ELSE 'above 60%' END AS verdict, accuracy > 0.7 AS suspicious_accuracy,
       false AS suspicious_auc, accuracy - 1 < -0.5 AS suspicious_r2, false AS suspicious_return FROM (SELECT avg((pred = actual)::int) AS accuracy FROM preds)""",
    ("preds",),
)
def plausibility(m):
    overall = M.classification(preds(m, "actual", "pred", "prob"), [])
    return M.plausibility(overall, F.col("accuracy") - 1.0, F.lit(0.0))


@query(
    "monthly_stability",
    "n_months:i min_accuracy:f9 max_accuracy:f9 std_accuracy:f9",
    """SELECT count(*) AS n_months, min(a) AS min_accuracy, max(a) AS max_accuracy, stddev_samp(a) AS std_accuracy FROM (
       SELECT strftime(date, '%Y-%m') AS p, avg((pred = actual)::int) AS a FROM preds GROUP BY 1)""",
    ("preds",),
)
def monthly_stability(m):
    right = (F.col("pred") == F.col("actual")).cast("double")
    monthly = m.predictions.groupBy(F.date_format("date", "yyyy-MM").alias("p")).agg(F.avg(right).alias("a"))
    return monthly.agg(
        F.count("*").alias("n_months"), F.min("a").alias("min_accuracy"), F.max("a").alias("max_accuracy"), F.stddev_samp("a").alias("std_accuracy")
    )


@query("bootstrap_ci", "n:i accuracy:f9 lower:f9 upper:f9")
def bootstrap_ci(m):
    return M.bootstrap_accuracy(m.predictions)


POISSON_SQL = " + ".join(f"(CASE WHEN place >= {c!r} THEN 1 ELSE 0 END)" for c in M.POISSON)


@query(
    "bootstrap_days",
    "n:i units:i accuracy:f9 lower:f9 upper:f9 spread:f9",
    f"""WITH c AS (SELECT date - date '1970-01-01' AS unit, count(*) AS n, count(*) FILTER (pred = actual) AS k FROM preds GROUP BY 1),
       h0 AS (SELECT *, (unit % {M.PRIME} * 48271 + r * 1103515245 + 12345) % {M.PRIME} AS x FROM c, (SELECT unnest(range(1, 1001)) AS r)),
       h1 AS (SELECT * REPLACE ((x * x + unit % {M.PRIME} + r * 7919 + 1013904223) % {M.PRIME} AS x) FROM h0),
       h2 AS (SELECT * REPLACE ((x * x + unit % {M.PRIME} + r * 7919 + 362437) % {M.PRIME} AS x) FROM h1),
       h3 AS (SELECT * REPLACE ((x * x + unit % {M.PRIME} + r * 7919 + 521288629) % {M.PRIME} AS x) FROM h2),
       w AS (SELECT r, n, k, {POISSON_SQL} AS w FROM (SELECT *, x / {float(M.PRIME)!r}E0 AS place FROM h3)),
       a AS (SELECT r, sum(w * k) / (0E0 + sum(w * n)) AS acc FROM w GROUP BY 1)
       SELECT (SELECT sum(n) FROM c) AS n, (SELECT count(*) FROM c) AS units, (SELECT sum(k) / (0E0 + sum(n)) FROM c) AS accuracy,
       quantile_cont(acc, 0.025) AS lower, quantile_cont(acc, 0.975) AS upper, stddev_samp(acc) AS spread FROM a""",
    ("preds",),
)
def bootstrap_days(m):
    """The accuracy's interval when whole days are drawn with replacement."""
    return M.poisson_bootstrap(m.predictions, F.unix_date("date"))


@query(
    "baseline_rules",
    "model n:i accuracy:f9",
    """SELECT 'always_up' AS model, count(*) AS n, avg(t) AS accuracy FROM (SELECT (lead("close") OVER w > "close")::int AS t FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE t IS NOT NULL
       UNION ALL SELECT 'previous_direction', count(*), avg((p = t)::int) FROM (SELECT (lead("close") OVER w > "close")::int AS t, coalesce("close" > lag("close") OVER w, false)::int AS p
       FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE t IS NOT NULL""",
    ("bars",),
)
def baseline_rules(m):
    bars = T.label(m.bars, name="t")
    both = W.previous_direction(bars).withColumnsRenamed({"pred": "p_prev", "prob": "s_prev"})
    both = W.always_up(both).withColumnRenamed("pred", "p_up")
    models = F.array(
        F.struct(F.lit("always_up").alias("model"), F.col("p_up").alias("pred")),
        F.struct(F.lit("previous_direction").alias("model"), F.col("p_prev").alias("pred")),
    )
    rows = both.select("t", F.explode(models).alias("m")).select("t", "m.*")
    right = (F.col("t") == F.col("pred")).cast("double")
    return rows.where(F.col("t").isNotNull()).groupBy("model").agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))


@query(
    "ensemble_thresholds",
    "threshold:f2 accuracy:f9 n:i",
    """SELECT threshold, avg(((e >= threshold)::int = actual)::int) AS accuracy, count(*) AS n FROM (SELECT actual, (0E0 + prob + prob_ext) / 2 AS e FROM preds),
       (SELECT unnest([0.48E0, 0.5E0, 0.52E0]) AS threshold) GROUP BY 1""",
    ("preds",),
)
def ensemble_thresholds(m):
    return W.threshold_accuracy(W.ensemble(m.predictions, "prob", "prob_ext"), "prob_ens")


@query(
    "symbol_trading",
    "symbol n:i hit_rate:f9 avg_return_on_buy:f9 cumulative_return:f6 max_drawdown:f7 sharpe:f6",
    """SELECT symbol, count(*) AS n, avg(CASE WHEN net <> 0 THEN (net > 0)::int END) AS hit_rate, avg(r) FILTER (pred = 1) AS avg_return_on_buy, product(1 + net) - 1 AS cumulative_return,
       min(eq / peak - 1) AS max_drawdown, avg(net) / stddev_pop(net) * sqrt(252) AS sharpe FROM (SELECT *, max(eq) OVER (PARTITION BY symbol ORDER BY date) AS peak FROM (
       SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY symbol ORDER BY date)) AS eq FROM (SELECT symbol, date, pred, least(greatest(next_ret, -0.5), 0.5) AS r, pred * least(greatest(next_ret, -0.5), 0.5) AS net FROM preds))) GROUP BY 1""",
    ("preds",),
)
def symbol_trading_(m):
    return symbol_trading(m.predictions)


# --- folds -----------------------------------------------------------------

cte("pd", "SELECT date, count(*) AS n FROM preds GROUP BY 1", "preds")


@query(
    "walk_forward_folds",
    "fold_id:i train_end:d test_start:d test_end:d n_train:i n_test:i",
    """SELECT no // 21 AS fold_id, date AS train_end, test_start, test_end, seen AS n_train, n_test FROM (
       SELECT *, row_number() OVER w - 1 AS no, lead(date) OVER w AS test_start, max(date) OVER f AS test_end, sum(n) OVER f AS n_test FROM (
         SELECT *, sum(n) OVER (ORDER BY date) AS seen, min(date) OVER () AS d0 FROM pd WHERE date < (SELECT max(date) - INTERVAL 12 MONTH FROM pd))
       WHERE date >= d0 + INTERVAL 36 MONTH WINDOW w AS (ORDER BY date), f AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING))
       WHERE no % 21 = 0 AND test_start IS NOT NULL""",
    ("pd",),
)
def walk_forward_folds(m):
    return W.date_folds(m.predictions)


@query(
    "training_window",
    "symbol n:i first_date:d",
    "SELECT symbol, count(*) AS n, min(date) AS first_date FROM (SELECT * FROM preds ORDER BY date DESC, symbol DESC LIMIT 5000) GROUP BY 1",
    ("preds",),
)
def training_window(m):
    """The newest 5000 training rows by (date, symbol)."""
    return W.last_rows(preds(m, "actual"), 5000).groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("first_date"))


BOOSTED = {"trees": 150, "depth": 4, "rate": 0.05}
LOGISTIC = {"c": 0.1}
KEYS = ("date", "symbol", "open", "high", "low", "close", "volume", "target_direction")


def model_panel(m):
    """Every feature with the next-day label, stored once for all fits; and the features' names."""
    panel = T.feature_panel(m.bars).withColumnRenamed("target_direction", "label")
    features = [c for c, kind in panel.dtypes if c not in (*KEYS, "label") and kind in ("double", "float", "int", "bigint")]
    return stored(panel.select("date", "symbol", "close", *features, "label"), "model"), features


def two_models(m):
    panel, features = model_panel(m)
    out = W.walk_models(panel, features, {"prob_boosted": ("boosted", BOOSTED), "prob_linear": ("logistic", LOGISTIC)})
    return W.ensemble(out, "prob_boosted", "prob_linear"), panel


cte(
    "walk_blocks",
    """SELECT (no - 500) // 42 AS block, date AS train_end, test_end, least(seen, 200000) AS n_train, n_test, least(seen, 200000) < 500 AS skipped FROM (
       SELECT *, row_number() OVER (ORDER BY date) - 1 AS no, sum(n) OVER (ORDER BY date) AS seen, max(date) OVER f AS test_end, sum(n) OVER f AS n_test, lead(date) OVER (ORDER BY date) AS after
       FROM pd WINDOW f AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 42 FOLLOWING)) WHERE no >= 500 AND (no - 500) % 42 = 0 AND after IS NOT NULL""",
    "pd",
)


@query("walk_forward_blocks", "block:i train_end:d test_end:d n_train:i n_test:i skipped", "SELECT * FROM walk_blocks", ("walk_blocks",))
def walk_forward_blocks(m):
    """Cut dates and sizes of every block; a block too small to train is marked, not left out."""
    ready = T.forward_return(m.bars.select("date", "symbol", "close")).where("next_ret is not null")
    return W.blocks_table(m.spark, W.retrain_blocks(ready))


@query(
    "walk_forward_fits",
    "block:i n_train:i n_test:i at_optimum trees_agree",
    "SELECT block, n_train, n_test, TRUE AS at_optimum, TRUE AS trees_agree FROM walk_blocks WHERE NOT skipped",
    ("walk_blocks",),
)
def walk_forward_fits(m):
    """The linear fit has no slope left, and tree scores equal trees walked node by node, in every block."""
    panel, features = model_panel(m)
    found = W.fit_checks(panel, features, {"b": ("boosted", BOOSTED), "l": ("logistic", LOGISTIC)})
    return found.select("block", "n_train", "n_test", (F.col("gradient") < 1e-8).alias("at_optimum"), (F.col("apart") < 1e-9).alias("trees_agree"))


@query("walk_forward_predictions", "date:d symbol model_name predicted_direction:i predicted_probability:f6 actual_direction:i actual_return:f9 fold_id:i train_end_date:d")
def walk_forward_predictions(m):
    """Boosted trees, the linear model and the mean of both, from one walk-forward."""
    out, panel = two_models(m)
    nexts = T.forward_return(panel.select("date", "symbol", "close"))
    out = stored(out, "walk")
    tables = [W.prediction_table(out.withColumn("prob", F.col(c)), name, nexts) for name, c in (("boosted", "prob_boosted"), ("linear", "prob_linear"), ("ensemble", "prob_ens"))]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query("walk_forward_boosted", "date:d symbol prob:f6 block:i")
def walk_forward_boosted(m):
    """Boosted trees on the 30 features with the largest mean gain."""
    panel, features = model_panel(m)
    best = W.top_features(W.feature_importance(panel, features, **BOOSTED), 30)
    return W.walk_forward(panel, best, "boosted", **BOOSTED)


@query("feature_importance", "feature importance:f6 rank:i")
def feature_importance(m):
    panel, features = model_panel(m)
    return W.feature_importance(panel, features, **BOOSTED)


@query("model_leaderboard", "model_name accuracy:f6 n_folds:i n:i")
def model_leaderboard(m):
    panel, features = model_panel(m)
    return leaderboard_of(panel, features)


def leaderboard_of(panel, features):
    models = {"logistic": ("logistic", LOGISTIC), "forest": ("forest", {"trees": 200, "depth": 6}), "boosted": ("boosted", BOOSTED)}
    preds = stored(W.walk_models(panel, features, models), "walk")
    right = [F.struct(F.lit(name).alias("model_name"), (F.col(name) >= 0.5).cast("int").alias("predicted_direction")) for name in models]
    long = preds.select(F.col("block").alias("fold_id"), F.col("label").cast("int").alias("actual_direction"), F.explode(F.array(*right)).alias("p"))
    return W.leaderboard(long.select("fold_id", "actual_direction", "p.*"))


# the eight configurations and the testing scheme of the original search: one day every third fold of 21 days
GRID = [
    {"trees": trees, "depth": depth, "rate": rate, "columns": columns, "alpha": penalty, "shrink": penalty}
    for trees, depth, rate, columns, penalty in (
        (100, 2, 0.01, 0.5, 1.0), (100, 3, 0.01, 0.5, 1.0), (100, 4, 0.01, 0.5, 1.0), (200, 3, 0.005, 0.5, 1.0),
        (100, 3, 0.02, 0.5, 1.0), (100, 3, 0.01, 0.3, 1.0), (100, 3, 0.01, 0.7, 1.0), (100, 3, 0.01, 0.5, 2.0),
    )
]


@query("parameter_grid", "config:i params threshold:f2 accuracy:f6 n:i")
def parameter_grid(m):
    panel, features = model_panel(m)
    return W.parameter_grid(panel, features, "boosted", GRID, [0.48, 0.5, 0.52], start=500, every=63, test_days=1)


cte(
    "long",
    f"""SELECT * FROM (SELECT {", ".join(f'cast(cast("{c}" AS float) AS double) AS "{c}"' for c in FEATURES)} FROM feat WHERE target_direction IS NOT NULL
       ORDER BY date DESC, symbol DESC LIMIT 200000) UNPIVOT INCLUDE NULLS (v FOR feature IN ({", ".join(f'"{c}"' for c in FEATURES)}))""",
    "feat",
)


@query(
    "linear_model",
    "feature magnitude:i middle:f6 mean:f6 spread:f6 flat",
    f"""SELECT feature, m AS magnitude, middle / pow(10, m) AS middle, mean / pow(10, m) AS mean, spread / pow(10, m) AS spread, true AS flat FROM (
       SELECT *, floor(log10(spread)) AS m FROM (
       SELECT feature, any_value(middle) AS middle, avg(coalesce(v, middle)) AS mean, coalesce(nullif(stddev_pop(coalesce(v, middle)), 0), 1) AS spread
       FROM long JOIN (SELECT feature, coalesce(median(v), 0) AS middle FROM long GROUP BY 1) USING (feature) GROUP BY 1))""",
    ("long",),
)
def linear_model(m):
    """The published linear model: medians, centres and scales of all features, and whether the loss is flat at its weights."""
    panel, features = model_panel(m)
    model = W.fit_model(panel, features, "logistic", LOGISTIC)
    rows = W.linear_slopes(model, W.last_rows(panel.where("label is not null"), 200_000), LOGISTIC["c"])
    size = F.floor(F.log10("spread"))
    scaled = [(F.col(c) / F.pow(F.lit(10.0), size)).alias(c) for c in ("middle", "mean", "spread")]
    return rows.select("feature", size.alias("magnitude"), *scaled, (F.abs("slope") < 1e-8).alias("flat"))


def symbol_panel(m):
    """Compact features with the next-day label, without implausible next moves."""
    rows = T.forward_return(T.label(T.compact_features(m.bars), name="label"))
    return stored(plausible_returns(rows, "next_ret").select("symbol", "date", *T.COMPACT, "label"), "symbols")


cte(
    "symbol_rows",
    f"""SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS no, count(*) OVER (PARTITION BY symbol) AS n
       FROM (SELECT c.*, lead("close") OVER (PARTITION BY symbol ORDER BY date) / "close" - 1 AS next_ret FROM (
       {COMPACT_SQL.replace('SELECT symbol, date,', 'SELECT symbol, date, "close",').replace('FROM feat2', 'FROM feat2l')}) c)
       WHERE abs(next_ret) <= 0.5 AND {' AND '.join(f'{c} IS NOT NULL' for c in [*T.COMPACT, 'label'])}""",
    "feat2l",
)


@query(
    "symbol_folds",
    "symbol fold:i n_train:i n_test:i train_end:d test_start:d test_end:d up:i at_optimum",
    """SELECT f.symbol, f.fold, f.no AS n_train, count(*) AS n_test, f.before AS train_end, min(r.date) AS test_start, max(r.date) AS test_end, sum(r.label) AS up, true AS at_optimum
       FROM (SELECT symbol, no, (no - 500) // 21 AS fold, before FROM (SELECT *, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS before FROM symbol_rows) WHERE n >= 521 AND no >= 500 AND (no - 500) % 21 = 0) f
       JOIN symbol_rows r ON r.symbol = f.symbol AND r.no >= f.no AND r.no < f.no + 21 GROUP BY ALL""",
    ("symbol_rows",),
)
def symbol_folds(m):
    """One model per symbol, refitted every 21 rows: the folds, and whether each linear fit reached its optimum."""
    out = W.walk_symbols(symbol_panel(m), T.COMPACT, {"prob": ("logistic", LOGISTIC)})
    each = out.groupBy("symbol", "fold", "n_train", "train_end").agg(
        F.count("*").alias("n_test"), F.min("date").alias("test_start"), F.max("date").alias("test_end"), F.sum("label").alias("up"), F.max("gradient").alias("g")
    )
    return each.withColumn("at_optimum", F.col("g") < 1e-8)


@query("symbol_model_predictions", "date:d symbol fold:i prob:f6 label:i train_end:d")
def symbol_model_predictions(m):
    """Boosted trees per symbol, refitted every 21 rows."""
    return W.walk_symbols(symbol_panel(m), T.COMPACT, {"prob": ("boosted", BOOSTED)})


@query("latest_model_signal", "symbol date:d close:f9 prob_up:f6 signal_rank:i")
def latest_model_signal(m):
    """The linear model fitted on all labelled rows up to the cap, applied to the newest row of each symbol."""
    from ..operators.market import last_rows_per_symbol, row_numbers

    panel, features = model_panel(m)
    newest = W.latest_scores(panel, last_rows_per_symbol(panel, 1), features, "logistic", LOGISTIC)
    return row_numbers(newest.select("symbol", "date", "close", F.col("prob").alias("prob_up")), "prob_up", "symbol", "signal_rank")


@query("best_model_signal", "symbol date:d close:f9 prob_up:f6 signal_rank:i")
def best_model_signal(m):
    """The best model of the leaderboard refitted on all labelled rows up to the cap."""
    from ..operators.market import last_rows_per_symbol, row_numbers

    panel, features = model_panel(m)
    kind = W.best_model(leaderboard_of(panel, features))
    params = {"logistic": LOGISTIC, "boosted": BOOSTED, "forest": {"trees": 200, "depth": 6}}[kind]
    newest = W.latest_scores(panel, last_rows_per_symbol(panel, 1), features, kind, params)
    return row_numbers(newest.select("symbol", "date", "close", F.col("prob").alias("prob_up")), "prob_up", "symbol", "signal_rank")
