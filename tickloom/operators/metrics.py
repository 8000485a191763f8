"""Evaluation of directional predictions.

Everything is a sum over rows or over distinct scores, so each metric is one partial
aggregation; no scores are sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.scalar import ratio
from ..session import stored
from .calendar import one_row
from .ranking import distinct_counts


def _hits(actual: str, pred: str) -> list[Column]:
    a, p = F.col(actual) == 1, F.col(pred) == 1
    return [
        F.count("*").alias("n"),
        F.count_if(a & p).alias("tp"),
        F.count_if(~a & p).alias("fp"),
        F.count_if(~a & ~p).alias("tn"),
        F.count_if(a & ~p).alias("fn"),
    ]


def with_rates(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1, balanced accuracy from n, tp, fp, tn, fn.

    Undefined precision, recall and f1 are 0; balanced accuracy averages the classes
    that occur.
    """
    zero = F.lit(0.0)
    precision = F.coalesce(ratio("tp", F.col("tp") + F.col("fp")), zero)
    recall = F.coalesce(ratio("tp", F.col("tp") + F.col("fn")), zero)
    tpr = ratio("tp", F.col("tp") + F.col("fn"))
    tnr = ratio("tn", F.col("tn") + F.col("fp"))
    return counts.withColumns(
        {
            "accuracy": ratio(F.col("tp") + F.col("tn"), "n"),
            "balanced_accuracy": F.coalesce((tpr + tnr) / 2.0, tpr, tnr),
            "precision": precision,
            "recall": recall,
            "f1": F.coalesce(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero),
        }
    )


def roc_auc(df: DataFrame, keys: list[str], actual: str = "actual", prob: str = "prob") -> DataFrame:
    """Tie-aware area under the ROC curve per key; NULL with a single class.

    Rank-sum form over distinct scores: a tied score counts with its average rank.
    """
    known = df.where(F.col(actual).isNotNull())
    scores = distinct_counts(known, keys, prob, pos=F.col(actual).cast("long"))
    sums = scores.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / F.lit(2.0))).alias("_ranks"),
        F.sum("pos").alias("_p"),
        F.sum("n").alias("_n"),
    )
    p, q = F.col("_p").cast("double"), (F.col("_n") - F.col("_p")).cast("double")
    return sums.select(*keys, ratio(F.col("_ranks") - p * (p + 1.0) / 2.0, p * q).alias("roc_auc"))


def classification(df: DataFrame, keys: list[str], actual: str = "actual", pred: str = "pred", prob: str | None = "prob") -> DataFrame:
    """Counts, rates, Brier score and AUC per key (no keys: one row)."""
    aggs = _hits(actual, pred)
    if prob:
        aggs.append(F.avg(F.pow(F.col(prob) - F.col(actual), F.lit(2.0))).alias("brier_score"))
    out = with_rates(df.groupBy(*keys).agg(*aggs))
    if not prob:
        return out
    auc = roc_auc(df, keys, actual, prob)
    if keys:
        return out.join(auc, keys, "left")
    return one_row(out, auc)


def by_period(df: DataFrame, actual: str = "actual", pred: str = "pred", prob: str = "prob") -> DataFrame:
    """Metrics by month and by quarter.

    Rows become one row per day first; month and quarter are grouping sets of those
    days. Only the AUC needs the scores themselves.
    """
    month = F.date_format("date", "yyyy-MM")
    quarter = F.concat(F.year("date"), F.lit("Q"), F.quarter("date"))
    daily = df.groupBy("date").agg(
        *_hits(actual, pred), F.sum(F.pow(F.col(prob) - F.col(actual), F.lit(2.0))).alias("_brier")
    )
    daily = daily.withColumns({"month": month, "quarter": quarter})
    names = ["n", "tp", "fp", "tn", "fn", "_brier"]
    sets = daily.groupingSets([[F.col("month")], [F.col("quarter")]], F.col("month"), F.col("quarter")).agg(
        *[F.sum(c).alias(c) for c in names]
    )
    kind = F.when(F.col("month").isNotNull(), "month").otherwise("quarter")
    sets = sets.select(kind.alias("period_type"), F.coalesce("month", "quarter").alias("period"), *names)
    out = with_rates(sets).withColumn("brier_score", ratio("_brier", "n")).drop("_brier")
    kinds = F.array(
        F.struct(F.lit("month").alias("period_type"), month.alias("period")),
        F.struct(F.lit("quarter").alias("period_type"), quarter.alias("period")),
    )
    long = df.select("*", F.explode(kinds).alias("_p")).select(actual, prob, "_p.*")
    return out.join(roc_auc(long, ["period_type", "period"], actual, prob), ["period_type", "period"], "left")


def regression(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """mae, rmse, mape (zero actuals left out), r2 of one pass."""
    e = F.col(predicted) - F.col(actual)
    return df.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(ratio(F.abs(e), F.abs(actual))) * 100.0).alias("mape"),
        (1.0 - ratio(F.sum(e * e), F.var_pop(actual) * F.count(actual))).alias("r2"),
    )


def calibration(df: DataFrame, actual: str = "actual", prob: str = "prob", n_bins: int = 10) -> DataFrame:
    """Observed rate per equal-width probability bin (lo, hi]; the lowest edge belongs to bin 1."""
    step = 1.0 / n_bins
    p = F.col(prob)
    bin_no = sum(((p > i * step).cast("int") for i in range(1, n_bins)), F.lit(1))
    return (
        df.where(p.isNotNull() & F.col(actual).isNotNull())
        .groupBy(bin_no.alias("bin"))
        .agg(F.count("*").alias("n"), F.avg(F.col(actual).cast("double")).alias("observed_up_rate"))
        .withColumn("prob_bin", (F.col("bin") - 0.5) * step)
    )


def calibration_verdict(df: DataFrame, actual: str = "actual", prob: str = "prob") -> DataFrame:
    one = df.where(F.col(prob).isNotNull() & F.col(actual).isNotNull()).agg(
        F.avg(prob).alias("mean_predicted_prob"),
        F.avg(F.col(actual).cast("double")).alias("base_up_rate"),
        F.avg(F.pow(F.col(prob) - F.col(actual), F.lit(2.0))).alias("brier_score"),
    )
    gap = F.col("mean_predicted_prob") - F.col("base_up_rate")
    return one.withColumn("confidence_gap", gap).withColumn(
        "verdict",
        F.when(F.abs(F.col("confidence_gap")) < 0.02, "well-calibrated")
        .when(F.col("confidence_gap") > 0, "overconfident")
        .otherwise("underconfident"),
    )


def naive_baselines(df: DataFrame, actual: str = "actual") -> DataFrame:
    up = F.avg(F.col(actual).cast("double"))
    return df.agg(up.alias("always_up_accuracy"), F.greatest(up, 1.0 - up).alias("majority_class_accuracy"))


BUCKETS_WIDE = [(0.5, 0.6), (0.6, 0.7), (0.7, 0.85), (0.85, 1.01)]
BUCKETS = [(0.5, 0.55), (0.55, 0.6), (0.6, 0.7), (0.7, 1.01)]


def confidence_buckets(df: DataFrame, buckets: Sequence[tuple[float, float]] = BUCKETS, actual: str = "actual", pred: str = "pred", prob: str = "prob") -> DataFrame:
    """n and accuracy per probability bucket [lo, hi) and for high confidence (>= .6 or <= .4)."""
    p, right = F.col(prob), (F.col(pred) == F.col(actual)).cast("double")
    bucket = F.lit(None).cast("string")
    for lo, hi in reversed(buckets):
        bucket = F.when((p >= lo) & (p < hi), f"{lo:.2f}-{hi:.2f}").otherwise(bucket)
    sure = F.when((p >= 0.6) | (p <= 0.4), "high_confidence")
    return (
        df.select(right.alias("right"), F.explode(F.array(bucket, sure)).alias("bucket"))
        .where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.count("*").alias("n"), F.avg("right").alias("accuracy"))
    )


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float]) -> DataFrame:
    """One row of exact linear-interpolated quantiles of a column of any size.

    The two order statistics around each quantile are picked by their position among
    the distinct values.
    """
    counts = distinct_counts(df, [], value)
    picks = {}
    for name, q in quantiles.items():
        at = (F.col("total") - 1) * F.lit(q)
        for side, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
            picks[f"_{name}_{side}"] = F.max(F.when(inside, F.col(value)))
        picks[f"_{name}_w"] = F.max(at - F.floor(at))
    one = counts.agg(*[c.alias(n) for n, c in picks.items()])
    return one.select(
        *[
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_w")).alias(n)
            for n in quantiles
        ]
    )


def terciles(df: DataFrame, ret: str, actual: str = "actual", prob: str = "prob") -> DataFrame:
    """Mean return, up rate and n of the low, middle and high third of the probabilities."""
    edges = exact_quantiles(df, prob, {"low": 1.0 / 3.0, "high": 2.0 / 3.0}).first()  # two numbers
    p = F.col(prob)
    band = F.when(p <= F.lit(edges.low), "low").when(p <= F.lit(edges.high), "mid").otherwise("high")
    return df.groupBy(band.alias("tercile")).agg(
        F.avg(ret).alias("mean_ret"), F.avg(F.col(actual).cast("double")).alias("mean_dir"), F.count("*").alias("n")
    )


def tercile_spread(table: DataFrame) -> DataFrame:
    """High minus low mean return."""
    return table.agg(
        (F.max(F.when(F.col("tercile") == "high", F.col("mean_ret"))) - F.max(F.when(F.col("tercile") == "low", F.col("mean_ret")))).alias("spread")
    )


def paired(base: DataFrame, ext: DataFrame) -> DataFrame:
    """Inner join of two prediction sets (date, symbol, actual, prob) on equal keys."""
    b = base.select("date", "symbol", F.col("actual").alias("actual"), F.col("prob").alias("prob_base"))
    e = ext.select("date", "symbol", F.col("actual").alias("actual_ext"), F.col("prob").alias("prob_ext"))
    return b.join(e, ["date", "symbol"])


def check_pairs(pairs: DataFrame) -> None:
    """Keys must be unique and both sets must carry the same outcome."""
    per_key = pairs.groupBy("date", "symbol").agg(
        F.count("*").alias("n"), F.count_if(F.col("actual") != F.col("actual_ext")).alias("d")
    )
    bad = per_key.agg(F.coalesce(F.max("n"), F.lit(1)).alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("d")).first()
    if bad.n > 1 or bad.d > 0:
        raise ValueError(f"pairs are not one-to-one or disagree on outcomes: {bad.asDict()}")


def paired_gate(base: DataFrame, ext: DataFrame) -> DataFrame:
    """AUC of two prediction sets on the rows both have, and whether the extended one is better.

    Both sides are checked first (unique keys, equal outcomes), and results too good to be
    true raise an alarm.
    """
    pairs = paired(base, ext)
    check_pairs(pairs)
    sides = F.explode(F.array(F.struct(F.lit("base").alias("side"), F.col("prob_base").alias("prob")), F.struct(F.lit("ext").alias("side"), F.col("prob_ext").alias("prob"))))
    long = pairs.select("actual", sides.alias("s")).select("actual", "s.*").withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
    found = classification(long, ["side"])
    for r in found.select("accuracy", "roc_auc").collect():  # two rows
        sanity_alarm(r["accuracy"] or 0.0, r["roc_auc"])

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    out = found.agg(of("base", "n").alias("n"), of("base", "roc_auc").alias("auc_base"), of("ext", "roc_auc").alias("auc_extended"))
    return out.withColumn("better", F.col("auc_extended") > F.col("auc_base"))


def mcnemar(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Discordant pairs of two predictors; z > 0 favours the extended one."""
    y = F.col("actual") == 1
    b, e = (F.col("prob_base") >= threshold) == y, (F.col("prob_ext") >= threshold) == y
    one = pairs.agg(
        F.count("*").alias("n"),
        F.avg(b.cast("double")).alias("acc_base"),
        F.avg(e.cast("double")).alias("acc_ext"),
        F.avg(y.cast("double")).alias("base_rate"),
        F.count_if(b & ~e).alias("b_base_only"),
        F.count_if(~b & e).alias("c_ext_only"),
    )
    spread = F.sqrt(F.col("base_rate") * (1.0 - F.col("base_rate")) / F.col("n"))
    discordant = F.col("b_base_only") + F.col("c_ext_only")
    return one.withColumns(
        {
            "z_mcnemar": ratio(F.col("c_ext_only") - F.col("b_base_only"), F.sqrt(discordant.cast("double"))),
            "z_base": ratio(F.col("acc_base") - F.col("base_rate"), spread),
            "z_ext": ratio(F.col("acc_ext") - F.col("base_rate"), spread),
        }
    )


def significance(df: DataFrame, horizon: int = 1, actual: str = "actual", pred: str = "pred") -> DataFrame:
    """Accuracy against the base rate and a coin; the overlap-adjusted z divides by sqrt(horizon)."""
    one = df.agg(
        F.count("*").alias("n"),
        F.avg((F.col(actual) == F.col(pred)).cast("double")).alias("accuracy"),
        F.avg(F.col(actual).cast("double")).alias("base_rate"),
    )
    se = F.sqrt(0.25 / F.col("n"))
    spread = F.sqrt(F.col("base_rate") * (1.0 - F.col("base_rate")) / F.col("n"))
    z = ratio(F.col("accuracy") - F.col("base_rate"), spread)
    return one.withColumns(
        {
            "binomial_se": se,
            "z_vs_coin": (F.col("accuracy") - 0.5) / se,
            "z_vs_base": z,
            "z_overlap_adjusted": z / float(horizon) ** 0.5,
            "edge_vs_naive": F.col("accuracy") - F.col("base_rate"),
        }
    )


def bootstrap_accuracy(df: DataFrame, actual: str = "actual", pred: str = "pred", resamples: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the accuracy under resampling with replacement.

    The number of right rows in a resample of n rows is Binomial(n, accuracy), so the
    draws need the two counts only, whatever n is.
    """

    @pandas_udf("double")
    def draw(n: pd.Series, right: pd.Series, replicate: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(
            [np.random.default_rng([seed, int(r)]).binomial(int(m), k / m) / m for m, k, r in zip(n, right, replicate)]
        )

    counts = df.agg(F.count("*").alias("n"), F.count_if(F.col(actual) == F.col(pred)).alias("k")).where("n > 0")
    draws = counts.select("n", "k", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("r"))
    draws = draws.withColumn("acc", draw("n", "k", "r"))
    tail = (1.0 - confidence) / 2.0
    return draws.groupBy("n", "k").agg(
        F.percentile("acc", F.lit(tail)).alias("lower"), F.percentile("acc", F.lit(1.0 - tail)).alias("upper")
    ).select("n", ratio("k", "n").alias("accuracy"), "lower", "upper")


PRIME = 2_147_483_647
POISSON = [sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)) for k in range(13)]  # chance of k or fewer


def unit_weight(unit: Column, replicate: Column) -> Column:
    """How often a unit is drawn in a replicate: Poisson with mean one, from a hash of both numbers.

    Squares modulo a prime mix the bits; the place in [0, 1) is looked up among ``POISSON``.
    Whole numbers only, so any engine gets the same draws.
    """
    x = (F.pmod(unit, F.lit(PRIME)) * 48271 + replicate * 1_103_515_245 + 12345) % PRIME
    for add in (1_013_904_223, 362_437, 521_288_629):
        x = (x * x + F.pmod(unit, F.lit(PRIME)) + replicate * 7919 + add) % PRIME
    place = x / F.lit(float(PRIME))
    return sum((F.when(place >= c, 1).otherwise(0) for c in POISSON), F.lit(0))


def poisson_bootstrap(df: DataFrame, unit: Column, resamples: int = 1000, confidence: float = 0.95, actual: str = "actual", pred: str = "pred") -> DataFrame:
    """Percentile interval of the accuracy when whole units (a day, a symbol) are drawn with replacement.

    Rows of one unit stand or fall together, so the interval is right where they are alike. They
    are counted once per unit; a replicate then reads units, not rows, and each draw depends on
    the numbers of its unit and replicate alone, wherever and however often it is made.
    """
    right = F.count_if(F.col(actual) == F.col(pred))
    counts = df.groupBy(unit.cast("long").alias("unit")).agg(F.count("*").alias("n"), right.alias("k"))
    draws = counts.select("n", "k", "unit", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(resamples).cast("long"))).alias("r"))
    draws = draws.withColumn("w", unit_weight(F.col("unit"), F.col("r")))
    each = draws.groupBy("r").agg(ratio(F.sum(F.col("w") * F.col("k")), F.sum(F.col("w") * F.col("n"))).alias("acc"))
    tail = (1.0 - confidence) / 2.0
    interval = each.agg(F.percentile("acc", F.lit(tail)).alias("lower"), F.percentile("acc", F.lit(1.0 - tail)).alias("upper"), F.stddev_samp("acc").alias("spread"))
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("units"), ratio(F.sum("k"), F.sum("n")).alias("accuracy")).where("n > 0")
    return whole.crossJoin(F.broadcast(interval))  # one row each


THRESHOLDS = [0.40 + 0.005 * i for i in range(41)]


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] = THRESHOLDS, actual: str = "actual", prob: str = "prob") -> DataFrame:
    """Accuracy of ``prob >= t`` for every threshold t.

    Each row falls into one cell between two thresholds; the accuracies are running
    sums over the cells, so rows are read once and never multiplied.
    """
    ts = F.array(*[F.lit(float(t)) for t in thresholds])
    cell = F.size(F.filter(ts, lambda t: F.col(prob) >= t))
    cells = df.groupBy(cell.alias("_cell")).agg(F.count("*").alias("n"), F.sum(F.col(actual).cast("long")).alias("pos"))
    one = cells.agg(F.map_from_entries(F.collect_list(F.struct("_cell", F.struct("n", "pos")))).alias("m"))  # <= 42 cells
    steps = one.select("m", F.posexplode(ts).alias("_i", "threshold"))
    every = F.sequence(F.lit(0), F.lit(len(thresholds)))

    def total(keep, field: str, complement: bool = False) -> Column:
        def add(acc, c):
            cell_ = F.try_element_at(F.col("m"), c)
            value = cell_["n"] - cell_["pos"] if complement else cell_[field]
            return acc + F.when(keep(c), F.coalesce(value, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))

        return F.aggregate(every, F.lit(0).cast("long"), add)

    right = total(lambda c: c > F.col("_i"), "pos") + total(lambda c: c <= F.col("_i"), "n", True)
    return steps.select("threshold", ratio(right, total(lambda c: c >= 0, "n")).alias("accuracy"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Highest accuracy, the lowest threshold on ties."""
    return sweep.agg(
        F.max_by("threshold", F.struct("accuracy", -F.col("threshold"))).alias("threshold"), F.max("accuracy").alias("accuracy")
    )


def weighted_mean_accuracy(folds: DataFrame, accuracy: str = "accuracy", n: str = "n", keys: list[str] | None = None) -> DataFrame:
    return folds.groupBy(*(keys or [])).agg(ratio(F.sum(F.col(accuracy) * F.col(n)), F.sum(n)).alias("accuracy"))


def grid_summary(results: DataFrame) -> DataFrame:
    """Mean accuracy per threshold over the other parameters, and its rank."""
    means = results.groupBy("threshold").agg(F.avg("accuracy").alias("mean_accuracy"), F.count("*").alias("n_configs"))
    best = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_accuracy"), "threshold")  # one row per threshold
    return means.withColumn("rank", F.row_number().over(best))


def extreme_symbols(by_symbol: DataFrame, n: int = 10) -> DataFrame:
    """The n best and n worst symbols by accuracy."""
    by_symbol = stored(by_symbol, "symbols")
    best = by_symbol.orderBy(F.desc("accuracy"), "symbol").limit(n).withColumn("side", F.lit("best"))
    worst = by_symbol.orderBy("accuracy", "symbol").limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def median_date_split(df: DataFrame, actual: str = "actual", pred: str = "pred") -> DataFrame:
    """Accuracy up to the row-weighted median date and after it."""
    daily = df.groupBy("date").agg(
        F.count("*").alias("n"), F.count_if(F.col(actual) == F.col(pred)).alias("right")
    )
    mid = F.percentile(F.unix_date("date"), F.lit(0.5), F.col("n")).over(Window.partitionBy(F.lit(0)))
    part = F.when(F.unix_date("date") <= F.col("_mid"), "validation").otherwise("out_of_sample_test")
    return (
        daily.withColumn("_mid", mid)
        .groupBy(part.alias("period"))
        .agg(F.sum("n").alias("n"), ratio(F.sum("right"), F.sum("n")).alias("accuracy"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    )


def plausibility(overall: DataFrame, r2: Column, cumulative: Column) -> DataFrame:
    """Verdict bands and warning flags over a one-row metrics table with accuracy and roc_auc."""
    acc = F.col("accuracy")
    return overall.withColumns(
        {
            "verdict": F.when(acc < 0.55, "below 55%").when(acc < 0.60, "55% to 60%").otherwise("above 60%"),
            "suspicious_accuracy": acc > 0.70,
            "suspicious_auc": F.coalesce(F.col("roc_auc") > 0.75, F.lit(False)),
            "suspicious_r2": F.coalesce(F.abs(r2) > 0.5, F.lit(False)),
            "suspicious_return": F.coalesce(F.abs(cumulative) > 1000.0, F.lit(False)),
        }
    )


def sanity_alarm(accuracy: float, auc: float | None, max_accuracy: float = 0.60, max_auc: float = 0.65) -> None:
    """Out-of-sample results this good point to leakage."""
    if accuracy > max_accuracy or (auc is not None and auc > max_auc):
        raise ValueError(f"leakage suspected: accuracy {accuracy:.4f}, AUC {auc}")
