"""Chronological splits, model fits per block, and the prediction table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType, _parse_datatype_string

from ..functions import rolling as R
from ..functions.scalar import flag, ratio
from ..session import stored
from . import learners as L
from .calendar import join_daily


# --- splits ----------------------------------------------------------------


def row_splits(n: int, initial: int, test: int = 1, step: int | None = None) -> list[tuple[int, int]]:
    """(train size, test end) of expanding splits by row count."""
    step = test if step is None else step
    if initial < 2 or test < 1 or step < 1:
        raise ValueError("initial must be >= 2, test and step >= 1")
    return [(start, min(start + test, n)) for start in range(initial, n, step)]


def date_folds(df: DataFrame, holdout_months: int = 12, min_train_years: int = 3, step: int = 21) -> DataFrame:
    """Expanding folds by date before a holdout of the last months.

    One row per fold: fold_id, train_end, test_start, test_end, n_train, n_test. The
    panel is reduced to rows per date first, everything after is one row per date.
    """
    per_day = df.groupBy("date").agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))
    per_day = per_day.withColumn("_cut", F.add_months(F.max("date").over(everything), -holdout_months))
    before = per_day.where(F.col("date") < F.col("_cut"))
    w = everything.orderBy("date")
    before = before.withColumns(
        {"_from": F.add_months(F.min("date").over(everything), 12 * min_train_years), "_seen": F.sum("n").over(R.running(w))}
    )
    usable = before.where(F.col("date") >= F.col("_from")).withColumn("_no", F.row_number().over(w) - 1)
    ahead = w.rowsBetween(1, step)
    folds = usable.withColumns(
        {
            "test_start": F.lead("date").over(w),
            "test_end": F.max("date").over(ahead),
            "n_test": F.sum("n").over(ahead),
        }
    ).where((F.col("_no") % step == 0) & F.col("test_start").isNotNull())
    return folds.select(
        (F.col("_no") / step).cast("int").alias("fold_id"),
        F.col("date").alias("train_end"),
        "test_start",
        "test_end",
        F.col("_seen").alias("n_train"),
        "n_test",
    )


@dataclass(frozen=True)
class Block:
    number: int
    train_start: dt.date
    train_end: dt.date
    test_end: dt.date
    n_train: int
    n_test: int
    skipped: bool


def retrain_blocks(df: DataFrame, start: int = 500, every: int = 42, test_days: int | None = None, train_cap: int | None = 200_000, min_train: int = 500) -> list[Block]:
    """Cut dates of a walk-forward, from the rows per date (bounded by the calendar).

    A block trains on the rows up to its cut date, the newest ``train_cap`` of them, and tests
    on the next ``every`` dates (``test_days`` below that gives the sparse form that tests a few
    days per step). Blocks with under ``min_train`` training rows are marked as skipped.
    """
    days = df.groupBy("date").agg(F.count("*").alias("n")).orderBy("date").collect()
    seen = [0]
    for r in days:
        seen.append(seen[-1] + r["n"])
    out, first = [], 0
    for number, cut in enumerate(range(start, len(days) - 1, every)):
        end = min(cut + (test_days or every), len(days) - 1)
        n = seen[cut + 1]
        while train_cap is not None and seen[cut + 1] - seen[first + 1] >= train_cap:
            first += 1  # the remaining dates alone fill the cap
        kept = n if train_cap is None else min(n, train_cap)
        out.append(Block(number, days[first]["date"], days[cut]["date"], days[end]["date"], kept, seen[end + 1] - seen[cut + 1], kept < min_train))
    return out


def blocks_table(spark, blocks: list[Block]) -> DataFrame:
    """One row per block, skipped ones included."""
    rows = [(b.number, b.train_end, b.test_end, b.n_train, b.n_test, b.skipped) for b in blocks]
    return spark.createDataFrame(rows, "block int, train_end date, test_end date, n_train long, n_test long, skipped boolean")


def assert_chronological(folds: DataFrame) -> None:
    if folds.where(F.col("train_end") >= F.col("test_start")).limit(1).count():
        raise ValueError("a fold tests on its own training dates")


def last_rows(train: DataFrame, cap: int) -> DataFrame:
    """The newest ``cap`` rows by (date, symbol).

    Whole dates while they fit; of the date on the edge the last symbols. Only that
    date and the number of its rows to keep come to the driver.
    """
    per_day = train.groupBy("date").agg(F.count("*").alias("n"))
    newer = Window.partitionBy(F.lit(0)).orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    counted = per_day.withColumn("_newer", F.coalesce(F.sum("n").over(newer), F.lit(0)))
    edge = counted.where((F.col("_newer") < cap) & (F.col("_newer") + F.col("n") > cap)).first()
    if edge is None:
        whole = counted.where(F.col("_newer") < cap).select("date")
        return join_daily(train, whole, "left_semi")
    part = train.where(F.col("date") == F.lit(edge["date"])).orderBy(F.desc("symbol")).limit(cap - edge["_newer"])
    return train.where(F.col("date") > F.lit(edge["date"])).unionByName(part)


# --- models ----------------------------------------------------------------

Models = dict[str, tuple[str, dict]]  # column of the result -> kind of learner, its parameters


def learner(kind: str, params: dict):
    if kind not in L.KINDS:
        raise ValueError(f"unknown model {kind}")
    return L.KINDS[kind](**params)


def packed(features: list[str]) -> Column:
    """All features of a row as one array ``x`` of 32-bit numbers, gaps as nulls: one column to shuffle and to hand over."""
    return F.array(*[F.col(f"`{f}`").cast("float") for f in features]).alias("x")


def unpacked(x: pa.ChunkedArray) -> np.ndarray:
    """The matrix of packed rows, gaps as NaN."""
    chunks = [np.asarray(c.flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(c), -1) for c in x.chunks if len(c)]
    return np.concatenate(chunks)


@dataclass(frozen=True)
class Rows:
    """The rows of one partition in order of date and symbol: ``keys`` (the other columns) and the matrix ``x``."""

    keys: pd.DataFrame
    x: np.ndarray

    def where(self, keep: np.ndarray) -> "Rows":
        return Rows(self.keys[keep], self.x[keep])


def by_block(panel: DataFrame, features: list[str], blocks: list[Block], label: str) -> DataFrame:
    """The labelled rows of every block, each block a partition of its own: ``block``, ``train`` and the columns a fit needs.

    A row goes to the blocks that train on it (a range of numbers, by its date) and to the
    one that tests it. The table of these ranges has one row per calendar date. Blocks are
    dealt out by number, not by hash, so no task gets two while another one gets none.
    """
    kept = [b for b in blocks if not b.skipped]
    days = panel.select("date").distinct()
    trains = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(b.number).alias("block"), F.lit(True).alias("train"), F.lit(b.train_start).alias("lo"), F.lit(b.train_end).alias("hi")) for i, b in enumerate(kept)])
    tests = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(b.number).alias("block"), F.lit(False).alias("train"), F.date_add(F.lit(b.train_end), 1).alias("lo"), F.lit(b.test_end).alias("hi")) for i, b in enumerate(kept)])
    roles = days.select("date", F.explode(F.filter(F.concat(trains, tests), lambda x: (F.col("date") >= x["lo"]) & (F.col("date") <= x["hi"]))).alias("r"))
    rows = panel.select("date", "symbol", F.col(label).cast("double").alias("label"), packed(features))
    rows = rows.repartition(panel.sparkSession.sparkContext.defaultParallelism, "date", "symbol")  # a stored panel may be one small file, and each row is copied to many blocks
    return rows.join(roles.select("date", "r.slot", "r.block", "r.train"), "date").repartitionById(len(kept), "slot").drop("slot")


def per_partition(rows: DataFrame, run: Callable[[Rows], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` over the packed rows of each partition that has any."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        found = [b for b in batches if b.num_rows]
        if found:
            table = pa.Table.from_batches(found).sort_by([("date", "ascending"), ("symbol", "ascending")])
            yield run(Rows(table.drop_columns("x").to_pandas(), unpacked(table["x"])))

    kind = _parse_datatype_string(schema)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(kind)
        for frame in whole(batches):
            yield pa.RecordBatch.from_pandas(frame[target.names], schema=target, preserve_index=False)

    return rows.mapInArrow(frames, kind)


def _fitted(rows: Rows, models: Models, cap: int | None):
    """Training part and test part of one block, and the fitted learners; trees share one bin table."""
    in_train = rows.keys["train"].to_numpy()
    train, test = rows.where(in_train), rows.where(~in_train)
    if cap is not None:
        train = Rows(train.keys[-cap:], train.x[-cap:])
    y, middle = train.keys["label"].to_numpy(), L.medians(train.x)
    x = L.filled(train.x, middle)
    bins = L.cut(x) if any(kind != "logistic" for kind, _ in models.values()) else None
    fitted = {name: learner(kind, params).fit(x, y, bins) for name, (kind, params) in models.items()}
    return train.keys, test.keys, L.filled(test.x, middle), fitted


def walk_models(
    panel: DataFrame,
    features: list[str],
    models: Models,
    start: int = 500,
    every: int = 42,
    test_days: int | None = None,
    train_cap: int = 200_000,
    label: str = "label",
    min_train: int = 500,
) -> DataFrame:
    """Out-of-sample probabilities of several models, fitted up to each cut date.

    One Spark job: a block is a partition of at most ``train_cap`` training rows (the newest; a
    bound on the labelled rows of a fit, as in the original analysis) and its test rows, and
    the blocks run side by side. Gaps are filled with the exact medians of the training rows.
    Give a stored panel: it is read for the cut dates and for the fits.
    """
    for kind, params in models.values():
        learner(kind, params)
    ready = panel.where(F.col(label).isNotNull())
    blocks = retrain_blocks(ready, start, every, test_days, train_cap, min_train)
    if all(b.skipped for b in blocks):
        raise ValueError("not enough dates for one block")
    ends = {b.number: b.train_end for b in blocks}

    def run(rows: Rows) -> pd.DataFrame:
        _, test, x, fitted = _fitted(rows, models, train_cap)
        out = test[["date", "symbol", "label", "block"]].assign(train_end=ends[int(rows.keys["block"].iloc[0])])
        return out.assign(**{name: m.predict(x) for name, m in fitted.items()})

    schema = "date date, symbol string, label double, block int, train_end date, " + ", ".join(f"{m} double" for m in models)
    return per_partition(by_block(ready, features, blocks, label), run, schema).withColumnRenamed("label", label)


def walk_forward(panel: DataFrame, features: list[str], kind: str = "logistic", label: str = "label", start: int = 500, every: int = 42, test_days: int | None = None, train_cap: int = 200_000, min_train: int = 500, **params) -> DataFrame:
    """``walk_models`` for one model, as the column ``prob``."""
    return walk_models(panel, features, {"prob": (kind, params)}, start, every, test_days, train_cap, label, min_train)


def trees_apart(model: L.Boosted, x: np.ndarray) -> float:
    """The largest difference, over all rows, between the scores of a block and trees walked node by node."""
    walked = np.array([model.predict_row(row) for row in x])
    return float(np.max(np.abs(model.predict(x) - walked), initial=0.0))


def fit_checks(panel: DataFrame, features: list[str], models: Models, label: str = "label", train_cap: int = 200_000, **walk) -> DataFrame:
    """Per block: rows used, the linear model's gradient where its fit ended, and the largest
    difference between tree scores of whole blocks and trees walked node by node."""
    ready = panel.where(F.col(label).isNotNull())
    blocks = retrain_blocks(ready, train_cap=train_cap, **walk)

    def run(rows: Rows) -> pd.DataFrame:
        train, test, x, fitted = _fitted(rows, models, train_cap)
        gradient = max((m.gradient for m in fitted.values() if isinstance(m, L.Linear)), default=0.0)
        trees = [m for m in fitted.values() if isinstance(m, L.Boosted)]
        apart = max((trees_apart(m, x) for m in trees), default=0.0)
        return pd.DataFrame({"block": [int(rows.keys["block"].iloc[0])], "n_train": [len(train)], "n_test": [len(test)], "gradient": [gradient], "apart": [apart]})

    return per_partition(by_block(ready, features, blocks, label), run, "block int, n_train long, n_test long, gradient double, apart double")


SIDE = 4  # groups that share the folds of a symbol


def walk_symbols(panel: DataFrame, features: list[str], models: Models, label: str = "label", initial: int = 500, test: int = 21, cap: int = 20_000) -> DataFrame:
    """Walk-forwards of one model per symbol, all symbols side by side.

    A symbol's complete rows (label and every feature known) are split by number: the first
    ``initial`` and later all rows before a fold train it, the next ``test`` are predicted. One
    group holds the daily rows of one symbol, the newest ``cap`` of them (80 years); symbols with
    fewer than ``initial + test`` rows have no fold. The folds of a symbol are dealt to ``SIDE``
    groups with a copy of its rows each, so one long symbol does not hold up the others. Returns date, symbol, label, fold, n_train,
    train_end, one probability per model, and ``gradient`` (largest entry left of the linear fits, 0 without one).
    """
    for kind, params in models.values():
        learner(kind, params)
    known = F.col(label).isNotNull()
    for f in features:
        known = known & F.col(f"`{f}`").isNotNull()
    rows = panel.where(known).select("date", "symbol", F.col(label).cast("double").alias("label"), packed(features))
    names = ", ".join(f"{m} double" for m in models)
    schema = _parse_datatype_string(f"date date, symbol string, label double, fold int, n_train long, train_end date, {names}, gradient double")

    def run(group: pa.Table) -> pa.Table:
        target = to_arrow_schema(schema)
        group = group.sort_by("date").slice(max(0, group.num_rows - cap))
        x, keys = unpacked(group["x"]), group.drop_columns(["x", "side"]).to_pandas()
        y, out = keys["label"].to_numpy(), []
        mine = group["side"][0].as_py() if group.num_rows else 0
        for fold, (size, end) in enumerate(row_splits(len(x), initial, test) if len(x) >= initial + test else []):
            if fold % SIDE != mine:
                continue
            bins = L.cut(x[:size]) if any(kind != "logistic" for kind, _ in models.values()) else None
            fitted = {name: learner(kind, params).fit(x[:size], y[:size], bins) for name, (kind, params) in models.items()}
            left = max((m.gradient for m in fitted.values() if isinstance(m, L.Linear)), default=0.0)
            part = keys[size:end].assign(fold=fold, n_train=size, train_end=keys["date"].iloc[size - 1], gradient=left)
            out.append(part.assign(**{name: m.predict(x[size:end]) for name, m in fitted.items()}))
        return pa.Table.from_pandas(pd.concat(out)[target.names], schema=target, preserve_index=False) if out else target.empty_table()

    # small tables would be fitted by one task: a given number of partitions is not merged
    parts = 4 * panel.sparkSession.sparkContext.defaultParallelism
    dealt = rows.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
    return dealt.repartition(parts, "symbol", "side").groupBy("symbol", "side").applyInArrow(run, schema)


def prediction_table(preds: DataFrame, model_name: str, returns: DataFrame, label: str = "label") -> DataFrame:
    """Long prediction table with outcome and next-day return."""
    joined = preds.join(returns.select("date", "symbol", "next_ret"), ["date", "symbol"], "left")
    return joined.select(
        "date",
        "symbol",
        F.lit(model_name).alias("model_name"),
        (F.col("prob") >= 0.5).cast("int").alias("predicted_direction"),
        F.col("prob").alias("predicted_probability"),
        F.col(label).cast("int").alias("actual_direction"),
        F.col("next_ret").alias("actual_return"),
        F.col("block").alias("fold_id"),
        F.col("train_end").alias("train_end_date"),
    )


def feature_importance(panel: DataFrame, features: list[str], label: str = "label", train_cap: int = 200_000, start: int = 500, every: int = 42, **params) -> DataFrame:
    """Gain of each feature in the boosted model of a block (as a share), averaged over blocks: feature, importance, rank."""
    ready = panel.where(F.col(label).isNotNull())
    blocks = retrain_blocks(ready, start, every, train_cap=train_cap)

    def run(rows: Rows) -> pd.DataFrame:
        gains = _fitted(rows, {"m": ("boosted", params)}, train_cap)[3]["m"].gains
        return pd.DataFrame({"feature": features, "importance": gains / max(gains.sum(), 1e-12)})

    shares = per_partition(by_block(ready, features, blocks, label), run, "feature string, importance double")
    means = shares.groupBy("feature").agg(F.avg("importance").alias("importance"))  # one row per feature
    return means.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")))


def top_features(importance: DataFrame, n: int = 30) -> list[str]:
    """The first n features; as many rows come to the driver."""
    return [r["feature"] for r in importance.where(F.col("rank") <= n).orderBy("rank").collect()]


def parameter_grid(panel: DataFrame, features: list[str], kind: str, grid: list[dict], thresholds: list[float], label: str = "label", **walk) -> DataFrame:
    """Walk-forward accuracy of each parameter set and threshold, best first.

    All sets run in one walk-forward. Predictions are counted once per (set, cell between
    thresholds, label); the accuracy at a threshold is then a sum over cells.
    """
    models: Models = {f"_m{i}": (kind, given) for i, given in enumerate(grid)}
    preds = walk_models(panel, features, models, label=label, **walk)
    long = preds.select(label, F.explode(F.array(*[F.struct(F.lit(i).alias("config"), F.col(f"_m{i}").alias("prob")) for i in range(len(grid))])).alias("p")).select(label, "p.*")
    cell = sum(((F.col("prob") >= t).cast("int") for t in sorted(thresholds)), F.lit(0))  # thresholds reached
    cells = long.groupBy("config", cell.alias("cell"), label).agg(F.count("*").alias("n"))
    t = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(x)).alias("threshold")) for k, x in enumerate(sorted(thresholds))])).alias("t")
    right = F.when((F.col("cell") > F.col("t.k")).cast("double") == F.col(label), F.col("n")).otherwise(0)
    found = cells.select("*", t).groupBy("config", "t.threshold").agg((F.sum(right) / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))
    names = F.create_map(*[F.lit(x) for i, given in enumerate(grid) for x in (i, str(sorted(given.items())))])
    return found.withColumn("params", F.element_at(names, F.col("config"))).orderBy(F.desc("accuracy"), "config", "threshold")


def leaderboard(predictions: DataFrame) -> DataFrame:
    """Row-weighted accuracy per model over its folds, best first."""
    right = (F.col("predicted_direction") == F.col("actual_direction")).cast("double")
    folds = predictions.groupBy("model_name", "fold_id").agg(F.avg(right).alias("a"), F.count("*").alias("n"))
    return folds.groupBy("model_name").agg(
        ratio(F.sum(F.col("a") * F.col("n")), F.sum("n")).alias("accuracy"), F.count("*").alias("n_folds"), F.sum("n").alias("n")
    ).orderBy(F.desc("accuracy"), "model_name")


def fit_model(panel: DataFrame, features: list[str], kind: str, params: dict, label: str = "label", train_cap: int = 200_000) -> DataFrame:
    """The model fitted on the newest ``train_cap`` labelled rows, as a table of ``learners.MODEL`` rows.

    One task fits it: the training rows are bounded, and so is the model.
    """
    learner(kind, params)
    train = last_rows(panel.where(F.col(label).isNotNull()), train_cap)
    rows = train.select("date", "symbol", F.col(label).cast("double").alias("label"), packed(features))

    def run(rows: Rows) -> pd.DataFrame:
        middle = L.medians(rows.x)
        x = L.filled(rows.x, middle)
        model = learner(kind, params).fit(x, rows.keys["label"].to_numpy(), None if kind == "logistic" else L.cut(x))
        return pd.DataFrame(L.model_rows(kind, model, features, middle)).astype({"tree": "Int32", "node": "Int32"})

    return stored(per_partition(rows.repartitionById(1, F.lit(0)), run, L.MODEL), "model")


def linear_inputs(model: list[Row]) -> tuple[list[Row], Column]:
    """The columns of a linear model, and the standardised inputs as one array: gaps filled, centred, scaled."""
    columns = sorted((r for r in model if r["feature"] is not None), key=lambda r: r["feature"])

    def numbers(c: str) -> Column:
        return F.lit([float(r[c]) for r in columns])

    values = F.array(*[F.col(f"`{r['feature']}`").cast("float").cast("double") for r in columns])
    filled = F.zip_with(values, numbers("middle"), lambda v, m: F.coalesce(v, m))
    centred = F.zip_with(filled, numbers("mean"), lambda v, m: v - m)
    return columns, F.zip_with(centred, numbers("spread"), lambda v, s: v / s)


def linear_probability(model: list[Row], inputs: Column) -> Column:
    """The probability of a linear model from its rows, as an expression of the inputs."""
    columns, _ = linear_inputs(model)
    intercept = next(r["weight"] for r in model if r["feature"] is None)
    terms = F.zip_with(inputs, F.lit([float(r["weight"]) for r in columns]), lambda z, w: z * w)
    score = F.aggregate(terms, F.lit(float(intercept)), lambda total, term: total + term)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(score, F.lit(35.0)), F.lit(-35.0))))


def apply_model(model: DataFrame, rows: DataFrame, name: str = "prob") -> DataFrame:
    """``rows`` with the probability of a stored model, wherever they are: nothing is shuffled.

    The model comes to the driver (features and tree nodes) and goes to the tasks; the linear
    model is an expression of the plan.
    """
    found = model.collect()
    if not found:
        raise ValueError("the model has no rows: nothing to train on")
    if found[0]["kind"] == "logistic":
        return rows.withColumn(name, linear_probability(found, linear_inputs(found)[1]))
    fitted, features, middle = L.model_from_rows([r.asDict() for r in found])
    shared = rows.sparkSession.sparkContext.broadcast((fitted, middle))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, fill = shared.value
        for batch in batches:
            if batch.num_rows:
                x = unpacked(pa.chunked_array([batch.column(len(names))]))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(m.predict(L.filled(x, fill)))], names=[*names, name])

    asked = rows.select(*[F.col(f"`{c}`") for c in names], packed(features))
    return asked.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))


def latest_scores(panel: DataFrame, newest: DataFrame, features: list[str], kind: str, params: dict, label: str = "label", train_cap: int = 200_000) -> DataFrame:
    """The model fitted on the newest labelled rows, applied to ``newest``: its columns and ``prob``."""
    return apply_model(fit_model(panel, features, kind, params, label, train_cap), newest)


def linear_slopes(model: DataFrame, train: DataFrame, c: float, label: str = "label") -> DataFrame:
    """One row per feature: its median, centre, scale and weight, and the mean slope of the
    penalised log loss along it, from the published numbers alone. At the optimum all slopes are zero."""
    found = model.collect()
    columns, inputs = linear_inputs(found)
    seen = train.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), inputs.alias("z"))
    scored = seen.select("z", (linear_probability(found, F.col("z")) - F.col("y")).alias("residual"))
    sums = scored.select("residual", F.posexplode("z").alias("at", "z")).groupBy("at").agg(F.avg(F.col("residual") * F.col("z")).alias("slope"), F.count("*").alias("n"))
    named = sums.withColumn("feature", F.element_at(F.lit([r["feature"] for r in columns]), F.col("at") + 1))
    of_column = named.join(model.where("feature is not null").select("feature", "middle", "mean", "spread", "weight"), "feature")
    return of_column.select("feature", "middle", "mean", "spread", "weight", (F.col("slope") + F.col("weight") / c / F.col("n")).alias("slope"))


def best_model(board: DataFrame) -> str:
    """The first model of the leaderboard."""
    return board.agg(F.max_by("model_name", F.struct("accuracy", "model_name"))).first()[0]


# --- rules and ensembles ---------------------------------------------------


def always_up(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"pred": F.lit(1), "prob": F.lit(1.0)})


def previous_direction(bars: DataFrame) -> DataFrame:
    """Predict the sign of the last known daily return; no return yet means down."""
    up = flag(R.change("close", R.series()) > 0)
    return bars.withColumns({"pred": up.cast("int"), "prob": up})


def ensemble(preds: DataFrame, *probs: str, name: str = "prob_ens") -> DataFrame:
    mean: Column = sum((F.col(p) for p in probs), F.lit(0.0)) / float(len(probs))
    return preds.withColumn(name, mean)


def threshold_accuracy(preds: DataFrame, prob: str, thresholds: tuple[float, ...] = (0.48, 0.50, 0.52), actual: str = "actual") -> DataFrame:
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    rows = preds.select(actual, prob, t)
    right = ((F.col(prob) >= F.col("threshold")).cast("int") == F.col(actual)).cast("double")
    return rows.groupBy("threshold").agg(F.avg(right).alias("accuracy"), F.count("*").alias("n"))
