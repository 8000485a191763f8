"""Shape of the physical plans."""

import re

from pyspark.sql import functions as F

from data import bars, price_frame
from tickloom.operators import portfolio as P
from tickloom.operators import technical as T
from tickloom.operators.cross import with_market_state
from tickloom.plans import QUERIES
from tickloom.session import stored
from tickloom.sources import readers, sinks
from tickloom.sources.views import Market


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_panel_needs_two_shuffles(spark, folder):
    """Ticks to days, then every family of features in one partitioning by symbol."""
    text = plan(T.feature_panel(Market(spark, folder).bars))
    found = re.findall(r"Exchange hashpartitioning\((\w+?)#", text)
    assert len(found) == 2 and "symbol" in found  # the other one is the packed (symbol, day)
    assert text.count("partial_sum(qty") == 1  # aggregated before the shuffle


def test_only_needed_columns_are_read(spark, folder):
    text = plan(Market(spark, folder).bars.groupBy("symbol").agg(F.sum("volume")))
    schema = next(s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "l_quantity" in s)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_suppkey", "l_quantity", "l_shipdate"}


def test_daily_state_is_broadcast(spark):
    panel = stored(bars(spark, price_frame(("A", "B"), 30)).withColumns({c: F.lit(0.1) for c in ("ret_1d", "ret_5d", "ret_20d", "dist_sma_20", "dist_sma_50", "volatility_20d")}))
    text = plan(with_market_state(panel))
    assert "BroadcastHashJoin [date" in text and "SortMergeJoin" not in text


def test_rank_limits_run_before_the_shuffle(spark):
    preds = bars(spark, price_frame(("A", "B"), 30)).withColumn("prob", F.lit(0.6))
    text = plan(P.top_k_weights(preds, 3))
    assert re.search(r"WindowGroupLimit.*Partial", text)


def test_date_range_prunes_partitions_and_files(spark, tmp_path):
    path = str(tmp_path / "panel")
    sinks.write_panel(bars(spark, price_frame(("A", "B"), 300)), path)
    text = plan(readers.parquet(spark, path, ["symbol", "date", "close"], "2020-03-01", "2020-06-30"))
    assert "GreaterThanOrEqual(date" in text and "LessThanOrEqual(date" in text
    assert "ReadSchema: struct<date:date,symbol:string,close:double>" in text


def test_no_nested_loops(spark, folder):
    names = ["earnings_features", "estimate_revisions", "macro_features", "option_features", "cost_sensitivity", "threshold_sweep", "portfolio_daily", "max_pain"]
    for name in names:
        text = plan(QUERIES[name](spark, folder))
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_ranks_whatever_the_values(spark):
    """Distinct values in a narrow range, and one value with one common prefix of ties."""
    from tickloom.operators.ranking import percent_ranks, row_numbers

    narrow = spark.range(5000).selectExpr("1e6 + (id * 7919 % 5000) / 5000.0D as v", "concat('NSE:XYZ', lpad(id, 6, '0')) as k")
    ranks = percent_ranks(narrow, [], {"r": "v"}).selectExpr("v", "round(r * 5000) as r").collect()
    assert all(round((x["v"] - 1e6) * 5000) + 1 == x["r"] for x in ranks)
    same = narrow.selectExpr("0.5D as p", "k")
    assert [x["k"] for x in row_numbers(same, "p", "k").orderBy("rank").collect()] == sorted(x["k"] for x in same.collect())


def test_ranks_put_only_part_totals_in_one_place(spark):
    """Every window without a key stands on an aggregate by part."""
    from tickloom.operators.ranking import row_numbers

    rows = spark.range(1000).selectExpr("id % 10 as p", "id as k")
    lines = row_numbers(rows, "p", "k")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    single = [i for i, line in enumerate(lines) if "Window" in line and "windowspecdefinition(0" in line or "Window" in line and ", [0], [" in line]
    for i in single:
        assert any("Aggregate [_part" in line for line in lines[i : i + 3])


def test_holding_time_runs_in_the_jvm(spark, folder):
    text = plan(QUERIES["weights_hysteresis_hold"](spark, folder))
    assert not any(x in text for x in ("Python", "Pandas", "Arrow"))
