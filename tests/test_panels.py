"""Snapshot tables, states carried on, and the maintained feature panel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from data import bars, price_frame, to_pandas
from tickloom.operators import carry, dedup
from tickloom.operators import technical as T
from tickloom.session import stored
from tickloom.sources.snapshots import FAN_IN, SnapshotTable
from tickloom.streaming import market as SM
from tickloom.streaming.log import log_schema, newest, write_log
from tickloom.streaming.refresh import FeaturePanel, refresh_panel


def same(got, want):
    got, want = to_pandas(got, "symbol", "date"), to_pandas(want, "symbol", "date")
    assert len(got) == len(want) and (got.symbol == want.symbol).all() and (got.date == want.date).all()
    for c in got.columns:
        if c not in ("symbol", "date"):
            np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=c)


# --- snapshot tables -------------------------------------------------------


def test_parts_grow_with_the_logarithm(spark, tmp_path):
    """Forty batches, some of them retried; the newest row per key at any time."""
    table = SnapshotTable(spark, str(tmp_path / "t"))

    def merge(rows):
        return dedup.keep_best(rows, ["k"], F.struct("batch"))

    for i in range(40):
        rows = spark.range(1).selectExpr(f"id + {i % 7} as k", f"{i} as batch")
        table.append(rows, i, merge)
        if i % 11 == 5:
            before = table.version()
            assert table.append(rows, i, merge) == before  # a retry adds nothing
    version = table.version()
    tiers = [p.tier for p in version.parts]
    assert len(tiers) <= (FAN_IN - 1) * 4 and tiers == sorted(tiers, reverse=True)
    assert [(p.first_batch, p.last_batch) for p in version.parts][0][0] == 0 and version.last_batch == 39
    assert all(a.last_batch + 1 == b.first_batch for a, b in zip(version.parts, version.parts[1:]))
    got = {r["k"]: r["batch"] for r in merge(table.read()).collect()}
    assert got == {k: max(i for i in range(40) if i % 7 == k) for k in range(7)}


def test_readers_of_an_old_version(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.version().number == 0
    table.append(spark.range(3))
    old = table.version()
    reader = table.read(old)
    table.replace(table.read().union(spark.range(100, 102)))  # reads what it replaces
    assert reader.count() == 3 and table.read(old).count() == 3 and table.read().count() == 5
    for _ in range(3):
        table.append(spark.range(1))
    table.expire(keep=1)
    assert table.read().count() == 8
    with pytest.raises(Exception):
        table.read(old).count()


def test_a_second_writer_fails(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.append(spark.range(1))
    before = table.version()
    table.append(spark.range(1))
    with pytest.raises(RuntimeError):
        table.commit(before, before.parts)
    assert table.read().count() == 2


def test_dates_open_the_parts_that_hold_them(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), "date")
    for day in ("2024-01-01", "2024-02-01", "2024-03-01"):
        table.append(spark.range(40).selectExpr(f"date_add(date '{day}', cast(id % 20 as int)) as date", "id"))
    assert table.newest_date() == "2024-03-20"
    some = table.read(since="2024-02-10", until="2024-02-15")
    assert some.count() == 12 and len({f.rsplit("/", 2)[1] for f in some.inputFiles()}) == 1
    assert table.read(since="2025-01-01") is None


def test_log_merges_in_the_sink(spark, tmp_path):
    src, log = str(tmp_path / "src"), str(tmp_path / "log")
    for i in range(9):
        spark.createDataFrame([("A", i), ("B", -i)], "symbol string, seq int").coalesce(1).write.mode("append").parquet(src)
    stream = SM.read_folder(spark, src, "symbol string, seq int", files_per_batch=1)
    write_log(stream, log, str(tmp_path / "cp"), key=["symbol"], tie=["seq"]).awaitTermination()
    table = SnapshotTable(spark, log)
    assert len(table.version().parts) <= 2 * (FAN_IN - 1) and table.read().count() < 18
    shape = log_schema(spark.createDataFrame([], "symbol string, seq int"))
    assert sorted(tuple(r) for r in newest(spark, log, shape, ["symbol"], ["seq"]).collect()) == [("A", 8), ("B", 0)]
    assert newest(spark, str(tmp_path / "none"), shape, ["symbol"]).count() == 0


# --- states ----------------------------------------------------------------


@pytest.fixture(scope="module")
def history(spark):
    """Three symbols; one begins late, so its windows are not full."""
    pdf = price_frame(tuple("ABC"), 420)
    days = sorted(pdf.date.unique())
    pdf = pdf[(pdf.symbol != "C") | (pdf.date >= days[300])]
    return stored(bars(spark, pdf), "history"), days


def test_states_carry_on(spark, history):
    """One day, many days, a symbol that is new, a symbol that misses a day."""
    b, days = history
    b = b.where((F.col("symbol") != "B") | (F.col("date") != F.lit(days[381])))
    first = carry.first_state(b.where(F.col("date") <= F.lit(days[290])))
    state, got = stored(first.state), first.features
    for lo, hi in ((290, 291), (291, 380), (380, 381), (381, 419)):
        done = carry.carry_on(state, b.where((F.col("date") > F.lit(days[lo])) & (F.col("date") <= F.lit(days[hi]))))
        got = got.unionByName(done.features)
        state = stored(carry.with_states(state, done.state))
        assert state.select(F.max(F.size("tail"))).first()[0] <= carry.TAIL
    same(got, T.indicators(b).select(*got.columns))


def test_late_bars(spark, history):
    b, days = history
    state = carry.first_state(b.where((F.col("date") <= F.lit(days[310])))).state
    late = carry.late_bars(state, b.where(F.col("date").isin(days[310], days[311])))
    assert sorted((r["symbol"], r["date"]) for r in late.collect()) == [(s, days[310]) for s in "ABC"]


# --- the panel -------------------------------------------------------------


def test_panel_equals_a_rebuild_in_any_order(spark, history, tmp_path):
    """Files whose dates overlap: late bars, corrections, a retried batch."""
    b, days = history
    src, folder = str(tmp_path / "src"), str(tmp_path / "panel")
    spread = F.when(F.col("date") <= F.lit(days[300]), 0).otherwise(1 + F.pmod(F.xxhash64("symbol", "date"), 2))
    for k in range(3):
        part = b.where(spread == k)
        if k == 0:  # a price that a later batch corrects
            part = part.withColumn("close", F.when((F.col("symbol") == "A") & (F.col("date") == F.lit(days[250])), 1.5).otherwise(F.col("close")))
        if k == 2:
            part = part.unionByName(b.where((F.col("symbol") == "A") & (F.col("date") == F.lit(days[250]))))
        part.coalesce(1).write.mode("append").parquet(src)
    refresh_panel(SM.read_folder(spark, src, b.schema, files_per_batch=1), folder, str(tmp_path / "cp")).awaitTermination()
    panel = FeaturePanel(spark, folder)
    want = T.indicators(b)
    same(panel.read(since=str(days[240])), want.where(F.col("date") >= F.lit(days[240])))
    same(panel.today(), want.where(F.col("date") == F.lit(days[419])))
    before = panel.features.version()
    panel.refresh(b, before.last_batch)  # that batch is in
    assert panel.features.version() == before


def test_history_is_not_read(spark, history, tmp_path, monkeypatch):
    b, days = history
    panel = FeaturePanel(spark, str(tmp_path / "panel"))
    panel.refresh(b.where(F.col("date") < F.lit(days[418])), 0)
    monkeypatch.setattr(panel.bars, "read", lambda *a, **k: pytest.fail("the bars were read"))
    monkeypatch.setattr(panel.features, "read", lambda *a, **k: pytest.fail("the features were read"))
    panel.refresh(b.where(F.col("date") == F.lit(days[418])), 1)
    monkeypatch.undo()
    same(panel.read(since=str(days[418])), T.indicators(b).where(F.col("date") == F.lit(days[418])))
