import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from data import bars, price_frame, to_pandas
from tickloom.operators import technical as T
from tickloom.operators.bars import daily_from_candles
from tickloom.session import shared_folder, stored
from tickloom.sources import readers, sinks
from tickloom.streaming import market as SM
from tickloom.streaming.log import compact, log_schema, newest, write_log

D = dt.date


def test_ohlcv_csv(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text("Date , OPEN,High,low,Close,Volume\n2024-01-02,1,2,1,2,10\n2024-01-01,1,2,1,1.5,10\n2024-01-02,1,2,1,3,bad\n")
    rows = readers.ohlcv_csv(spark, str(f), "X").orderBy("date").collect()
    assert [(r.date, r.close, r.volume) for r in rows] == [(D(2024, 1, 1), 1.5, 10.0), (D(2024, 1, 2), 3.0, None)]
    (tmp_path / "y.csv").write_text("date,open\n2024-01-01,1\n")
    with pytest.raises(ValueError):
        readers.ohlcv_csv(spark, str(tmp_path / "y.csv"))


def test_provider_frame(spark):
    rows = [("05-Jan-2024", "EQ", "99", "100", "105", "98", "101", "5000000"), ("05-Jan-2024", "EQ", "99", "100", "105", "98", "90", "1"), ("04-Jan-2024", "EQ", "9", "10", "15", "8", "11", "x")]
    raw = spark.createDataFrame(rows, "DATE string, SERIES string, PREV_CLOSE string, OPEN string, HIGH string, LOW string, mva string, VOLUME string")
    got = readers.provider_bars(raw, "TCS", "p").orderBy("date").collect()
    assert [(r.date, r.close, r.volume) for r in got] == [(D(2024, 1, 4), 11.0, None), (D(2024, 1, 5), 101.0, 5e6)]
    with pytest.raises(ValueError):
        readers.provider_bars(raw.drop("OPEN"), "TCS", "p")


def test_flow_headers():
    names = ["Trade Date", "FII Gross Buy", "FII Gross Sell", "DII Net Value", "Other"]
    assert readers.flow_columns(names) == {"date": "Trade Date", "fii_gross_buy": "FII Gross Buy", "fii_gross_sell": "FII Gross Sell", "dii_net": "DII Net Value"}


def test_flows_json(spark, tmp_path):
    f = tmp_path / "f.json"
    f.write_text(json.dumps([{"d": "05-Jan-2024", "fb": 1.0, "fs": 0.5, "fn": 0.5, "dn": 1}, {"d": "bad", "fn": 1}]))
    rows = readers.flows_json(spark, str(f)).collect()
    assert len(rows) == 1 and rows[0].fii_net == 0.5 and rows[0].dii_gross_buy is None


CANDLES = "timestamp,open,high,low,close,volume\n{d}T09:15:00+05:30,100,101,99,100.5,10\n{d}T09:20:00+05:30,100.5,105,100,103,20\n{d}T09:25:00+05:30,103,104,102,104,30\n"


def test_candle_files(spark, tmp_path):
    (tmp_path / "TCS_2024-01-05.csv").write_text(CANDLES.format(d="2024-01-05"))
    (tmp_path / "M&M_20240108.csv").write_text(CANDLES.format(d="2024-01-08"))
    (tmp_path / "noise.csv").write_text(CANDLES.format(d="2024-01-08"))
    (tmp_path / "X_notadate.csv").write_text(CANDLES.format(d="2024-01-08"))
    got = readers.daily_from_candle_files(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.symbol, r.date) for r in got] == [("TCS", D(2024, 1, 5)), ("M&M", D(2024, 1, 8))]
    assert (got[0].open, got[0].high, got[0].low, got[0].close, got[0].volume) == (100, 105, 99, 104, 60)


def test_panel_upsert_touches_only_its_year(spark, tmp_path):
    path = str(tmp_path / "panel")
    b = bars(spark, price_frame(("A", "B"), 400)).withColumn("source", F.lit("old"))
    sinks.write_panel(b, path)
    before = {p.name for p in (tmp_path / "panel" / "year=2020").iterdir()}
    fresh = b.where("year(date) = 2021 and symbol = 'A'").withColumns({"close": F.lit(1.0), "source": F.lit("new")})
    sinks.upsert_panel(spark, path, fresh)
    once = sinks.read_panel(spark, path)
    assert once.count() == b.count() and once.where("source = 'new'").count() == fresh.count()
    sinks.upsert_panel(spark, path, fresh)
    assert sinks.read_panel(spark, path).count() == b.count()
    assert {p.name for p in (tmp_path / "panel" / "year=2020").iterdir()} == before


def test_stored(spark):
    df = spark.range(100)
    assert stored(df).count() == 100 and shared_folder(spark)


def build(b):
    return T.indicators(b, "returns", "rsi").select("date", "symbol", "close", "ret_1d", "rsi_14")


def test_refresh_stream_is_incremental_and_idempotent(spark, tmp_path):
    b = bars(spark, price_frame(("A", "B"), 80))
    cut = F.lit("2020-04-01").cast("date")
    bars_path, features_path, live = (str(tmp_path / n) for n in ("bars", "features", "live"))
    sinks.write_panel(b.where(F.col("date") <= cut), bars_path)
    sinks.write_panel(build(b.where(F.col("date") <= cut)), features_path)
    fresh = b.where(F.col("date") > cut)
    stranger = fresh.limit(1).withColumn("symbol", F.lit("NEW"))
    fresh.unionByName(stranger).coalesce(1).write.parquet(live)

    def run(n):
        stream = SM.read_folder(spark, live, b.schema)
        SM.refresh_stream(stream, bars_path, features_path, str(tmp_path / f"checkpoint{n}"), build).awaitTermination()
        return to_pandas(sinks.read_panel(spark, features_path), "symbol", "date")

    first = run(1)
    want = to_pandas(build(b), "symbol", "date")
    assert len(first) == len(want) and (first.rsi_14 - want.rsi_14).abs().max() < 1e-9
    assert len(run(2)) == len(want)  # the same input again adds nothing


def test_log_keeps_newest_over_batches(spark, tmp_path):
    src, log = tmp_path / "src", str(tmp_path / "log")
    schema = "symbol string, timestamp string, px int"
    for i, rows in enumerate(([("A", "t1", 1), ("A", "t2", 2)], [("A", "t2", 99), ("A", "t3", 3)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = SM.read_folder(spark, str(src), schema, files_per_batch=1)
        write_log(stream, log, str(tmp_path / "cp")).awaitTermination()
    shape = log_schema(spark.createDataFrame([], schema))
    key = ["symbol", "timestamp"]
    want = [("A", "t1", 1), ("A", "t2", 99), ("A", "t3", 3)]
    assert sorted(map(tuple, newest(spark, log, shape, key).collect())) == want
    compact(spark, log, str(tmp_path / "small"), shape, key)
    assert sorted(map(tuple, newest(spark, str(tmp_path / "small"), shape, key).collect())) == want


def test_stream_equals_batch(spark, tmp_path):
    rows = [("A", dt.datetime(2024, 1, 5, 9, 15 + i % 20, i % 60), 100.0 + (i * 7) % 13, 1.0, i) for i in range(200)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, px double, volume double, seq long")
    ticks.repartition(4).write.parquet(str(tmp_path / "t"))
    from tickloom.operators.bars import candles

    stream = SM.read_folder(spark, str(tmp_path / "t"), ticks.schema, files_per_batch=1)
    got = to_pandas(SM.run_candles(spark, stream), "symbol", "ts")
    want = to_pandas(candles(ticks, "5 minutes", ["seq"]), "symbol", "ts")
    assert got.equals(want[got.columns])
    day = daily_from_candles(spark.createDataFrame(want)).first()
    assert day.volume == 200.0


def test_late_ticks_are_kept(spark, tmp_path):
    """One file per batch, the third far older than the others."""
    days = (20, 21, 5)
    for k, day in enumerate(days):
        row = [("A", dt.datetime(2024, 1, day, 10, 0), 100.0 + k, 1.0, k)]
        spark.createDataFrame(row, "symbol string, ts timestamp, px double, volume double, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    ticks = SM.read_folder(spark, str(tmp_path / "t"), "symbol string, ts timestamp, px double, volume double, seq long", files_per_batch=1)
    got = sorted((r["ts"].day, r["close"]) for r in SM.run_candles(spark, ticks).collect())
    assert got == [(5, 102.0), (20, 100.0), (21, 101.0)]


def test_candle_parts_over_batches(spark, tmp_path):
    """First and last price of one candle come from different batches, the later ones first."""
    for seq, px in ((5, 105.0), (1, 101.0), (9, 109.0), (3, 90.0)):
        row = [("A", dt.datetime(2024, 1, 5, 10, 0, seq), px, 1.0, seq)]
        spark.createDataFrame(row, "symbol string, ts timestamp, px double, volume double, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    ticks = SM.read_folder(spark, str(tmp_path / "t"), "symbol string, ts timestamp, px double, volume double, seq long", files_per_batch=1)
    bar = SM.run_candles(spark, ticks).first()
    assert (bar.open, bar.high, bar.low, bar.close, bar.volume) == (101.0, 109.0, 90.0, 109.0, 4.0)


def test_newest_sequence_wins_in_any_order(spark, tmp_path):
    src = str(tmp_path / "src")
    for seq in (9, 1, 4):
        spark.createDataFrame([("A", seq, float(seq))], "symbol string, seq int, px double").coalesce(1).write.mode("append").parquet(src)
    stream = SM.read_folder(spark, src, "symbol string, seq int, px double", files_per_batch=1)
    assert [tuple(r) for r in SM.run_upsert(spark, stream, ["symbol"], tie=["seq"]).collect()] == [("A", 9, 9.0)]


def test_csv_order_over_files(spark, tmp_path):
    """The last row of the last file by name wins, however Spark packs the files."""
    head = "Date,Open,High,Low,Close,Volume\n"
    (tmp_path / "a.csv").write_text(head + "2024-01-02,1,1,1,1,1\n")
    (tmp_path / "b.csv").write_text(head + "".join(f"2024-01-03,{k},{k},{k},{k},{k}\n" for k in range(1, 2000)) + "2024-01-02,7,7,7,7,7\n")
    rows = {str(r["date"]): r["close"] for r in readers.ohlcv_csv(spark, str(tmp_path)).collect()}
    assert rows == {"2024-01-02": 7.0, "2024-01-03": 1999.0}


def test_candle_file_names(spark, tmp_path):
    head = "timestamp,open,high,low,close,volume\n"
    (tmp_path / "AB_2024-01-05.csv").write_text(head + "2024-01-05 09:15:00,1,3,1,2,5\n2024-01-05 09:20:00,2,4,2,3,5\n")
    folder = tmp_path / "key=X_Y_20240108"
    folder.mkdir()
    (folder / "part-0001.csv").write_text(head + "2024-01-08 09:15:00,9,9,9,9,1\n")
    got = sorted((r["symbol"], str(r["date"]), r["open"], r["close"], r["volume"]) for r in readers.daily_from_candle_files(spark, str(tmp_path)).collect())
    assert got == [("AB", "2024-01-05", 1.0, 3.0, 10.0), ("X_Y", "2024-01-08", 9.0, 9.0, 1.0)]


def test_files_per_year(spark, tmp_path):
    """Many tasks, few files: a task writes into the years of its range only."""
    import glob

    rows = spark.range(7 * 250 * 8).selectExpr("date_add(date '2010-01-01', cast(id / 8 as int)) as date", "concat('S', id % 8) as symbol", "id * 1.0D as close")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_panel(rows, str(tmp_path / "p"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    years = spark.read.parquet(str(tmp_path / "p")).select("year").distinct().count()
    assert len(glob.glob(str(tmp_path / "p" / "year=*" / "*.parquet"))) <= 32 + years
