"""Market tables derived from the star-schema test tables.

Each property is a lazy plan over the whole input tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from ..operators.bars import candles, pack_day, roll_up, unpack_day
from ..operators.technical import forward_return


class Market:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def ticks(self) -> DataFrame:
        """Trades: nation as symbol, ship date as day. The supplier join is left to Spark,
        which broadcasts by size and splits skewed keys otherwise."""
        supplier = self.table("supplier").select("s_suppkey", "s_nationkey")
        return (
            self.table("lineitem")
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                F.col("s_nationkey").cast("string").alias("symbol"),
                F.col("s_nationkey").alias("symbol_id"),
                F.to_date("l_shipdate").alias("date"),
                (F.lit(100.0) + F.col("l_extendedprice") / F.lit(10000.0)).alias("px"),
                F.col("l_quantity").alias("qty"),
                (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),  # line numbers are below 8
                "l_partkey",
                "l_suppkey",
            )
        )

    TICK_ORDER = ["seq", "l_partkey", "l_suppkey"]

    @cached_property
    def bars(self) -> DataFrame:
        day = pack_day(F.col("symbol_id"), F.col("date")).alias("_day")
        symbol, date = unpack_day(F.col("_day"))
        rolled = roll_up(self.ticks, [day], self.TICK_ORDER)
        return rolled.select(symbol.cast("string").alias("symbol"), date.alias("date"), "open", "high", "low", "close", "volume")

    @cached_property
    def sectors(self) -> DataFrame:
        region = self.table("region")
        return (
            self.table("nation")
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_nationkey").cast("string").alias("symbol"), F.col("r_name").alias("sector"))
        )

    @staticmethod
    def probability(a: int, b: int):
        """A reproducible pseudo-probability from volume and day of month."""
        return ((F.col("volume") * a + F.dayofmonth("date") * b) % 1000).cast("double") / F.lit(1000.0)

    @cached_property
    def signal(self) -> DataFrame:
        return self.bars.withColumn("prob", self.probability(7919, 104729))

    @cached_property
    def predictions(self) -> DataFrame:
        """date, symbol, next_ret, actual, prob, prob_ext, pred for every bar with a next bar."""
        return (
            forward_return(forward_return(self.bars), 5, "ret_5d_fwd")
            .where(F.col("next_ret").isNotNull())
            .select(
                "date",
                "symbol",
                "close",
                "volume",
                "next_ret",
                "ret_5d_fwd",
                (F.col("next_ret") > 0).cast("int").alias("actual"),
                self.probability(7919, 104729).alias("prob"),
                self.probability(104729, 7919).alias("prob_ext"),
            )
            .withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
        )

    @cached_property
    def flows(self) -> DataFrame:
        o = self.table("orders")
        urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        filled = F.col("o_orderstatus") == "F"
        price = F.col("o_totalprice")

        def net(c):
            return F.sum(F.when(c, price).otherwise(-price)) / F.lit(1e5)

        def buy(c):
            return F.sum(F.when(c, price).otherwise(F.lit(0.0))) / F.lit(1e5)

        return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(
            net(urgent).alias("fii_net"),
            net(filled).alias("dii_net"),
            buy(urgent).alias("fii_gross_buy"),
            buy(filled).alias("dii_gross_buy"),
        )

    @cached_property
    def event_ticks(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_type").alias("symbol"),
            "ts",
            (F.lit(100.0) + F.col("value") / F.lit(10.0)).alias("px"),
            (1 + F.col("event_id") % 100).cast("double").alias("volume"),
            F.col("event_id").alias("seq"),
        )

    @cached_property
    def candles_5m(self) -> DataFrame:
        return candles(self.event_ticks, "5 minutes", ["seq"])

    @cached_property
    def delivery(self) -> DataFrame:
        share = 0.2 + 0.6 * ((F.dayofmonth("date") * 37 + F.month("date") * 11) % 100) / 100.0
        out = self.bars.withColumn("delivery_qty", F.col("volume") * share)
        return out.withColumn("delivery_pct", F.round(ratio("delivery_qty", "volume") * 100.0, 6))

    def _customer_orders(self) -> DataFrame:
        c = self.table("customer").select("c_custkey", "c_nationkey", "c_acctbal")
        return self.table("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("c_nationkey").cast("string").alias("symbol"),
            F.to_date("o_orderdate").alias("date"),
            "o_totalprice",
            "c_acctbal",
        )

    @cached_property
    def earnings(self) -> DataFrame:
        """Reports on the 15th of each quarter's first month, from all orders of the quarter."""
        orders = self._customer_orders().withColumn("date", F.date_add(F.trunc("date", "quarter"), 14))
        out = orders.groupBy("symbol", "date").agg(
            (F.max("o_totalprice") / 1000.0).alias("estimated_eps"), F.count("*").alias("n")
        )
        surprise = (F.col("n") % 7 - 3).cast("double") + F.lit(0.5)
        return out.select(
            "symbol",
            "date",
            "estimated_eps",
            surprise.alias("surprise_pct"),
            (surprise / 2.0).alias("revenue_surprise_pct"),
        )

    @cached_property
    def estimates(self) -> DataFrame:
        """Analyst estimates on the 5th, 15th and 25th, from all orders of that third of the month."""
        third = F.least(F.floor((F.dayofmonth("date") - 1) / 10), F.lit(2)).cast("int")
        orders = self._customer_orders().withColumn("date", F.date_add(F.trunc("date", "month"), 4 + 10 * third))
        return orders.groupBy("symbol", "date").agg(
            (F.max("o_totalprice") / 1000.0).alias("high_estimate"),
            (F.min("o_totalprice") / 1000.0).alias("low_estimate"),
            (F.max("o_totalprice") / 2000.0 + F.min("o_totalprice") / 2000.0).alias("mean_estimate"),
            F.count("*").alias("num_analysts"),
            (F.max("c_acctbal") / 100.0).alias("target_price_mean"),
        ).withColumn("estimate_type", F.lit("EPS_FY1"))

    @cached_property
    def fundamentals(self) -> DataFrame:
        """Ratios on the 10th of each month, from all orders of the month."""
        orders = self._customer_orders().withColumn("date", F.date_add(F.trunc("date", "month"), 9))
        return orders.groupBy("symbol", "date").agg(
            (F.max("o_totalprice") / 1e4).alias("pe_ratio"),
            (F.max("c_acctbal") / 1e3).alias("roe"),
            (F.min("c_acctbal") / 1e3).alias("roa"),
            (F.count("*") * 0.5).alias("current_ratio"),
        )

    @cached_property
    def option_chain(self) -> DataFrame:
        li = self.table("lineitem")
        place = (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", F.col("r_name").alias("symbol"))
        )
        month = F.to_date(F.date_trunc("month", "l_shipdate"))
        qty = F.col("l_quantity").cast("int")
        return (
            li.join(place, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(
                "symbol",
                month.alias("date"),
                F.add_months(month, (F.col("l_linenumber") % 2 + 1).cast("int")).alias("expiry"),
                (F.lit(90) + 5 * (qty % 6)).cast("double").alias("strike"),
                F.when(F.col("l_returnflag") == "A", "CE").otherwise("PE").alias("option_type"),
            )
            .agg(
                F.sum("l_quantity").alias("open_interest"),
                F.sum(qty % 10).cast("double").alias("volume"),
                F.avg(F.lit(10.0) + F.col("l_discount") * 100.0).alias("iv"),
                F.avg(F.col("l_extendedprice") / 1e4).alias("last_price"),
            )
            .withColumn("spot_price", F.lit(102.0))
        )

    @cached_property
    def news(self) -> DataFrame:
        return self.table("documents").select(
            "doc_id",
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("date"),
            F.col("source").alias("symbol"),
            F.col("lang").alias("sector"),
            "text",
        )
