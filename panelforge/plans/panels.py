"""Long panels ``(date, ticker, px, volume)`` and series ``(strategy, date, ret, ...)`` derived from the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import number
from panelforge.operators.panel import align
from panelforge.plans.storage import write_table
from panelforge.sources.tables import table


def raw_panel(spark: SparkSession, d: str, every: str = "week") -> DataFrame:
    """Mean unit price and volume of line items per period and status, as an index level of realistic returns."""
    date = F.col("l_shipdate").cast("date") if every == "day" else F.date_trunc(every, "l_shipdate").cast("date")
    raw = table(spark, d, "lineitem").groupBy(date.alias("date"), F.concat("l_returnflag", "l_linestatus").alias("ticker")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("x"), F.sum("l_quantity").alias("volume"))
    of = Window.partitionBy("ticker")
    step = 0.01 * (F.col("x") - F.avg("x").over(of)) / F.stddev_samp("x").over(of)
    walked = raw.withColumn("step", step)
    return walked.select("date", "ticker", (100 * F.exp(F.sum("step").over(of.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))).alias("px"), "volume")


def weekly(spark: SparkSession, d: str) -> DataFrame:
    """The aligned weekly panel, written once: what follows reads it several times, the line items only here (an action)."""
    return write_table(align(raw_panel(spark, d, "week")), "weekly")


def daily(spark: SparkSession, d: str) -> DataFrame:
    """The aligned daily panel, written once (an action)."""
    return write_table(align(raw_panel(spark, d, "day")), "daily")


def strategies(spark: SparkSession, d: str) -> DataFrame:
    """The stored equity table, one row per strategy and day: the one loaded last. ``ret`` or ``equity`` may be null; each operator leaves out what it cannot use."""
    rows = table(spark, d, "equity").select("strategy", F.col("trade_date").alias("date"), "loaded_at", number("ret").alias("ret"), number("equity").alias("equity"), "turnover", "cost")
    kept = rows.where("strategy is not null and date is not null").groupBy("strategy", "date").agg(F.max(F.struct("loaded_at", "ret", "equity", "turnover", "cost")).alias("row"))
    return kept.select("strategy", "date", "row.ret", "row.equity", "row.turnover", "row.cost")


def returning(spark: SparkSession, d: str) -> DataFrame:
    """The days of :func:`strategies` that have a return."""
    return strategies(spark, d).where("ret is not null")
