"""The data behind each chart and section of a report, as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.metrics import over, so_far


def drawdown_curve(series: DataFrame) -> DataFrame:
    return series.where("equity is not null").select("strategy", "date", (F.col("equity") / F.max("equity").over(so_far("strategy")) - 1).alias("drawdown"))


def month_end_weights(held: DataFrame) -> DataFrame:
    """Weights at each month's last date, tickers ranked by mean weight."""
    last = held.groupBy("strategy", "ticker", F.date_trunc("month", "date").cast("date").alias("month")).agg(F.max_by("w", "date").alias("w"))
    mean = last.groupBy("strategy", "ticker").agg(F.avg("w").alias("mean_w"))
    ranked = mean.withColumn("rank", F.row_number().over(Window.partitionBy("strategy").orderBy(F.col("mean_w").desc(), "ticker")))
    return last.join(ranked, ["strategy", "ticker"]).select("strategy", "month", "ticker", "w", "rank")


def weight_summary(held: DataFrame) -> DataFrame:
    """Mean weight while held and largest weight."""
    return held.groupBy("strategy", "ticker").agg(F.avg(F.when(F.col("w") != 0, F.col("w"))).alias("avg_w"), F.max("w").alias("max_w"))


def turnover_curve(series: DataFrame, window: int = 6) -> DataFrame:
    """Active rebalances with the mean of the last ``window``."""
    active = series.where("turnover > 0")
    return active.select("strategy", "date", "turnover", F.avg("turnover").over(over("strategy").rowsBetween(-(window - 1), 0)).alias("smooth"))


def regime_overlay(series: DataFrame, labelled: DataFrame) -> DataFrame:
    """Equity level with the regime known on or before each date."""
    j = series.select("strategy", "date", "equity").join(labelled.select("strategy", "date", "regime"), ["strategy", "date"], "left")
    return j.select("strategy", "date", (F.col("equity") / F.first("equity").over(so_far("strategy"))).alias("level"), F.last("regime", ignorenulls=True).over(so_far("strategy")).alias("regime"))


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per bin of equal width; values outside go to the outer bins."""
    k = F.floor((F.col(column) - low) / ((high - low) / bins)).cast("int")
    placed = values.where(F.col(column).isNotNull()).select(F.greatest(F.lit(0), F.least(F.lit(bins - 1), k)).alias("bin"))
    return placed.groupBy("bin").agg(F.count("*").alias("n"))


def best_of(report: DataFrame) -> DataFrame:
    """Strategy with the largest Sharpe ratio and with the smallest volatility."""
    return report.agg(F.max(F.struct("sharpe", "strategy"))["strategy"].alias("best_sharpe"), F.min(F.struct("ann_vol", "strategy"))["strategy"].alias("least_vol"))


def text_report(sections: dict[str, DataFrame], rows: int = 200) -> str:
    """A plain report: each frame (a summary of few rows) as a table under its title. Brings at most ``rows`` rows of each to the driver."""
    parts = []
    for title, frame in sections.items():
        table = frame.limit(rows).toPandas()
        parts.append(f"{title}\n{'=' * len(title)}\n" + (table.to_string(index=False, float_format=lambda v: f"{v:.4f}") if len(table) else "(no rows)"))
    return "\n\n".join(parts) + "\n"
