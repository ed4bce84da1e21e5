"""Risk and performance of return series ``(strategy, date, ret)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 252


def over(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("date")


def so_far(*keys: str) -> Window:
    return over(*keys).rowsBetween(Window.unboundedPreceding, 0)


def curve(series: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Adds the compounded ``growth`` and its ``drawdown`` from the running peak (no initial peak of 1)."""
    grown = series.withColumn("growth", F.exp(F.sum(F.log1p("ret")).over(so_far(*keys))))
    return grown.withColumn("drawdown", F.col("growth") / F.max("growth").over(so_far(*keys)) - 1)


def sharpe(mean: Column, sd: Column, rf: float) -> Column:
    """Annualised Sharpe ratio of daily figures; 0 without spread."""
    return F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((mean - rf / DAYS) / sd * F.sqrt(F.lit(float(DAYS))))


def risk_report(series: DataFrame, keys: Sequence[str] = ("strategy",), rf: float = 0.04, confidence: float = 0.95) -> DataFrame:
    """Ten figures per key. Infinite ratios (no downside, no losses) are infinite, not null."""
    keys = list(keys)
    excess = F.col("ret") - rf / DAYS
    tail = curve(series, keys)
    var = series.groupBy(*keys).agg(F.percentile("ret", F.lit(1 - confidence)).alias("var_95"))
    joined = tail.join(var, keys)
    n, sd = F.count("ret"), F.stddev_samp("ret")
    loss = F.sum(F.when(F.col("ret") < 0, -F.col("ret")))
    gain = F.coalesce(F.sum(F.when(F.col("ret") > 0, F.col("ret"))), F.lit(0.0))
    infinite = F.lit(float("inf"))
    a = joined.groupBy(*keys).agg(
        n.alias("n"),
        F.exp(F.sum(F.log1p("ret"))).alias("compound"),
        F.coalesce(sd, F.lit(0.0)).alias("sd"),
        F.avg("ret").alias("mean"),
        F.avg(F.when(excess < 0, excess * excess)).alias("downside"),
        F.min("drawdown").alias("max_dd"),
        F.first("var_95").alias("var_95"),
        F.avg(F.when(F.col("ret") <= F.col("var_95"), F.col("ret"))).alias("tail_mean"),
        F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
        F.when(loss.isNull(), infinite).when(gain == 0, 0.0).otherwise(gain / loss).alias("profit_factor"),
    )
    ann = F.pow(F.col("compound"), F.lit(float(DAYS)) / F.col("n")) - 1
    root = F.sqrt(F.lit(float(DAYS)))
    sortino = F.when(F.col("n") < 2, 0.0).when(F.col("downside").isNull(), infinite).otherwise((F.col("mean") - rf / DAYS) * DAYS / (F.sqrt("downside") * root))
    return a.select(
        *keys,
        ann.alias("ann_return"),
        (F.col("sd") * root).alias("ann_vol"),
        F.when(F.col("n") < 2, 0.0).otherwise(sharpe(F.col("mean"), F.col("sd"), rf)).alias("sharpe"),
        sortino.alias("sortino"),
        "max_dd",
        F.when(F.col("max_dd") == 0, 0.0).otherwise(ann / F.abs("max_dd")).alias("calmar"),
        "var_95",
        F.coalesce("tail_mean", "var_95").alias("cvar_95"),
        "win_rate",
        "profit_factor",
        F.col("n").alias("n_days"),
    )


def equity_summary(series: DataFrame, capital: Column | float | None = None) -> DataFrame:
    """Total return, CAGR by calendar years and maximum drawdown of ``equity`` curves."""
    run = series.where("equity is not null").withColumn("peak", F.max("equity").over(so_far("strategy")))
    a = run.groupBy("strategy").agg(F.min_by("equity", "date").alias("first"), F.max_by("equity", "date").alias("last"), F.min("date").alias("start"), F.max("date").alias("end"), F.min(F.col("equity") / F.col("peak") - 1).alias("max_dd"))
    base = F.col("first") if capital is None else F.lit(capital)
    years = F.datediff("end", "start") / 365.25
    return a.select("strategy", (F.col("last") / base - 1).alias("total_return"), F.when(years > 0, F.pow(F.col("last") / base, 1 / years) - 1).otherwise(0.0).alias("cagr"), "max_dd")


def moments(series: DataFrame) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis, from Spark's population forms."""
    a = series.groupBy("strategy").agg(F.count("ret").cast("double").alias("n"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))
    n = F.col("n")
    return a.where("n > 3").select("strategy", n.cast("long").alias("n"), "mean", "sd", (F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), (((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurtosis"))


def rolling(series: DataFrame, window: int, rf: float = 0.04) -> DataFrame:
    """Rolling annualised volatility and Sharpe ratio over full windows; null before."""
    f = over("strategy").rowsBetween(-(window - 1), 0)
    full = F.count("ret").over(f) == window
    mean, sd = F.avg("ret").over(f), F.stddev_samp("ret").over(f)
    root = F.sqrt(F.lit(float(DAYS)))
    return series.select("strategy", "date", F.when(full, sd * root).alias("vol"), F.when(full & (sd > 0), (mean - rf / DAYS) / sd * root).alias("sharpe"))


def drawdown_episodes(series: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` deepest drawdowns of each equity curve: islands of days below the peak."""
    eq = series.where("equity is not null").select("strategy", "date", (F.col("equity") / F.max("equity").over(so_far("strategy")) - 1).alias("dd"))
    marked = eq.withColumn("episode", F.sum((F.col("dd") == 0).cast("int")).over(so_far("strategy")))
    recovered = marked.withColumn("next_peak", F.first(F.when(F.col("dd") == 0, F.col("date")), ignorenulls=True).over(over("strategy").rowsBetween(0, Window.unboundedFollowing))).withColumn("last_date", F.max("date").over(Window.partitionBy("strategy")))
    below = recovered.where("dd < 0").groupBy("strategy", "episode").agg(F.min("date").alias("start"), F.min(F.struct("dd", "date")).alias("low"), F.coalesce(F.first("next_peak", ignorenulls=True), F.max("last_date")).alias("end"))
    ranked = below.withColumn("rank", F.row_number().over(Window.partitionBy("strategy").orderBy("low.dd", "start")))
    return ranked.where(F.col("rank") <= top).select("strategy", "rank", "start", F.col("low.date").alias("trough"), "end", F.col("low.dd").alias("depth"), F.datediff("end", "start").alias("duration_days"))


def turnover_analysis(series: DataFrame) -> DataFrame:
    a = series.groupBy("strategy").agg((F.count("ret") / DAYS).alias("years"), F.sum("turnover").alias("turnover"), F.sum("cost").alias("cost"), F.avg("equity").alias("equity"))
    ann = F.col("turnover") / F.col("years")
    return a.select("strategy", ann.alias("ann_turnover"), F.when(ann > 0, DAYS / ann).otherwise(float("inf")).alias("holding_days"), (F.col("cost") / F.col("equity") / F.col("years") * 10_000).alias("cost_drag_bps"))


def cost_sensitivity(series: DataFrame, multipliers: Sequence[float] = (0.0, 0.5, 1.0, 2.0, 3.0, 5.0), rf: float = 0.04) -> DataFrame:
    """Sharpe ratio with costs scaled: each day's return gives back its cost ratio and pays it ``multiplier`` times."""
    wide = series.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])))
    ret = F.col("ret") + F.coalesce(F.col("cost") / F.col("equity"), F.lit(0.0)) * (1 - F.col("multiplier"))
    a = wide.groupBy("strategy", "multiplier").agg(F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("sd"))
    return a.select("strategy", "multiplier", sharpe(F.col("mean"), F.col("sd"), rf).alias("sharpe"))


def ranking(report: DataFrame, by: str = "sharpe") -> DataFrame:
    """``rank`` by a figure, the best first, ties by name. One row a strategy; ranked in one task."""
    return report.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(by).desc_nulls_last(), "strategy")))


def comparison(series: DataFrame, rf: float = 0.04) -> DataFrame:
    """One row a strategy: Sharpe ratio, volatility, CAGR, worst drawdown of equity, turnover a year and total cost, ranked by Sharpe ratio.

    Days without a return count for the equity figures only, days without equity
    for the return figures only; a strategy that has neither of one kind has nulls there.
    """
    returning = series.where("ret is not null")
    report = risk_report(returning, ("strategy",), rf).select("strategy", "sharpe", "ann_vol")
    wealth = equity_summary(series).select("strategy", "cagr", "max_dd")
    trades = turnover_analysis(returning).select("strategy", "ann_turnover")
    paid = returning.groupBy("strategy").agg(F.sum("cost").alias("total_cost"))
    return ranking(report.join(wealth, "strategy", "left").join(trades, "strategy", "left").join(paid, "strategy", "left"))


def monthly_heatmap(series: DataFrame) -> DataFrame:
    """Compounded return per month, one row a year and one column a month."""
    months = list(range(1, 13))
    dated = series.select("strategy", F.year("date").alias("year"), F.month("date").alias("month"), "ret")
    out = dated.groupBy("strategy", "year").pivot("month", months).agg(F.exp(F.sum(F.log1p("ret"))) - 1)
    return out.select("strategy", "year", *[F.col(str(m)).alias(f"m{m:02d}") for m in months])


def normalised(series: DataFrame) -> DataFrame:
    return series.where("equity is not null").select("strategy", "date", (F.col("equity") / F.first("equity").over(so_far("strategy"))).alias("level"))


def rank_correlation(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman correlation of two columns, ties at their average rank."""

    def rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(F.lit(0)).orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2

    return pairs.select(rank(x).alias("rx"), rank(y).alias("ry")).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("spearman"))
