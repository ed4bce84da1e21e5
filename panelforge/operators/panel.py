"""Price panels: alignment, gaps, returns, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_ticker() -> Window:
    return Window.partitionBy("ticker").orderBy("date")


def align(panel: DataFrame, limit: int | None = 5) -> DataFrame:
    """Outer alignment of all tickers on all dates; gaps carried over at most ``limit`` rows; dates kept only if every ticker has a price.

    The dates become one row (an array bounded by the calendar) that is joined to
    the tickers by a constant key, so no ticker's rows meet another's.
    """
    constant = F.lit(0).alias("_k")
    dates = panel.where("date is not null").agg(F.array_sort(F.collect_set("date")).alias("dates")).select("dates", constant)
    tickers = panel.where("ticker is not null").select("ticker").distinct()
    grid = tickers.select("ticker", constant).join(F.broadcast(dates), "_k").select("ticker", F.explode("dates").alias("date"))
    values = [c for c in panel.columns if c not in ("date", "ticker")]
    frame = by_ticker().rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    filled = grid.join(panel, ["date", "ticker"], "left").select("date", "ticker", *[F.last(c, ignorenulls=True).over(frame).alias(c) for c in values])
    n = tickers.agg(F.count("*").alias("_n")).select("_n", constant)
    complete = Window.partitionBy("date")
    return filled.withColumn("_have", F.count("px").over(complete)).withColumn("_k", F.lit(0)).join(F.broadcast(n), "_k").where("_have = _n").select("date", "ticker", *values)


def log_returns(panel: DataFrame) -> DataFrame:
    """``ln(px / previous px)``; the first row of a ticker is dropped; a price of zero or below is an error."""
    w = by_ticker()
    px = F.when(F.col("px") > 0, F.col("px")).otherwise(F.raise_error(F.lit("prices must be positive")).cast("double"))
    return panel.withColumn("px", px).select("date", "ticker", F.log(F.col("px") / F.lag("px").over(w)).alias("r")).where("r is not null")


def simple_returns(panel: DataFrame) -> DataFrame:
    return panel.select("date", "ticker", (F.col("px") / F.lag("px").over(by_ticker()) - 1).alias("r")).where("r is not null")


def simple_to_log(r: Column) -> Column:
    return F.log1p(r)


def log_to_simple(r: Column) -> Column:
    return F.expm1(r)


def handle_missing(returns: DataFrame, method: str = "drop") -> DataFrame:
    """Missing returns: ``drop`` dates with any, ``zero``, or ``ffill`` then drop; else an error."""
    if method == "zero":
        return returns.fillna(0.0, ["r"])
    if method not in ("drop", "ffill"):
        raise ValueError(f"unknown method {method!r}; choose drop, zero or ffill")
    if method == "ffill":
        returns = returns.withColumn("r", F.last("r", ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("date")
    return returns.withColumn("_gap", F.max(F.col("r").isNull()).over(whole)).where("not _gap").drop("_gap")


def annualised(returns: DataFrame, days: int = 252) -> DataFrame:
    return returns.groupBy("ticker").agg((F.avg("r") * days).alias("ann_return"), (F.stddev_samp("r") * F.sqrt(F.lit(days))).alias("ann_vol"))


def calendar(panel: DataFrame, frequency: str = "monthly") -> DataFrame:
    """``date, rn, is_reb, reb_id``: every date numbered; rebalances on the first date and where the month number changes, or daily."""
    dates = panel.select("date").distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    if frequency == "monthly":
        flag = F.coalesce(F.month("date") != F.month(F.lag("date").over(w)), F.lit(True))
    elif frequency == "daily":
        flag = F.lit(True)
    else:
        raise ValueError(f"unknown frequency {frequency!r}; choose monthly or daily")
    marked = dates.select("date", F.row_number().over(w).alias("rn"), flag.alias("is_reb"))
    return marked.withColumn("reb_id", F.sum(F.col("is_reb").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def month_starts(panel: DataFrame) -> DataFrame:
    """The first date of each calendar month."""
    return panel.groupBy(F.date_trunc("month", "date").cast("date").alias("month")).agg(F.min("date").alias("date"))


def asof(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], fallback: dict | None = None, clamp: bool = False) -> DataFrame:
    """Left rows with the last non-null ``values`` of ``right`` at or before ``at``; ``clamp`` takes the first ones before there are any; then ``fallback``."""
    marks = right.select(key, at, *values, F.lit(0).alias("_side"))
    asked = left.select("*", F.lit(1).alias("_side"))
    both = asked.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(0, Window.unboundedFollowing)
    out = both
    for v in values:
        found = F.last(v, ignorenulls=True).over(w)
        if clamp:
            found = F.coalesce(found, F.first(v, ignorenulls=True).over(ahead))
        out = out.withColumn(f"_{v}", found)
    chosen = [(F.coalesce(F.col(f"_{v}"), F.lit(fallback[v])) if fallback and v in fallback else F.col(f"_{v}")).alias(v) for v in values]
    return out.where("_side = 1").select(*left.columns, *chosen)


def tail(panel: DataFrame, n: int = 5) -> DataFrame:
    """All rows of the last ``n`` dates; fewer where there are fewer. Only the ``n`` dates are brought together."""
    dates = panel.select("date").where("date is not null").distinct().orderBy(F.col("date").desc()).limit(n)
    return panel.join(F.broadcast(dates), "date", "left_semi")
