"""Rolling totals over trailing calendar periods."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import day_number, number
from panelforge.plans.scans import blocked_scan
from panelforge.plans.storage import write_table

#: Calendar days per block.
BLOCK_DAYS = 256
#: Amounts are added as whole numbers, so adding and later subtracting leaves no residue: each is rounded to ten decimals, returns count in units of the tenth, equity in wholes and such units.
EXACT, UNIT = "decimal(27,10)", 10_000_000_000


def daily_series(equity: DataFrame) -> DataFrame:
    """One row per strategy and calendar day from its first to its last ``trade_date``.

    Of several rows for a day the one with the latest ``loaded_at`` counts (null
    loads last; then the larger values). ``ret`` is 0 where absent; ``equity`` is
    carried from the last earlier day, null before the first. NaN counts as null.
    Rows without strategy or day are left out. Each row brings the days since the
    row before it, so nothing is joined to a calendar. Writes two tables (actions).
    """
    rows = equity.select("strategy", "trade_date", "loaded_at", number("ret").alias("ret"), number("equity").alias("equity")).where("strategy is not null and trade_date is not null")
    best = rows.groupBy("strategy", day_number("trade_date").alias("day")).agg(F.max(F.struct("loaded_at", "ret", "equity")).alias("row"))
    kept = write_table(best.select("strategy", "day", F.floor(F.col("day") / BLOCK_DAYS).alias("block"), "row.ret", "row.equity"), "kept")
    scanned = blocked_scan(kept, ["strategy"], "block", ["day"], befores={"day_before": "day", "equity_before": "equity"})
    days = scanned.select("*", F.explode(F.sequence(F.coalesce(F.col("day_before") + 1, "day"), "day")).alias("at"))
    own = F.col("at") == F.col("day")
    return write_table(days.select("strategy", F.col("at").alias("day"), own.alias("has_row"), F.when(own, F.coalesce("ret", F.lit(0.0))).otherwise(0.0).alias("ret"), F.when(own, F.coalesce("equity", "equity_before")).otherwise(F.col("equity_before")).alias("equity")), "days")


def trailing_totals(equity: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals and averages of ``ret`` and ``equity`` over trailing calendar days.

    Each day's amount is an event that adds on its day and subtracts once it has
    left the window; the running sum of these deltas is the window's total. The
    deltas are whole numbers, so the sums are exact. Columns: ``strategy, trade_date,
    window_days, ret, equity, ret_sum, ret_mean, equity_sum, equity_mean``. Means
    divide by the days there are (the first days of a strategy have short
    windows; equity before its first value counts neither way). Empty in, empty out.
    Writes the tables of :func:`daily_series` (actions).
    """
    windows = [int(w) for w in windows]
    value = F.col("equity").cast(EXACT)
    whole = F.floor(value)
    days = daily_series(equity).select("strategy", "day", "ret", "equity", (F.col("ret").cast(EXACT) * UNIT).cast("long").alias("r"), whole.cast("long").alias("e"), ((value - whole) * UNIT).cast("long").alias("f"))
    span = days.groupBy("strategy").agg(F.max("day").alias("last"), F.min("day").alias("first"), F.min(F.when(F.col("equity").isNotNull(), F.col("day"))).alias("first_equity"))
    leaves = F.explode(F.array(*[F.lit(w) for w in (0, *windows)]))
    events = days.select("strategy", "day", leaves.alias("after"), "ret", "equity", "r", "e", "f").withColumn("at", F.col("day") + F.col("after"))
    adds = F.col("after") == 0
    own = [F.when(adds, F.col(c)).alias(c) for c in ("ret", "equity")]
    events = events.join(span, "strategy").where("at <= last").select("strategy", F.floor(F.col("at") / BLOCK_DAYS).alias("block"), "at", "after", *own, "r", "e", "f", "first", "first_equity").repartition("strategy", "block")
    names = {(k, w): f"{k}_{w}" for w in windows for k in ("r", "e", "f")}
    deltas = events.select("strategy", "block", "at", adds.alias("adds"), "ret", "equity", "first", "first_equity", *[F.when(adds, F.col(k)).when(F.col("after") == w, -F.col(k)).alias(f"d_{name}") for (k, w), name in names.items()])
    total = blocked_scan(deltas, ["strategy"], "block", ["at", "adds"], sums={name: f"d_{name}" for name in names.values()}).where("adds")
    long = total.select("strategy", "at", "ret", "equity", "first", "first_equity", F.explode(F.array(*[F.struct(F.lit(w).alias("window_days"), *[F.col(names[k, w]).alias(k) for k in ("r", "e", "f")]) for w in windows])).alias("t"))
    ret_sum = F.col("t.r") / F.lit(float(UNIT))
    equity_sum = (F.col("t.e").cast("decimal(20,0)") + F.col("t.f").cast("decimal(20,0)") * F.lit(Decimal(1) / UNIT)).cast("double")
    days_since = lambda c: F.least(F.col("t.window_days"), F.col("at") - F.col(c) + 1)
    has = F.col("first_equity") <= F.col("at")
    return long.select(
        "strategy",
        F.date_add(F.lit("1970-01-01").cast("date"), F.col("at")).alias("trade_date"),
        "t.window_days",
        "ret",
        "equity",
        ret_sum.alias("ret_sum"),
        (ret_sum / days_since("first")).alias("ret_mean"),
        F.when(has, equity_sum).alias("equity_sum"),
        F.when(has, equity_sum / days_since("first_equity")).alias("equity_mean"),
    )


def drawdown_cases(totals: DataFrame, ret_limit: float = -0.12, equity_ratio: float = 1.12) -> DataFrame:
    """Of 7- and 30-day totals, the days whose 7-day return sum (six decimals) is at most ``ret_limit`` or whose 30-day mean equity is at least ``equity_ratio`` times the day's."""
    weak = (F.col("window_days") == 7) & (F.round("ret_sum", 6) <= ret_limit)
    under = (F.col("window_days") == 30) & (F.col("equity_mean") >= F.lit(equity_ratio) * F.col("equity"))
    return totals.where(weak | under).select("strategy", F.date_format("trade_date", "yyyy-MM-dd").alias("day"), "window_days")
