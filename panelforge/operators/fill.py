"""Filling missing values from similar records, each filled value marked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import day_number, number
from panelforge.operators.nodata import no_data_codes
from panelforge.plans.scans import blocked_scan
from panelforge.plans.storage import write_table

#: Days per block.
BLOCK_DAYS = 256
#: Largest log return that counts in a class's mean.
STEP = 0.5


def neighbours(df: DataFrame, entity: str, day: str, columns: Sequence[str]) -> DataFrame:
    """Add ``<c>_prev`` and ``<c>_next``, structs ``(at, v)`` of the nearest observed value at or before and at or after each row, and ``<c>_before``, the last one before it.

    ``(entity, day)`` must be unique and non-null, ``day`` an integer. Writes a table (an action), so what ``df`` comes from is evaluated once.
    """
    seen = [F.when(F.col(c).isNotNull(), F.struct(F.col(day).alias("at"), F.col(c).alias("v"))).alias(f"_seen_{c}") for c in columns]
    framed = write_table(df.select("*", F.floor(F.col(day) / BLOCK_DAYS).alias("_block"), *seen), "days")
    source = {c: f"_seen_{c}" for c in columns}
    scanned = blocked_scan(framed, [entity], "_block", [day], lasts={f"{c}_prev": v for c, v in source.items()}, befores={f"{c}_before": v for c, v in source.items()}, nexts={f"{c}_next": v for c, v in source.items()})
    return scanned.drop("_block", *source.values())


def fill_series(df: DataFrame, entity: str, day: str, numeric: Sequence[str] = (), categorical: Sequence[str] = (), max_gap: int = 10) -> DataFrame:
    """Time-ordered filling per entity.

    Numeric values are interpolated linearly between observed neighbours at most
    ``max_gap`` days apart from the row; categories are carried forward at most
    ``max_gap`` days. For each column ``c`` three columns come out: ``c`` filled,
    ``c_method`` (``observed``, ``interpolated``, ``carried``, ``missing``) and
    ``c_distance`` (days to the nearer value used). Rows without entity or day
    are left out; NaN is missing; ``(entity, day)`` must be unique.
    """
    kept = df.select(F.col(entity), F.col(day), *[number(c).alias(c) for c in numeric], *[F.col(c) for c in categorical]).where(F.col(entity).isNotNull() & F.col(day).isNotNull())
    wide = neighbours(kept, entity, day, [*numeric, *categorical])
    at, out = F.col(day), []
    for c in numeric:
        p, n = F.col(f"{c}_prev"), F.col(f"{c}_next")
        back, ahead = at - p["at"], n["at"] - at
        near = (back <= max_gap) & (ahead <= max_gap)
        mid = p["v"] + (n["v"] - p["v"]) * back / (back + ahead)
        method = F.when(F.col(c).isNotNull(), "observed").when(near, "interpolated").otherwise("missing")
        out += [F.coalesce(F.col(c), F.when(near, mid)).alias(c), method.alias(f"{c}_method"), F.when(method == "observed", 0).when(near, F.least(back, ahead)).cast("int").alias(f"{c}_distance")]
    for c in categorical:
        p = F.col(f"{c}_prev")
        back = at - p["at"]
        method = F.when(back == 0, "observed").when(back <= max_gap, "carried").otherwise("missing")
        out += [F.when(back <= max_gap, p["v"]).alias(c), method.alias(f"{c}_method"), F.when(back <= max_gap, back).cast("int").alias(f"{c}_distance")]
    return wide.select(entity, day, *out)


def fill_panel(panel: DataFrame, universe: DataFrame, max_gap: int = 10) -> DataFrame:
    """The panel with one price per ticker and delivered day, missing ones filled.

    A day is missing if none of its rows carries a price: all null, NaN or a
    no-data code. Impossible prices (zero or below) are not missing, but neither
    are they used; they come out as ``unusable`` with a null price. Methods, in
    this order: ``interpolated`` in time between the ticker's own observed days
    at most ``max_gap`` days away; ``class``: the nearest own price within
    ``max_gap`` days moved by the mean daily log return of the ticker's asset
    class over the days between; ``carried``: that price unmoved, where the class
    is unknown or has no returns; else ``missing`` and null. ``px_distance`` is in
    days. Of several prices of a day the one fetched last counts (ties: the
    larger). Asset classes match without regard to case and outer blanks. In a
    class's mean a log return counts as at most STEP up or down, so one wrong price
    does not move a class. Tables of days, neighbours and class levels (one row a
    class and day) are written (actions).
    """
    codes = no_data_codes(panel).select(F.col("code").alias("px"), F.lit(True).alias("is_code"))
    rows = panel.select("ticker", "trade_date", "fetched_at", number("px").alias("px")).where("ticker is not null and trade_date is not null").join(codes, "px", "left")
    carries = F.col("px").isNotNull() & F.col("is_code").isNull()
    days = rows.groupBy("ticker", day_number("trade_date").alias("day")).agg(
        F.max(F.when(carries & (F.col("px") > 0), F.struct("fetched_at", "px")))["px"].alias("px"),
        F.max(carries).alias("delivered"),
    )
    kinds = universe.select("ticker", F.upper(F.trim("asset_class")).alias("asset_class")).where("ticker is not null").groupBy("ticker").agg(F.max(F.when(F.col("asset_class") != "", F.col("asset_class"))).alias("asset_class"))
    wide = write_table(neighbours(days.join(kinds, "ticker", "left"), "ticker", "day", ["px"]), "neighbours")
    returns = wide.where("px is not null and asset_class is not null and px_before is not null").select("asset_class", "day", F.log(F.col("px") / F.col("px_before.v")).alias("r"))
    by_class = returns.groupBy("asset_class", "day").agg(F.avg(F.greatest(F.lit(-STEP), F.least(F.lit(STEP), F.col("r")))).alias("r"))
    to_day = Window.partitionBy("asset_class").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    index = write_table(by_class.select("asset_class", "day", F.sum("r").over(to_day).alias("level")), "index")

    p, n = F.col("px_prev"), F.col("px_next")
    back, ahead = F.col("day") - p["at"], n["at"] - F.col("day")
    has_back, has_ahead = F.coalesce(back <= max_gap, F.lit(False)), F.coalesce(ahead <= max_gap, F.lit(False))
    use_back = has_back & (~has_ahead | (back <= ahead))
    wide = wide.withColumn("near", F.when(use_back, p).when(has_ahead, n))
    gaps = wide.where("px is null")
    gaps = gaps.withColumn("near_day", F.col("near.at")).join(index.withColumnRenamed("level", "level_here"), ["asset_class", "day"], "left")
    gaps = gaps.join(index.select("asset_class", F.col("day").alias("near_day"), F.col("level").alias("level_near")), ["asset_class", "near_day"], "left")
    moved_px = F.col("near.v") * F.exp(F.col("level_here") - F.col("level_near"))
    mid = p["v"] + (n["v"] - p["v"]) * back / (back + ahead)
    method = (
        F.when(F.col("delivered"), "unusable").when(has_back & has_ahead, "interpolated").when(F.col("near").isNotNull() & moved_px.isNotNull(), "class").when(F.col("near").isNotNull(), "carried").otherwise("missing")
    )
    filled = gaps.withColumn("px_method", method).select(
        "ticker",
        "day",
        F.when(F.col("px_method") == "interpolated", mid).when(F.col("px_method") == "class", moved_px).when(F.col("px_method") == "carried", F.col("near.v")).alias("px"),
        "px_method",
        F.when(F.col("px_method").isin("interpolated", "class", "carried"), F.abs(F.col("near.at") - F.col("day"))).cast("int").alias("px_distance"),
    )
    kept = wide.where("px is not null").select("ticker", "day", "px", F.lit("observed").alias("px_method"), F.lit(0).alias("px_distance"))
    return kept.unionByName(filled).select("ticker", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("trade_date"), "px", "px_method", "px_distance")
