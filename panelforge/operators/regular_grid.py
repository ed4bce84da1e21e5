"""Irregular readings onto a regular grid of periods per source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import minute_number, minute_text, number
from panelforge.plans.scans import blocked_scan

#: Periods per block. A block is scanned by one task.
BLOCK = 2048


def regular_grid(readings: DataFrame, universe: DataFrame, max_gap: int = 3) -> DataFrame:
    """One row per ticker and period of its cadence, from its first to its last reading.

    Readings are aggregated per period first (last valid value by ``ts``, then
    ``arrived_at``), the sequence of periods is generated per ticker in blocks,
    the aggregates are joined to it on the left, and the last observation is
    carried over at most ``max_gap`` periods. ``<field>_status`` is ``observed``,
    ``filled`` or ``missing``; ``<field>_age`` counts the periods since the value
    was read.

    Null and NaN values are no observations but their rows extend the span of
    periods. Rows with null ``ticker`` or ``ts``, tickers without a positive
    cadence, or absent from ``universe``, have no grid. If ``universe`` repeats a
    ticker, the smallest cadence holds. Ties at one ``ts`` and ``arrived_at`` go
    to the larger value. Empty inputs give an empty grid.
    """
    cadence = (
        universe.select("ticker", F.col("cadence_min").cast("long").alias("cadence"))
        .where("ticker is not null and cadence > 0")
        .groupBy("ticker")
        .agg(F.min("cadence").alias("cadence"))
    )
    rows = (
        readings.select("ticker", "ts", "arrived_at", number("px").alias("px"), number("volume").alias("volume"))
        .where("ticker is not null and ts is not null")
        .join(cadence, "ticker")
        .withColumn("slot", F.floor(minute_number("ts") / F.col("cadence")))
    )

    def latest(c: str):
        return F.max(F.when(F.col(c).isNotNull(), F.struct("ts", "arrived_at", c)))[c].alias(c)

    per_slot = rows.groupBy("ticker", "cadence", "slot").agg(F.count("*").alias("n_readings"), latest("px"), latest("volume"))
    span = per_slot.groupBy("ticker", "cadence").agg(F.min("slot").alias("first"), F.max("slot").alias("last"))
    blocks = span.select("ticker", "cadence", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("last") / BLOCK))).alias("block"))
    spread = blocks.repartition("ticker", "block")
    grid = spread.select(
        "ticker",
        "cadence",
        "block",
        F.explode(F.sequence(F.greatest("first", F.col("block") * BLOCK), F.least("last", F.col("block") * BLOCK + BLOCK - 1))).alias("slot"),
    )
    observed = per_slot.drop("cadence").withColumn("block", F.floor(F.col("slot") / BLOCK))
    joined = grid.join(observed, ["ticker", "block", "slot"], "left").select(
        "ticker",
        "cadence",
        "block",
        "slot",
        F.coalesce("n_readings", F.lit(0)).alias("n_readings"),
        *[F.when(F.col(c).isNotNull(), F.struct(F.col("slot").alias("at"), F.col(c).alias("v"))).alias(f"{c}_seen") for c in ("px", "volume")],
    )
    scanned = blocked_scan(joined, ["ticker"], "block", ["slot"], lasts={"px_last": "px_seen", "volume_last": "volume_seen"})
    out = []
    for c in ("px", "volume"):
        age = F.col("slot") - F.col(f"{c}_last.at")
        out += [
            F.when(age <= max_gap, F.col(f"{c}_last.v")).alias(c),
            F.when(age == 0, "observed").when(age <= max_gap, "filled").otherwise("missing").alias(f"{c}_status"),
            age.alias(f"{c}_age"),
        ]
    return scanned.select("ticker", minute_text(F.col("slot") * F.col("cadence")).alias("slot_start"), "cadence", "n_readings", *out)


def unobserved(grid: DataFrame) -> DataFrame:
    """Of a grid, the periods and fields without a reading: ``ticker, slot_start, field``."""
    fields = [F.when(F.col(f"{c}_status") != "observed", F.lit(c)) for c in ("px", "volume")]
    return grid.select("ticker", "slot_start", F.explode(F.array_compact(F.array(*fields))).alias("field"))
