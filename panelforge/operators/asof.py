"""Attributes as known at event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import day_number
from panelforge.plans.scans import blocked_scan

#: Days per block of the carried state.
BLOCK_DAYS = 64


def _sets(weights: DataFrame) -> DataFrame:
    """Weight sets by header: one row per set, restated headers kept apart, rows without owner, date or knowledge left out."""
    return (
        weights.select("strategy", "set_id", "reb_date", "known_at")
        .where("strategy is not null and set_id is not null and reb_date is not null and known_at is not null")
        .distinct()
    )


def _events(equity: DataFrame) -> DataFrame:
    return equity.select("strategy", "trade_date", "asof_ts").where("strategy is not null and trade_date is not null and asof_ts is not null").distinct()


def _carry(events: DataFrame, sets: DataFrame, event_time: Column, set_time: Column, name: str) -> DataFrame:
    """Carry the best header (latest reb_date, then known_at, then set_id) known so far onto each event.

    Changes sort before events at the same moment. The state is a running
    maximum: a late restatement of an old set never displaces a newer one.
    """
    header = F.struct("reb_date", "known_at", "set_id")
    kinds = ["strategy", "trade_date", "asof_ts"]
    nothing = {c: F.lit(None).cast(dict(events.dtypes)[c]) for c in kinds[1:]}
    changes = sets.select("strategy", *[v.alias(c) for c, v in nothing.items()], set_time.alias("at"), F.lit(0).alias("rank"), header.alias("header"))
    waiting = events.select(*kinds, event_time.alias("at"), F.lit(1).alias("rank"), F.lit(None).cast(changes.schema["header"].dataType).alias("header"))
    line = changes.unionByName(waiting).withColumn("block", F.floor(day_number(F.col("at").cast("date")) / BLOCK_DAYS))
    scanned = blocked_scan(line, ["strategy"], "block", ["at", "rank"], maxes={name: "header"})
    return scanned.where("rank = 1").select(*kinds, name)


def known_sets(equity: DataFrame, weights: DataFrame) -> DataFrame:
    """For each strategy and day of ``equity`` the weight set usable at ``asof_ts`` and the one hindsight would pick.

    Events and attribute changes are united and sorted by strategy and time of
    availability (a set is available from the later of ``known_at`` and the start
    of ``reb_date``; at equal times changes come first), and the best header so
    far is carried forward in blocks of days. ``usable`` and ``hindsight`` are
    structs ``(reb_date, known_at, set_id)`` or null; an event is never dropped.
    ``hindsight`` ignores when a set became known.

    Availability folds both conditions into one time because ``asof_ts`` lies on
    ``trade_date``; for events where it does not, the time used is the earlier of
    ``asof_ts`` and the end of ``trade_date``, so nothing unknown is ever used.
    Exact repeats count once; of equal (reb_date, known_at) the larger set_id
    counts. Null strategy, day or asof_ts: no event. Null known_at: never known.
    """
    events, sets = _events(equity), _sets(weights)
    start = lambda c: F.col(c).cast("timestamp_ntz")
    last_moment = F.expr("cast(date_add(trade_date, 1) as timestamp_ntz) - interval '0.000001' second")
    usable = _carry(events, sets, F.least(F.col("asof_ts").cast("timestamp_ntz"), last_moment), F.greatest(F.col("known_at").cast("timestamp_ntz"), start("reb_date")), "usable")
    hindsight = _carry(events, sets, start("trade_date"), start("reb_date"), "hindsight")
    return usable.join(hindsight, ["strategy", "trade_date", "asof_ts"])


def returns_with_known_weights(equity: DataFrame, weights: DataFrame) -> DataFrame:
    """Every distinct row of ``equity`` (day, return, load time) with the weights known at its ``asof_ts``.

    ``set_id`` and ``weights`` (ticker to weight) are null where nothing was known
    yet. Of repeated (set, ticker) rows with different weights the largest counts;
    null weights are left out of the map.
    """
    chosen = known_sets(equity, weights).select("strategy", "trade_date", "asof_ts", "usable.set_id")
    held = (
        weights.select("strategy", "set_id", "ticker", "w")
        .where("ticker is not null and w is not null")
        .groupBy("strategy", "set_id", "ticker")
        .agg(F.max("w").alias("w"))
        .groupBy("strategy", "set_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ticker", "w")))).alias("weights"))
    )
    days = equity.select("strategy", "trade_date", "ret", "asof_ts", "loaded_at").where("strategy is not null and trade_date is not null").distinct()
    return days.join(chosen, ["strategy", "trade_date", "asof_ts"], "left").join(held, ["strategy", "set_id"], "left")
