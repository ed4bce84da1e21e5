"""Exact percentiles per group of very large columns, from partial results that can be combined."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import number
from panelforge.plans.storage import broadcast_if_small, partitions_for, write_table

#: Wanted positions up to this many rows (24 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_TARGETS = 500_000


def partial(df: DataFrame, group: str, row_key: str, metrics: Sequence[str]) -> DataFrame:
    """A partial result of one day or file: its distinct ``(metric, group, value, row key)``.

    Null and NaN values, and rows without group or key, are left out. Repeats of
    a row fall together whether they lie in one partial result or in several.
    Nothing is shuffled here; repeats are removed where partial results meet.
    """
    each = F.array(*[F.struct(F.lit(i).alias("metric"), number(m).alias("value")) for i, m in enumerate(metrics)])
    long = df.where(F.col(group).isNotNull() & F.col(row_key).isNotNull()).select(F.col(group).alias("group"), F.col(row_key).alias("key"), F.explode(each).alias("x"))
    return long.select(F.col("x.metric").alias("metric"), "group", F.col("x.value").alias("value"), "key").where("value is not null")


def combine(partials: Sequence[DataFrame]) -> DataFrame:
    """The union of partial results; associative and commutative, repeats included."""
    first, *rest = partials
    for other in rest:
        first = first.unionByName(other)
    return first


def sorted_runs(combined: DataFrame, label: str = "order") -> DataFrame:
    """The full distributed sort: every value once, in the order (metric, group, value), written with its place.

    One range shuffle orders the rows and brings repeats side by side, where they
    are dropped. ``place`` is partition number times 2**33 plus the position in
    the partition. Range bounds come from the rows, so a group that holds a third
    of them spreads over a third of the partitions, whose number follows the
    estimated size. Writes a table (an action).
    """
    n = partitions_for(combined)
    order = ["metric", "group", "value", "key"]
    ranged = combined.repartitionByRange(n, *order).dropDuplicates(order).sortWithinPartitions(*order)
    return write_table(ranged.select("metric", "group", "value", F.monotonically_increasing_id().alias("place")), label)


def percentiles(runs: DataFrame, wanted: Mapping[int, Sequence[float]], group_name: str = "group") -> DataFrame:
    """Linearly interpolated percentiles per metric and group from :func:`sorted_runs`.

    Counts per partition and group give each partition's offset within the
    group; the target positions are located by these offsets as exact places, and
    the one or two neighbouring order statistics are fetched and interpolated:
    the result is exact, ties included. Columns ``metric, <group>, fraction,
    value, n``. Groups without values do not come out.
    """
    counts = runs.groupBy("metric", "group", F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n_part"), F.min("place").alias("first_place"))
    in_group = Window.partitionBy("metric", "group")
    placed = counts.withColumn("end", F.sum("n_part").over(in_group.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("n_part").over(in_group))
    fractions = F.map_from_arrays(F.array(*[F.lit(m) for m in wanted]), F.array(*[F.array(*[F.lit(float(q)) for q in qs]) for qs in wanted.values()]))
    position = F.col("fraction") * (F.col("n") - 1)
    targets = (
        placed.select("*", F.explode(fractions[F.col("metric")]).alias("fraction"))
        .withColumn("low", F.floor(position))
        .withColumn("weight", position - F.col("low"))
        .select("metric", "group", "n", "fraction", "first_place", "n_part", "end", F.explode(F.array(F.struct(F.col("low").alias("at"), (1 - F.col("weight")).alias("w")), F.struct((F.col("low") + 1).alias("at"), F.col("weight").alias("w")))).alias("t"))
        .where("t.w > 0 and t.at >= end - n_part and t.at < end")
        .select("metric", "group", "n", "fraction", "t.w", (F.col("first_place") + F.col("t.at") - F.col("end") + F.col("n_part")).alias("place"))
    )
    targets = broadcast_if_small(targets, BROADCAST_TARGETS)
    found = runs.select("place", "value").join(targets, "place")
    return found.groupBy("metric", F.col("group").alias(group_name), "fraction").agg(F.sum(F.col("value") * F.col("w")).alias("value"), F.max("n").alias("n"))


def group_percentiles(df: DataFrame, group: str, row_key: str, wanted: Mapping[str, Sequence[float]]) -> DataFrame:
    """Exact percentiles of several columns per group, repeats of ``(group, row_key)`` with an equal value counted once.

    Empty tables give no rows; extra columns are not read.
    """
    metrics = list(wanted)
    runs = sorted_runs(combine([partial(df, group, row_key, metrics)]))
    out = percentiles(runs, {i: wanted[m] for i, m in enumerate(metrics)}, group)
    names = F.array(*[F.lit(m) for m in metrics])
    return out.withColumn("metric", names[F.col("metric")])
