"""Constant codes that stand for "no data"."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import number
from panelforge.plans.storage import broadcast_if_small, write_table

#: Frequent values (some 50 bytes each) up to which they are broadcast; beyond, the join shuffles.
BROADCAST_VALUES = 200_000


def no_data_codes(panel: DataFrame, value: str = "px", entity: str = "ticker", share: float = 0.08, least: int = 2, far: float = 20.0) -> DataFrame:
    """The constants that recur for many entities and lie far off the level of each of them.

    A value is a code if at least ``share`` of all entities (and ``least``) carry
    it, and in at most one of five of its rows it lies within ``far`` times of the
    entity's own median (never so for negative values). Zero is an impossible
    price rather than a code. Returns one column, ``code``; its size is bounded by
    ``1 / share`` times the distinct values one entity can carry everywhere, in
    practice a handful. Ties, repeats and nulls: repeats count once per entity,
    nulls and NaN never; an empty table has no codes.
    """
    rows = panel.select(F.col(entity).alias("_e"), number(value).alias("_v")).where("_e is not null and _v is not null")
    levels = write_table(rows.groupBy("_e").agg(F.percentile_approx(F.when(F.col("_v") > 0, F.col("_v")), 0.5, 200).alias("level")), "levels")
    wanted = max(float(least), levels.count() * share)
    often = rows.where("_v <> 0").groupBy("_v").agg(F.count("*").alias("n"), F.min("_e").alias("a"), F.max("_e").alias("b")).where((F.col("n") >= wanted) & (F.col("a") != F.col("b"))).select("_v")
    often = write_table(often, "often")
    seen = rows.join(broadcast_if_small(often, BROADCAST_VALUES), "_v").groupBy("_v", "_e").agg(F.count("*").alias("n")).join(levels, "_e")
    near = F.coalesce((F.col("_v") > 0) & (F.greatest(F.col("_v") / F.col("level"), F.col("level") / F.col("_v")) <= far), F.lit(False)).cast("double")
    found = seen.groupBy("_v").agg(F.count("*").alias("n_e"), F.avg(near).alias("near")).where((F.col("n_e") >= wanted) & (F.col("near") <= 0.2))
    return write_table(found.select(F.col("_v").alias("code")), "codes")
