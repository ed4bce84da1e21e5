"""Running totals, running maxima and carried-forward values that never put one entity into one task.

A plain window over an entity sorts all rows of that entity in one task. Here a
series is cut into blocks of time; each block is reduced to one row, the small
block table is scanned per entity, and the result is carried into the blocks,
each of which is scanned by itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def blocked_scan(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str],
    *,
    sums: Mapping[str, str] | None = None,
    lasts: Mapping[str, str] | None = None,
    befores: Mapping[str, str] | None = None,
    nexts: Mapping[str, str] | None = None,
    maxes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add running columns per ``keys`` in the order of ``order``.

    ``block`` must be a non-null column that is monotone in ``order``. Each
    mapping goes from the new column to its source: ``sums`` adds non-null
    values, ``lasts`` keeps the latest non-null value, ``maxes`` the largest
    non-null one (a struct compares field by field), all with the row itself;
    ``befores`` is ``lasts`` without the row itself, ``nexts`` the nearest non-null
    value at or after the row. ``df`` is evaluated twice, once for one row a block:
    give it a written table, or one that costs as little. Keys must be non-null.
    Rows with equal ``order`` are scanned in unspecified order: make ``order``
    unique where that matters. An empty input gives an empty output.
    """
    sums, lasts, befores, nexts, maxes = (dict(m or {}) for m in (sums, lasts, befores, nexts, maxes))
    at = F.struct(*order)
    here = lambda c: F.when(F.col(c).isNotNull(), at)
    last_of = {c: f"_l{k}" for k, c in enumerate(dict.fromkeys([*lasts.values(), *befores.values()]))}
    per_block = df.groupBy(*keys, block).agg(
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.max_by(c, here(c)).alias(n) for c, n in last_of.items()],
        *[F.min_by(c, here(c)).alias(f"_n_{n}") for n, c in nexts.items()],
        *[F.max(c).alias(f"_m_{n}") for n, c in maxes.items()],
    )
    blocks = Window.partitionBy(*keys).orderBy(block)
    before, after = blocks.rowsBetween(Window.unboundedPreceding, -1), blocks.rowsBetween(1, Window.unboundedFollowing)
    carried = per_block.select(
        *keys,
        block,
        *[F.sum(f"_s_{n}").over(before).alias(f"_s_{n}") for n in sums],
        *[F.last(n, ignorenulls=True).over(before).alias(n) for n in last_of.values()],
        *[F.first(f"_n_{n}", ignorenulls=True).over(after).alias(f"_n_{n}") for n in nexts],
        *[F.max(f"_m_{n}").over(before).alias(f"_m_{n}") for n in maxes],
    )
    rows = Window.partitionBy(*keys, block).orderBy(*order)
    inside, earlier, later = (rows.rowsBetween(a, b) for a, b in ((Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1), (0, Window.unboundedFollowing)))
    columns = [F.col(c) for c in df.columns]
    kinds = dict(df.dtypes)
    for n, c in sums.items():
        a, b = F.col(f"_s_{n}"), F.sum(c).over(inside)
        if kinds[c].startswith("decimal"):  # the sum of two of 38 digits would lose one behind the point
            a, b = (x.cast(f"decimal(37,{kinds[c].rstrip(')').split(',')[1]})") for x in (a, b))
        columns.append(F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b).alias(n))
    columns += [F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(last_of[c])).alias(n) for n, c in lasts.items()]
    columns += [F.coalesce(F.last(c, ignorenulls=True).over(earlier), F.col(last_of[c])).alias(n) for n, c in befores.items()]
    columns += [F.coalesce(F.first(c, ignorenulls=True).over(later), F.col(f"_n_{n}")).alias(n) for n, c in nexts.items()]
    columns += [F.greatest(F.max(c).over(inside), F.col(f"_m_{n}")).alias(n) for n, c in maxes.items()]
    return df.join(carried, [*keys, block], "left").select(*columns)
