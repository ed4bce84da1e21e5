"""Daily factor files: text with a preamble, rows of a date and percentages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIVE = ("mkt_rf", "smb", "hml", "rmw", "cma", "rf")
#: Codes of missing figures in the files.
MISSING = (-99.99, -999.0)


def read_factors(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """``date`` and the named columns as decimals: lines whose first field is eight digits, other lines skipped."""
    cells = F.split("value", ",")
    rows = spark.read.text(path).where(F.trim(cells[0]).rlike("^[0-9]{8}$"))
    percent = [F.trim(cells[k + 1]).try_cast("double") for k in range(len(names))]
    return rows.select(F.to_date(F.trim(cells[0]), "yyyyMMdd").alias("date"), *[F.when(~p.isin(*MISSING), p / 100).alias(n) for p, n in zip(percent, names, strict=True)])


def six_factors(spark: SparkSession, five: str, momentum: str) -> DataFrame:
    """Five factors and the riskless rate joined with momentum on common dates."""
    return read_factors(spark, five, FIVE).join(read_factors(spark, momentum, ("mom",)), "date")


def with_fallback(read: Callable[[], DataFrame], cached: Callable[[], DataFrame]) -> DataFrame:
    """The first reader, or the cached copy where it fails (it is tried on one row)."""
    try:
        df = read()
        df.take(1)
    except Exception:  # noqa: BLE001
        return cached()
    return df
