"""Implausible readings: spikes, stuck values, impossible values, each judged by its source's own behaviour."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import day_number, number
from panelforge.operators.nodata import no_data_codes
from panelforge.plans.storage import broadcast_if_small, write_table

#: Days per block and days seen on either side of it. A block is one task's group: at most BLOCK_DAYS + 2 * HALO_DAYS rows.
BLOCK_DAYS, HALO_DAYS = 2048, 96
#: Bars of the trend's running median, and bars on each side that give the level beside an excursion.
TREND_BARS, SIDE_BARS = 15, 3
#: No-data codes and flagged days (some 100 bytes each) up to which they are broadcast; beyond, the joins shuffle.
BROADCAST_CODES, BROADCAST_FLAGS = 100_000, 200_000

#: Rounds of trend and season.
ROUNDS = 2

FLAGS = "ticker string, day int, px_low double, px_high double, volume_low double, volume_high double, px_stuck double, volume_stuck double"


@lru_cache(maxsize=4096)
def esd_critical(n: int, k: int, alpha: float) -> np.ndarray:
    """The critical deviations of the generalised ESD test for the 1st to the ``k``-th outlier of ``n`` values, by an expansion of Student's t."""
    i = np.arange(1, k + 1)
    z = np.array([NormalDist().inv_cdf(v) for v in 1 - alpha / (2 * (n - i + 1))])
    df = np.maximum(n - i - 1, 3)
    t = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)
    return (n - i) * t / np.sqrt((n - i - 1 + t**2) * (n - i + 1))


def esd_limits(residual: np.ndarray, alpha: float = 0.01, most: float = 0.2) -> tuple[float, float]:
    """The residuals (low, high) beyond which the generalised extreme studentised deviate test calls a value an outlier.

    Up to ``most`` of the values are removed one after another, always the one
    farthest from the mean; mean and deviation are those of the values left, so
    outliers cannot hide each other. The limits are those of the test after the
    last deviation that is beyond its critical value. Infinite for fewer than 8 values.
    """
    x = np.sort(residual[np.isfinite(residual)])
    n = len(x)
    if n < 8:
        return -math.inf, math.inf
    k = max(1, int(most * n))
    critical = esd_critical(n, k + 1, alpha)
    v, total, squares = x.tolist(), float(x.sum()), float((x * x).sum())
    low, high, last = 0, n - 1, 0
    means, deviations = [], []
    for i in range(k + 1):
        left = n - i
        mean = total / left
        deviation = math.sqrt(max((squares - total * mean) / (left - 1), 1e-24))
        means.append(mean)
        deviations.append(deviation)
        out = v[high] if v[high] - mean >= mean - v[low] else v[low]
        if abs(out - mean) > critical[i] * deviation and i < k:
            last = i + 1
        if out is v[high]:
            high -= 1
        else:
            low += 1
        total -= out
        squares -= out * out
    reach = critical[last] * deviations[last]
    return means[last] - reach, means[last] + reach


def _running_median(x: np.ndarray) -> np.ndarray:
    half = min(TREND_BARS // 2, max(0, (len(x) - 1) // 2))
    if half == 0:
        return np.full(len(x), np.median(x) if len(x) else 0.0)
    padded = np.pad(x, half, mode="reflect")
    return np.partition(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), half, axis=1)[:, half]


def decompose(x: np.ndarray, weekday: np.ndarray) -> np.ndarray:
    """Trend plus season of a series without gaps: running median of what the season leaves, and the median of each weekday around it, in turns."""
    season = np.zeros(7)
    for _ in range(ROUNDS):
        trend = _running_median(x - season[weekday])
        season = np.array([np.median((x - trend)[weekday == d]) if (weekday == d).sum() >= 8 else 0.0 for d in range(7)])
    return trend + season[weekday]


def _side_levels(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """before[i]: median of the last SIDE_BARS values before i; after[i]: of the first ones from i on; NaN where there are none."""
    n, k = len(x), SIDE_BARS
    gap = np.full(k, np.nan)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([gap, x, gap]), k)
    with np.errstate(all="ignore"):
        level = np.full(len(windows), np.nan)
        some = np.isfinite(windows).any(axis=1)
        level[some] = np.nanmedian(windows[some], axis=1)
    return level[: n + 1], level[k : k + n + 1]


def excursion_limits(x: np.ndarray, threshold: float, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Per bar the values (low, high) beyond which it belongs to an excursion of at most ``longest`` bars.

    A bar's excursion may hold neighbours, which then must lie beyond the same
    limits, while the bars next to the excursion must not; its levels are taken
    before and after the whole excursion. An excursion at either end of the
    series has a level on one side only and is none: it may as well be a new level.
    """
    n = len(x)
    before, after = _side_levels(x)
    low, high = np.full(n, -np.inf), np.full(n, np.inf)
    for length in range(1, longest + 1):
        starts = np.arange(0, n - length + 1)
        if not len(starts):
            break
        b, a = before[starts], after[starts + length]
        top, bottom = np.maximum(b, a) + threshold, np.minimum(b, a) - threshold
        inside = np.lib.stride_tricks.sliding_window_view(x, length)[: len(starts)]
        up, down = inside > top[:, None], inside < bottom[:, None]
        left = np.concatenate([[np.nan], x[: n - 1]])[starts]
        right = np.concatenate([x[1:], [np.nan]])[starts + length - 1]
        whole_up, whole_down = ~((left > top) | (right > top)), ~((left < bottom) | (right < bottom))
        for j in range(length):
            others = [c for c in range(length) if c != j]
            ok_up, ok_down = whole_up & up[:, others].all(axis=1), whole_down & down[:, others].all(axis=1)
            at = starts + j
            high[at] = np.where(ok_up & np.isfinite(top), np.minimum(high[at], top), high[at])
            low[at] = np.where(ok_down & np.isfinite(bottom), np.maximum(low[at], bottom), low[at])
    return low, high


def stuck_values(x: np.ndarray, other: np.ndarray, shortest: int) -> np.ndarray:
    """The value at each bar that continues (not begins) a run of ``shortest`` or more equal values while ``other`` moves; else NaN."""
    out, at = np.full(len(x), np.nan), np.nonzero(np.isfinite(x))[0]
    if len(at) < shortest:
        return out
    v, o = x[at], other[at]
    edges = np.concatenate([[0], np.nonzero(np.diff(v) != 0)[0] + 1, [len(v)]])
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        if e - s >= shortest:
            seen = o[s:e][np.isfinite(o[s:e])]
            if len(seen) > 1 and np.mean(np.diff(seen) != 0) >= 0.5:
                out[at[s + 1 : e]] = v[s]
    return out


def _limits_of(day: np.ndarray, value: np.ndarray, threshold: float | None, moves: float) -> tuple[np.ndarray, np.ndarray]:
    """Low and high limits at every day, from the days with a positive value."""
    low, high = np.full(len(day), -np.inf), np.full(len(day), np.inf)
    at = np.nonzero(np.isfinite(value) & (value > 0))[0]
    if len(at) < 8:
        return low, high
    x = np.log(value[at])
    usual = np.median(np.abs(np.diff(x))) / 0.6745
    limit = threshold if threshold is not None else moves * max(usual, 1e-9)
    fit = decompose(x, ((day[at] + 3) % 7).astype(int))
    proposed_low, proposed_high = esd_limits(x - fit)
    side_low, side_high = excursion_limits(x, limit)
    with np.errstate(over="ignore"):
        low[at], high[at] = np.exp(np.minimum(side_low, fit + proposed_low)), np.exp(np.maximum(side_high, fit + proposed_high))
    return low, high


def block_flags(block: pa.Table, moves: float, fold: float, shortest_run: int, block_days: int) -> pa.Table:
    """Limits and stuck values for those days of one ticker's block on which some delivered value is beyond them (the halo is seen, not reported)."""
    block = block.sort_by("day")
    day = block["day"].to_numpy()
    px, volume, px_min, px_max, volume_min, volume_max = (block[c].to_numpy().astype(float) for c in ("px", "volume", "px_min", "px_max", "volume_min", "volume_max"))
    px_low, px_high = _limits_of(day, px, None, moves)
    volume_low, volume_high = _limits_of(day, volume, math.log(fold), moves)
    px_stuck, volume_stuck = stuck_values(px, volume, shortest_run), stuck_values(volume, px, shortest_run)
    some = (px_max > px_high) | (px_min < px_low) | (volume_max > volume_high) | (volume_min < volume_low) | np.isfinite(px_stuck) | np.isfinite(volume_stuck)
    some &= (day // block_days) == block["block"].to_numpy()
    columns = {"ticker": block["ticker"].filter(pa.array(some)), "day": day[some].astype(np.int32), "px_low": px_low[some], "px_high": px_high[some], "volume_low": volume_low[some], "volume_high": volume_high[some]}
    return pa.table(columns | {"px_stuck": pa.array(px_stuck[some], from_pandas=True), "volume_stuck": pa.array(volume_stuck[some], from_pandas=True)})


def flag_readings(panel: DataFrame, moves: float = 8.0, fold: float = 25.0, shortest_run: int = 6) -> DataFrame:
    """Every distinct delivered value of ``px`` and ``volume`` that cannot be a true reading: ``ticker, trade_date, field, value, reason``.

    Per ticker and block of days a seasonal-trend decomposition by running and
    weekday medians leaves residuals; values beyond the generalised ESD limits of
    these are proposed as spikes. A proposed value is a ``spike`` if it also lies
    beyond the level on both sides of an excursion of up to three bars by more than
    ``moves`` usual day-to-day moves (``px``) or ``fold``-fold (``volume``). Constant
    runs (``stuck``: every value but the first of ``shortest_run`` or more equal ones
    while the other field moves) and ranges (``impossible``: price of zero or
    below, volume below zero) are checked separately.

    The series that gives levels and runs holds one value a day, the first one
    delivered that is usable. Days are reduced before any series is formed and a
    series is cut into blocks with halos, so no task holds more than
    ``BLOCK_DAYS + 2 * HALO_DAYS`` rows however many a ticker has; only days with a
    value to flag leave it. Nulls, NaN and no-data codes are neither readings nor
    flagged; bars without a value do not break a run. Rows without ticker or day
    are left out; null ``fetched_at`` counts as delivered last; series of fewer
    than eight values have no spikes. Writes small tables (actions).
    """
    codes = broadcast_if_small(no_data_codes(panel).select(F.col("code").alias("px"), F.lit(True).alias("is_code")), BROADCAST_CODES)
    rows = panel.select("ticker", "trade_date", "fetched_at", number("px").alias("px"), number("volume").alias("volume")).where("ticker is not null and trade_date is not null")
    rows = rows.join(codes, "px", "left").select("ticker", day_number("trade_date").alias("day"), "fetched_at", F.when(F.col("is_code").isNull(), F.col("px")).alias("px"), "volume")

    def first(c: str, usable):
        return F.min(F.when(usable, F.struct(F.col("fetched_at").isNull().alias("late"), F.col("fetched_at").alias("at"), F.col(c).alias("v"))))["v"].alias(c)

    ends = [f(F.when(F.col(c) > 0, F.col(c))).alias(f"{c}_{n}") for c in ("px", "volume") for n, f in (("min", F.min), ("max", F.max))]
    series = rows.groupBy("ticker", "day").agg(first("px", F.col("px") > 0), first("volume", F.col("volume") >= 0), *ends)
    placed = series.select("*", F.explode(F.array_distinct(F.array(*[F.floor((F.col("day") + h) / BLOCK_DAYS).cast("int") for h in (-HALO_DAYS, 0, HALO_DAYS)]))).alias("block"))
    days = BLOCK_DAYS
    flags = write_table(placed.groupBy("ticker", "block").applyInArrow(lambda block: block_flags(block, moves, fold, shortest_run, days), FLAGS), "flags")

    def long(df: DataFrame, *others: str) -> DataFrame:
        return df.select("ticker", "day", *others, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("px", "volume")])).alias("x")).select("ticker", "day", *others, "x.field", "x.value")

    def of(what: str):
        return F.when(F.col("field") == "px", F.col(f"px_{what}")).otherwise(F.col(f"volume_{what}"))

    value = F.col("value")
    impossible = ((F.col("field") == "px") & (value <= 0)) | (value < 0)
    out_of_range = long(rows.where("px <= 0 or volume < 0")).where(impossible).withColumn("reason", F.lit("impossible"))
    met = long(rows.join(broadcast_if_small(flags, BROADCAST_FLAGS), ["ticker", "day"]), *[c for c in flags.columns if c not in ("ticker", "day")]).where(~impossible)
    beyond = (value > 0) & ((value > of("high")) | (value < of("low")))
    judged = met.select("ticker", "day", "field", "value", F.when(beyond, "spike").when(value == of("stuck"), "stuck").alias("reason")).where("reason is not null")
    return out_of_range.unionByName(judged).distinct().select("ticker", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("trade_date"), "field", "value", "reason")
