"""Trading costs: proportional, and market impact in four parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.panel import asof, by_ticker

#: Cost and slippage in basis points; coefficients of the impact model; stand-ins where no history exists.
COST_BPS, SLIPPAGE_BPS = 10.0, 5.0
HALF_SPREAD_BPS, ETA, GAMMA, SLIPPAGE = 5.0, 0.1, 0.1, 0.5
NO_PRICE, NO_SIGMA, NO_ADV = 100.0, 0.01, 1e6


def rate(cost_bps: float = COST_BPS, slippage_bps: float = SLIPPAGE_BPS) -> float:
    return (cost_bps + slippage_bps) / 1e4


def proportional(trade: Column, value: Column, cost_bps: float = COST_BPS, slippage_bps: float = SLIPPAGE_BPS) -> Column:
    """Cost of one asset's change in weight."""
    return F.abs(trade) * value * rate(cost_bps, slippage_bps)


def one_way(trade: Column) -> Column:
    """Aggregate: one-way turnover of the changes in weight."""
    return F.sum(F.abs(trade)) / 2


def net_return(gross: Column, cost: Column, value: Column) -> Column:
    return F.when(value > 0, gross - cost / value).otherwise(gross)


def market_state(panel: DataFrame, window: int = 20) -> DataFrame:
    """``adv`` (mean volume over up to ``window`` rows) and ``sigma`` (deviation of log returns, two rows at least) per ticker and date."""
    f = by_ticker().rowsBetween(-(window - 1), 0)
    moved = panel.withColumn("_r", F.log(F.col("px") / F.lag("px").over(by_ticker())))
    return moved.withColumn("adv", F.avg("volume").over(f)).withColumn("sigma", F.stddev_samp("_r").over(f)).drop("_r")


def impact_of(dollars: np.ndarray, px: np.ndarray, adv: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """The total of :func:`impact` for arrays of absolute dollars."""
    known = (px > 0) & (adv > 0)
    part = np.where(known, dollars / np.where(known, px * adv, 1.0), 0.0)
    total = dollars * (HALF_SPREAD_BPS / 1e4 + ETA * sigma * np.sqrt(part) + GAMMA * part + SLIPPAGE * sigma)
    return np.where(dollars < 1e-10, 0.0, total)


def impact(trades: DataFrame, state: DataFrame, half_spread_bps: float = HALF_SPREAD_BPS, eta: float = ETA, gamma: float = GAMMA, slippage: float = SLIPPAGE) -> DataFrame:
    """Cost of ``trades(ticker, date, dollars, ...)`` as spread, temporary and permanent impact and slippage, by the state known at ``date``."""
    known = asof(trades, state, "ticker", "date", ["px", "adv", "sigma"], {"px": NO_PRICE, "adv": NO_ADV, "sigma": NO_SIGMA})
    d = F.abs("dollars")
    part = F.when((F.col("px") > 0) & (F.col("adv") > 0), d / F.col("px") / F.col("adv")).otherwise(0.0)
    none = d < 1e-10
    parts = {"spread": d * half_spread_bps / 1e4, "temporary": F.lit(eta) * F.col("sigma") * F.sqrt(part) * d, "permanent": F.lit(gamma) * part * d, "slip": F.lit(slippage) * F.col("sigma") * d}
    costs = known.select(*trades.columns, *[F.when(none, 0.0).otherwise(c).alias(k) for k, c in parts.items()])
    return costs.withColumn("total", F.col("spread") + F.col("temporary") + F.col("permanent") + F.col("slip"))


def impact_total(trades: DataFrame, state: DataFrame, *keys: str) -> DataFrame:
    return impact(trades, state).groupBy(*keys).agg(F.sum("total").alias("cost"))


def last_rebalance(costs: DataFrame) -> DataFrame:
    """Of per-asset costs, those of the last date with a trade of some size."""
    active = costs.where(F.abs("dollars") > 1e-6)
    return active.join(F.broadcast(active.agg(F.max("date").alias("date"))), "date").select(costs.columns)
