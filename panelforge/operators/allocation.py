"""Allocation in long form: equilibrium, views, risk contributions, leverage; and all strategies' raw targets per rebalance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import weights as W
from panelforge.functions.covariances import estimator
from panelforge.operators.covariance import full, matrix
from panelforge.plans.storage import spread

#: Named strategies and how each builds its raw target; ``lever`` asks the fold for a volatility target, ``method`` overrides the covariance estimator.
REGISTRY = {
    "equal_weight": {"kind": "equal"},
    "full_kelly": {"kind": "kelly", "fraction": 1.0},
    "half_kelly": {"kind": "kelly", "fraction": 0.5},
    "bl_kelly": {"kind": "bl", "fraction": 0.5},
    "vol_targeted_bl": {"kind": "bl", "fraction": 0.5, "lever": True},
    "hrp": {"kind": "hrp"},
    "risk_parity": {"kind": "parity"},
}


def matvec(cov: DataFrame, vector: DataFrame, name: str) -> DataFrame:
    """``ticker, <name>`` of a long (half) covariance times ``vector(ticker, v)``."""
    return full(cov).join(vector.select(F.col("ticker").alias("j"), "v"), "j").groupBy(F.col("i").alias("ticker")).agg(F.sum(F.col("cov") * F.col("v")).alias(name))


def equilibrium(cov: DataFrame, market: DataFrame, aversion: float = 2.5) -> DataFrame:
    """``ticker, pi``: returns at which the market portfolio ``market(ticker, w)`` is optimal."""
    share = market.withColumn("v", F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0))))
    return matvec(cov, share, "risk").select("ticker", (aversion * F.col("risk")).alias("pi"))


def momentum_views(returns: DataFrame, cov: DataFrame, lookback: int = 252, tau: float = 0.05, confidence: float = 0.25) -> DataFrame:
    """``ticker, view, omega``: annualised trailing log return, and the view's variance from the covariance's diagonal."""
    if not 0 < confidence <= 1:
        raise ValueError("confidence lies in (0, 1]")
    age = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc()))
    last = returns.withColumn("age", age).where(F.col("age") <= lookback).groupBy("ticker").agg((F.sum("r") * lookback / F.count("r")).alias("view"))
    return last.join(cov.where("i = j").select(F.col("i").alias("ticker"), (F.col("cov") * tau * (1 / confidence - 1)).alias("omega")), "ticker")


def risk_contributions(cov: DataFrame, holdings: DataFrame) -> DataFrame:
    """``ticker, w, contribution, share`` of ``holdings(ticker, w)``; contributions sum to the variance."""
    with_risk = holdings.join(matvec(cov, holdings.select("ticker", F.col("w").alias("v")), "risk"), "ticker").withColumn("contribution", F.col("w") * F.col("risk"))
    return with_risk.select("ticker", "w", "contribution", (F.col("contribution") / F.sum("contribution").over(Window.partitionBy(F.lit(0)))).alias("share"))


def vol_target(cov: DataFrame, holdings: DataFrame, target: float = 0.10, most: float = 1.5) -> DataFrame:
    """``variance, leverage`` of a portfolio by an annualised covariance."""
    v = risk_contributions(cov, holdings).agg(F.sum("contribution").alias("variance"))
    return v.select("variance", F.when(F.col("variance") < 1e-20, 1.0).otherwise(F.least(F.lit(target) / F.sqrt("variance"), F.lit(float(most)))).alias("leverage"))


def turnover_cap(trades: DataFrame, most: float = 0.30) -> DataFrame:
    """``trades(key, ticker, current, target)`` with targets drawn back so that one-way turnover is at most ``most``."""
    one_way = F.sum(F.abs(F.col("target") - F.col("current"))).over(Window.partitionBy("key")) / 2
    scaled = F.greatest(F.col("current") + (F.col("target") - F.col("current")) * most / F.col("one_way"), F.lit(0.0))
    return trades.withColumn("one_way", one_way).withColumn("w", F.when((F.col("one_way") > most) & (F.col("one_way") > 1e-10), scaled).otherwise(F.col("target")))


def members(panel: DataFrame, schedule: DataFrame, lookback: int) -> DataFrame:
    """Log returns of the last ``lookback`` rows up to each rebalance, keyed by ``reb_id``: an equi-join on row numbers."""
    w = Window.partitionBy("ticker").orderBy("rn")
    returns = panel.join(schedule.select("date", "rn"), "date").select("date", "rn", "ticker", F.log(F.col("px") / F.lag("px").over(w)).alias("r")).where("r is not null")
    wanted = schedule.where("is_reb").select("reb_id", F.col("rn").alias("reb_rn"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("rn") - lookback + 1), F.col("rn"))).alias("rn"))
    return wanted.join(returns, "rn").select("reb_id", "reb_rn", "date", "ticker", "r")


RAW = "strategy string, reb_id long, ticker string, w double, warm boolean, lever boolean, cov array<double>"


def target_of(spec: dict, x: np.ndarray, cov: np.ndarray, market: np.ndarray, periods: int, rf: float) -> np.ndarray:
    if spec["kind"] == "kelly":
        return W.kelly(x.mean(axis=0) * periods, cov, rf, spec["fraction"])
    if spec["kind"] == "bl":
        return W.kelly(W.black_litterman(x, cov, market), cov, rf, spec["fraction"])
    if spec["kind"] == "hrp":
        return W.hrp(cov)[0]
    if spec["kind"] == "parity":
        return W.risk_budget(cov)
    return np.full(len(cov), 1 / len(cov))


def raw_targets(panel: DataFrame, schedule: DataFrame, lookback: int = 252, vol_rows: int = 63, periods: int = 252, method: str = "ledoit_wolf", market: dict[str, float] | None = None, strategies: dict | None = None, rf: float = 0.04) -> DataFrame:
    """Raw targets of all strategies at every rebalance, one group per rebalance.

    Fewer than ``lookback`` returns: one over the number of tickers, ``warm``.
    ``cov`` is the ticker's row of the annualised covariance over ``vol_rows``,
    null until there are so many.
    """
    strategies = REGISTRY if strategies is None else strategies

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tickers, x = matrix(pdf)
        n, rows = len(tickers), []
        ready = len(x) >= lookback
        covs = {m: estimator(m)(x) * periods for m in {spec.get("method", method) for spec in strategies.values()}} if ready else {}
        recent = estimator(method)(x[-vol_rows:]) * periods if len(x) >= vol_rows else None
        caps = np.array([(market or {}).get(t, 0.0) for t in tickers]) if market else np.full(n, 1 / n)
        for name, spec in strategies.items():
            w = target_of(spec, x, covs[spec.get("method", method)], caps, periods, rf) if ready else np.full(n, 1 / n)
            warm = not ready or spec["kind"] == "equal"
            rows += [(name, pdf["reb_id"].iloc[0], t, w[k], warm, bool(spec.get("lever")), None if recent is None else recent[k].tolist()) for k, t in enumerate(tickers)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RAW.split(", ")])

    found = spread(members(panel, schedule, lookback), "reb_id").groupBy("reb_id").applyInPandas(run, RAW)
    first = panel.join(schedule.where("rn = 1 and is_reb").select("date", "reb_id"), "date").select("reb_id", "ticker", (1 / F.count("*").over(Window.partitionBy("reb_id"))).alias("w"))
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), F.lit(bool(s.get("lever"))).alias("lever")) for k, s in strategies.items()]))
    opening = first.select(names.alias("s"), "reb_id", "ticker", "w").select("s.strategy", "reb_id", "ticker", "w", F.lit(True).alias("warm"), "s.lever", F.lit(None).cast("array<double>").alias("cov"))
    return found.unionByName(opening)
