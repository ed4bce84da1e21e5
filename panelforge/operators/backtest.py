"""Rebalanced portfolios without a day loop.

Between rebalances holdings are bought and held, so a day's equity is the equity
at the last rebalance times a growth that depends on prices alone. Under
proportional cost the equity at rebalances is a running product. Only where a
target depends on the state (turnover cap, volatility target, market impact)
does one fold per strategy run over its rebalances.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.weights import cap_turnover, vol_leverage
from panelforge.operators.costs import impact_of, rate
from panelforge.operators.panel import calendar
from panelforge.plans.storage import spread, write_table

CAPITAL = 1_000_000.0


def equal_weight(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """Targets ``(strategy, reb_id, ticker, w)`` of one over the number of tickers."""
    days = panel.join(schedule.where("is_reb").select("date", "reb_id"), "date")
    return days.select(F.lit("equal_weight").alias("strategy"), "reb_id", "ticker", (1 / F.count("*").over(Window.partitionBy("date"))).alias("w"))


def _segments(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """Prices with the rebalance they follow and the price at it."""
    days = panel.select("date", "ticker", "px").join(schedule.select("date", "is_reb", "reb_id"), "date")
    at = days.where("is_reb").select("ticker", "reb_id", F.col("px").alias("px_k"))
    return days.join(at, ["ticker", "reb_id"])


def completed(targets: DataFrame) -> DataFrame:
    """Targets with a weight of zero for every ticker that a strategy holds at some rebalance and not at this one.

    Without these rows a ticker that leaves the set would be sold unseen. One row
    per strategy, rebalance and ticker of the strategy comes out (of repeats the
    sum); null weights are zero.
    """
    at = targets.select("strategy", "reb_id").distinct()
    held = targets.where("w <> 0").select("strategy", "ticker").distinct()
    given = targets.groupBy("strategy", "reb_id", "ticker").agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("w"))
    return at.join(held, "strategy").join(given, ["strategy", "reb_id", "ticker"], "left").select("strategy", "reb_id", "ticker", F.coalesce("w", F.lit(0.0)).alias("w"))


def anchored(panel: DataFrame, schedule: DataFrame, targets: DataFrame, cost_rate: float | None = None, capital: float = CAPITAL) -> DataFrame:
    """``strategy, reb_id, date, equity_k, cost, turnover`` at each rebalance, for targets that do not depend on the state.

    Tickers that a target set leaves out are sold (:func:`completed`).
    """
    fee = rate() if cost_rate is None else cost_rate
    prices = panel.select("date", "ticker", "px").join(schedule.where("is_reb").select("date", "reb_id"), "date")
    w = Window.partitionBy("strategy", "ticker").orderBy("reb_id")
    line = completed(targets).join(prices, ["reb_id", "ticker"]).select("strategy", "reb_id", "date", "ticker", "w", F.lag("w", 1, 0.0).over(w).alias("w0"), (F.col("px") / F.lag("px").over(w)).alias("move"))
    grown = line.withColumn("held", F.col("w0") * F.coalesce("move", F.lit(1.0)))
    g = grown.groupBy("strategy", "reb_id").agg((1 + F.sum(F.col("held") - F.col("w0"))).alias("g"))
    per = grown.join(g, ["strategy", "reb_id"]).groupBy("strategy", "reb_id").agg(F.max("date").alias("date"), F.max("g").alias("g"), F.sum(F.abs(F.col("w") - F.col("held") / F.col("g"))).alias("traded"))
    run = Window.partitionBy("strategy").orderBy("reb_id")
    factor = F.col("g") * (1 - fee * F.col("traded"))
    product = F.exp(F.sum(F.log(factor)).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    done = per.withColumn("equity_k", capital * product)
    return done.select("strategy", "reb_id", "date", "equity_k", (F.col("equity_k") / (1 - fee * F.col("traded")) * fee * F.col("traded")).alias("cost"), (F.col("traded") / 2).alias("turnover"))


def expand(panel: DataFrame, schedule: DataFrame, targets: DataFrame, anchors: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """Daily ``strategy, date, equity, ret, turnover, cost`` from the state at rebalances. The first return is the first cost."""
    prices = _segments(panel, schedule)
    growth = targets.join(prices, ["reb_id", "ticker"]).groupBy("strategy", "reb_id", "date").agg((1 + F.sum(F.col("w") * (F.col("px") / F.col("px_k") - 1))).alias("g"))
    days = growth.join(anchors.withColumnRenamed("date", "reb_date"), ["strategy", "reb_id"])
    at = F.col("date") == F.col("reb_date")
    equity = days.select("strategy", "date", (F.col("equity_k") * F.col("g")).alias("equity"), F.when(at, F.col("turnover")).otherwise(0.0).alias("turnover"), F.when(at, F.col("cost")).otherwise(0.0).alias("cost"))
    w = Window.partitionBy("strategy").orderBy("date")
    return equity.select("strategy", "date", "equity", (F.col("equity") / F.lag("equity", 1, capital).over(w) - 1).alias("ret"), "turnover", "cost")


def positions(panel: DataFrame, schedule: DataFrame, targets: DataFrame) -> DataFrame:
    """Daily weights, drifted since the last rebalance."""
    prices = _segments(panel, schedule)
    held = targets.join(prices, ["reb_id", "ticker"]).withColumn("value", F.col("w") * F.col("px") / F.col("px_k"))
    day = Window.partitionBy("strategy", "date")
    g = 1 + F.sum(F.col("value") - F.col("w")).over(day)
    return held.select("strategy", "date", "ticker", (F.col("value") / g).alias("w"))


def run_backtest(panel: DataFrame, targets: DataFrame | None = None, frequency: str = "monthly", cost_rate: float | None = None, capital: float = CAPITAL) -> DataFrame:
    """Daily equity of targets that do not depend on the state; equal weight by default.

    Schedule, state at rebalances and the daily result are small next to the
    panel and are written on the way (actions), so neither they nor what is
    derived from the result repeats the work before them.
    """
    schedule = write_table(calendar(panel, frequency), "calendar")
    targets = equal_weight(panel, schedule) if targets is None else targets
    anchors = write_table(anchored(panel, schedule, targets, cost_rate, capital), "anchors")
    return write_table(expand(panel, schedule, targets, anchors, capital), "backtest")


FOLDED = "strategy string, reb_id long, ticker string, date date, w double, equity_k double, cost double, turnover double, leverage double"


def fold(raw: DataFrame, max_turnover: float | None = 0.30, vol_target: float = 0.10, max_leverage: float = 1.5, impact: bool = False, cost_rate: float | None = None, capital: float = CAPITAL) -> DataFrame:
    """The state machine over rebalances: cap turnover, lever to the volatility target where asked, cap again, pay costs.

    ``raw(strategy, reb_id, date, ticker, w, warm, lever, cov, px, adv, sigma)``:
    raw targets with the price at the rebalance; ``warm`` targets are not capped,
    ``lever`` rows are scaled to ``vol_target`` by the annualised covariance row
    ``cov`` (null: leverage 1). A ticker without a row at a rebalance has a target
    of zero; what was held of it is sold at the price of its latest row. Impact
    without a price or volume is zero. One group per strategy, one row per
    rebalance and ticker of it.
    """
    fee = rate() if cost_rate is None else cost_rate

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["reb_id", "ticker"])
        names = np.unique(pdf["ticker"].to_numpy(str))
        equity, weights, last_px, rows = capital, np.zeros(len(names)), np.full(len(names), np.nan), []
        for reb_id, g in pdf.groupby("reb_id", sort=True):
            at = np.searchsorted(names, g["ticker"].to_numpy(str))
            px = last_px.copy()
            px[at] = g["px"].to_numpy(float)
            values = np.where(weights != 0, weights * px / np.where(weights != 0, last_px, 1.0), 0.0)
            growth = 1 - weights.sum() + values.sum()
            equity *= growth
            current = values / growth
            target = np.zeros(len(names))
            target[at] = g["w"].to_numpy(float)
            if not g["warm"].iloc[0]:
                target = cap_turnover(target, current, max_turnover)
            leverage = 1.0
            if g["lever"].iloc[0] and g["cov"].iloc[0] is not None:
                cov = np.zeros((len(names), len(names)))
                cov[np.ix_(at, at)] = np.array([list(r) for r in g["cov"]])
                leverage = vol_leverage(target, cov, vol_target, max_leverage)
                target = cap_turnover(target * leverage, current, max_turnover)
            trade = target - current
            if impact:
                adv, sigma = np.zeros(len(names)), np.zeros(len(names))
                adv[at], sigma[at] = g["adv"].to_numpy(float), g["sigma"].to_numpy(float)
                cost = float(impact_of(np.abs(trade) * equity, px, adv, sigma).sum())
            else:
                cost = fee * float(np.abs(trade).sum()) * equity
            equity -= cost
            rows += [(g["strategy"].iloc[0], reb_id, t, g["date"].iloc[0], w, equity, cost, np.abs(trade).sum() / 2, leverage) for t, w in zip(names, target, strict=True)]
            weights, last_px = target, px
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FOLDED.split(", ")])

    return spread(raw, "strategy").groupBy("strategy").applyInPandas(walk, FOLDED)
