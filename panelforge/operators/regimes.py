"""Market regimes: thresholds on volatility, hidden Markov states, and performance within them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.frames import empty
from panelforge.functions.inference import regimes as hmm
from panelforge.operators.metrics import over, risk_report, rolling
from panelforge.plans.storage import spread


def classify(series: DataFrame, window: int = 60, bull: float = 0.15, sideways: float = 0.25) -> DataFrame:
    """``regime`` by rolling volatility: bull, sideways or bear; null until the window is full."""
    vol = rolling(series, window).select("strategy", "date", "vol")
    label = F.when(F.col("vol") < bull, "bull").when(F.col("vol") < sideways, "sideways").when(F.col("vol").isNotNull(), "bear")
    return series.join(vol, ["strategy", "date"]).withColumn("regime", label)


def regime_report(labelled: DataFrame, rf: float = 0.04) -> DataFrame:
    """Risk report per strategy and regime with at least two days, and the share of its days."""
    valid = labelled.where("regime is not null")
    share = valid.groupBy("strategy", "regime").agg(F.count("*").alias("k")).withColumn("fraction", F.col("k") / F.sum("k").over(Window.partitionBy("strategy"))).where("k >= 2").drop("k")
    return risk_report(valid.select("strategy", "regime", "date", "ret"), ("strategy", "regime"), rf).join(share, ["strategy", "regime"])


def performance(labelled: DataFrame, rf: float = 0.04) -> DataFrame:
    """Mean, volatility, Sharpe ratio and worst drawdown within contiguous blocks, per strategy and regime."""
    seen = labelled.where("regime is not null")
    block = F.row_number().over(over("strategy")) - F.row_number().over(over("strategy", "regime"))
    runs = seen.withColumn("block", block)
    inside = over("strategy", "regime", "block").rowsBetween(Window.unboundedPreceding, 0)
    grown = runs.withColumn("growth", F.exp(F.sum(F.log1p("ret")).over(inside)))
    dd = grown.withColumn("dd", F.col("growth") / F.max("growth").over(inside) - 1)
    a = dd.groupBy("strategy", "regime").agg(F.count("*").alias("n_days"), (F.avg("ret") * 252).alias("mean_return"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("volatility"), F.min("dd").alias("max_dd"))
    return a.select("strategy", "regime", "n_days", (F.col("n_days") / F.sum("n_days").over(Window.partitionBy("strategy"))).alias("fraction"), "mean_return", "volatility", F.when(F.col("volatility") > 1e-10, (F.col("mean_return") - rf) / F.col("volatility")).otherwise(0.0).alias("sharpe"), F.least("max_dd", F.lit(0.0)).alias("max_dd"))


def conditional_sharpe(labelled: DataFrame, order: list[str], rf: float = 0.04) -> DataFrame:
    """Sharpe ratios, one row a strategy and one column a regime."""
    return performance(labelled, rf).groupBy("strategy").pivot("regime", order).agg(F.first("sharpe"))


def features(series: DataFrame, window: int = 20) -> DataFrame:
    """``z_ret, z_vol``: returns and rolling volatility standardised per strategy, where the window is full."""
    f = series.join(rolling(series, window).select("strategy", "date", "vol"), ["strategy", "date"]).where("vol is not null")
    of = Window.partitionBy("strategy")
    z = lambda c: (F.col(c) - F.avg(c).over(of)) / F.stddev_pop(c).over(of)
    return f.select("strategy", "date", z("ret").alias("z_ret"), z("vol").alias("z_vol"))


HMM_ROWS = "strategy string, date date, state int, regime string, states int, mean_vol double, stay double"


def hmm_regimes(series: DataFrame, window: int = 20) -> DataFrame:
    """States of a Gaussian hidden Markov model per series, two or three by BIC, ordered by volatility; ``stay`` is the state's self-transition.

    One series is one group; series too short for the window have no rows.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        try:
            at, state, labels, facts = hmm(pdf["ret"].to_numpy(float), window)
        except ValueError:
            return empty(HMM_ROWS)
        return pd.DataFrame(
            {"strategy": pdf["strategy"].iloc[0], "date": pdf["date"].to_numpy()[at], "state": state, "regime": [labels[s] for s in state], "states": len(labels), "mean_vol": facts["means"][state, 1], "stay": facts["transition"].diagonal()[state]}
        )

    return spread(series.select("strategy", "date", "ret"), "strategy").groupBy("strategy").applyInPandas(fit, HMM_ROWS)


HMM_STATES = "strategy string, state int, regime string, mean_ret double, mean_vol double, to_state int, probability double"


def hmm_parameters(series: DataFrame, window: int = 20) -> DataFrame:
    """The fitted transition matrix, one row per pair of states, with each state's mean return and volatility (standardised, as fitted)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        try:
            _, _, labels, facts = hmm(pdf["ret"].to_numpy(float), window)
        except ValueError:
            return empty(HMM_STATES)
        n, means = len(labels), facts["means"]
        rows = [(pdf["strategy"].iloc[0], a, labels[a], float(means[a, 0]), float(means[a, 1]), b, float(facts["transition"][a, b])) for a in range(n) for b in range(n)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in HMM_STATES.split(", ")])

    return spread(series.select("strategy", "date", "ret"), "strategy").groupBy("strategy").applyInPandas(fit, HMM_STATES)


def transitions(labelled: DataFrame) -> DataFrame:
    """Observed transition shares between successive regimes."""
    pairs = labelled.where("regime is not null").select("strategy", F.col("regime").alias("from_regime"), F.lead("regime").over(over("strategy")).alias("to_regime")).where("to_regime is not null")
    return pairs.groupBy("strategy", "from_regime", "to_regime").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("strategy", "from_regime")))
