"""Covariances in long form by aggregation, and other estimators per window by grouped functions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.covariances import diagnostics, estimator, mp_bounds, mp_density
from panelforge.plans.storage import spread


def pairs(returns: DataFrame) -> DataFrame:
    """Returns of two tickers on each date, ``i <= j``: an equi-join on the date, assets by assets wide."""
    a, b = returns.select("date", F.col("ticker").alias("i"), F.col("r").alias("x")), returns.select("date", F.col("ticker").alias("j"), F.col("r").alias("y"))
    return a.join(b, "date").where("i <= j")


def sample(returns: DataFrame) -> DataFrame:
    return pairs(returns).groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"))


def ewma(returns: DataFrame, decay: float = 0.94) -> DataFrame:
    """Exponentially weighted covariance of the last date, in closed form."""
    if not 0 < decay < 1:
        raise ValueError("decay lies in (0, 1)")
    age = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.col("date").desc())) - 1
    weighted = pairs(returns.join(returns.select("date").distinct().withColumn("wt", F.pow(F.lit(decay), age)), "date").select("date", "ticker", "r")).join(returns.select("date").distinct().withColumn("wt", F.pow(F.lit(decay), age)), "date")
    w, x, y = F.col("wt"), F.col("x"), F.col("y")
    s = weighted.groupBy("i", "j").agg(F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * y).alias("wxy"))
    mean = F.col("wxy") / F.col("w") - F.col("wx") * F.col("wy") / (F.col("w") * F.col("w"))
    return s.select("i", "j", (mean * F.col("w") * F.col("w") / (F.col("w") * F.col("w") - F.col("w2"))).alias("cov"))


def ledoit_wolf(returns: DataFrame) -> DataFrame:
    """Linear shrinkage towards the scaled identity, from sums over pairs of tickers."""
    centred = returns.withColumn("r", F.col("r") - F.avg("r").over(Window.partitionBy("ticker")))
    s = pairs(centred).groupBy("i", "j").agg(F.avg(F.col("x") * F.col("y")).alias("s"), F.avg(F.col("x") * F.col("x") * F.col("y") * F.col("y")).alias("q"), F.count("*").alias("n"))
    same = F.col("i") == F.col("j")
    both = F.when(same, 1).otherwise(2)
    totals = s.agg(F.sum(F.when(same, F.col("s"))).alias("tr"), F.sum(F.when(same, 1)).alias("p"), F.sum(both * F.col("s") * F.col("s")).alias("ss"), F.sum(both * F.col("q")).alias("qq"))
    t = s.withColumn("_k", F.lit(0)).join(F.broadcast(totals.withColumn("_k", F.lit(0))), "_k")
    mu = F.col("tr") / F.col("p")
    delta = (F.col("ss") - 2 * mu * F.col("tr") + F.col("p") * mu * mu) / F.col("p")
    beta = F.least((F.col("qq") - F.col("ss")) / (F.col("p") * F.col("n")), delta)
    shrink = F.when((beta > 0) & (delta > 0), beta / delta).otherwise(0.0)
    return t.select("i", "j", ((1 - shrink) * F.col("s") + F.when(F.col("i") == F.col("j"), shrink * mu).otherwise(0.0)).alias("cov"))


def full(cov: DataFrame) -> DataFrame:
    """Both triangles of a long covariance."""
    return cov.unionByName(cov.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "cov"))


def matrix(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Tickers and the matrix of returns, one row a date, of one group."""
    wide = pdf.pivot_table(index="date", columns="ticker", values="r").sort_index().dropna()
    return list(wide.columns), wide.to_numpy(float)


def estimate(returns: DataFrame, methods: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``method, i, j, cov`` of each group of ``keys`` (one window each) by the named estimators, run side by side."""
    for m in methods:
        estimator(m)
    named = returns.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    key_types = [f"{k} {dict(returns.dtypes)[k]}" for k in keys]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tickers, x = matrix(pdf)
        c = estimator(pdf["method"].iloc[0])(x)
        n = len(tickers)
        out = pd.DataFrame({"method": pdf["method"].iloc[0], "i": np.repeat(tickers, n), "j": tickers * n, "cov": c.ravel()})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[["method", *keys, "i", "j", "cov"]]

    return spread(named, "method", *keys).groupBy("method", *keys).applyInPandas(run, ", ".join(["method string", *key_types, "i string", "j string", "cov double"]))


def compare(cov: DataFrame) -> DataFrame:
    """Trace, Frobenius norm, condition number and extreme eigenvalues per method of a full long covariance."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="i", columns="j", values="cov").to_numpy(float)
        return pd.DataFrame([{"method": pdf["method"].iloc[0], **diagnostics(m)}])

    return cov.groupBy("method").applyInPandas(run, "method string, trace double, frobenius double, condition double, min_eig double, max_eig double")


def dcc_series(returns: DataFrame, i: str, j: str) -> DataFrame:
    """The conditional correlation of two tickers on every date, with the fitted parameters and whether either fell back to EWMA."""
    from panelforge.functions.covariances import dcc

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="date", columns="ticker", values="r").sort_index().dropna()
        names = list(wide.columns)
        _, path, facts = dcc(wide.to_numpy(float))
        a, b = names.index(i), names.index(j)
        return pd.DataFrame({"date": wide.index, "correlation": path[:, a, b], "a": facts["a"], "b": facts["b"], "fallback": bool({a, b} & set(facts["fallback"]))})

    return returns.withColumn("_k", F.lit(0)).groupBy("_k").applyInPandas(run, "date date, correlation double, a double, b double, fallback boolean")


def eigenvalues(returns: DataFrame) -> DataFrame:
    """Eigenvalues of the correlation matrix with the edges and density of pure noise."""
    from panelforge.functions.covariances import sample as numpy_sample
    from panelforge.functions.weights import correlation

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, x = matrix(pdf)
        values = np.sort(np.linalg.eigvalsh(correlation(numpy_sample(x))))[::-1]
        ratio = x.shape[1] / x.shape[0]
        low, high = mp_bounds(ratio)
        return pd.DataFrame({"rank": np.arange(1, len(values) + 1), "eigenvalue": values, "low": low, "high": high, "density": mp_density(values, ratio)})

    return returns.withColumn("_k", F.lit(0)).groupBy("_k").applyInPandas(run, "rank int, eigenvalue double, low double, high double, density double")


def noise_edges(returns: DataFrame) -> DataFrame:
    """``q, low, high``: assets over dates, and the edges between which pure noise has its eigenvalues."""
    q = returns.agg((F.countDistinct("ticker") / F.countDistinct("date")).alias("q"))
    return q.select("q", F.pow(1 - F.sqrt("q"), F.lit(2)).alias("low"), F.pow(1 + F.sqrt("q"), F.lit(2)).alias("high"))
