"""Factor attribution by least squares."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.frames import empty
from panelforge.functions.inference import ols
from panelforge.plans.storage import spread

FACTORS = ("mkt_rf", "smb", "hml", "rmw", "cma", "mom")
LONG = "strategy string, term string, beta double, se double, t double, p double, r2 double, n long, ir double, attributed double"


def attribute(series: DataFrame, factors: DataFrame, names: Sequence[str] = FACTORS, lags: int = 5, least: int = 60) -> DataFrame:
    """Full-sample regression of excess returns with Newey-West errors; one row per strategy and term (``alpha`` first).

    ``attributed`` is the annual return explained by the term; ``ir`` the
    information ratio. Strategies with fewer than ``least`` common days have no rows.
    """
    joined = series.select("strategy", "date", "ret").join(factors, "date")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").dropna()
        if len(pdf) < least:
            return empty(LONG)
        f = pdf[list(names)].to_numpy(float)
        fit = ols((pdf["ret"] - pdf["rf"]).to_numpy(float), np.column_stack([np.ones(len(f)), f]), lags)
        sd = fit["residual"].std(ddof=1)
        ir = fit["beta"][0] / sd * np.sqrt(252) if sd > 0 else 0.0
        means = np.concatenate([[1.0], f.mean(axis=0)])
        return pd.DataFrame({"strategy": pdf["strategy"].iloc[0], "term": ["alpha", *names], "beta": fit["beta"], "se": fit["se"], "t": fit["t"], "p": fit["p"], "r2": fit["r2"], "n": fit["n"], "ir": ir, "attributed": fit["beta"] * means * 252})

    return spread(joined, "strategy").groupBy("strategy").applyInPandas(run, LONG)


ROLLING = "strategy string, date date, alpha double, alpha_se double, r2 double, betas array<double>"


def rolling_attribution(series: DataFrame, factors: DataFrame, names: Sequence[str] = FACTORS, window: int = 252) -> DataFrame:
    """Regression over each trailing window, from running sums of cross products: one pass per strategy, all windows solved together."""
    joined = series.select("strategy", "date", "ret").join(factors, "date")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").dropna()
        n = len(pdf)
        if n < window + 10:
            return empty(ROLLING)
        f = pdf[list(names)].to_numpy(float)
        x = np.column_stack([np.ones(n), f])
        y = (pdf["ret"] - pdf["rf"]).to_numpy(float)

        def windowed(v: np.ndarray) -> np.ndarray:
            c = np.concatenate([np.zeros((1, *v.shape[1:])), np.cumsum(v, axis=0)])
            return c[window:] - c[:-window]

        xx, xy, yy, sy = windowed(x[:, :, None] * x[:, None, :]), windowed(x * y[:, None]), windowed(y * y), windowed(y)
        inverse = np.linalg.pinv(xx)
        beta = np.einsum("tij,tj->ti", inverse, xy)
        sse = np.maximum(yy - np.einsum("ti,ti->t", beta, xy), 0)
        sst = yy - sy * sy / window
        se = np.sqrt(np.maximum(inverse[:, 0, 0] * sse / (window - x.shape[1]), 0))
        return pd.DataFrame({"strategy": pdf["strategy"].iloc[0], "date": pdf["date"].to_numpy()[window - 1 :], "alpha": beta[:, 0] * 252, "alpha_se": se * 252, "r2": np.where(sst > 0, 1 - sse / np.where(sst > 0, sst, 1), 0.0), "betas": list(beta[:, 1:])})

    return spread(joined, "strategy").groupBy("strategy").applyInPandas(run, ROLLING)


def single_factor(series: DataFrame, factors: DataFrame, name: str = "mkt_rf") -> DataFrame:
    """One-factor regression by built-in aggregates."""
    j = series.join(factors.select("date", name), "date")
    return j.groupBy("strategy").agg(F.regr_intercept("ret", name).alias("alpha"), F.regr_slope("ret", name).alias("beta"), F.regr_r2("ret", name).alias("r2"), F.count("*").alias("n"))
