"""Walk-forward runs, purged cross-validation, Sharpe-ratio tests and parameter stability."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import inference as I
from panelforge.functions.frames import empty
from panelforge.functions.weights import black_litterman, kelly
from panelforge.operators.allocation import members, target_of
from panelforge.operators.backtest import run_backtest
from panelforge.operators.covariance import matrix
from panelforge.operators.metrics import moments, rank_correlation, sharpe
from panelforge.operators.panel import calendar
from panelforge.plans.storage import spread


def splits(returns: DataFrame, groups: int = 10, test_groups: int = 2, purge: int = 5, embargo: float = 0.01) -> DataFrame:
    """Dates by split and side: ``split_id, g, date, is_test`` for every choice of test groups, purged and embargoed rows left out.

    The choices are literals that each date is exploded with; there is no join.
    """
    dates = returns.select("date").distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    placed = dates.withColumn("g", F.ntile(groups).over(w) - 1).withColumn("t", F.count("*").over(Window.partitionBy(F.lit(0))))
    inside = Window.partitionBy("g")
    placed = placed.withColumn("ahead", F.row_number().over(inside.orderBy("date"))).withColumn("back", F.row_number().over(inside.orderBy(F.col("date").desc())))
    choices = F.array(*[F.struct(F.lit(k).alias("split_id"), F.array(*[F.lit(x) for x in c]).alias("tests")) for k, c in enumerate(itertools.combinations(range(groups), test_groups))])
    wide = placed.withColumn("c", F.explode(choices))
    tested = lambda g: F.array_contains(F.col("c.tests"), g)
    is_test = tested(F.col("g"))
    dropped = (tested(F.col("g") + 1) & (F.col("back") <= purge)) | (tested(F.col("g") - 1) & (F.col("ahead") <= purge + F.floor(F.col("t") * embargo)))
    return wide.select(F.col("c.split_id").alias("split_id"), "g", "date", is_test.alias("is_test"), (~is_test & dropped).alias("dropped")).where("not dropped").drop("dropped")


def cpcv_equal_weight(returns: DataFrame, rf: float = 0.04, least: int = 30, **how) -> DataFrame:
    """In- and out-of-sample Sharpe ratio of each split for equal weights (which need no fit): aggregation only."""
    portfolio = returns.groupBy("date").agg(F.avg("r").alias("r"))
    joined = splits(returns, **how).join(portfolio, "date")
    side = lambda test: F.when(F.col("is_test") if test else ~F.col("is_test"), F.col("r"))
    a = joined.groupBy("split_id").agg(F.count(side(False)).alias("n_train"), F.count(side(True)).alias("n_test"), F.avg(side(False)).alias("m0"), F.stddev_samp(side(False)).alias("s0"), F.avg(side(True)).alias("m1"), F.stddev_samp(side(True)).alias("s1"))
    return a.where(F.col("n_train") >= least).select("split_id", "n_train", "n_test", sharpe(F.col("m0"), F.col("s0"), rf).alias("is_sharpe"), sharpe(F.col("m1"), F.col("s1"), rf).alias("oos_sharpe"))


def _sharpe(x: np.ndarray, rf: float) -> float:
    sd = x.std(ddof=1) if len(x) > 1 else 0.0
    return 0.0 if sd == 0 else float((x.mean() - rf / 252) / sd * math.sqrt(252))


def cpcv(returns: DataFrame, strategy: Callable[[np.ndarray], np.ndarray], rf: float = 0.04, least: int = 30, **how) -> DataFrame:
    """As above for any ``strategy(training returns) -> weights``, one group per split; splits it fails on, or leaves without holdings, have no row."""
    schema = "split_id int, n_train long, n_test long, is_sharpe double, oos_sharpe double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="date", columns="ticker", values="r").sort_index().dropna()
        test = pdf.groupby("date")["is_test"].first().reindex(wide.index).to_numpy(bool)
        x = wide.to_numpy(float)
        if (~test).sum() < least:
            return empty(schema)
        try:
            w = strategy(x[~test])
        except Exception:  # noqa: BLE001
            return empty(schema)
        if w.sum() == 0:
            return empty(schema)
        p = x @ w
        return pd.DataFrame([(pdf["split_id"].iloc[0], int((~test).sum()), int(test.sum()), _sharpe(p[~test], rf), _sharpe(p[test], rf))], columns=list(empty(schema).columns))

    return spread(splits(returns, **how).join(returns, "date"), "split_id").groupBy("split_id").applyInPandas(run, schema)


def overfitting(split_sharpes: DataFrame) -> DataFrame:
    """Share of losing splits, rank correlation of both sides, mean degradation; 1 and 0 without splits."""
    a = split_sharpes.agg(F.coalesce(F.avg((F.col("oos_sharpe") < 0).cast("double")), F.lit(1.0)).alias("pbo"), F.avg("oos_sharpe").alias("mean_oos"), F.stddev_pop("oos_sharpe").alias("sd_oos"), F.avg(F.when(F.col("is_sharpe") != 0, F.col("oos_sharpe") / F.col("is_sharpe"))).alias("degradation"))
    r = rank_correlation(split_sharpes, "is_sharpe", "oos_sharpe")
    return a.withColumn("_k", F.lit(0)).join(r.withColumn("_k", F.lit(0)), "_k").select("pbo", "mean_oos", "sd_oos", "degradation", F.when(F.col("n") >= 3, F.col("spearman")).otherwise(0.0).alias("spearman"))


def sharpe_tests(series: DataFrame, benchmark: float = 0.0, trials: int = 1, rf: float = 0.04, alpha: float = 0.05) -> DataFrame:
    """Standard error, deflated and probabilistic Sharpe ratio and minimum length per strategy.

    Moments are aggregated; the normal distribution, which has no built-in, is
    applied to one row per strategy.
    """
    m = moments(series).withColumn("sr", (F.col("mean") - rf / 252) / F.col("sd"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                se = I.sharpe_se(r.sr, r.n, r.skew, r.kurtosis)
                best = I.expected_best(trials, se)
                out.append((r.strategy, se * math.sqrt(252), I.probabilistic_sharpe(r.sr, best, se), I.probabilistic_sharpe(r.sr, benchmark / math.sqrt(252), se), I.minimum_length(r.sr, r.skew, r.kurtosis, alpha)))
            yield pd.DataFrame(out, columns=["strategy", "se", "dsr", "psr", "min_length"])

    return m.mapInPandas(run, "strategy string, se double, dsr double, psr double, min_length double")


def sharpe_error(series: DataFrame, rf: float = 0.04) -> DataFrame:
    """Annualised standard error, and minimum length at 5 %, as expressions alone (``z`` is a fixed value)."""
    m = moments(series).withColumn("sr", (F.col("mean") - rf / 252) / F.col("sd"))
    inner = 1 - F.col("skew") * F.col("sr") + (F.col("kurtosis") + 2) / 4 * F.col("sr") * F.col("sr")
    z = 1.6448536269514722
    return m.select("strategy", "n", F.when(inner >= 0, F.sqrt(inner / (F.col("n") - 1)) * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("se"), F.when(F.col("sr") != 0, 1 + inner * F.pow(z / F.col("sr"), F.lit(2))).alias("min_length"))


WEIGHTS = "reb_id long, ticker string, w double"


def walk_forward_weights(panel: DataFrame, least: int = 756, periods: int = 252, rf: float = 0.04, use_bl: bool = False) -> DataFrame:
    """``reb_date, ticker, w``: Kelly weights (not capped by turnover) from all returns up to the first date of each month, once there are ``least``."""
    schedule = calendar(panel)
    history = members(panel, schedule, 1_000_000)
    spec = {"kind": "bl" if use_bl else "kelly", "fraction": 0.5}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from panelforge.functions.covariances import ledoit_wolf

        tickers, x = matrix(pdf)
        if len(x) < least:
            return empty(WEIGHTS)
        cov = ledoit_wolf(x) * periods
        w = target_of(spec, x, cov, np.full(len(tickers), 1 / len(tickers)), periods, rf)
        return pd.DataFrame({"reb_id": pdf["reb_id"].iloc[0], "ticker": tickers, "w": w})

    found = spread(history, "reb_id").groupBy("reb_id").applyInPandas(run, WEIGHTS)
    return found.join(schedule.where("is_reb").select("reb_id", F.col("date").alias("reb_date")), "reb_id")


def walk_forward(panel: DataFrame, least: int = 756, **how) -> DataFrame:
    """The daily run of walk-forward weights over the whole period: equal weight before the first, ``is_oos`` from the first on."""
    schedule = calendar(panel)
    fitted = walk_forward_weights(panel, least, **how).select("reb_id", "ticker", "w")
    days = panel.join(schedule.where("is_reb").select("date", "reb_id"), "date").select("reb_id", "ticker", (1 / F.count("*").over(Window.partitionBy("reb_id"))).alias("even"))
    targets = days.join(fitted, ["reb_id", "ticker"], "left").select(F.lit("walk_forward").alias("strategy"), "reb_id", "ticker", F.coalesce("w", "even").alias("w"))
    start = fitted.agg(F.min("reb_id").alias("first_reb")).withColumn("_k", F.lit(0))
    daily = run_backtest(panel, targets)
    return daily.join(schedule.select("date", "reb_id"), "date").withColumn("_k", F.lit(0)).join(F.broadcast(start), "_k").select("strategy", "date", "equity", "ret", "turnover", "cost", F.coalesce(F.col("reb_id") >= F.col("first_reb"), F.lit(False)).alias("is_oos"))


def compare_sides(report: DataFrame, side: str = "side", threshold: float = 0.5) -> DataFrame:
    """In- against out-of-sample figures of a risk report with a ``side`` column (``is``, ``oos``), with the overfitting flag."""
    figures = ["ann_return", "sharpe", "sortino", "max_dd", "calmar", "ann_vol", "var_95", "win_rate"]
    a, b = report.where(F.col(side) == "is"), report.where(F.col(side) == "oos")
    j = a.select("strategy", *[F.col(f).alias(f"is_{f}") for f in figures]).join(b.select("strategy", *[F.col(f).alias(f"oos_{f}") for f in figures]), "strategy")
    wide = j.select("strategy", F.col("is_sharpe").alias("_s"), F.col("oos_sharpe").alias("_o"), F.explode(F.array(*[F.struct(F.lit(f).alias("metric"), F.col(f"is_{f}").alias("is_value"), F.col(f"oos_{f}").alias("oos_value")) for f in figures])).alias("m"))
    flag = F.coalesce((F.col("_s") > 0) & (F.col("_o") / F.col("_s") < threshold), F.lit(False))
    return wide.select("strategy", "m.metric", "m.is_value", "m.oos_value", (F.col("m.oos_value") - F.col("m.is_value")).alias("delta"), flag.alias("overfit"))


def stability_windows(first, last, years: int = 3, step_months: int = 3) -> list[tuple]:
    """Windows of ``years`` that begin every ``step_months`` (each start counted from the one before it, so a clamped day stays clamped)."""
    out, start = [], pd.Timestamp(first)
    while (end := start + pd.DateOffset(years=years)) <= pd.Timestamp(last):
        out.append((start.date(), end.date()))
        start = start + pd.DateOffset(months=step_months)
    return out


def window_grid(panel: DataFrame, years: int = 3, step_months: int = 3) -> DataFrame:
    """``window_start, window_end`` of :func:`stability_windows` over the dates of a panel (one row on the driver)."""
    span = panel.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    windows = stability_windows(span["a"], span["b"], years, step_months) if span["a"] else []
    return panel.sparkSession.createDataFrame(windows, "window_start date, window_end date")


STABILITY = "window_start date, combo int, parameters map<string,double>, sharpe double"
Signal = Callable[[np.ndarray, np.ndarray], np.ndarray]


def bl_kelly_signal(fraction: float, tau: float, view_confidence: float, lookback: int, periods: int = 252, rf: float = 0.04, turnover: float | None = 0.3) -> Signal:
    """Weights from the log returns so far and the current weights: Kelly on Black-Litterman returns, equal weights until there are ``lookback`` rows."""
    from panelforge.functions.covariances import ledoit_wolf

    def signal(x: np.ndarray, current: np.ndarray) -> np.ndarray:
        even = np.full(len(current), 1 / len(current))
        if len(x) < lookback:
            return even
        cov = ledoit_wolf(x[-lookback:]) * periods
        mean = black_litterman(x[-lookback:], cov, even, tau=tau, confidence=view_confidence)
        return kelly(mean, cov, rf, fraction, current=current, turnover=turnover)

    return signal


def parameter_runs(panel: DataFrame, factory: Callable[..., Signal], grid: dict[str, list], years: int = 3, step_months: int = 3, least: int = 126, rf: float = 0.04) -> DataFrame:
    """Sharpe ratio of ``factory(**parameters)`` for every combination of ``grid`` in every window, one group per pair.

    A signal gets the window's log returns up to a rebalance and the current
    weights, and gives the target. Windows of fewer than ``least`` rows are left out.
    """
    span = panel.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    windows = stability_windows(span["a"], span["b"], years, step_months) if span["a"] else []
    combos = [dict(zip(grid, c, strict=True)) for c in itertools.product(*grid.values())]
    marks = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in windows]) if windows else F.array().cast("array<struct<a:date,b:date>>")
    inside = panel.select("date", "ticker", "px", F.explode(F.filter(marks, lambda m: (F.col("date") >= m["a"]) & (F.col("date") <= m["b"]))).alias("m"))
    tasks = inside.select("date", "ticker", "px", F.col("m.a").alias("window_start"), F.explode(F.array(*[F.lit(k) for k in range(len(combos))])).alias("combo"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="date", columns="ticker", values="px").sort_index().dropna()
        parameters = combos[pdf["combo"].iloc[0]]
        if len(wide) < least:
            return empty(STABILITY)
        signal = factory(**parameters)
        px = wide.to_numpy(float)
        r = np.diff(np.log(px), axis=0)
        month = pd.to_datetime(wide.index).month.to_numpy()
        reb = np.concatenate([[True], month[1:] != month[:-1]])
        w, equity, out = np.zeros(px.shape[1]), 1.0, []
        for t in range(len(px)):
            before = equity
            if t:
                held = w * px[t] / px[t - 1]
                growth = 1 - w.sum() + held.sum()
                equity, w = equity * growth, held / growth
            if reb[t]:
                target = signal(r[:t], w)
                equity *= 1 - 0.0015 * np.abs(target - w).sum()
                w = target
            out.append(equity / before - 1)
        return pd.DataFrame([(pdf["window_start"].iloc[0], pdf["combo"].iloc[0], {k: float(v) for k, v in parameters.items()}, _sharpe(np.array(out), rf))], columns=["window_start", "combo", "parameters", "sharpe"])

    return spread(tasks, "window_start", "combo").groupBy("window_start", "combo").applyInPandas(run, STABILITY)


def parameter_stability(runs: DataFrame) -> DataFrame:
    """The best combination of each window (the first of equals), and how much each parameter varies over windows: ``parameter, cv, stable``."""
    best = runs.withColumn("rk", F.row_number().over(Window.partitionBy("window_start").orderBy(F.col("sharpe").desc(), "combo"))).where("rk = 1")
    long = best.select(F.explode("parameters").alias("parameter", "v"))
    a = long.groupBy("parameter").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).where("n >= 2")
    return a.select("parameter", F.col("n").alias("windows"), F.when(F.abs("m") < 1e-10, 0.0).otherwise(F.col("s") / F.abs("m")).alias("cv")).withColumn("stable", F.col("cv") < 0.5)
