"""Backtest, costs, covariance, allocation, validation, simulation and regimes against direct computations."""

import datetime as dt
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import covariances as C
from panelforge.functions import inference as I
from panelforge.functions import weights as W
from panelforge.operators import allocation as al
from panelforge.operators import backtest as bt
from panelforge.operators import charts as ch
from panelforge.operators import costs as cs
from panelforge.operators import covariance as cv
from panelforge.operators import factors as fa
from panelforge.operators import metrics as me
from panelforge.operators import montecarlo as mc
from panelforge.operators import panel as pn
from panelforge.operators import regimes as rg
from panelforge.operators import validation as va

TICKERS = ["AAA", "BBB", "CCC"]


def prices(n=260, seed=42, k=3):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2020-01-01", periods=n)
    px = 100 * np.exp(np.cumsum(rng.normal(0.0004, 0.012, (n, k)), axis=0))
    return pd.DataFrame(px, index=days, columns=TICKERS[:k])


def long(spark, wide):
    rows = [(d.date(), t, float(wide.at[d, t]), 1e6 + 10.0 * i) for i, d in enumerate(wide.index) for t in wide.columns]
    return spark.createDataFrame(rows, "date date, ticker string, px double, volume double")


@pytest.fixture(scope="module")
def wide():
    return prices()


@pytest.fixture(scope="module")
def panel(spark, wide):
    return long(spark, wide).cache()


def day_loop(wide, target, fee=0.0015, capital=1e6, cap=None):
    w, equity, month, out = np.zeros(wide.shape[1]), capital, None, []
    px = wide.to_numpy()
    for t, d in enumerate(wide.index):
        if t:
            held = w * px[t] / px[t - 1]
            g = 1 - w.sum() + held.sum()
            equity, w = equity * g, held / g
        if d.month != month:
            goal = W.cap_turnover(target(t), w, cap)
            equity *= 1 - fee * np.abs(goal - w).sum()
            w = goal
        month = d.month
        out.append(equity)
    return np.array(out)


def test_backtest_equals_a_day_loop(panel, wide):
    got = bt.run_backtest(panel).toPandas().sort_values("date")
    want = day_loop(wide, lambda t: np.full(3, 1 / 3))
    np.testing.assert_allclose(got.equity, want, rtol=1e-12)
    assert abs(got.ret.iloc[0] + 0.0015) < 1e-12 and abs(got.turnover.iloc[0] - 0.5) < 1e-12
    with pytest.raises(ValueError):
        pn.calendar(panel, "weekly")


def sparse_weights(months, t):
    """A leaves at every third rebalance, B at the next, and so on; a ticker that is left out has no row."""
    w = np.array([0.0 if (months[t] + k) % 3 == 0 else 0.5 for k in range(3)])
    return w


def test_backtests_sell_what_leaves_the_target_set(spark, panel, wide):
    schedule = pn.calendar(panel)
    months = np.cumsum(np.concatenate([[True], wide.index.month[1:] != wide.index.month[:-1]]))
    rows = [("s", int(r), t, 0.5) for r in np.unique(months) for k, t in enumerate(TICKERS) if (r + k) % 3 != 0]
    targets = spark.createDataFrame(rows, "strategy string, reb_id long, ticker string, w double")
    want = day_loop(wide, lambda t: sparse_weights(months, t))
    got = bt.run_backtest(panel, targets).toPandas().sort_values("date")
    np.testing.assert_allclose(got.equity, want, rtol=1e-12)
    state = panel.join(schedule.where("is_reb").select("date", "reb_id"), "date")
    raw = state.join(targets, ["reb_id", "ticker"], "left").select(F.lit("s").alias("strategy"), "reb_id", "date", "ticker", F.coalesce("w", F.lit(0.0)).alias("w"), F.lit(True).alias("warm"), F.lit(False).alias("lever"), F.lit(None).cast("array<double>").alias("cov"), "px", F.lit(0.0).alias("adv"), F.lit(0.01).alias("sigma"))
    folded = bt.fold(raw, max_turnover=None).toPandas()
    at = folded.groupby("date").equity_k.first()
    np.testing.assert_allclose(at.to_numpy(), pd.Series(want, index=wide.index.date)[at.index].to_numpy(), rtol=1e-12)
    # a ticker without a row is sold at its latest price; without volume there is no impact but spread and slippage
    gone = bt.fold(raw.where("ticker <> 'BBB' or reb_id = 1"), max_turnover=None, impact=True).toPandas()
    assert gone[(gone.ticker == "BBB") & (gone.reb_id > 1)].w.abs().max() == 0 and np.isfinite(gone.equity_k).all()
    # the second doubles, then leaves: its gain stays
    d = [dt.date(2020, 1, 1), dt.date(2020, 2, 3)]
    two = spark.createDataFrame([(d[0], "A", 1.0, 1.0), (d[0], "B", 1.0, 1.0), (d[1], "A", 1.0, 1.0), (d[1], "B", 2.0, 1.0)], "date date, ticker string, px double, volume double")
    goal = spark.createDataFrame([("s", 1, "A", 0.5), ("s", 1, "B", 0.5), ("s", 2, "A", 1.0)], "strategy string, reb_id long, ticker string, w double")
    last = bt.run_backtest(two, goal, cost_rate=0.0).orderBy("date").collect()[-1]
    assert abs(last.equity - 1.5e6) < 1e-6 and abs(last.turnover - 2 / 3) < 1e-12


def test_fold_equals_a_day_loop_with_turnover_cap(spark, panel, wide):
    schedule = pn.calendar(panel)
    targets = {"AAA": 0.9, "BBB": 0.0, "CCC": 0.05}
    raw = panel.join(schedule.where("is_reb").select("date", "reb_id"), "date").select(
        F.lit("s").alias("strategy"), "reb_id", "date", "ticker", F.when((F.col("reb_id") % 2 == 0) & (F.col("ticker") == "AAA"), 0.1).when(F.col("ticker") == "AAA", 0.9).when(F.col("ticker") == "CCC", 0.05).otherwise(0.0).alias("w"),
        F.lit(False).alias("warm"), F.lit(False).alias("lever"), F.lit(None).cast("array<double>").alias("cov"), "px", F.lit(1e6).alias("adv"), F.lit(0.01).alias("sigma"),
    )
    folded = bt.fold(raw, max_turnover=0.3)
    anchors = folded.groupBy("strategy", "reb_id").agg(F.max("date").alias("date"), F.max("equity_k").alias("equity_k"), F.max("cost").alias("cost"), F.max("turnover").alias("turnover"))
    got = bt.expand(panel, schedule, folded.select("strategy", "reb_id", "ticker", "w"), anchors).toPandas().sort_values("date")
    months = np.cumsum(np.concatenate([[True], wide.index.month[1:] != wide.index.month[:-1]]))
    want = day_loop(wide, lambda t: np.array([0.1 if months[t] % 2 == 0 else targets["AAA"], 0.0, 0.05]), cap=0.3)
    np.testing.assert_allclose(got.equity, want, rtol=1e-12)
    assert got.turnover.max() <= 0.3 + 1e-12


def test_align_limits_gaps(spark, wide):
    rows = long(spark, wide.iloc[:40])
    gappy = rows.where(~((F.col("ticker") == "BBB") & F.col("date").between(str(wide.index[5].date()), str(wide.index[12].date()))))
    got = pn.align(gappy).toPandas()
    assert sorted(got.groupby("date").size().unique()) == [3] and got.date.nunique() == 40 - 3
    assert pn.align(rows.limit(0)).count() == 0


def test_log_returns_refuse_bad_prices(spark, panel):
    with pytest.raises(Exception, match="positive"):
        pn.log_returns(panel.withColumn("px", F.lit(0.0))).count()
    with pytest.raises(ValueError):
        pn.handle_missing(pn.log_returns(panel), "guess")


def test_risk_report_by_hand(spark):
    r = [0.01, -0.02, 0.03, 0.0, -0.01]
    s = spark.createDataFrame([("s", dt.date(2020, 1, 1 + i), x) for i, x in enumerate(r)], "strategy string, date date, ret double")
    got = me.risk_report(s).first()
    x = np.array(r)
    e = x - 0.04 / 252
    curve = np.cumprod(1 + x)
    assert abs(got.ann_return - (curve[-1] ** (252 / 5) - 1)) < 1e-12
    assert abs(got.sharpe - e.mean() / x.std(ddof=1) * math.sqrt(252)) < 1e-9
    assert abs(got.sortino - e.mean() * 252 / (math.sqrt((e[e < 0] ** 2).mean()) * math.sqrt(252))) < 1e-9
    assert abs(got.max_dd - (curve / np.maximum.accumulate(curve) - 1).min()) < 1e-12
    assert abs(got.var_95 - np.percentile(x, 5)) < 1e-12 and abs(got.cvar_95 + 0.02) < 1e-12
    assert got.win_rate == 0.4 and abs(got.profit_factor - 0.04 / 0.03) < 1e-12
    up = me.risk_report(s.withColumn("ret", F.lit(0.01) + F.abs("ret"))).first()
    assert up.profit_factor == math.inf and up.sortino == math.inf and up.calmar == 0
    assert me.risk_report(s.limit(0)).count() == 0


def test_drawdown_episodes(spark):
    eq = [100, 90, 95, 101, 99, 80, 102, 101]
    s = spark.createDataFrame([("s", dt.date(2020, 1, 1 + i), float(x)) for i, x in enumerate(eq)], "strategy string, date date, equity double")
    got = [tuple(r) for r in me.drawdown_episodes(s).collect()]
    day = lambda k: dt.date(2020, 1, 1 + k)
    assert [g[1:5] for g in sorted(got, key=lambda g: g[1])] == [(1, day(4), day(5), day(6)), (2, day(1), day(1), day(3)), (3, day(7), day(7), day(7))]


def test_impact_parts_sum_and_fall_back(spark, panel):
    state = cs.market_state(panel)
    trades = spark.createDataFrame([("AAA", dt.date(2020, 6, 1), 5000.0), ("ZZZ", dt.date(2020, 6, 1), -2000.0), ("AAA", dt.date(2019, 1, 1), 0.0)], "ticker string, date date, dollars double")
    got = {(r.ticker, r.date): r for r in cs.impact(trades, state).collect()}
    z = got["ZZZ", dt.date(2020, 6, 1)]
    part = 2000 / 100 / 1e6
    assert abs(z.total - (2000 * 5e-4 + 0.1 * 0.01 * math.sqrt(part) * 2000 + 0.1 * part * 2000 + 0.5 * 0.01 * 2000)) < 1e-9
    assert got["AAA", dt.date(2019, 1, 1)].total == 0
    assert got["AAA", dt.date(2020, 6, 1)].total > 0


def test_simple_costs(spark):
    rows = spark.createDataFrame([("d1", "A", 0.2, 1e6, 0.01), ("d1", "B", -0.1, 1e6, 0.0), ("d2", "A", 0.0, 0.0, 0.02)], "k string, ticker string, trade double, value double, gross double")
    got = rows.select("k", "ticker", cs.proportional(F.col("trade"), F.col("value")).alias("cost"), "value", "gross").withColumn("net", cs.net_return(F.col("gross"), F.col("cost"), F.col("value"))).collect()
    np.testing.assert_allclose([r.cost for r in got], [300.0, 150.0, 0.0])
    np.testing.assert_allclose([r.net for r in got], [0.0097, -0.00015, 0.02])
    by = {r.k: r.t for r in rows.groupBy("k").agg(cs.one_way(F.col("trade")).alias("t")).collect()}
    assert abs(by["d1"] - 0.15) < 1e-12 and by["d2"] == 0
    d = [dt.date(2020, 1, k) for k in (2, 3, 6)]
    trades = spark.createDataFrame([(d[0], "A", 1000.0), (d[1], "A", -500.0), (d[1], "B", 1e-7), (d[2], "A", 0.0)], "date date, ticker string, dollars double")
    state = spark.createDataFrame([(d[0], "A", 10.0, 1e4, 0.02)], "date date, ticker string, px double, adv double, sigma double")
    each = cs.impact(trades, state)
    assert [(r.date, r.ticker) for r in cs.last_rebalance(each).collect()] == [(d[1], "A")]
    total = {r.ticker: r.cost for r in cs.impact_total(trades, state, "ticker").collect()}
    want = cs.impact_of(np.array([1000.0, 500.0]), np.full(2, 10.0), np.full(2, 1e4), np.full(2, 0.02)).sum()
    assert abs(total["A"] - want) < 1e-9 and total["B"] < 1e-9


def test_tail_and_comparison(spark, panel):
    last = sorted({r.date for r in panel.select("date").collect()})[-5:]
    assert sorted({r.date for r in pn.tail(panel).collect()}) == last and pn.tail(panel).count() == 15 and pn.tail(panel.limit(0)).count() == 0
    d = [dt.date(2020, 1, k) for k in range(1, 6)]
    rows = [("a", d[k], r, e, 0.1, 1.0) for k, (r, e) in enumerate([(0.01, 101.0), (0.02, None), (None, 150.0), (-0.01, 102.0), (0.0, 102.0)])] + [("b", d[0], None, 5.0, 0.0, 0.0)]
    got = me.comparison(spark.createDataFrame(rows, "strategy string, date date, ret double, equity double, turnover double, cost double")).collect()
    assert [(r.strategy, r.rank) for r in got] == [("a", 1)] and abs(got[0].max_dd - (102 / 150 - 1)) < 1e-12 and got[0].total_cost == 4.0


def test_long_covariances_equal_numpy(panel, wide):
    r = pn.log_returns(panel)
    x = np.diff(np.log(wide.to_numpy()), axis=0)
    for frame, want in ((cv.sample(r), np.cov(x, rowvar=False)), (cv.ewma(r), C.ewma(x)), (cv.ledoit_wolf(r), C.ledoit_wolf(x))):
        got = cv.full(frame).toPandas().pivot(index="i", columns="j", values="cov").to_numpy()
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-14)


def test_estimators_are_symmetric_and_positive(spark, panel):
    est = cv.estimate(pn.log_returns(panel), list(C.ESTIMATORS)).toPandas()
    for m, g in est.groupby("method"):
        c = g.pivot(index="i", columns="j", values="cov").to_numpy()
        np.testing.assert_allclose(c, c.T, atol=1e-12)
        assert np.linalg.eigvalsh(c).min() > 0, m
    with pytest.raises(ValueError, match="choose one of"):
        cv.estimate(pn.log_returns(panel), ["nope"])


def test_denoising_keeps_trace_and_signal():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 50)) + 0.05 * rng.normal(size=(200, 50))
    corr = np.corrcoef(x, rowvar=False)
    for method in ("constant_residual", "targeted_shrinkage"):
        d = C.denoise(corr, 200, method)
        assert abs(np.trace(d) - 50) < 1e-9
    with pytest.raises(ValueError):
        C.denoise(corr, 200, "other")
    low, high = C.mp_bounds(0.25)
    assert (low, high) == (0.25, 2.25) and C.mp_density(np.array([0.1, 3.0]), 0.25).sum() == 0
    grid = np.linspace(low, high, 20001)
    assert abs(np.trapezoid(C.mp_density(grid, 0.25), grid) - 1) < 1e-3


def test_correlation_rises_in_a_crisis():
    rng = np.random.default_rng(1)
    calm, common = rng.normal(0, 0.005, (300, 3)), rng.normal(0, 0.02, (300, 1))
    _, path, facts = C.dcc(np.vstack([calm, common + rng.normal(0, 0.005, (300, 3))]))
    assert path[-50:, 0, 1].mean() > path[100:200, 0, 1].mean() + 0.2 and facts["a"] + facts["b"] < 1


def test_weights():
    cov = np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.16]])
    assert (W.kelly(np.array([0.01, 0.02, 0.03]), cov) == 0).all()
    w = W.kelly(np.array([0.3, 0.3, 0.01]), cov)
    assert w.max() <= 0.4 and w[2] == 0 and w.sum() <= 1.5
    capped = W.kelly(np.array([0.3, 0.3, 0.2]), cov, current=np.array([1.0, 0, 0]), turnover=0.1)
    assert abs(np.abs(capped - [1, 0, 0]).sum() / 2 - 0.1) < 1e-12
    erc = W.risk_budget(cov)
    share = erc * (cov @ erc) / (erc @ cov @ erc)
    np.testing.assert_allclose(share, 1 / 3, atol=1e-8)
    with pytest.raises(ValueError):
        W.risk_budget(cov, np.array([0.5, 0.6, -0.1]))
    h, merges = W.hrp(cov)
    assert abs(h.sum() - 1) < 1e-12 and (h > 0).all() and len(merges) == 2 and (W.hrp(np.array([[1.0]]))[0] == 1).all()
    for m in ("single", "complete", "average", "ward"):
        assert len(W.linkage(np.array([[0, 1, 2], [1, 0, 3], [2, 3, 0.0]]), m)) == 2
    prior = W.equilibrium(cov, np.ones(3))
    far, _ = W.posterior(cov, prior, np.ones(3), np.full(3, 1e9))
    near, _ = W.posterior(cov, prior, np.ones(3), np.full(3, 1e-12))
    np.testing.assert_allclose(far, prior, rtol=1e-5)
    np.testing.assert_allclose(near, 1, rtol=1e-6)
    with pytest.raises(ValueError):
        W.posterior(cov, prior, np.ones(3), np.zeros(3))
    assert W.vol_leverage(np.zeros(3), cov) == 1 and W.vol_leverage(np.ones(3) / 3, cov, 0.1) <= 1.5


def test_no_look_ahead(spark):
    base = prices(420, 7)
    more = pd.concat([base, prices(60, 8).set_index(pd.bdate_range(base.index[-1] + pd.Timedelta(days=1), periods=60)) * np.exp(np.linspace(0, 20, 60))[:, None]])
    a = va.walk_forward_weights(long(spark, base), 252).toPandas()
    b = va.walk_forward_weights(long(spark, more), 252).toPandas()
    m = a.merge(b, on=["reb_date", "ticker"])
    assert len(m) == len(a) > 0
    np.testing.assert_allclose(m.w_x, m.w_y, rtol=1e-9)


def test_cpcv_equals_a_loop(panel, wide):
    import itertools

    r = pn.log_returns(panel)
    got = va.cpcv_equal_weight(r).toPandas().set_index("split_id")
    viaf = va.cpcv(r, lambda x: np.full(3, 1 / 3)).toPandas().set_index("split_id")
    x = np.diff(np.log(wide.to_numpy()), axis=0).mean(axis=1)
    parts = np.array_split(np.arange(len(x)), 10)
    gap = int(0.01 * len(x))
    for k, tests in enumerate(itertools.combinations(range(10), 2)):
        train = []
        for g in range(10):
            if g not in tests:
                ix = list(parts[g])
                if g - 1 in tests:
                    ix = ix[5 + gap :]
                if g + 1 in tests:
                    ix = ix[:-5]
                train += ix
        assert (got.n_train[k], got.n_test[k]) == (len(train), sum(len(parts[g]) for g in tests))
        y = x[train]
        want = (y.mean() - 0.04 / 252) / y.std(ddof=1) * math.sqrt(252)
        assert abs(got.is_sharpe[k] - want) < 1e-9 and abs(viaf.is_sharpe[k] - want) < 1e-9
    assert va.cpcv(r, lambda x: 1 / 0).count() == 0
    o = va.overfitting(va.cpcv_equal_weight(r)).first()
    assert 0 <= o.pbo <= 1 and -1 <= o.spearman <= 1


def test_sharpe_tests():
    assert I.expected_best(1, 0.1) == 0 and I.expected_best(10, 0.1) > 0
    assert I.minimum_length(0.0, 0, 0) == math.inf and I.sharpe_se(0.1, 1, 0, 0) == 0
    assert abs(I.probabilistic_sharpe(0.1, 0.1, 0.05) - 0.5) < 1e-12 and I.probabilistic_sharpe(1, 0, 0) == 0.5


def test_windows_step_from_the_one_before():
    w = va.stability_windows("2015-01-31", "2019-01-01", 3, 3)
    assert [a.isoformat() for a, _ in w[:3]] == ["2015-01-31", "2015-04-30", "2015-07-30"]


def test_monte_carlo(spark):
    p = mc.paths(spark, 0.0, 0.01, 400, 50, seed=1)
    a = p.repartition(7).orderBy("path", "day").collect()
    b = mc.paths(spark, 0.0, 0.01, 400, 50, seed=1).orderBy("path", "day").collect()
    assert a == b
    r = np.array([x.ret for x in a])
    assert abs(r.mean()) < 4e-4 and abs(r.std() - 0.01) < 3e-4
    e = mc.outcomes(p, 1e6).toPandas()
    assert (e.max_dd <= 0).all() and len(e) == 400
    s = mc.summary(mc.outcomes(p, 1e6), 1e6).first()
    assert abs(s.median_terminal - np.median(e.terminal)) < 1e-6
    n = spark.createDataFrame([(1, d, q) for d, q in enumerate([0.9, 0.8, 1.1, 1.0, 0.9, 0.9, 1.2])], "path long, day int, equity double")
    assert mc.underwater(n, 1.0).first().longest == 3


def test_forward_simulation_is_of_full_size_and_from_the_stored_returns(spark, smoke):
    from panelforge.queries_reference import QUERIES, strategies

    own = strategies(spark, smoke).toPandas().groupby("strategy").ret.agg(["mean", "std"])
    ends = QUERIES["mc_strategy_terminal"](spark, smoke).toPandas()
    bands = QUERIES["mc_strategy_bands"](spark, smoke).toPandas()
    longest = QUERIES["mc_strategy_underwater"](spark, smoke).toPandas()
    assert set(ends.strategy) == set(own.index) and len(ends) == len(longest) == 50_000 * len(own) and len(bands) == 252 * len(own)
    name = own.index[0]
    equity = 1e6 * np.cumprod(1 + np.random.default_rng(42).normal(*own.loc[name], (50_000, 252)), axis=1)
    peak = np.maximum(np.maximum.accumulate(equity, axis=1), 1e6)
    mine = ends[ends.strategy == name].sort_values("path")
    np.testing.assert_allclose(mine.terminal, equity[:, -1], rtol=1e-9)
    np.testing.assert_allclose(mine.max_dd, (equity / peak - 1).min(axis=1), atol=1e-9)
    np.testing.assert_allclose(bands[bands.strategy == name].sort_values("day").p05, np.quantile(equity, 0.05, axis=0), rtol=1e-9)
    runs = [max(map(len, "".join("u" if x else " " for x in row).split()), default=0) for row in equity[:50] < peak[:50]]
    assert list(longest[longest.strategy == name].sort_values("path").longest[:50]) == runs


def test_bands_of_strategies_found_together_are_those_of_all_paths():
    rng = np.random.default_rng(3)
    odd = [(0, 0), (1e-3, 1e-12), (1e-3, 1.1e-12), (0.3, 0.01), (-0.4, 0.01), (-1, 0.01), (-2, 0.01), (0, 0.5), (0, 0.06), (0, 0.0601), (0, 0.085), (0, 0.0851), (0.001, 0.09), (math.inf, math.nan), (0, 1e-300)]
    rows = [*odd, *zip(rng.normal(0, 1e-3, 50), rng.uniform(0.0055, 0.015, 50))]
    stats = pd.DataFrame(rows, columns=["mean", "sd"]).assign(strategy=lambda x: x.index.astype(str))
    for n_paths, n_days in ((1, 3), (2, 5), (37, 40), (5_001, 60)):
        got = dict(mc._strategy_bands(stats, mc.shocks(n_paths, n_days, 42), 1e6))
        assert len(got) == len(stats)
        for r in stats.itertuples():
            equity = mc.simulate(lambda g, k, r=r: g.normal(r.mean, r.sd, (k, n_days)), n_paths)
            np.testing.assert_allclose(got[r.strategy], np.quantile(equity, mc.BANDS, axis=0).T, rtol=1e-12, err_msg=str(r))


def test_bands_of_many_strategies_cost_little_more_than_of_one(spark):
    rng = np.random.default_rng(5)
    many = pd.DataFrame({"strategy": np.repeat([f"s{i}" for i in range(240)], 3), "ret": np.outer(rng.uniform(0.009, 0.011, 240), [1, 0, -1]).ravel()})
    began = time.perf_counter()
    mc._bands(mc.simulate(lambda g, k: g.normal(0, 0.01, (k, 252))), 1e6)
    one, began = time.perf_counter() - began, time.perf_counter()
    assert mc.forward(spark.createDataFrame(many), "bands").count() == 240 * 252
    assert time.perf_counter() - began < 35 * one  # each on its own: 60 or more times one, on four cores


def test_correlated_simulation_is_of_all_assets(spark, smoke):
    from panelforge.plans.panels import daily
    from panelforge.queries_reference import QUERIES

    x = pn.simple_returns(daily(spark, smoke)).toPandas().pivot(index="date", columns="ticker", values="r").dropna().to_numpy()
    got = QUERIES["mc_correlated"](spark, smoke).toPandas().sort_values("path")
    r = np.random.default_rng(42).multivariate_normal(x.mean(axis=0), np.cov(x, rowvar=False), (200, 252)).mean(axis=2)
    assert len(got) == 50_000 and x.shape[1] == 6
    np.testing.assert_allclose(got.terminal[:200], 1e6 * np.prod(1 + r, axis=1), rtol=1e-6)


def test_allocation_is_over_all_tickers(spark, smoke):
    from panelforge.plans.panels import weekly
    from panelforge.queries_reference import QUERIES

    p = weekly(spark, smoke)
    x = pn.log_returns(p).toPandas().pivot(index="date", columns="ticker", values="r").dropna()
    volume = p.toPandas().groupby("ticker").volume.sum()[x.columns].to_numpy(float)
    got = {q: QUERIES[q](spark, smoke).toPandas().set_index("ticker").iloc[:, 0] for q in ("kelly_panel", "bl_posterior_panel", "risk_parity_panel", "hrp_panel")}
    assert len(x.columns) == 6 and all(set(g.index) == set(x.columns) for g in got.values())
    c = np.cov(x.to_numpy(), rowvar=False) * 52
    w = got["risk_parity_panel"][x.columns].to_numpy()
    np.testing.assert_allclose(w * (c @ w) / (w @ c @ w), 1 / 6, atol=1e-8)
    assert abs(got["hrp_panel"].sum() - 1) < 1e-12 and (got["hrp_panel"] > 0).all()
    excess = x.mean().to_numpy() * 52 - 0.04
    on = excess > 0
    full = np.zeros(6)
    full[on] = np.clip(0.5 * np.linalg.inv(c[np.ix_(on, on)]) @ excess[on], 0, 0.4)
    np.testing.assert_allclose(got["kelly_panel"][x.columns], full * min(1, 1.5 / max(full.sum(), 1e-300)), atol=1e-9)
    view, prior = x.iloc[-52:].sum().to_numpy(), 2.5 * c @ (volume / volume.sum())
    gain = 0.05 * c @ np.linalg.inv(0.05 * c + np.diag(np.diag(c) * 0.15))
    np.testing.assert_allclose(got["bl_posterior_panel"][x.columns], prior + gain @ (view - prior), rtol=1e-7)


def test_parameter_stability_takes_any_strategy_and_grid(spark):
    from panelforge.queries_reference import GRID

    p = long(spark, prices(300, 5))

    def factory(share, other):
        return lambda x, current: np.array([share, 1 - share, 0.0])

    runs = va.parameter_runs(p, factory, {"share": [0.0, 0.5, 1.0], "other": [1, 2]}, years=1)
    got = runs.toPandas()
    assert set(got.combo) == set(range(6)) and len(got) == 6 * got.window_start.nunique()
    assert {r.parameter for r in va.parameter_stability(runs.unionByName(runs.withColumn("window_start", F.date_add("window_start", 400)))).collect()} == {"share", "other"}
    x = np.random.default_rng(0).normal(0.002, 0.01, (260, 3))
    base = {k: v[1] for k, v in GRID.items()}
    even = np.full(3, 1 / 3)
    w = va.bl_kelly_signal(**base, turnover=None)(x, even)
    for name, value in (("fraction", 0.1), ("view_confidence", 0.9), ("lookback", 189)):
        assert np.abs(va.bl_kelly_signal(**base | {name: value}, turnover=None)(x, even) - w).max() > 1e-9 or (w == 0.4).all(), name
    assert np.prod([len(v) for v in GRID.values()]) == 54 and (va.bl_kelly_signal(**base)(x[:100], even) == even).all()


def test_covariance_backtests_have_all_estimators(spark, smoke):
    from panelforge.queries_reference import QUERIES

    assert {r.strategy for r in QUERIES["cov_backtests"](spark, smoke).select("strategy").collect()} == set(C.ESTIMATORS)


def test_factor_queries_use_all_six_factors(spark, smoke):
    from panelforge.queries_reference import QUERIES

    assert {r.term for r in QUERIES["factor_ols"](spark, smoke).collect()} == {"alpha", *fa.FACTORS}
    assert len(QUERIES["factor_rolling"](spark, smoke).first().betas) == 6


def test_regimes(spark):
    rng = np.random.default_rng(3)
    r = np.concatenate([rng.normal(0, 0.005, 300), rng.normal(0, 0.025, 300)])
    s = spark.createDataFrame([("s", (pd.Timestamp("2020-01-01") + pd.Timedelta(days=i)).date(), float(x)) for i, x in enumerate(r)] + [("short", dt.date(2020, 1, 1), 0.1)], "strategy string, date date, ret double")
    got = rg.hmm_regimes(s).toPandas().sort_values("date")
    assert set(got.strategy) == {"s"} and len(got) == 581
    assert (got.regime.iloc[:250] == "low_vol").mean() > 0.9 and (got.regime.iloc[-250:] != "low_vol").mean() > 0.9
    flat = rg.classify(s)
    assert flat.where("regime is null").count() == 60
    perf = rg.performance(flat.where("strategy = 's'")).toPandas()
    assert abs(perf.fraction.sum() - 1) < 1e-12 and (perf.max_dd <= 0).all()


def test_factors(spark):
    rng = np.random.default_rng(4)
    n = 400
    f = rng.normal(0, 0.01, (n, 2))
    y = 0.0002 + f @ [1.2, -0.4] + rng.normal(0, 0.002, n)
    days = [(pd.Timestamp("2020-01-01") + pd.Timedelta(days=i)).date() for i in range(n)]
    series = spark.createDataFrame([("s", d, float(v)) for d, v in zip(days, y, strict=True)], "strategy string, date date, ret double")
    fac = spark.createDataFrame([(d, float(a), float(b), 0.0) for d, (a, b) in zip(days, f, strict=True)], "date date, mkt_rf double, smb double, rf double")
    got = fa.attribute(series, fac, ("mkt_rf", "smb")).toPandas().set_index("term")
    x = np.column_stack([np.ones(n), f])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    np.testing.assert_allclose(got.beta[["alpha", "mkt_rf", "smb"]], beta, rtol=1e-9)
    e = y - x @ beta
    kernel = np.maximum(0, 1 - np.abs(np.subtract.outer(np.arange(n), np.arange(n))) / 6)
    inv = np.linalg.inv(x.T @ x)
    np.testing.assert_allclose(got.se[["alpha", "mkt_rf", "smb"]], np.sqrt(np.diag(inv @ (x * e[:, None]).T @ kernel @ (x * e[:, None]) @ inv)), rtol=1e-9)
    roll = fa.rolling_attribution(series, fac, ("mkt_rf", "smb"), 100).toPandas().sort_values("date")
    last = np.linalg.lstsq(x[-100:], y[-100:], rcond=None)[0]
    np.testing.assert_allclose(roll.betas.iloc[-1], last[1:], rtol=1e-7)
    assert fa.attribute(series.limit(10), fac, ("mkt_rf",)).count() == 0


def test_strategies_and_report(spark, panel):
    s = pn.calendar(panel)
    raw = al.raw_targets(panel, s, 60, 30).toPandas()
    assert set(raw.strategy) == set(al.REGISTRY) and (raw.groupby(["strategy", "reb_id"]).w.sum() <= 1.5 + 1e-9).all()
    p = bt.positions(panel, s, bt.equal_weight(panel, s))
    assert abs(p.where("date = '2020-03-10'").agg(F.sum("w")).first()[0] - 1) < 1e-9
    text = ch.text_report({"Weights": ch.weight_summary(p), "None": panel.limit(0)})
    assert "Weights" in text and "(no rows)" in text
