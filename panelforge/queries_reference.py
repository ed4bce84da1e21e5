"""Queries of the panel operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

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
from panelforge.plans.panels import daily, raw_panel, returning, strategies, weekly
from panelforge.plans.storage import write_table
from panelforge.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6, **others: int) -> DataFrame:
    """Doubles rounded (``others`` names columns with other places), no negative zero, integers as long: values two engines can agree on."""
    return df.select(*[(F.round(c, others.get(c, places)) + 0.0).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def _panel_sql(period: str) -> str:
    return f"""with li as (select {period} as date, l_returnflag || l_linestatus as ticker, avg(l_extendedprice / l_quantity) as x, sum(l_quantity) as volume from lineitem group by 1, 2),
st as (select *, 0.01 * (x - avg(x) over (partition by ticker)) / stddev_samp(x) over (partition by ticker) as step from li),
lv as (select date, ticker, volume, 100 * exp(sum(step) over (partition by ticker order by date)) as px from st),
gr as (select d.date, t.ticker from (select distinct date from lv) d cross join (select distinct ticker from lv) t),
fl as (select gr.date, gr.ticker, last_value(lv.px ignore nulls) over f as px, last_value(lv.volume ignore nulls) over f as volume from gr left join lv on gr.date = lv.date and gr.ticker = lv.ticker
  window f as (partition by gr.ticker order by gr.date rows between 5 preceding and current row)),
pw as (select date, ticker, px, volume from (select *, count(px) over (partition by date) as have from fl) where have = (select count(distinct ticker) from lv)),
r as (select date, ticker, ln(px / p0) as r, px / p0 - 1 as sr from (select *, lag(px) over (partition by ticker order by date) as p0 from pw) where p0 is not null)"""


WEEK = _panel_sql("cast(date_trunc('week', l_shipdate) as date)")
DAY = _panel_sql("cast(l_shipdate as date)")
EQ = """with eq as (select strategy, trade_date as date, ret, equity, turnover, cost from
  (select *, row_number() over (partition by strategy, trade_date order by loaded_at desc) as rn from equity where strategy is not null and trade_date is not null) where rn = 1 and ret is not null)"""
EQE = EQ.replace("where rn = 1 and ret is not null", "where rn = 1")
REB = """, cal as (select date, rn, sum(flag) over (order by date) as reb_id, flag from
  (select date, row_number() over (order by date) as rn, case when lag(date) over (order by date) is null or month(date) <> month(lag(date) over (order by date)) then 1 else 0 end as flag from (select distinct date from pw)))"""


@query(DAY + " select date, ticker, round(px, 6) as px, round(volume, 6) as volume from pw")
def panel_align_ffill(spark, d):
    return rounded(daily(spark, d))


@query(WEEK + " select date, ticker, round(r, 8) as r from r")
def log_returns(spark, d):
    return rounded(pn.log_returns(weekly(spark, d)), 8)


@query(WEEK + " select date, ticker, round(sr, 8) as r, round(ln(1 + sr), 8) as lr, round(exp(ln(1 + sr)) - 1, 8) as back from r")
def returns_roundtrip(spark, d):
    s = pn.simple_returns(weekly(spark, d)).withColumn("lr", pn.simple_to_log(F.col("r")))
    return rounded(s.withColumn("back", pn.log_to_simple(F.col("lr"))), 8)


_GAPS = DAY + ", gp as (select gr.date, gr.ticker, ln(lv.px / 100) as r from gr left join lv on gr.date = lv.date and gr.ticker = lv.ticker)"


def _gappy(spark, d):
    raw = raw_panel(spark, d, "day")
    dates = raw.agg(F.array_sort(F.collect_set("date")).alias("dates")).withColumn("_k", F.lit(0))
    grid = raw.select("ticker").distinct().withColumn("_k", F.lit(0)).join(F.broadcast(dates), "_k").select("ticker", F.explode("dates").alias("date"))
    return grid.join(raw, ["date", "ticker"], "left").select("date", "ticker", F.log(F.col("px") / 100).alias("r"))


@query(_GAPS + " select date, ticker, round(r, 8) + 0 as r from (select *, count(r) over (partition by date) as k, count(*) over (partition by date) as n from gp) where k = n")
def missing_drop(spark, d):
    return rounded(pn.handle_missing(_gappy(spark, d), "drop"), 8)


@query(_GAPS + " select date, ticker, round(coalesce(r, 0), 8) + 0 as r from gp")
def missing_zero(spark, d):
    return rounded(pn.handle_missing(_gappy(spark, d), "zero"), 8)


@query(_GAPS + ", ff as (select date, ticker, last_value(r ignore nulls) over (partition by ticker order by date) as r from gp) select date, ticker, round(r, 8) + 0 as r from (select *, count(r) over (partition by date) as k, count(*) over (partition by date) as n from ff) where k = n")
def missing_ffill(spark, d):
    return rounded(pn.handle_missing(_gappy(spark, d), "ffill"), 8)


@query(WEEK + " select ticker, round(avg(r) * 252, 6) as ann_return, round(stddev_samp(r) * sqrt(252), 6) as ann_vol from r group by ticker")
def annualised_stats(spark, d):
    return rounded(pn.annualised(pn.log_returns(weekly(spark, d))))


_CURVE = ", cu as (select *, exp(sum(ln(1 + ret)) over (partition by {k} order by date)) as growth from {t}), dd as (select *, growth / max(growth) over (partition by {k} order by date) - 1 as drawdown from cu)"


def _report_sql(keys: str, source: str) -> str:
    return (
        _CURVE.format(k=keys, t=source)
        + f""", va as (select {keys}, quantile_cont(ret, 0.05::double) as var_95 from {source} group by {keys}),
ag as (select {", ".join("dd." + k.strip() for k in keys.split(","))}, count(ret) as n, exp(sum(ln(1 + ret))) as compound, coalesce(stddev_samp(ret), 0) as sd, avg(ret) as mean,
  avg(case when ret - 0.04 / 252 < 0 then (ret - 0.04 / 252) * (ret - 0.04 / 252) end) as downside, min(drawdown) as max_dd, any_value(var_95) as var_95,
  avg(case when ret <= var_95 then ret end) as tail_mean, avg(case when ret > 0 then 1.0::double else 0.0::double end) as win_rate,
  sum(case when ret > 0 then ret end) / sum(case when ret < 0 then -ret end) as profit_factor
  from dd join va on {" and ".join(f"dd.{k.strip()} = va.{k.strip()}" for k in keys.split(","))} group by all)
"""
    )


_REPORT_COLS = """round(pow(compound, 252.0 / n) - 1, 6) as ann_return, round(sd * sqrt(252), 6) as ann_vol, round((mean - 0.04 / 252) / sd * sqrt(252), 6) as sharpe,
round((mean - 0.04 / 252) * 252 / (sqrt(downside) * sqrt(252)), 6) as sortino, round(max_dd, 6) + 0 as max_dd, case when max_dd = 0 then 0 else round((pow(compound, 252.0 / n) - 1) / abs(max_dd), 6) end as calmar,
round(var_95, 8) as var_95, round(tail_mean, 6) as cvar_95, round(win_rate, 6) as win_rate, round(profit_factor, 6) as profit_factor, n as n_days"""


@query(EQ + _report_sql("strategy", "eq") + f"select strategy, {_REPORT_COLS} from ag")
def risk_report(spark, d):
    return rounded(me.risk_report(returning(spark, d)), var_95=8)


@query(
    EQE
    + """ , e as (select *, max(equity) over (partition by strategy order by date) as peak from eq where equity is not null and not isnan(equity)),
a as (select strategy, arg_min(equity, date) as f, arg_max(equity, date) as l, min(date) as s, max(date) as t, min(equity / peak - 1) as max_dd from e group by strategy)
select strategy, round(l / f - 1, 6) as total_return, round(pow(l / f, 1 / ((t - s) / 365.25)) - 1, 6) as cagr, round(max_dd, 6) as max_dd from a"""
)
def equity_summary(spark, d):
    return rounded(me.equity_summary(strategies(spark, d)))


@query(EQ + " select strategy, count(*) as n, round(avg(ret), 8) as mean, round(stddev_samp(ret), 8) as sd, round(skewness(ret), 6) as skew, round(kurtosis(ret), 6) as kurtosis from eq group by strategy having count(*) > 3")
def skew_kurt(spark, d):
    m = me.moments(returning(spark, d))
    return m.select("strategy", "n", F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"), F.round("skew", 6).alias("skew"), F.round("kurtosis", 6).alias("kurtosis"))


@query(
    EQ
    + """ select strategy, date, case when count(ret) over w = 60 then round(stddev_samp(ret) over w * sqrt(252), 6) end as vol,
case when count(ret) over w = 60 then round((avg(ret) over w - 0.04 / 252) / stddev_samp(ret) over w * sqrt(252), 6) end as sharpe from eq window w as (partition by strategy order by date rows between 59 preceding and current row)"""
)
def rolling_risk(spark, d):
    return rounded(me.rolling(returning(spark, d), 60))


@query(DAY + " select date, ticker, round(avg(volume) over w, 6) as adv, round(stddev_samp(lr) over w, 8) as sigma from (select *, ln(px / lag(px) over (partition by ticker order by date)) as lr from pw) window w as (partition by ticker order by date rows between 19 preceding and current row)")
def adv20(spark, d):
    return cs.market_state(daily(spark, d)).select("date", "ticker", F.round("adv", 6).alias("adv"), F.round("sigma", 8).alias("sigma"))


@query(
    DAY
    + """, q as (select distinct ticker, cast(date_trunc('month', date) as date) as date from pw)
select q.ticker, q.date, round(coalesce((select arg_max(px, date) from pw where pw.ticker = q.ticker and pw.date <= q.date), 100.0), 6) as px from q"""
)
def asof_lookup(spark, d):
    p = daily(spark, d)
    asked = p.select("ticker", F.date_trunc("month", "date").cast("date").alias("date")).distinct()
    return rounded(pn.asof(asked, p, "ticker", "date", ["px"], {"px": cs.NO_PRICE}))


@query(EQE + " select strategy, date, round(equity / max(equity) over (partition by strategy order by date) - 1, 8) as drawdown from eq where equity is not null and not isnan(equity)")
def drawdown_curve(spark, d):
    return rounded(ch.drawdown_curve(strategies(spark, d)), 8)


@query(
    EQE
    + """, a as (select strategy, date, equity / max(equity) over (partition by strategy order by date) - 1 as dd from eq where equity is not null and not isnan(equity)),
b as (select *, sum(cast(dd = 0 as int)) over (partition by strategy order by date) as ep, first_value(case when dd = 0 then date end ignore nulls) over (partition by strategy order by date rows between current row and unbounded following) as nx, max(date) over (partition by strategy) as ld from a),
c as (select strategy, ep, min(date) as start, min(dd) as depth, arg_min(date, (dd, date)) as trough, coalesce(any_value(nx), max(ld)) as e from b where dd < 0 group by strategy, ep),
k as (select *, row_number() over (partition by strategy order by depth, start) as rk from c)
select strategy, rk as rank, start, trough, e as "end", round(depth, 6) as depth, cast(e - start as bigint) as duration_days from k where rk <= 3"""
)
def top_drawdowns(spark, d):
    return rounded(me.drawdown_episodes(strategies(spark, d)))


@query(DAY + REB + " select date, rn, cast(flag as boolean) as is_reb, cast(reb_id as bigint) as reb_id from cal")
def rebalance_calendar(spark, d):
    return rounded(pn.calendar(daily(spark, d)))


@query(DAY + " select cast(date_trunc('month', date) as date) as month, min(date) as date from pw group by 1")
def month_starts(spark, d):
    return pn.month_starts(daily(spark, d))


_BT = (
    WEEK
    + REB
    + """, tg as (select reb_id, pw.date, ticker, px, 1.0 / count(*) over (partition by pw.date) as w from pw join cal on pw.date = cal.date where flag = 1),
ln as (select *, lag(w, 1, 0) over (partition by ticker order by reb_id) as w0, coalesce(px / lag(px) over (partition by ticker order by reb_id), 1) as mv from tg),
gg as (select reb_id, 1 + sum(w0 * mv - w0) as g from ln group by reb_id),
pr as (select ln.reb_id, max(date) as date, max(g) as g, sum(abs(w - w0 * mv / g)) as traded from ln join gg on ln.reb_id = gg.reb_id group by ln.reb_id),
an as (select *, 1e6 * exp(sum(ln(g * (1 - 0.0015 * traded))) over (order by reb_id)) as ek from pr),
sg as (select pw.date, pw.ticker, cal.reb_id, pw.px, tg.px as pk, tg.w from pw join cal on pw.date = cal.date join tg on tg.reb_id = cal.reb_id and tg.ticker = pw.ticker),
eqd as (select sg.date, sg.reb_id, 1 + sum(w * (px / pk - 1)) as g from sg group by sg.date, sg.reb_id),
bt as (select 'equal_weight' as strategy, eqd.date, ek * eqd.g as equity, case when an.date = eqd.date then traded / 2 else 0 end as turnover, case when an.date = eqd.date then ek / (1 - 0.0015 * traded) * 0.0015 * traded else 0 end as cost from eqd join an on eqd.reb_id = an.reb_id),
bk as (select strategy, date, equity, equity / lag(equity, 1, 1e6) over (order by date) - 1 as ret, turnover, cost from bt)"""
)


@query(_BT + " select strategy, date, round(equity, 4) as equity, round(ret, 8) as ret, round(turnover, 8) as turnover, round(cost, 4) as cost from bk")
def backtest_ew(spark, d):
    b = bt.run_backtest(weekly(spark, d))
    return b.select("strategy", "date", F.round("equity", 4).alias("equity"), F.round("ret", 8).alias("ret"), F.round("turnover", 8).alias("turnover"), F.round("cost", 4).alias("cost"))


@query(_BT + " select 'equal_weight' as strategy, date, ticker, round(w * px / pk / (1 + sum(w * px / pk - w) over (partition by date)), 8) as w from sg")
def positions_ew(spark, d):
    p = weekly(spark, d)
    s = pn.calendar(p)
    return rounded(bt.positions(p, s, bt.equal_weight(p, s)), 8)


@query(_BT + _report_sql("strategy", "bk") + f"select strategy, {_REPORT_COLS} from ag")
def backtest_risk_report(spark, d):
    return rounded(me.risk_report(bt.run_backtest(weekly(spark, d))), var_95=8)


_SPARSE = _BT.replace(
    "select reb_id, pw.date, ticker, px, 1.0 / count(*) over (partition by pw.date) as w from pw join cal on pw.date = cal.date where flag = 1",
    "select reb_id, date, ticker, px, case when held then 1.0 / sum(cast(held as int)) over (partition by date) else 0 end as w from (select reb_id, pw.date, ticker, px, (reb_id + dense_rank() over (order by ticker)) % 3 <> 0 as held from pw join cal on pw.date = cal.date where flag = 1)",
).replace("'equal_weight'", "'sparse'")


def sparse_targets(panel, schedule):
    """Equal weights of two tickers in three, others at every rebalance; the rest have no rows."""
    names = panel.select("ticker").distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ticker")))
    held = panel.join(schedule.where("is_reb").select("date", "reb_id"), "date").join(names, "ticker").where((F.col("reb_id") + F.col("k")) % 3 != 0)
    return held.select(F.lit("sparse").alias("strategy"), "reb_id", "ticker", (1 / F.count("*").over(Window.partitionBy("date"))).alias("w"))


@query(_SPARSE + " select strategy, date, round(equity, 4) as equity, round(ret, 8) as ret, round(turnover, 8) as turnover, round(cost, 4) as cost from bk")
def backtest_sparse(spark, d):
    p = weekly(spark, d)
    return rounded(bt.run_backtest(p, sparse_targets(p, pn.calendar(p))), 8, equity=4, cost=4)


_TURN = "select strategy, round(sum(turnover) / (count(ret) / 252.0), 6) as ann_turnover, round(252 / (sum(turnover) / (count(ret) / 252.0)), 6) as holding_days, round(sum(cost) / avg(equity) / (count(ret) / 252.0) * 10000, 6) as cost_drag_bps from {t} group by strategy"


@query(EQ + " " + _TURN.format(t="eq"))
def turnover_analysis(spark, d):
    return rounded(me.turnover_analysis(returning(spark, d)))


@query(EQ + ", m as (select unnest([0.0, 0.5, 1.0, 2.0, 3.0, 5.0]::double[]) as multiplier) , a as (select strategy, multiplier, ret + coalesce(cost / equity, 0) * (1 - multiplier) as x from eq, m) select strategy, multiplier, round((avg(x) - 0.04 / 252) / stddev_samp(x) * sqrt(252), 6) as sharpe from a group by strategy, multiplier")
def cost_sensitivity(spark, d):
    return rounded(me.cost_sensitivity(returning(spark, d)))


@query(
    DAY
    + """, ms as (select date, ticker, px, avg(volume) over w as adv, stddev_samp(lr) over w as sigma from (select *, ln(px / lag(px) over (partition by ticker order by date)) as lr from pw) window w as (partition by ticker order by date rows between 19 preceding and current row)),
t as (select date, ticker, 1000 * ((row_number() over (partition by ticker order by date)) % 7) as dollars from pw),
j as (select t.date, t.ticker, dollars, px, adv, coalesce(last_value(sigma ignore nulls) over (partition by t.ticker order by t.date), 0.01) as sigma, dollars / px / adv as part from t join ms on t.date = ms.date and t.ticker = ms.ticker)
select date, ticker, cast(dollars as double) as dollars, round(dollars * 5e-4, 6) as spread, round(0.1 * sigma * sqrt(part) * dollars, 6) as temporary, round(0.1 * part * dollars, 6) as permanent, round(0.5 * sigma * dollars, 6) as slip,
round(dollars * 5e-4 + 0.1 * sigma * sqrt(part) * dollars + 0.1 * part * dollars + 0.5 * sigma * dollars, 6) as total from j"""
)
def ac_cost_breakdown(spark, d):
    p = daily(spark, d)
    trades = p.select("date", "ticker", (1000 * (F.row_number().over(Window.partitionBy("ticker").orderBy("date")) % 7)).cast("double").alias("dollars"))
    return rounded(cs.impact(trades, cs.market_state(p)))


_REG = EQ + ", vo as (select *, case when count(ret) over w = 60 then stddev_samp(ret) over w * sqrt(252) end as vol from eq window w as (partition by strategy order by date rows between 59 preceding and current row)), rg as (select *, case when vol < 0.15 then 'bull' when vol < 0.25 then 'sideways' when vol is not null then 'bear' end as regime from vo)"


@query(_REG + " select strategy, date, round(vol, 8) as vol, regime from rg")
def regime_threshold(spark, d):
    return rounded(rg.classify(returning(spark, d)).select("strategy", "date", "vol", "regime"), 8)


@query(_REG + ", rv as (select strategy, regime, date, ret from rg where regime is not null), sh as (select strategy, regime, count(*) as k, count(*) / sum(count(*)) over (partition by strategy) as fraction from rv group by strategy, regime)" + _report_sql("strategy, regime", "rv") + f"select ag.strategy, ag.regime, {_REPORT_COLS}, round(fraction, 6) as fraction from ag join sh on ag.strategy = sh.strategy and ag.regime = sh.regime where k >= 2")
def regime_stats(spark, d):
    return rounded(rg.regime_report(rg.classify(returning(spark, d))), var_95=8)


_PERF = (
    _REG
    + """, rb as (select *, row_number() over (partition by strategy order by date) - row_number() over (partition by strategy, regime order by date) as bl from rg where regime is not null),
gr as (select *, exp(sum(ln(1 + ret)) over (partition by strategy, regime, bl order by date)) as gw from rb),
dw as (select *, gw / max(gw) over (partition by strategy, regime, bl order by date) - 1 as ddn from gr),
pf as (select strategy, regime, count(*) as n_days, avg(ret) * 252 as mean_return, stddev_samp(ret) * sqrt(252) as volatility, least(min(ddn), 0) as max_dd from dw group by strategy, regime),
px as (select *, n_days / sum(n_days) over (partition by strategy) as fraction, case when volatility > 1e-10 then (mean_return - 0.04) / volatility else 0 end as sharpe from pf)"""
)


@query(_PERF + " select strategy, regime, n_days, round(fraction, 6) as fraction, round(mean_return, 6) as mean_return, round(volatility, 6) as volatility, round(sharpe, 6) as sharpe, round(max_dd, 6) as max_dd from px")
def regime_blocks(spark, d):
    return rounded(rg.performance(rg.classify(returning(spark, d))))


@query(_PERF + " select strategy, round(max(case when regime = 'bull' then sharpe end), 6) as bull, round(max(case when regime = 'sideways' then sharpe end), 6) as sideways, round(max(case when regime = 'bear' then sharpe end), 6) as bear from px group by strategy")
def conditional_sharpe(spark, d):
    return rounded(rg.conditional_sharpe(rg.classify(returning(spark, d)), ["bull", "sideways", "bear"]))


@query(_REG + ", tr as (select strategy, regime as from_regime, lead(regime) over (partition by strategy order by date) as to_regime from rg where regime is not null) select strategy, from_regime, to_regime, count(*) as n, round(count(*) / sum(count(*)) over (partition by strategy, from_regime), 6) as share from tr where to_regime is not null group by strategy, from_regime, to_regime")
def regime_transitions(spark, d):
    return rounded(rg.transitions(rg.classify(returning(spark, d))))


_CPCV = (
    WEEK
    + """, po as (select date, avg(r) as r from r group by date),
pl as (select date, ntile(10) over (order by date) - 1 as g, count(*) over () as t from po),
pp as (select *, row_number() over (partition by g order by date) as fw, row_number() over (partition by g order by date desc) as bw from pl),
co as (select a.g as g1, b.g as g2, row_number() over (order by a.g, b.g) - 1 as split_id from range(10) a(g) join range(10) b(g) on a.g < b.g),
sp as (select split_id, po.r, g in (g1, g2) as te, ((g + 1 in (g1, g2)) and bw <= 5) or ((g - 1 in (g1, g2)) and fw <= 5 + floor(t * 0.01)) as dr from pp join po on pp.date = po.date, co),
sg as (select split_id, count(*) filter (not te and not dr) as n_train, count(*) filter (te) as n_test, avg(r) filter (not te and not dr) as m0, stddev_samp(r) filter (not te and not dr) as s0, avg(r) filter (te) as m1, stddev_samp(r) filter (te) as s1 from sp group by split_id),
cp as (select split_id, n_train, n_test, (m0 - 0.04 / 252) / s0 * sqrt(252) as is_sharpe, (m1 - 0.04 / 252) / s1 * sqrt(252) as oos_sharpe from sg where n_train >= 30)"""
)


@query(_CPCV + " select split_id, n_train, n_test, round(is_sharpe, 6) as is_sharpe, round(oos_sharpe, 6) as oos_sharpe from cp")
def cpcv_splits(spark, d):
    return rounded(va.cpcv_equal_weight(pn.log_returns(weekly(spark, d))))


@query(
    _CPCV
    + """, rk as (select *, rank() over (order by is_sharpe) + (count(*) over (partition by is_sharpe) - 1) / 2 as rx, rank() over (order by oos_sharpe) + (count(*) over (partition by oos_sharpe) - 1) / 2 as ry from cp)
select round(avg(case when oos_sharpe < 0 then 1.0::double else 0.0::double end), 6) as pbo, round(avg(oos_sharpe), 6) as mean_oos, round(stddev_pop(oos_sharpe), 6) as sd_oos, round(avg(case when is_sharpe <> 0 then oos_sharpe / is_sharpe end), 6) as degradation, round(corr(rx, ry), 6) as spearman from rk"""
)
def pbo(spark, d):
    return rounded(va.overfitting(va.cpcv_equal_weight(pn.log_returns(weekly(spark, d)))))


_SR = EQ + ", mo as (select strategy, count(*) as n, (avg(ret) - 0.04 / 252) / stddev_samp(ret) as sr, skewness(ret) as g, kurtosis(ret) as k from eq group by strategy having count(*) > 3), ir as (select *, 1 - g * sr + (k + 2) / 4 * sr * sr as i from mo)"


@query(_SR + " select strategy, n, round(sqrt(i / (n - 1)) * sqrt(252), 6) as se, round(1 + i * pow(1.6448536269514722 / sr, 2), 4) as min_length from ir")
def sr_stderr_minbtl(spark, d):
    e = va.sharpe_error(returning(spark, d))
    return e.select("strategy", "n", F.round("se", 6).alias("se"), F.round("min_length", 4).alias("min_length"))


@query()
def dsr_psr(spark, d):
    return va.sharpe_tests(returning(spark, d), benchmark=0.5, trials=7)


_U = "(('0x' || substr(md5('42|' || path || '|' || day || '|{k}'), 1, 8))::bigint + 0.5) / 4294967296.0::double"
_MC = (
    EQ
    + f""", pf as (select date, avg(ret) as r from eq group by date), pm as (select round(avg(r), 10) as m, round(stddev_samp(r), 10) as s from pf),
ra as (select p.path, y.day from range(50000) p(path), range(1, 253) y(day)),
dr as (select path, day, m + s * (sqrt(-2 * ln({_U.format(k=0)})) * cos(2 * pi() * ({_U.format(k=1)}))) as ret from ra, pm),
wk as (select *, 1e6 * exp(sum(ln(1 + ret)) over (partition by path order by day)) as equity from dr)"""
)
_MC_ENDS = _MC + ", wd as (select *, equity / greatest(max(equity) over (partition by path order by day), 1e6) - 1 as dd from wk), en as (select path, arg_max(equity, day) as terminal, least(min(dd), 0) as max_dd from wd group by path)"


def _walk(spark, d):
    """50,000 paths of 252 days of the equal-weight portfolio of all strategies, from the mean and deviation of its stored returns (one row on the driver)."""
    portfolio = returning(spark, d).groupBy("date").agg(F.avg("ret").alias("r"))
    m = portfolio.agg(F.round(F.avg("r"), 10).alias("m"), F.round(F.stddev_samp("r"), 10).alias("s")).first()
    return mc.paths(spark, m["m"], m["s"])


@query(_MC_ENDS + " select path, round(terminal, 2) as terminal, round(max_dd, 6) as max_dd from en")
def mc_terminal(spark, d):
    return rounded(mc.outcomes(_walk(spark, d), 1e6), 6, terminal=2)


@query(_MC + " select day, " + ", ".join(f"round(quantile_cont(equity, {q}::double), 2) as p{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " from wk group by day")
def mc_bands(spark, d):
    return rounded(mc.bands(_walk(spark, d)), 2)


@query(_MC + ", un as (select path, day, equity / greatest(max(equity) over (partition by path order by day), 1e6) - 1 < 0 as u from wk), ru as (select *, sum(cast(not u as int)) over (partition by path order by day) as run from un), lo as (select path, run, sum(cast(u as int)) as n from ru group by path, run) select path, cast(max(n) as bigint) as longest from lo group by path")
def mc_underwater(spark, d):
    return mc.underwater(_walk(spark, d), 1e6)


@query(
    """with k as (select distinct run_id, path, initial_capital, terminal, max_dd from mc_path where run_id is not null and terminal is not null and not isnan(terminal) and max_dd is not null and not isnan(max_dd))
select run_id, round(quantile_cont(terminal, 0.5::double), 4) as median_terminal, round(avg(terminal), 4) as mean_terminal, round(quantile_cont(terminal, 0.05::double), 4) as terminal_p05, round(avg(case when terminal > initial_capital then 1.0::double else 0.0::double end), 6) as prob_profit,
round(avg(case when terminal < 0.75 * initial_capital then 1.0::double else 0.0::double end), 6) as prob_loss_25, round(quantile_cont(max_dd, 0.5::double), 8) as median_max_dd, round(quantile_cont(max_dd, 0.05::double), 8) as max_dd_p05 from k group by run_id"""
)
def mc_run_summary(spark, d):
    from panelforge.functions.columns import number

    p = table(spark, d, "mc_path").select("run_id", "path", "initial_capital", number("terminal").alias("terminal"), number("max_dd").alias("max_dd")).where("run_id is not null and terminal is not null and max_dd is not null").distinct()
    s = mc.summary(p, F.col("initial_capital"), ["run_id"])
    places = {"prob_profit": 6, "prob_loss_25": 6, "median_max_dd": 8, "max_dd_p05": 8}
    return s.select("run_id", *[F.round(c, places.get(c, 4)).alias(c) for c in s.columns[1:]])


@query()
def mc_strategy_terminal(spark, d):
    return mc.forward(returning(spark, d), "outcomes")


@query()
def mc_strategy_bands(spark, d):
    return mc.forward(returning(spark, d), "bands")


@query()
def mc_strategy_underwater(spark, d):
    return mc.forward(returning(spark, d), "underwater")


@query()
def mc_correlated(spark, d):
    return mc.forward_correlated(pn.simple_returns(daily(spark, d)), "outcomes")


@query(EQ + ", mo as (select strategy, year(date) as year, month(date) as m, exp(sum(ln(1 + ret))) - 1 as x from eq group by 1, 2, 3) select strategy, cast(year as bigint) as year, " + ", ".join(f"round(max(case when m = {m} then x end), 8) as m{m:02d}" for m in range(1, 13)) + " from mo group by strategy, year")
def monthly_heatmap(spark, d):
    return rounded(me.monthly_heatmap(returning(spark, d)), 8)


@query(EQE + " select strategy, date, round(equity / first_value(equity) over (partition by strategy order by date), 8) as level from eq where equity is not null and not isnan(equity)")
def equity_level(spark, d):
    return rounded(me.normalised(strategies(spark, d)), 8)


_MEW = _BT + ", hd as (select date, ticker, w * px / pk / (1 + sum(w * px / pk - w) over (partition by date)) as w from sg), le as (select ticker, cast(date_trunc('month', date) as date) as month, arg_max(w, date) as w from hd group by 1, 2), mw as (select ticker, avg(w) as mean_w, row_number() over (order by avg(w) desc, ticker) as rank from le group by ticker)"


@query(_MEW + " select 'equal_weight' as strategy, month, le.ticker, round(w, 8) as w, rank from le join mw on le.ticker = mw.ticker")
def month_end_weights(spark, d):
    p = weekly(spark, d)
    s = pn.calendar(p)
    return rounded(ch.month_end_weights(bt.positions(p, s, bt.equal_weight(p, s))), 8)


@query(_BT + ", hd as (select date, ticker, w * px / pk / (1 + sum(w * px / pk - w) over (partition by date)) as w from sg) select 'equal_weight' as strategy, ticker, round(avg(nullif(w, 0)), 8) as avg_w, round(max(w), 8) as max_w from hd group by ticker")
def weight_summary(spark, d):
    p = weekly(spark, d)
    s = pn.calendar(p)
    return rounded(ch.weight_summary(bt.positions(p, s, bt.equal_weight(p, s))), 8)


@query(_BT + " select strategy, date, round(turnover, 8) as turnover, round(avg(turnover) over (order by date rows between 5 preceding and current row), 8) as smooth from bk where turnover > 0")
def turnover_curve(spark, d):
    return rounded(ch.turnover_curve(bt.run_backtest(weekly(spark, d))), 8)


@query(_REG + " select strategy, date, round(equity / first_value(equity) over (partition by strategy order by date), 8) as level, last_value(regime ignore nulls) over (partition by strategy order by date) as regime from rg")
def regime_overlay(spark, d):
    s = returning(spark, d)
    return rounded(ch.regime_overlay(s, rg.classify(s)), 8)


@query(_CPCV + " select greatest(0, least(19, cast(floor((oos_sharpe + 5) / 0.5) as bigint))) as bin, count(*) as n from cp group by 1")
def cpcv_histogram(spark, d):
    s = va.cpcv_equal_weight(pn.log_returns(weekly(spark, d)))
    return rounded(ch.histogram(s, "oos_sharpe", -5.0, 5.0, 20))


_PAIR = WEEK + ", pa as (select a.date, a.ticker as i, b.ticker as j, a.r as x, b.r as y from r a join r b on a.date = b.date and a.ticker <= b.ticker)"


@query(_PAIR + " select i, j, round(covar_samp(x, y), 10) as cov from pa group by i, j")
def cov_sample(spark, d):
    return rounded(cv.sample(pn.log_returns(weekly(spark, d))), 10)


@query(
    _PAIR
    + """, ag as (select date, pow(0.94::double, row_number() over (order by date desc) - 1) as w from (select distinct date from r)),
s as (select i, j, sum(w) as w, sum(w * w) as w2, sum(w * x) as wx, sum(w * y) as wy, sum(w * x * y) as wxy from pa join ag on pa.date = ag.date group by i, j)
select i, j, round((wxy / w - wx * wy / (w * w)) * w * w / (w * w - w2), 10) as cov from s"""
)
def cov_ewma(spark, d):
    return rounded(cv.ewma(pn.log_returns(weekly(spark, d))), 10)


_LW = (
    WEEK
    + """, ce as (select date, ticker, r - avg(r) over (partition by ticker) as r from r), pc as (select a.ticker as i, b.ticker as j, a.r as x, b.r as y from ce a join ce b on a.date = b.date),
s as (select i, j, avg(x * y) as s, avg(x * x * y * y) as q, count(*) as n from pc group by i, j),
t as (select sum(case when i = j then s end) as tr, sum(case when i = j then 1 end) as p, sum(s * s) as ss, sum(q) as qq, max(n) as n from s),
u as (select tr / p as mu, (ss - 2 * tr / p * tr + p * (tr / p) * (tr / p)) / p as delta, (qq - ss) / (p * n) as b0 from t),
v as (select mu, least(b0, delta) / delta as k from u),
lw as (select i, j, (1 - k) * s + case when i = j then k * mu else 0 end as cov from s, v)"""
)


@query(_LW + " select i, j, round(cov, 10) as cov from lw where i <= j")
def cov_ledoit_wolf(spark, d):
    return rounded(cv.ledoit_wolf(pn.log_returns(weekly(spark, d))), 10)


@query(_LW + " select round(sum(case when i = j then cov end), 10) as trace, round(sqrt(sum(cov * cov)), 10) as frobenius from lw")
def cov_diagnostics(spark, d):
    c = cv.full(cv.ledoit_wolf(pn.log_returns(weekly(spark, d)))).withColumn("method", F.lit("ledoit_wolf"))
    return rounded(cv.compare(c).select("trace", "frobenius"), 10)


@query(WEEK + ", q as (select count(distinct ticker) / count(distinct date) as q from r) select round(q, 8) as q, round(pow(1 - sqrt(q), 2), 8) as low, round(pow(1 + sqrt(q), 2), 8) as high from q")
def mp_bounds(spark, d):
    return rounded(cv.noise_edges(pn.log_returns(weekly(spark, d))), 8)


_METHODS = ("sample", "ledoit_wolf", "ewma", "rmt_denoised", "ledoit_wolf_nonlinear", "dcc_garch")


@query()
def cov_estimators(spark, d):
    return cv.estimate(pn.log_returns(weekly(spark, d)), _METHODS)


@query()
def cov_comparison(spark, d):
    return cv.compare(cv.estimate(pn.log_returns(weekly(spark, d)), _METHODS))


@query()
def cov_eigenvalues(spark, d):
    return cv.eigenvalues(pn.log_returns(weekly(spark, d)))


@query()
def dcc_correlation(spark, d):
    return cv.dcc_series(pn.log_returns(weekly(spark, d)), "AF", "RF")


_ANN = _LW + ", fc as (select i, j, cov * 252 as cov from lw), mk as (select ticker, sum(volume) / (select sum(volume) from pw) as w from pw group by ticker)"


def _annual(spark, d):
    p = weekly(spark, d)
    r = pn.log_returns(p)
    return p, r, cv.ledoit_wolf(r).select("i", "j", (F.col("cov") * 252).alias("cov"))


def _market(p):
    return p.groupBy("ticker").agg(F.sum("volume").alias("w"))


@query(_ANN + " select i as ticker, round(2.5 * sum(cov * w), 8) as pi from fc join mk on fc.j = mk.ticker group by i")
def bl_equilibrium(spark, d):
    p, _, c = _annual(spark, d)
    return rounded(al.equilibrium(c, _market(p)), 8)


@query(_ANN + ", tv as (select ticker, sum(r) * 52 / count(r) as view from (select *, row_number() over (partition by ticker order by date desc) as k from r) where k <= 52 group by ticker) select ticker, round(view, 8) as view, round(cov * 0.05 * 3, 10) as omega from tv join fc on fc.i = ticker and fc.j = ticker")
def bl_views(spark, d):
    _, r, c = _annual(spark, d)
    v = al.momentum_views(r, c, 52)
    return v.select("ticker", F.round("view", 8).alias("view"), F.round("omega", 10).alias("omega"))


_HOLD = _ANN + ", rc as (select i as ticker, sum(cov * b.w) as risk from fc join mk b on fc.j = b.ticker group by i), rr as (select mk.ticker, w, w * risk as c from mk join rc on mk.ticker = rc.ticker)"


def _holdings(p):
    m = _market(p)
    return m.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0))))


@query(_HOLD + " select ticker, round(w, 8) as w, round(c, 10) as contribution, round(c / sum(c) over (), 8) as share from rr")
def risk_contributions(spark, d):
    p, _, c = _annual(spark, d)
    x = al.risk_contributions(c, _holdings(p))
    return x.select("ticker", F.round("w", 8).alias("w"), F.round("contribution", 10).alias("contribution"), F.round("share", 8).alias("share"))


@query(_HOLD + ", vv as (select sum(c) as v from rr) select round(v, 10) as variance, round(least(0.1 / sqrt(v), 1.5), 8) as leverage from vv")
def vol_target_leverage(spark, d):
    p, _, c = _annual(spark, d)
    x = al.vol_target(c, _holdings(p))
    return x.select(F.round("variance", 10).alias("variance"), F.round("leverage", 8).alias("leverage"))


_CAP = "with t as (select strategy || '|' || reb_date || '|' || set_id as key, ticker, max(w) as target from weight_history where w is not null and not isnan(w) and strategy is not null and ticker is not null and reb_date is not null and set_id is not null group by 1, 2), o as (select *, 1.0 / count(*) over (partition by key) as current from t), p as (select *, sum(abs(target - current)) over (partition by key) / 2 as one_way from o)"


@query(_CAP + " select key, ticker, round(current, 8) as current, round(target, 8) as target, round(one_way, 8) as one_way, round(case when one_way > 0.3 then greatest(current + (target - current) * 0.3 / one_way, 0) else target end, 8) as w from p")
def turnover_cap(spark, d):
    h = table(spark, d, "weight_history").where("w is not null and not isnan(w) and ticker is not null")
    t = h.where("strategy is not null and reb_date is not null and set_id is not null").groupBy(F.concat_ws("|", "strategy", F.col("reb_date").cast("string"), F.col("set_id").cast("string")).alias("key"), "ticker").agg(F.max("w").alias("target"))
    t = t.withColumn("current", 1 / F.count("*").over(Window.partitionBy("key"))).select("key", "ticker", "current", "target")
    return rounded(al.turnover_cap(t), 8)


_TWO = (
    WEEK
    + """, c2 as (select a.ticker as i, b.ticker as j, covar_samp(a.r, a.r) * 252 as a, covar_samp(a.r, b.r) * 252 as b, covar_samp(b.r, b.r) * 252 as d, avg(a.r) * 252 as m1, avg(b.r) * 252 as m2
  from r a join r b on a.date = b.date and a.ticker < b.ticker group by 1, 2)"""
)


def _pairs(spark, d, solve):
    """``i, j, wi, wj`` of ``solve(returns, covariance a year)`` for every two tickers: assets by assets in number, one row each."""
    import numpy as np
    import pandas as pd

    from panelforge.functions.covariances import sample

    def run(pdf):
        names, x = cv.matrix(pdf)
        rows = []
        for k in range(len(names)):
            for m in range(k + 1, len(names)):
                two = x[:, [k, m]]
                rows.append((names[k], names[m], *map(float, np.asarray(solve(two, sample(two) * 252)))))
        return pd.DataFrame(rows, columns=["i", "j", "wi", "wj"])

    return pn.log_returns(weekly(spark, d)).withColumn("_k", F.lit(0)).groupBy("_k").applyInPandas(run, "i string, j string, wi double, wj double")


@query(
    _TWO
    + """, e2 as (select *, m1 + 0.5 - 0.04 as e1, m2 + 0.5 - 0.04 as e2, a * d - b * b as det from c2)
select i, j, round(least(greatest(0.5 * (d * e1 - b * e2) / det, 0), 0.4), 6) as wi, round(least(greatest(0.5 * (a * e2 - b * e1) / det, 0), 0.4), 6) as wj from e2"""
)
def kelly_pairs(spark, d):
    from panelforge.functions.weights import kelly

    return rounded(_pairs(spark, d, lambda x, c: kelly(x.mean(axis=0) * 252 + 0.5, c)), 6)


@query(
    _TWO
    + """, pr as (select *, 2.5 * (a * 0.5 + b * 0.5) as p1, 2.5 * (b * 0.5 + d * 0.5) as p2, a * 0.15 as o1, d * 0.15 as o2, (a * d - b * b) * 0.0025 as dt from c2),
iv as (select *, d * 0.05 / dt as ia, -b * 0.05 / dt as ib, a * 0.05 / dt as id from pr),
aa as (select *, ia + 1 / o1 as xa, ib as xb, id + 1 / o2 as xd, ia * p1 + ib * p2 + m1 / o1 as y1, ib * p1 + id * p2 + m2 / o2 as y2 from iv)
select i, j, round((xd * y1 - xb * y2) / (xa * xd - xb * xb), 6) as wi, round((xa * y2 - xb * y1) / (xa * xd - xb * xb), 6) as wj from aa"""
)
def bl_posterior_pairs(spark, d):
    import numpy as np

    from panelforge.functions.weights import equilibrium, posterior

    return rounded(_pairs(spark, d, lambda x, c: posterior(c, equilibrium(c, np.array([0.5, 0.5])), x.mean(axis=0) * 252, np.diag(c) * 0.15)[0]), 6)


@query(_TWO + " select i, j, round((1 / sqrt(a)) / (1 / sqrt(a) + 1 / sqrt(d)), 5) as wi, round((1 / sqrt(d)) / (1 / sqrt(a) + 1 / sqrt(d)), 5) as wj from c2")
def risk_parity_pairs(spark, d):
    from panelforge.functions.weights import risk_budget

    return rounded(_pairs(spark, d, lambda x, c: risk_budget(c)), 5)


@query(_TWO + " select i, j, round(d / (a + d), 6) as wi, round(a / (a + d), 6) as wj from c2")
def hrp_pairs(spark, d):
    from panelforge.functions.weights import hrp

    return rounded(_pairs(spark, d, lambda x, c: hrp(c)[0]), 6)


def _whole(spark, d, solve, name):
    """``ticker, <name>`` of ``solve(returns, covariance a year, market shares)`` over all tickers."""
    import pandas as pd

    from panelforge.functions.covariances import sample

    p = weekly(spark, d)

    def run(pdf):
        tickers, x = cv.matrix(pdf)
        market = pdf.groupby("ticker")["w"].first()[tickers].to_numpy(float)
        return pd.DataFrame({"ticker": tickers, name: solve(x, sample(x) * 52, market)})

    return pn.log_returns(p).join(_market(p), "ticker").select("date", "ticker", "r", "w").withColumn("_k", F.lit(0)).groupBy("_k").applyInPandas(run, f"ticker string, {name} double")


@query()
def kelly_panel(spark, d):
    from panelforge.functions.weights import kelly

    return _whole(spark, d, lambda x, c, market: kelly(x.mean(axis=0) * 52, c), "w")


@query()
def bl_posterior_panel(spark, d):
    from panelforge.functions.weights import equilibrium, momentum_views, posterior

    return _whole(spark, d, lambda x, c, market: posterior(c, equilibrium(c, market), *momentum_views(x, c, 52))[0], "mu")


@query()
def risk_parity_panel(spark, d):
    from panelforge.functions.weights import risk_budget

    return _whole(spark, d, lambda x, c, market: risk_budget(c), "w")


@query()
def hrp_panel(spark, d):
    from panelforge.functions.weights import hrp

    return _whole(spark, d, lambda x, c, market: hrp(c)[0], "w")


_LOOK, _VOL = 104, 52


def _raw(spark, d, method="ledoit_wolf", chosen=None):
    p = weekly(spark, d)
    s = write_table(pn.calendar(p), "calendar")
    raw = al.raw_targets(p, s, _LOOK, _VOL, 52, method, strategies=chosen)
    state = cs.market_state(p).join(s.where("is_reb").select("date", "reb_id"), "date")
    state = state.select("reb_id", "date", "ticker", "px", F.coalesce("adv", F.lit(cs.NO_ADV)).alias("adv"), F.coalesce("sigma", F.lit(cs.NO_SIGMA)).alias("sigma"))
    return p, s, raw.join(state, ["reb_id", "ticker"])


@query()
def strategy_targets(spark, d):
    return _raw(spark, d)[2].drop("cov", "px", "adv", "sigma")


@query()
def backtest_all_strategies(spark, d):
    p, s, raw = _raw(spark, d)
    return _expand_folded(p, s, bt.fold(raw))


def _expand_folded(p, s, folded):
    folded = write_table(folded, "folded")
    anchors = folded.groupBy("strategy", "reb_id").agg(F.max("date").alias("date"), F.max("equity_k").alias("equity_k"), F.max("cost").alias("cost"), F.max("turnover").alias("turnover"))
    return bt.expand(p, s, folded.select("strategy", "reb_id", "ticker", "w"), anchors)


@query()
def backtest_market_impact(spark, d):
    p, s, raw = _raw(spark, d)
    return _expand_folded(p, s, bt.fold(raw, impact=True))


@query()
def leverage_history(spark, d):
    return bt.fold(_raw(spark, d)[2]).where("strategy = 'vol_targeted_bl'").groupBy("strategy", "reb_id", "date").agg(F.max("leverage").alias("leverage"))


@query()
def hrp_weights(spark, d):
    return bt.fold(_raw(spark, d, chosen={"hrp": al.REGISTRY["hrp"]})[2]).select("strategy", "reb_id", "date", "ticker", "w")


@query()
def risk_parity_weights(spark, d):
    return bt.fold(_raw(spark, d, chosen={"risk_parity": al.REGISTRY["risk_parity"]})[2]).select("strategy", "reb_id", "date", "ticker", "w")


@query()
def hrp_dendrogram(spark, d):
    import pandas as pd

    from panelforge.functions.covariances import sample
    from panelforge.functions.weights import hrp

    def run(pdf):
        tickers, x = cv.matrix(pdf)
        m = hrp(sample(x))[1]
        return pd.DataFrame({"step": range(len(m)), "a": m[:, 0].astype(int), "b": m[:, 1].astype(int), "distance": m[:, 2], "size": m[:, 3].astype(int)})

    return pn.log_returns(weekly(spark, d)).withColumn("_k", F.lit(0)).groupBy("_k").applyInPandas(run, "step int, a int, b int, distance double, size int")


@query()
def cov_backtests(spark, d):
    p, s, raw = _raw(spark, d, chosen={m: al.REGISTRY["half_kelly"] | {"method": m} for m in _METHODS})
    return me.risk_report(_expand_folded(p, s, bt.fold(raw)))


@query()
def walk_forward_weights(spark, d):
    return va.walk_forward_weights(weekly(spark, d), _LOOK, 52)


@query()
def walk_forward_run(spark, d):
    return va.walk_forward(weekly(spark, d), _LOOK, periods=52)


@query()
def is_vs_oos(spark, d):
    w = va.walk_forward(weekly(spark, d), _LOOK, periods=52).withColumn("side", F.when(F.col("is_oos"), "oos").otherwise("is"))
    return va.compare_sides(me.risk_report(w, ("strategy", "side")))


@query()
def cpcv_kelly(spark, d):
    from panelforge.functions.covariances import ledoit_wolf
    from panelforge.functions.weights import kelly

    return va.cpcv(pn.log_returns(weekly(spark, d)), lambda x: kelly(x.mean(axis=0) * 252, ledoit_wolf(x) * 252))


@query()
def hmm_parameters(spark, d):
    return rg.hmm_parameters(returning(spark, d))


@query()
def hmm_regimes(spark, d):
    return rg.hmm_regimes(returning(spark, d))


#: The reference's 54 combinations.
GRID = {"fraction": [0.3, 0.5, 0.7], "tau": [0.025, 0.05, 0.1], "view_confidence": [0.15, 0.25, 0.35], "lookback": [189, 252]}


@query()
def param_stability(spark, d):
    return va.parameter_stability(va.parameter_runs(daily(spark, d), va.bl_kelly_signal, GRID))


@query(
    DAY
    + """, sp as (select min(date) as a, max(date) as b from pw), recursive_free as (select (a + to_months(cast(3 * k as int)))::date as s, b from sp, range(200) t(k))
select s as window_start, cast(s + to_years(3) as date) as window_end, lookback, fraction from recursive_free, (select unnest([126, 252]) as lookback) , (select unnest([0.25, 0.5]::double[]) as fraction) where cast(s + to_years(3) as date) <= b"""
)
def param_grid_windows(spark, d):
    grid = va.window_grid(daily(spark, d)).withColumn("lookback", F.explode(F.array(F.lit(126), F.lit(252)))).withColumn("fraction", F.explode(F.array(F.lit(0.25), F.lit(0.5))))
    return rounded(grid)


def _factors(spark, d):
    r = pn.simple_returns(weekly(spark, d))
    wide = r.groupBy("date").pivot("ticker", ["AF", "AO", "NF", "NO", "RF", "RO"]).agg(F.first("r")).dropna()
    base = (F.col("AF") + F.col("AO") + F.col("NF") + F.col("NO") + F.col("RF") + F.col("RO")) / 6
    return wide.select("date", base.alias("mkt_rf"), (F.col("AF") - F.col("RO")).alias("smb"), (F.col("AO") - F.col("RF")).alias("hml"), (F.col("NF") - F.col("NO")).alias("rmw"), (F.col("AF") - F.col("NO")).alias("cma"), (F.col("RF") - F.col("AF")).alias("mom"), F.lit(0.0001).alias("rf"))


def _factor_series(spark, d):
    return bt.run_backtest(weekly(spark, d)).select("strategy", "date", "ret")


@query()
def factor_ols(spark, d):
    return fa.attribute(_factor_series(spark, d), _factors(spark, d))


@query()
def factor_rolling(spark, d):
    return fa.rolling_attribution(_factor_series(spark, d), _factors(spark, d), window=104)


@query(_BT + ", mk1 as (select date, avg(sr) as m from r group by date having count(*) = 6) select strategy, round(regr_intercept(ret, m), 8) as alpha, round(regr_slope(ret, m), 6) as beta, round(regr_r2(ret, m), 6) as r2, count(*) as n from bk join mk1 on bk.date = mk1.date group by strategy")
def factor_ols_1f(spark, d):
    x = fa.single_factor(_factor_series(spark, d), _factors(spark, d))
    return x.select("strategy", F.round("alpha", 8).alias("alpha"), F.round("beta", 6).alias("beta"), F.round("r2", 6).alias("r2"), "n")


@query(
    EQ
    + """, a as (select strategy, avg(ret) as m, stddev_samp(ret) as s from eq group by strategy), b as (select *, rank() over (order by m) + (count(*) over (partition by m) - 1) / 2 as rx, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2 as ry from a) select count(*) as n, round(corr(rx, ry), 6) as spearman from b"""
)
def spearman_panel(spark, d):
    a = returning(spark, d).groupBy("strategy").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    return rounded(me.rank_correlation(a, "m", "s"))


@query(
    """with a as (select distinct ticker from weight_history where ticker is not null), b as (select ticker from universe where ticker is not null)
select ticker, 'both' as side from (select ticker from a intersect select ticker from b) union all select ticker, 'unheld' from (select ticker from b except select ticker from a) union all select ticker, 'unlisted' from (select ticker from a except select ticker from b)"""
)
def set_ops_assets(spark, d):
    a = table(spark, d, "weight_history").select("ticker").where("ticker is not null").distinct()
    b = table(spark, d, "universe").select("ticker").where("ticker is not null").distinct()
    side = lambda df, name: df.withColumn("side", F.lit(name))
    return side(a.intersect(b), "both").unionByName(side(b.subtract(a), "unheld")).unionByName(side(a.subtract(b), "unlisted"))


@query(EQ + _report_sql("strategy", "eq") + ", rp as (select strategy, round((mean - 0.04 / 252) / sd * sqrt(252), 6) as sharpe, round(sd * sqrt(252), 6) as ann_vol from ag) select row_number() over (order by sharpe desc, strategy) as rank, strategy, sharpe, ann_vol from rp")
def strategy_ranking(spark, d):
    return rounded(me.ranking(rounded(me.risk_report(returning(spark, d)).select("strategy", "sharpe", "ann_vol"))))


@query(EQ + ", f as (select strategy, date, ret, avg(ret) over w as m20, stddev_samp(ret) over w * sqrt(252) as vol, count(ret) over w as k from eq window w as (partition by strategy order by date rows between 19 preceding and current row)), z as (select strategy, date, (ret - avg(ret) over (partition by strategy)) / stddev_pop(ret) over (partition by strategy) as z_ret, (vol - avg(vol) over (partition by strategy)) / stddev_pop(vol) over (partition by strategy) as z_vol from f where k = 20) select strategy, date, round(z_ret, 6) as z_ret, round(z_vol, 6) as z_vol from z")
def hmm_features(spark, d):
    return rounded(rg.features(returning(spark, d)))


@query(DAY + " select date, ticker, round(px, 6) as px, round(volume, 6) as volume from pw where date in (select distinct date from pw order by date desc limit 5)")
def panel_tail(spark, d):
    return rounded(pn.tail(daily(spark, d)))


@query(
    EQ
    + _report_sql("strategy", "eq")
    + """, ea as (select strategy, trade_date as date, equity from (select *, row_number() over (partition by strategy, trade_date order by loaded_at desc) as rn from equity where strategy is not null and trade_date is not null) where rn = 1 and equity is not null and not isnan(equity)),
ep as (select *, max(equity) over (partition by strategy order by date) as peak from ea), es as (select strategy, arg_min(equity, date) as f, arg_max(equity, date) as l, min(date) as s, max(date) as t, min(equity / peak - 1) as dd from ep group by strategy),
tu as (select strategy, sum(turnover) / (count(ret) / 252.0) as ann_turnover, sum(cost) as total_cost from eq group by strategy),
cm as (select ag.strategy, (mean - 0.04 / 252) / sd * sqrt(252) as sharpe, sd * sqrt(252) as ann_vol, pow(l / f, 1 / ((t - s) / 365.25)) - 1 as cagr, dd as max_dd, ann_turnover, total_cost from ag join es on ag.strategy = es.strategy join tu on ag.strategy = tu.strategy)
select strategy, round(sharpe, 6) as sharpe, round(ann_vol, 6) as ann_vol, round(cagr, 6) as cagr, round(max_dd, 6) as max_dd, round(ann_turnover, 6) as ann_turnover, round(total_cost, 4) as total_cost, row_number() over (order by sharpe desc, strategy) as rank from cm"""
)
def strategy_comparison(spark, d):
    return rounded(me.comparison(strategies(spark, d)), 6, total_cost=4)
