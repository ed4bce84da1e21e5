"""Queries p1 to p6 of the training-data operators that live in the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.columns import iso, number
from panelforge.operators.asof import known_sets, returns_with_known_weights
from panelforge.operators.fill import fill_panel
from panelforge.operators.regular_grid import regular_grid, unobserved
from panelforge.operators.rolling import drawdown_cases, trailing_totals
from panelforge.operators.spikes import flag_readings
from panelforge.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    flagged = flag_readings(table(spark, d, "panel"))
    return flagged.select("ticker", iso("trade_date").alias("trade_date"), "field").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return unobserved(regular_grid(table(spark, d, "readings"), table(spark, d, "universe")))


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "readings"), table(spark, d, "universe")).drop("cadence").withColumn("n_readings", F.col("n_readings").cast("long"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    filled = fill_panel(table(spark, d, "panel"), table(spark, d, "universe"))
    return filled.where("px_method not in ('observed', 'unusable')").select("ticker", iso("trade_date").alias("trade_date"))


def p3_filled(spark: SparkSession, d: str) -> DataFrame:
    filled = fill_panel(table(spark, d, "panel"), table(spark, d, "universe"))
    return filled.select("ticker", "trade_date", F.round("px", 6).alias("px"), "px_method", F.col("px_distance").cast("long").alias("px_distance"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    sets = known_sets(table(spark, d, "equity"), table(spark, d, "weight_history"))
    return sets.where("usable is not null and usable.set_id <> hindsight.set_id").select("strategy", iso("trade_date").alias("trade_date"), "usable.set_id").distinct()


def p5_weights(spark: SparkSession, d: str) -> DataFrame:
    known = returns_with_known_weights(table(spark, d, "equity"), table(spark, d, "weight_history"))
    text = F.array_join(F.transform(F.map_entries("weights"), lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"] * 1e6).cast("long").cast("string"))), ";")
    return known.select("strategy", "trade_date", number("ret").alias("ret"), "loaded_at", "set_id", text.alias("weights")).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drawdown_cases(trailing_totals(table(spark, d, "equity")))


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    t = trailing_totals(table(spark, d, "equity"))
    return t.select("strategy", "trade_date", "window_days", *[F.round(c, 8 if c.startswith("ret") else 4).alias(c) for c in ("ret", "equity", "ret_sum", "ret_mean", "equity_sum", "equity_mean")])


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_grid, p3_found, p3_filled, p5_found, p5_weights, p6_found, p6_totals)}

_READ = """with c as (select ticker, min(cadence_min) as c from universe where cadence_min > 0 and ticker is not null group by ticker),
r as (select r.ticker, c.c, cast(floor(epoch_us(ts) / 60000000.0 / c.c) as bigint) as slot, px, volume from readings r join c on r.ticker = c.ticker where ts is not null),
a as (select ticker, c, slot, count(*) as n, max(case when px is not null and not isnan(px) then 1 else 0 end) as px, max(case when volume is not null and not isnan(volume) then 1 else 0 end) as volume from r group by ticker, c, slot),
g as (select ticker, c, unnest(range(min(slot), max(slot) + 1)) as slot from a group by ticker, c),
j as (select g.ticker, strftime(make_timestamp(g.slot * g.c * 60000000), '%Y-%m-%d %H:%M') as slot_start, coalesce(a.px, 0) as px, coalesce(a.volume, 0) as volume from g left join a on a.ticker = g.ticker and a.slot = g.slot)
"""
_DAYS = """with k as (select strategy, trade_date, ret, equity from (select *, row_number() over (partition by strategy, trade_date order by loaded_at desc) as rn from equity where strategy is not null and trade_date is not null) where rn = 1),
s as (select strategy, unnest(generate_series(min(trade_date)::timestamp, max(trade_date)::timestamp, interval 1 day))::date as d from k group by strategy),
f as (select s.strategy, s.d, k.ret, cast(coalesce(k.ret, 0) as decimal(38, 10)) as x, last_value(k.equity ignore nulls) over (partition by s.strategy order by s.d) as e from s left join k on k.strategy = s.strategy and k.trade_date = s.d),
w as (select strategy, d, 7 as window_days, coalesce(ret, 0) as ret, e as equity, sum(x) over w7 as rs, count(*) over w7 as n, sum(cast(e as decimal(38, 10))) over w7 as es, count(e) over w7 as m from f window w7 as (partition by strategy order by d rows between 6 preceding and current row)
  union all select strategy, d, 30, coalesce(ret, 0), e, sum(x) over w30, count(*) over w30, sum(cast(e as decimal(38, 10))) over w30, count(e) over w30 from f window w30 as (partition by strategy order by d rows between 29 preceding and current row))
"""

_CODES = """with v as (select ticker, trade_date, px from panel where ticker is not null and trade_date is not null),
o as (select * from v where px is not null and not isnan(px)),
l as (select ticker, median(px) as m from o where px > 0 group by ticker),
c as (select px from o left join l on o.ticker = l.ticker where px <> 0 group by px
  having count(distinct o.ticker) >= greatest(2, 0.08 * (select count(distinct ticker) from o)) and avg(case when px > 0 and greatest(px / m, m / px) <= 20 then 1.0 else 0.0 end) <= 0.2)
"""

_KNOWN = """with e as (select distinct strategy, trade_date, asof_ts from equity where strategy is not null and trade_date is not null and asof_ts is not null),
s as (select distinct strategy, set_id, reb_date, known_at from weight_history where known_at is not null and reb_date is not null and strategy is not null and set_id is not null),
b as (select e.strategy, trade_date, asof_ts, arg_max(set_id, (reb_date, known_at, set_id)) as set_id from e join s on s.strategy = e.strategy and reb_date <= trade_date and known_at <= asof_ts group by all),
h as (select strategy, set_id, string_agg(ticker || ':' || cast(cast(round(w * 1e6) as bigint) as varchar), ';' order by ticker) as weights from (select strategy, set_id, ticker, max(w) as w from weight_history where ticker is not null and w is not null group by all) group by all)
"""

ORACLE = {
    "p2_grid": """with c as (select ticker, min(cadence_min) as c from universe where cadence_min > 0 and ticker is not null group by ticker),
r as (select r.ticker, c.c, cast(floor(epoch_us(ts) / 60000000.0 / c.c) as bigint) as slot, ts, arrived_at, case when not isnan(px) then px end as px, case when not isnan(volume) then volume end as volume from readings r join c on r.ticker = c.ticker where ts is not null),
p as (select ticker, slot, px from r where px is not null qualify row_number() over (partition by ticker, slot order by ts desc, arrived_at desc nulls last, px desc) = 1),
v as (select ticker, slot, volume from r where volume is not null qualify row_number() over (partition by ticker, slot order by ts desc, arrived_at desc nulls last, volume desc) = 1),
n as (select ticker, slot, count(*) as n from r group by ticker, slot),
g as (select ticker, c, unnest(range(min(slot), max(slot) + 1)) as slot from r group by ticker, c),
j as (select g.ticker, g.c, g.slot, coalesce(n.n, 0) as n_readings, last_value(p.px ignore nulls) over w as px, last_value(v.volume ignore nulls) over w as volume,
  g.slot - last_value(p.slot ignore nulls) over w as px_age, g.slot - last_value(v.slot ignore nulls) over w as volume_age
  from g left join n on n.ticker = g.ticker and n.slot = g.slot left join p on p.ticker = g.ticker and p.slot = g.slot left join v on v.ticker = g.ticker and v.slot = g.slot window w as (partition by g.ticker order by g.slot))
select ticker, strftime(make_timestamp(slot * c * 60000000), '%Y-%m-%d %H:%M') as slot_start, n_readings, case when px_age <= 3 then px end as px, case when px_age = 0 then 'observed' when px_age <= 3 then 'filled' else 'missing' end as px_status, px_age,
case when volume_age <= 3 then volume end as volume, case when volume_age = 0 then 'observed' when volume_age <= 3 then 'filled' else 'missing' end as volume_status, volume_age from j""",
    "p3_filled": _CODES
    + """, f as (select ticker, trade_date, fetched_at, case when px is not null and not isnan(px) and px not in (select px from c) then px end as px from panel where ticker is not null and trade_date is not null),
g as (select ticker, trade_date, max(case when px is not null then 1 else 0 end) as delivered from f group by ticker, trade_date),
u as (select ticker, trade_date, px from f where px > 0 qualify row_number() over (partition by ticker, trade_date order by fetched_at desc nulls last, px desc) = 1),
k as (select ticker, max(case when trim(asset_class) <> '' then upper(trim(asset_class)) end) as kind from universe where ticker is not null group by ticker),
b as (select g.ticker, g.trade_date as d, u.px, delivered, kind from g left join u on u.ticker = g.ticker and u.trade_date = g.trade_date left join k on k.ticker = g.ticker),
w as (select *, last_value(case when px is not null then {'at': d, 'v': px} end ignore nulls) over (partition by ticker order by d) as p, first_value(case when px is not null then {'at': d, 'v': px} end ignore nulls) over (partition by ticker order by d rows between current row and unbounded following) as n from b),
r as (select kind, d, ln(px / lag(px) over (partition by ticker order by d)) as r from b where px is not null and kind is not null),
i as (select kind, d, sum(r) over (partition by kind order by d) as level from (select kind, d, avg(greatest(-0.5, least(0.5, r))) as r from r where r is not null group by kind, d)),
x as (select *, p.v as pv, n.v as nv, d - p.at as back, n.at - d as ahead, coalesce(d - p.at <= 10, false) as hb, coalesce(n.at - d <= 10, false) as ha from w),
y as (select *, case when hb and (not ha or back <= ahead) then pv when ha then nv end as near, case when hb and (not ha or back <= ahead) then p.at when ha then n.at end as near_at from x),
z as (select y.*, near * exp(h.level - m.level) as moved from y left join i h on h.kind = y.kind and h.d = y.d left join i m on m.kind = y.kind and m.d = y.near_at),
q as (select *, case when px is not null then 'observed' when delivered = 1 then 'unusable' when hb and ha then 'interpolated' when near is not null and moved is not null then 'class' when near is not null then 'carried' else 'missing' end as px_method from z)
select ticker, d as trade_date, round(case px_method when 'observed' then px when 'interpolated' then pv + (nv - pv) * back / (back + ahead) when 'class' then moved when 'carried' then near end, 6) as px, px_method,
case when px_method = 'observed' then 0 when px_method in ('interpolated', 'class', 'carried') then cast(abs(near_at - d) as bigint) end as px_distance from q""",
    "p5_weights": _KNOWN
    + """select distinct q.strategy, q.trade_date, case when not isnan(ret) then ret end as ret, loaded_at, b.set_id, h.weights from equity q left join b on b.strategy = q.strategy and b.trade_date = q.trade_date and b.asof_ts = q.asof_ts
left join h on h.strategy = q.strategy and h.set_id = b.set_id where q.strategy is not null and q.trade_date is not null""",
    "p3_found": _CODES
    + """select ticker, strftime(trade_date, '%Y-%m-%d') as trade_date from v
group by ticker, v.trade_date having max(case when px is not null and not isnan(px) and px not in (select px from c) then 1 else 0 end) = 0""",
    "p2_found": _READ + "select ticker, slot_start, 'px' as field from j where px = 0 union all select ticker, slot_start, 'volume' from j where volume = 0",
    "p5_found": """
with e as (select distinct strategy, trade_date, asof_ts from equity where strategy is not null and trade_date is not null and asof_ts is not null),
s as (select distinct strategy, set_id, reb_date, known_at from weight_history where known_at is not null and reb_date is not null and strategy is not null),
j as (select e.*, s.set_id, reb_date, known_at from e join s on s.strategy = e.strategy and reb_date <= trade_date),
b as (select strategy, trade_date, asof_ts, arg_max(set_id, (reb_date, known_at, set_id)) as h, arg_max(set_id, (reb_date, known_at, set_id)) filter (known_at <= asof_ts) as u from j group by all)
select distinct strategy, strftime(trade_date, '%Y-%m-%d') as trade_date, u as set_id from b where u is not null and u <> h""",
    "p6_found": _DAYS
    + """select strategy, strftime(d, '%Y-%m-%d') as day, window_days from w
where (window_days = 7 and round(rs, 6) <= -0.12) or (window_days = 30 and cast(es as double) / m >= 1.12 * equity)""",
    "p6_totals": _DAYS
    + """select strategy, d as trade_date, window_days, round(ret, 8) as ret, round(equity, 4) as equity, round(cast(rs as double), 8) as ret_sum, round(cast(rs as double) / n, 8) as ret_mean,
round(cast(es as double), 4) as equity_sum, round(cast(es as double) / m, 4) as equity_mean from w""",
}
