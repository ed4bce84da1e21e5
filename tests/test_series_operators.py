"""Grid, filling, as-of and rolling totals against brute force, and their edge cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import regular_grid as rg
from panelforge.operators import rolling as ro
from panelforge.operators.asof import known_sets, returns_with_known_weights
from panelforge.operators.fill import fill_panel, fill_series
from panelforge.operators.rolling import trailing_totals

READ = "ticker string, ts timestamp_ntz, px double, volume double, arrived_at timestamp_ntz, slot string, cadence string"
UNI = "ticker string, cadence_min int, asset_class string, px double"
EQ = "strategy string, trade_date date, equity double, ret double, turnover double, cost double, asof_ts timestamp_ntz, loaded_at timestamp_ntz, block int, at int"
WH = "set_id long, strategy string, reb_date date, known_at timestamp_ntz, ticker string, w double, header int"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(rg, "BLOCK", 7)
    monkeypatch.setattr(ro, "BLOCK_DAYS", 11)


def test_grid(spark, small_blocks):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    rows = [("A", at(3), 1.0, 5.0, at(3)), ("A", at(4), float("nan"), 6.0, at(4)), ("A", at(31), 2.0, None, at(40)), ("A", at(31), 2.0, None, at(40)), ("A", at(200), None, None, at(200)), ("A", None, 1.0, 1.0, None), (None, at(1), 1.0, 1.0, None), ("B", at(1), 1.0, 1.0, at(1))]
    readings = spark.createDataFrame([(*r, "x", "y") for r in rows], READ)
    universe = spark.createDataFrame([("A", 15, "bond", 1.0), ("A", 15, "bond", 1.0), ("B", None, "bond", 0.0), (None, 5, None, None)], UNI)
    g = rg.regular_grid(readings, universe, max_gap=2).toPandas().sort_values("slot_start").reset_index(drop=True)
    assert len(g) == 14 and set(g.ticker) == {"A"}
    assert list(g.px_status[:6]) == ["observed", "filled", "observed", "filled", "filled", "missing"]
    assert list(g.volume_status[:4]) == ["observed", "filled", "filled", "missing"]
    assert g.volume[0] == 6.0 and g.px[2] == 2.0 and np.isnan(g.px[5]) and g.slot_start[1] == "2024-01-01 00:15"
    assert rg.unobserved(rg.regular_grid(readings, universe)).count() == 12 + 13
    assert rg.regular_grid(readings.limit(0), universe).count() == 0 and rg.regular_grid(readings, universe.limit(0)).count() == 0


def test_fill_series(spark):
    df = spark.createDataFrame([("A", 1, 10.0, "x"), ("A", 2, None, None), ("A", 3, float("nan"), None), ("A", 4, 16.0, None), ("A", 5, None, "y"), ("A", 90, None, None), (None, 1, 1.0, "z")], "e string, d int, v double, c string")
    out = fill_series(df, "e", "d", ["v"], ["c"], max_gap=5).toPandas().set_index("d").sort_index()
    assert len(out) == 6
    assert list(out.v[[1, 2, 3, 4]]) == [10, 12, 14, 16] and np.isnan(out.v[5])
    assert list(out.v_method) == ["observed", "interpolated", "interpolated", "observed", "missing", "missing"]
    assert list(out.c[[1, 2, 3, 4, 5]]) == ["x", "x", "x", "x", "y"] and out.c_method[90] == "missing" and out.c_distance[4] == 3
    assert fill_series(df.limit(0), "e", "d", ["v"], ["c"]).count() == 0


def test_fill_panel(spark):
    d0, schema = dt.date(2020, 1, 1), "trade_date date, ticker string, px double, volume double, fetched_at timestamp, day int, near int"
    rows = []
    for t, k in (("A", 1.0), ("B", 2.0), ("C", 3.0)):
        for i in range(30):
            px = k * 10 * 1.01**i
            if (t, i) in {("A", 5), ("A", 29)}:
                px = None
            if i == 12:
                px = 999999.0
            rows.append((d0 + dt.timedelta(days=i), t, px, 1.0, dt.datetime(2020, 3, 1), 0, 0))
    rows += [(d0 + dt.timedelta(days=12), "B", 22.0, 1.0, dt.datetime(2020, 4, 1), 0, 0), (d0 + dt.timedelta(days=30), "C", -1.0, 1.0, None, 0, 0), (None, "A", 1.0, 1.0, None, 0, 0)]
    universe = spark.createDataFrame([("A", 5, " Bond", None), ("B", 5, "BOND", None), ("C", 5, None, None)], UNI)
    got = fill_panel(spark.createDataFrame(rows, schema), universe).toPandas()
    by = {(r.ticker, (r.trade_date - d0).days): r for r in got.itertuples()}
    assert len(got) == 91
    assert by["A", 5].px_method == "interpolated" and abs(by["A", 5].px - 10 * (1.01**4 + 1.01**6) / 2) < 1e-9
    assert by["A", 12].px_method == "interpolated" and by["B", 12].px_method == "observed" and by["B", 12].px == 22.0
    assert by["A", 29].px_method == "class" and abs(by["A", 29].px - 10 * 1.01**29) < 1e-6
    assert by["C", 30].px_method == "unusable" and np.isnan(by["C", 30].px)
    assert fill_panel(spark.createDataFrame([], schema), universe).count() == 0


def test_class_returns_cross_blocks(spark):
    d0, schema = dt.date(1970, 1, 1) + dt.timedelta(days=256 * 72 - 9), "trade_date date, ticker string, px double, volume double, fetched_at timestamp, day int, near int"
    rows = [(d0 + dt.timedelta(days=i), t, None if (t, i) in {("A", 9), ("C", 9), ("C", 10), ("C", 11)} else k * 1.01**i, 1.0, dt.datetime(2021, 1, 1), 0, 0) for t, k, n in (("A", 10.0, 10), ("B", 20.0, 20), ("C", 30.0, 12)) for i in range(n)]
    universe = spark.createDataFrame([(t, 5, "bond", None) for t in "ABC"], UNI)
    by = {(r.ticker, (r.trade_date - d0).days): r for r in fill_panel(spark.createDataFrame(rows, schema), universe).collect()}
    assert by["A", 9].px_method == "class" and abs(by["A", 9].px - 10 * 1.01**9) < 1e-9
    assert by["C", 11].px_method == "class" and abs(by["C", 11].px - 30 * 1.01**11) < 1e-9


def test_known_sets_against_brute_force(spark):
    rng = np.random.default_rng(5)
    d0 = dt.datetime(2021, 1, 1)
    events = [(s, (d0 + dt.timedelta(days=int(k))).date(), 1.0, 0.1, 0.0, 0.0, d0 + dt.timedelta(days=int(k), hours=21), d0 + dt.timedelta(days=int(k), hours=22), 1, 1) for s in ("hot", "b") for k in rng.choice(200, 90, replace=False)]
    events += events[:5] + [(None, d0.date(), 1.0, 1.0, 0.0, 0.0, d0, d0, 1, 1), ("hot", None, 1.0, 1.0, 0.0, 0.0, d0, d0, 1, 1)]
    sets = []
    for k in range(80):
        reb = d0 + dt.timedelta(days=int(rng.integers(-5, 200)))
        known = None if k % 13 == 0 else reb + dt.timedelta(hours=int(rng.integers(-200, 400)))
        if k % 11 == 0:
            known = reb + dt.timedelta(hours=21)  # the very moment of an event
        s = rng.choice(["hot", "b"])
        sets += [(k, s, reb.date(), known, t, float(w), 1) for t, w in (("X", 0.5), ("Y", 0.4), ("X", 0.5))]
    e, w = spark.createDataFrame(events, EQ), spark.createDataFrame(sets + [(9, None, None, None, None, None, 1)], WH)
    got = {(r.strategy, r.trade_date): (r.usable and r.usable.set_id, r.hindsight and r.hindsight.set_id) for r in known_sets(e, w).collect()}
    headers = {(k, s, reb, known) for k, s, reb, known, *_ in sets if known}
    want = {}
    for s, day, *_, asof, _l, _b, _a in events:
        if s and day:
            can = [h for h in headers if h[1] == s and h[2] <= day]
            best = lambda hs: max(hs, key=lambda h: (h[2], h[3], h[0]))[0] if hs else None
            want[s, day] = (best([h for h in can if h[3] <= asof]), best(can))
    assert got == want and any(a != b for a, b in want.values())
    full = returns_with_known_weights(e, w).collect()
    assert len(full) == 180 and all((r.weights == {"X": 0.5, "Y": 0.4}) == (r.set_id is not None) for r in full)
    assert known_sets(e.limit(0), w).count() == 0 and known_sets(e, w.limit(0)).where("usable is not null").count() == 0


def test_trailing_totals(spark, small_blocks):
    rng = np.random.default_rng(2)
    d0, rows, brute = dt.date(2021, 1, 1), [], {}
    for s in ("hot", "b"):
        days = sorted(rng.choice(120, 60, replace=False))
        for k in days:
            r, q = (None if rng.random() < 0.1 else float(np.round(rng.normal(0, 0.02), 6))), (None if rng.random() < 0.1 else float(np.round(100 + rng.normal(), 2)))
            day = d0 + dt.timedelta(days=int(k))
            rows.append((s, day, q, r, 0.0, 0.0, None, dt.datetime(2022, 1, 2), 1, 1))
            if rng.random() < 0.2:
                rows.append((s, day, 1.0, 9.0, 0.0, 0.0, None, dt.datetime(2022, 1, 1), 1, 1))
            brute[s, day] = (r, q)
    rows += rows[:3] + [(None, d0, 1.0, 1.0, 0.0, 0.0, None, None, 1, 1), ("hot", None, 1.0, 1.0, 0.0, 0.0, None, None, 1, 1)]
    e = spark.createDataFrame(rows, EQ)
    got = trailing_totals(e).toPandas()
    n = 0
    for s in ("hot", "b"):
        f = pd.DataFrame([(k[1], *v) for k, v in brute.items() if k[0] == s], columns=["d", "r", "q"]).set_index("d").sort_index()
        f = f.reindex(pd.date_range(f.index.min(), f.index.max()).date).astype(float)
        r, q = f.r.fillna(0), f.q.ffill()
        for w in (7, 30):
            g = got[(got.strategy == s) & (got.window_days == w)].sort_values("trade_date")
            np.testing.assert_allclose(g.ret_sum.to_numpy(float), r.rolling(w, min_periods=1).sum(), atol=1e-12)
            np.testing.assert_allclose(g.equity_mean.to_numpy(float), q.rolling(w, min_periods=1).mean(), rtol=1e-12)
            n += len(g)
    assert n == len(got)
    assert trailing_totals(e.limit(0)).count() == 0
