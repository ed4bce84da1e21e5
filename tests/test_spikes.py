import datetime as dt
import math

import numpy as np
import pytest

from panelforge.operators import spikes
from panelforge.operators.nodata import no_data_codes
from panelforge.operators.spikes import decompose, esd_limits, excursion_limits, flag_readings, stuck_values

PANEL = "trade_date date, ticker string, px double, volume double, fetched_at timestamp, day int, block int, reason string"
START = dt.date(2020, 1, 1)


def series(n=300, seed=3):
    rng = np.random.default_rng(seed)
    return np.round(50 * np.exp(np.cumsum(rng.normal(0, 0.01, n))), 4), np.round(1e6 * np.exp(rng.normal(0, 0.3, n)))


def rows_of(ticker, px, volume, start=START):
    out = []
    for i, (p, v) in enumerate(zip(px, volume, strict=True)):
        day = start + dt.timedelta(days=i)
        out.append((day, ticker, p, v, dt.datetime.combine(day, dt.time(22)), 7, 7, "clash"))
    return out


def found(spark, rows):
    got = flag_readings(spark.createDataFrame(rows, PANEL)).collect()
    return {(r.ticker, (r.trade_date - START).days, r.field, r.reason) for r in got}


def planted():
    px, volume = (list(map(float, x)) for x in series())
    want = set()
    px[40] *= 1.4
    want.add(("A", 40, "px", "spike"))
    for i in (80, 81, 82):
        px[i] *= 0.6
        want.add(("A", i, "px", "spike"))
    px[110:] = [p * 1.5 for p in px[110:]]  # a level that lasts
    for i in range(130, 137):
        px[i] = px[129]
        want.add(("A", i, "px", "stuck"))
    px[150] = px[149]  # a single repeat
    volume[60] *= 100
    want.add(("A", 60, "volume", "spike"))
    for i, f in zip(range(170, 178), (40, 26, 17, 11, 7, 5, 3, 2), strict=True):
        volume[i] *= f  # dies down
    for i in range(200, 209):
        volume[i], px[i] = 0.0, px[199]  # nothing traded
    px[220], volume[230] = -3.0, -5.0
    want |= {("A", 220, "px", "impossible"), ("A", 230, "volume", "impossible")}
    px[240], volume[241], px[242] = None, None, float("nan")
    return px, volume, want


def test_planted_cases_and_near_misses(spark):
    px, volume, want = planted()
    rows = rows_of("A", px, volume)
    rows += rows[:20] + [(START + dt.timedelta(days=40), "A", round(px[39], 4), volume[40], dt.datetime(2021, 1, 1), 0, 0, "")]  # repeats, a corrected row
    rows += [(None, "A", 1.0, 1.0, None, 0, 0, ""), (START, None, 1.0, 1.0, None, 0, 0, "")]
    assert found(spark, rows) == want


def test_blocks_do_not_matter(spark, monkeypatch):
    px, volume, want = planted()
    monkeypatch.setattr(spikes, "BLOCK_DAYS", 64)
    monkeypatch.setattr(spikes, "HALO_DAYS", 60)
    assert found(spark, rows_of("A", px, volume)) == want


def test_codes_are_not_readings(spark):
    rows = []
    for k in range(6):
        px, volume = (list(map(float, x)) for x in series(seed=k))
        px[50] = px[51] = px[52] = 999999.0
        px[90] = -99.99
        rows += rows_of(f"T{k}", px, volume)
    assert {r.code for r in no_data_codes(spark.createDataFrame(rows, PANEL)).collect()} == {999999.0, -99.99}
    assert found(spark, rows) == set()


def test_empty_and_short(spark):
    assert found(spark, rows_of("A", [5.0, None, 500.0], [1.0, 1.0, None])) == set()
    assert flag_readings(spark.createDataFrame([], PANEL)).count() == 0


def plain_esd(x, alpha=0.01, most=0.2):
    """The test as published: mean and deviation anew after each removal; which positions are outliers."""
    left, removed, last = list(range(len(x))), [], 0
    k = max(1, int(most * len(x)))
    critical = spikes.esd_critical(len(x), k, alpha)
    for i in range(k):
        v = x[left]
        far = int(np.argmax(np.abs(v - v.mean())))
        if np.abs(v[far] - v.mean()) / v.std(ddof=1) > critical[i]:
            last = i + 1
        removed.append(left.pop(far))
    return set(removed[:last])


def test_esd_equals_the_plain_test():
    rng = np.random.default_rng(0)
    for spikes_at in ((), (30, -25, 28), (9, 9.5, 10, 10.5, -11, 40, 400)):
        x = np.concatenate([rng.normal(0, 1, 300), spikes_at])
        low, high = esd_limits(x)
        assert set(np.nonzero((x < low) | (x > high))[0]) == plain_esd(x)
    assert esd_limits(np.zeros(3)) == (-math.inf, math.inf)
    assert abs(spikes.esd_critical(54, 1, 0.05)[0] - 3.158) < 0.01  # published for 54 values


def test_a_season_is_no_spike_and_the_limit_decides(spark, monkeypatch):
    """Thirty-fold volume every Monday is beyond both sides, but no outlier of the decomposition; without the ESD limits it would be flagged."""
    px, volume = (list(map(float, x)) for x in series())
    monday = [(START + dt.timedelta(days=i)).weekday() == 0 for i in range(len(px))]
    volume = [v * 60.0 if m else v for v, m in zip(volume, monday, strict=True)]
    volume[101] *= 1000
    assert not monday[101]
    assert found(spark, rows_of("A", px, volume)) == {("A", 101, "volume", "spike")}
    monkeypatch.setattr(spikes, "esd_limits", lambda residual: (math.inf, -math.inf))
    x = np.log(volume)
    day = np.arange(len(x))
    low, high = spikes._limits_of(day, np.array(volume), math.log(25), 8.0)
    assert ((np.exp(x) > high) & monday).sum() > 20
    assert np.abs((x - decompose(x, np.array([(START + dt.timedelta(days=i)).weekday() for i in range(len(x))])))[monday]).max() < 2


def test_excursions_of_four_bars_are_a_level():
    x = np.zeros(40)
    x[10:14] = 5
    low, high = excursion_limits(x, 1.0)
    assert not ((x > high) | (x < low)).any()
    x[13] = 0
    x[:2] = x[-2:] = -7  # no level on one side
    low, high = excursion_limits(x, 1.0)
    assert list(np.nonzero(x > high)[0]) == [10, 11, 12]


@pytest.mark.parametrize("other,n", [(np.arange(12.0), 7), (np.zeros(12), 0)])
def test_stuck_needs_the_other_field_to_move(other, n):
    x = np.array([1, 2, 3, 3, 3, np.nan, 3, 3, 3, 3, 3, 4.0])
    assert np.isfinite(stuck_values(x, other, 6)).sum() == n
