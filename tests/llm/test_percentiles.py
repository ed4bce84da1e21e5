import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from panelforge.llm.percentiles import combine, group_percentiles, partial, percentiles, sorted_runs

SCHEMA = "run long, path long, v double, u double, metric string, place long, `group` string"
Q = [0.0, 0.05, 0.5, 0.731, 1.0]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "g") for r in rows], SCHEMA)


def brute(rows, col):
    seen = {(r[0], r[1], r[col]) for r in rows if r[0] is not None and r[1] is not None and r[col] is not None and not np.isnan(r[col])}
    by = pd.DataFrame(seen, columns=["run", "path", "v"]).groupby("run").v
    return {(k, q): np.percentile(g, 100 * q) for k, g in by for q in Q}


def test_skew_ties_repeats_and_gaps(spark):
    rng = np.random.default_rng(0)
    rows = []
    for run, n in ((1, 4000), (2, 50), (3, 1), (None, 5)):
        rows += [(run, k, float(np.round(rng.normal(), 1)), float(rng.normal())) for k in range(n)]
    rows += rows[:500] + [(2, 99, None, float("nan")), (2, None, 1.0, 1.0), (4, 1, None, None)]
    got = group_percentiles(frame(spark, rows), "run", "path", {"v": Q, "u": Q[:3]}).collect()
    for metric, col, qs in (("v", 2, Q), ("u", 3, Q[:3])):
        want = {k: x for k, x in brute(rows, col).items() if k[1] in qs}
        have = {(r.run, r.fraction): r.value for r in got if r.metric == metric}
        assert have.keys() == want.keys()
        for k, x in want.items():
            assert abs(have[k] - x) < 1e-12
    assert {r.n for r in got if r.run == 1} == {4000}


def test_partial_results_combine(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k % 3), k, float(rng.normal()), 0.0) for k in range(900)]
    days = [rows[:400], rows[300:700], rows[650:]]
    parts = [partial(frame(spark, d), "run", "path", ["v"]) for d in days]
    for order in ([0, 1, 2], [2, 0, 1]):
        got = percentiles(sorted_runs(combine([parts[i] for i in order])), {0: [0.25]}).collect()
        for r in got:
            assert abs(r.value - np.percentile([x[2] for x in rows if x[0] == r.group], 25)) < 1e-12


def test_empty(spark):
    assert group_percentiles(frame(spark, []), "run", "path", {"v": [0.5]}).count() == 0


@pytest.mark.parametrize("limit", [0, 500_000])
def test_beyond_the_broadcast_bound(spark, monkeypatch, limit):
    from panelforge.llm import percentiles as p

    monkeypatch.setattr(p, "BROADCAST_TARGETS", limit)
    rows = [(1, k, float(k), 0.0) for k in range(100)]
    assert group_percentiles(frame(spark, rows), "run", "path", {"v": [0.5]}).first().value == 49.5


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 30), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_any_rows(spark, rows):
    rows = [(a, b, c, 0.0) for a, b, c in rows]
    got = {(r.run, r.fraction): r.value for r in group_percentiles(frame(spark, rows), "run", "path", {"v": Q}).collect()}
    for k, x in brute(rows, 2).items():
        assert abs(got[k] - x) <= 1e-9 * max(1, abs(x))
