"""Monte Carlo paths from a counter-based random source, so a result depends on the seed alone and not on partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators.covariance import matrix
from panelforge.plans.storage import spread

#: Paths drawn at once.
PATH_BLOCK = 5_000
#: Fractions of the bands.
BANDS = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Terms of the series of a logarithm, and for the strategies whose bands are found together: largest times smallest k, step times largest number, how many at most and at least.
TERMS, SPAN, STEP, TOGETHER, FEW = 6, 1.4, 0.01, 500, 2
#: More than the rounding of a sum of logarithms.
ROUNDING = 1e-13


def uniform(seed: int, *counters: Column | str, draw: int = 0) -> Column:
    """A uniform number in (0, 1) that is a function of seed, counters and draw."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in counters], F.lit(str(draw)))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(2**32))


def normal(seed: int, *counters: Column | str, draw: int = 0) -> Column:
    """A standard normal number by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(seed, *counters, draw=2 * draw))) * F.cos(2 * np.pi * uniform(seed, *counters, draw=2 * draw + 1))


def _grid(spark: SparkSession, n_paths: int, n_days: int) -> DataFrame:
    return spark.range(n_paths).withColumnRenamed("id", "path").withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(n_days))))


def paths(spark: SparkSession, mean: float, sd: float, n_paths: int = 50_000, n_days: int = 252, capital: float = 1e6, seed: int = 42) -> DataFrame:
    """``path, day, ret, equity`` of normal daily returns; equity compounds from ``capital``."""
    drawn = _grid(spark, n_paths, n_days).withColumn("ret", F.lit(mean) + F.lit(sd) * normal(seed, "path", "day"))
    w = Window.partitionBy("path").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return drawn.withColumn("equity", F.lit(capital) * F.exp(F.sum(F.log1p("ret")).over(w)))


def correlated_paths(spark: SparkSession, means: Sequence[float], cov: np.ndarray, weights: Sequence[float], n_paths: int = 50_000, n_days: int = 252, capital: float = 1e6, seed: int = 42) -> DataFrame:
    """Portfolio paths of several correlated assets; the Cholesky factor (assets by assets) enters as literals."""
    values, vectors = np.linalg.eigh(np.asarray(cov, dtype=float))
    mix = np.asarray(weights) @ (vectors * np.sqrt(np.maximum(values, 0)))
    ret = F.lit(float(np.dot(weights, means)))
    for k, m in enumerate(mix):
        ret = ret + F.lit(float(m)) * normal(seed, "path", "day", draw=k)
    w = Window.partitionBy("path").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return _grid(spark, n_paths, n_days).withColumn("ret", ret).withColumn("equity", F.lit(capital) * F.exp(F.sum(F.log1p("ret")).over(w)))


def outcomes(walked: DataFrame, capital: float) -> DataFrame:
    """``path, terminal, max_dd``; the initial capital is the first peak."""
    w = Window.partitionBy("path").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    dd = walked.withColumn("dd", F.col("equity") / F.greatest(F.max("equity").over(w), F.lit(capital)) - 1)
    return dd.groupBy("path").agg(F.max_by("equity", "day").alias("terminal"), F.least(F.min("dd"), F.lit(0.0)).alias("max_dd"))


def summary(ends: DataFrame, capital: Column | float, keys: Sequence[str] = ()) -> DataFrame:
    """Median, mean and 5th percentile of terminal wealth, chances of profit and of losing a quarter, drawdown percentiles."""
    capital = F.lit(capital) if isinstance(capital, (int, float)) else capital
    low = F.array(F.lit(0.5), F.lit(0.05))
    a = ends.groupBy(*keys).agg(
        F.percentile("terminal", low).alias("t"),
        F.percentile("max_dd", low).alias("d"),
        F.avg("terminal").alias("mean_terminal"),
        F.avg((F.col("terminal") > capital).cast("double")).alias("prob_profit"),
        F.avg((F.col("terminal") < 0.75 * capital).cast("double")).alias("prob_loss_25"),
    )
    return a.select(*keys, F.col("t")[0].alias("median_terminal"), "mean_terminal", F.col("t")[1].alias("terminal_p05"), "prob_profit", "prob_loss_25", F.col("d")[0].alias("median_max_dd"), F.col("d")[1].alias("max_dd_p05"))


def bands(walked: DataFrame, fractions: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    q = walked.groupBy("day").agg(F.percentile("equity", F.array(*[F.lit(float(q)) for q in fractions])).alias("q"))
    return q.select("day", *[F.col("q")[k].alias(f"p{int(round(f * 100)):02d}") for k, f in enumerate(fractions)])


def underwater(walked: DataFrame, capital: float, threshold: float = 0.0) -> DataFrame:
    """Longest run of days per path on which the drawdown exceeds ``threshold``."""
    w = Window.partitionBy("path").orderBy("day")
    to_date = w.rowsBetween(Window.unboundedPreceding, 0)
    under = walked.select("path", "day", (F.col("equity") / F.greatest(F.max("equity").over(to_date), F.lit(capital)) - 1 < -threshold).alias("under"))
    runs = under.withColumn("run", F.sum((~F.col("under")).cast("int")).over(to_date))
    return runs.groupBy("path", "run").agg(F.sum(F.col("under").cast("int")).alias("n")).groupBy("path").agg(F.max("n").alias("longest"))


def simulate(draw: Callable[[np.random.Generator, int], np.ndarray], n_paths: int = 50_000, capital: float = 1e6, seed: int = 42) -> np.ndarray:
    """Equity, paths by days, of the returns ``draw(rng, paths)`` gives; blocks of paths go on in one stream of numbers, so their size has no influence."""
    rng = np.random.default_rng(seed)
    return capital * np.concatenate([np.cumprod(1 + draw(rng, min(PATH_BLOCK, n_paths - a)), axis=1) for a in range(0, n_paths, PATH_BLOCK)])


def _ends(equity: np.ndarray, capital: float) -> pd.DataFrame:
    peak, dd = np.full(len(equity), capital), np.zeros(len(equity))
    for e in equity.T:
        peak = np.maximum(peak, e)
        dd = np.minimum(dd, e / peak - 1)
    return pd.DataFrame({"path": np.arange(len(equity)), "terminal": equity[:, -1], "max_dd": dd})


def _bands(equity: np.ndarray, capital: float) -> pd.DataFrame:
    return _band_rows(np.array([np.quantile(e, BANDS) for e in equity.T]))


def _band_rows(q: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame(q, columns=["p05", "p25", "p50", "p75", "p95"]).assign(day=np.arange(1, len(q) + 1))


def shocks(n_paths: int, n_days: int, seed: int) -> np.ndarray:
    """The standard normal numbers, days by paths, of which ``simulate`` draws of ``rng.normal`` are mean + deviation * number."""
    rng, z = np.random.default_rng(seed), np.empty((n_days, n_paths))
    for a in range(0, n_paths, PATH_BLOCK):
        b = min(a + PATH_BLOCK, n_paths)
        z[:, a:b] = rng.standard_normal((b - a, n_days)).T
    return z


def _bands_one(z: np.ndarray, mean: float, sd: float, capital: float) -> np.ndarray:
    """Days by fractions, from all paths."""
    growth, out = np.ones(z.shape[1]), np.empty((len(z), len(BANDS)))
    for day, row in enumerate(z):
        growth *= 1 + (mean + sd * row)
        out[day] = np.quantile(capital * growth, BANDS)
    return out


def _bands_near(z: np.ndarray, mean: np.ndarray, k: np.ndarray, capital: float) -> np.ndarray:
    """Strategies by days by fractions, for strategies whose ``k`` = deviation / (1 + mean) lie near each other.

    Equity is capital * (1 + mean)^day * exp(f) with f the sum of log(1 + k z) over the path's days, so ``k``
    alone orders the paths. With u = z / (1 + k0 z) and step = k - k0, f is the sum of log(1 + k0 z) plus the series
    step * sum(u) - step^2 / 2 * sum(u^2) + ..., to a double's precision. k0 / k * f has the order of f; less what all paths have in common
    it is within ``room`` of its value at k0, for every k here. An order statistic thus lies between those of the lower and of the upper
    bounds, and only paths whose bounds reach there are evaluated for each strategy; all others are known to be
    below or above.
    """
    at = np.array(BANDS) * (z.shape[1] - 1)
    low = at.astype(int)
    high, share = np.minimum(low + 1, z.shape[1] - 1), at - low
    k0 = (k.min() + k.max()) / 2
    step = k - k0
    tilting, bending, rest = np.abs(step / k).max(), (k0 * step**2 / (2 * k)).max(), (k0 * np.abs(step) ** 3 / (3 * k)).max()
    series = np.array([-((-step) ** n) / n for n in range(1, TERMS + 1)]).T
    base, sums, top = np.zeros(z.shape[1]), np.zeros((TERMS, z.shape[1])), 0.0
    out = np.empty((len(k), len(z), len(BANDS)))
    for day, row in enumerate(z):
        base += np.log1p(k0 * row)
        u = row / (1 + k0 * row)
        top = max(top, u.max(), -u.min())
        power = u.copy()
        for s in sums:
            s += power
            power *= u
        tilt = k0 * sums[0] - base
        room = tilting * np.abs(tilt - tilt.mean()) + bending * np.abs(sums[1] - sums[1].mean()) + rest * top / (1 - np.abs(step).max() * top) * sums[1] + ROUNDING
        lower, upper = base - room, base + room
        least, most = np.sort(lower)[low], np.sort(upper)[high]
        grown = (day + 1) * np.log1p(mean)
        for j in range(len(BANDS)):
            near = np.flatnonzero((upper >= least[j]) & (lower <= most[j]))
            ranks = np.array([low[j], high[j]]) - np.count_nonzero(upper < least[j])
            f = np.partition(base[near] + series @ sums[:, near], ranks, axis=1)[:, ranks]
            a, b = (capital * np.exp(grown[:, None] + f)).T
            out[:, day, j] = a + (b - a) * share[j]
    return out


def _strategy_bands(stats: pd.DataFrame, z: np.ndarray, capital: float) -> Iterator[tuple[str, np.ndarray]]:
    """Strategy, and days by fractions, of each row of ``strategy, mean, sd``, those of near ``k`` together."""
    widest = max(z.max(), -z.min())
    stats = stats.assign(k=stats["sd"] / (1 + stats["mean"])).sort_values("k", ignore_index=True)
    mean, k = stats["mean"].to_numpy(), stats["k"].to_numpy()
    usable, a = (np.abs(mean) <= 0.5) & (k > 0) & (k * widest <= 0.5), 0
    while a < len(stats):
        b = a + 1
        while b < len(stats) and usable[a] and usable[b] and k[b] <= SPAN * k[a] and (k[b] - k[a]) * widest <= STEP and b - a < TOGETHER:
            b += 1
        if b - a < FEW:
            for r in stats[a:b].itertuples():
                yield r.strategy, _bands_one(z, r.mean, r.sd, capital)
        else:
            yield from zip(stats["strategy"][a:b], _bands_near(z, mean[a:b], k[a:b], capital))
        a = b


def _longest(equity: np.ndarray, capital: float) -> pd.DataFrame:
    peak, run, most = np.full(len(equity), capital), np.zeros(len(equity), np.int64), np.zeros(len(equity), np.int64)
    for e in equity.T:
        peak = np.maximum(peak, e)
        run = np.where(e < peak, run + 1, 0)
        most = np.maximum(most, run)
    return pd.DataFrame({"path": np.arange(len(equity)), "longest": most})


#: What is kept of a simulation, and its columns.
KEPT = {
    "outcomes": (_ends, "path long, terminal double, max_dd double"),
    "bands": (_bands, "day int, p05 double, p25 double, p50 double, p75 double, p95 double"),
    "underwater": (_longest, "path long, longest long"),
}


def forward(series: DataFrame, keep: str, n_paths: int = 50_000, n_days: int = 252, capital: float = 1e6, seed: int = 42) -> DataFrame:
    """``outcomes``, ``bands`` or ``underwater`` of a simulation of every strategy from its own daily returns' mean and deviation.

    A strategy's paths by days are one task's matrix (100 MB by default), a size
    that does not depend on the input. All strategies have the same seed; for ``bands`` a
    task draws the numbers once and finds those of strategies of like deviation together.
    Strategies with fewer than two returns have no rows.
    """
    found, columns = KEPT[keep]
    names = ["strategy", *[c.split()[0] for c in columns.split(", ")]]
    stats = series.groupBy("strategy").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd")).where("sd is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                out = found(simulate(lambda rng, k, r=r: rng.normal(r.mean, r.sd, (k, n_days)), n_paths, capital, seed), capital)
                yield out.assign(strategy=r.strategy)[names]

    def run_bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = None
        for pdf in batches:
            if len(pdf):
                z = shocks(n_paths, n_days, seed) if z is None else z
                for strategy, q in _strategy_bands(pdf, z, capital):
                    yield _band_rows(q).assign(strategy=strategy)[names]

    if keep == "bands":
        near = stats.repartitionByRange(2 * series.sparkSession.sparkContext.defaultParallelism, "sd")
        return near.mapInPandas(run_bands, "strategy string, " + columns)
    return spread(stats, "strategy").mapInPandas(run, "strategy string, " + columns)


def forward_correlated(returns: DataFrame, keep: str, weights: dict[str, float] | None = None, n_paths: int = 50_000, n_days: int = 252, capital: float = 1e6, seed: int = 42) -> DataFrame:
    """The same of a portfolio (``weights`` by ticker, equal by default) whose assets are drawn together, with means and covariance of their ``returns``."""
    found, columns = KEPT[keep]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tickers, x = matrix(pdf)
        w = np.array([weights.get(t, 0.0) for t in tickers]) if weights else np.full(len(tickers), 1 / len(tickers))
        mean, cov = x.mean(axis=0), np.atleast_2d(np.cov(x, rowvar=False))
        return found(simulate(lambda rng, k: rng.multivariate_normal(mean, cov, (k, n_days)) @ w, n_paths, capital, seed), capital)

    return returns.select("date", "ticker", "r").withColumn("_k", F.lit(0)).groupBy("_k").applyInPandas(run, columns)
