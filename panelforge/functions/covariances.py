"""Covariance estimators on a matrix of returns, one row a day (numpy; used inside grouped functions)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from panelforge.functions.weights import correlation


def sample(x: np.ndarray) -> np.ndarray:
    return np.atleast_2d(np.cov(x, rowvar=False))


def ledoit_wolf(x: np.ndarray) -> np.ndarray:
    """Shrinkage of the sample covariance (divisor n) towards a multiple of the identity."""
    n, p = x.shape
    c = x - x.mean(axis=0)
    s = c.T @ c / n
    mu = np.trace(s) / p
    delta = ((s**2).sum() - 2 * mu * np.trace(s) + p * mu * mu) / p
    c2 = c**2
    beta = min(((c2.T @ c2).sum() / n - (s**2).sum()) / (p * n), delta)
    shrink = 0.0 if beta <= 0 or delta <= 0 else beta / delta
    return (1 - shrink) * s + shrink * mu * np.eye(p)


def ewma(x: np.ndarray, decay: float = 0.94) -> np.ndarray:
    """Exponentially weighted covariance, unbiased for its weights."""
    if not 0 < decay < 1:
        raise ValueError("decay lies in (0, 1)")
    w = decay ** np.arange(len(x) - 1, -1, -1.0)
    total = w.sum()
    c = x - (w @ x) / total
    return (c * w[:, None]).T @ c / total * (total**2 / (total**2 - (w**2).sum()))


def mp_bounds(ratio: float, variance: float = 1.0) -> tuple[float, float]:
    """Edges of the spectrum of pure noise for ``ratio`` variables per observation."""
    root = np.sqrt(ratio)
    return variance * (1 - root) ** 2, variance * (1 + root) ** 2


def mp_density(x: np.ndarray, ratio: float, variance: float = 1.0) -> np.ndarray:
    low, high = mp_bounds(ratio, variance)
    x = np.asarray(x, dtype=float)
    inside = (x > 0) & (x >= low) & (x <= high)
    safe = np.where(inside, x, 1.0)
    return np.where(inside, np.sqrt(np.maximum((high - safe) * (safe - low), 0)) / (2 * np.pi * ratio * variance * safe), 0.0)


def denoise(corr: np.ndarray, n_obs: int, method: str = "constant_residual") -> np.ndarray:
    """A correlation matrix without the eigenvalues that noise alone explains.

    ``constant_residual`` gives noise eigenvalues their mean, ``targeted_shrinkage``
    spreads their sum over all eigenvalues.
    """
    if method not in ("constant_residual", "targeted_shrinkage"):
        raise ValueError(f"unknown method {method!r}; choose constant_residual or targeted_shrinkage")
    values, vectors = np.linalg.eigh(corr)
    noise = values <= mp_bounds(len(corr) / n_obs)[1]
    if noise.all() or not noise.any():
        return corr.copy()
    if method == "constant_residual":
        values = np.where(noise, values[noise].mean(), values)
    else:
        values = np.where(noise, 0.0, values) + values[noise].sum() / len(values)
    rebuilt = (vectors * values) @ vectors.T
    return correlation((rebuilt + rebuilt.T) / 2)


def rmt(x: np.ndarray, method: str = "constant_residual") -> np.ndarray:
    cov = sample(x)
    sd = np.sqrt(np.diag(cov))
    return denoise(correlation(cov), len(x), method) * np.outer(sd, sd)


def _kernel(grid: np.ndarray, points: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray]:
    """Epanechnikov density and its Hilbert transform at ``grid``."""
    a = (points[None, :] - grid[:, None]) / h
    density = np.where(np.abs(a) <= 1, 0.75 * (1 - a * a), 0.0).sum(axis=1) / (len(points) * h)
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = 0.75 * (2 * a + (1 - a * a) * np.log(np.abs((a + 1) / (a - 1))))
    inner = np.where(np.abs(np.abs(a) - 1) < 1e-12, 1.5 * np.sign(a), inner)
    inner = np.where(np.abs(a) < 1e-12, 0.0, inner)
    return density, inner.sum(axis=1) / (len(points) * h * np.pi)


def nonlinear(x: np.ndarray) -> np.ndarray:
    """Nonlinear shrinkage: each eigenvalue moved by a kernel estimate of the spectrum around it."""
    s = sample(x)
    n_obs, p = x.shape
    values, vectors = np.linalg.eigh(s)
    values = np.maximum(values, 0.0)
    take = min(p, n_obs)
    if take <= 1:
        return s.copy()
    used = np.sort(values)[::-1][:take]
    quartiles = np.percentile(used, [75, 25])
    spread, iqr = used.std(ddof=1), quartiles[0] - quartiles[1]
    h = max(0.9 * (min(spread, iqr / 1.34) if iqr > 0 else spread) * take**-0.2, 1e-6 * max(used[0], 1e-10))
    c = p / n_obs
    f, hilbert = _kernel(values, used, h)
    shrunk = values / np.maximum((1 - c - c * values * hilbert) ** 2 + (c * values * np.pi * f) ** 2, 1e-15)
    return (vectors * shrunk) @ vectors.T


def garch_variance(r: np.ndarray) -> tuple[np.ndarray, bool]:
    """Conditional variance of a GARCH(1,1) without mean, by maximum likelihood; True where the EWMA stand-in had to be used.

    Variance targeting leaves two parameters: a coarse grid, then shrinking
    coordinate steps. All grid points are filtered at once.
    """
    x = 100 * r
    v = float(np.var(x))
    if not np.isfinite(v) or v <= 0 or len(x) < 20:
        return ewma_variance(r), True

    def filtered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = np.empty((len(x), len(a)))
        h[0] = v
        for t in range(1, len(x)):
            h[t] = (1 - a - b) * v + a * x[t - 1] ** 2 + b * h[t - 1]
        return h

    def cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = np.maximum(filtered(a, b), 1e-12)
        return (np.log(h) + (x**2)[:, None] / h).sum(axis=0)

    ga, gb = (g.ravel() for g in np.meshgrid(np.linspace(0.01, 0.25, 9), np.linspace(0.5, 0.98, 13)))
    ok = ga + gb < 0.999
    ga, gb = ga[ok], gb[ok]
    k = int(np.argmin(cost(ga, gb)))
    a, b, step = ga[k], gb[k], 0.03
    for _ in range(6):
        ca = np.clip(a + step * np.array([0, -1, 1, 0, 0, -1, 1]), 1e-4, 0.6)
        cb = np.clip(b + step * np.array([0, 0, 0, -1, 1, 1, -1]), 0.0, 0.998)
        ok = ca + cb < 0.9995
        ca, cb = ca[ok], cb[ok]
        k = int(np.argmin(cost(ca, cb)))
        a, b, step = ca[k], cb[k], step / (2 if k == 0 else 1)
    h = filtered(np.array([a]), np.array([b]))[:, 0] / 1e4
    return (h, False) if np.isfinite(h).all() and (h > 0).all() else (ewma_variance(r), True)


def ewma_variance(r: np.ndarray, decay: float = 0.94) -> np.ndarray:
    out, num, den = np.empty(len(r)), 0.0, 0.0
    for t, v in enumerate(r):
        num, den = decay * num + v * v, decay * den + 1
        out[t] = max(num / den, 1e-16)
    return out


def dcc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
    """Dynamic conditional correlation: (covariance of the last day, correlation per day, facts).

    One filter pass per grid cell, all cells side by side.
    """
    t_len, n = x.shape
    fitted = [garch_variance(x[:, i]) for i in range(n)]
    sd = np.sqrt(np.stack([f[0] for f in fitted], axis=1))
    e = np.nan_to_num(x / sd, nan=0.0, posinf=0.0, neginf=0.0)
    base = np.nan_to_num(np.atleast_2d(np.corrcoef(e, rowvar=False)), nan=0.0)
    np.fill_diagonal(base, 1.0)
    grid_a, grid_b = (g.ravel() for g in np.meshgrid(np.arange(0.005, 0.15, 0.01), np.arange(0.80, 0.995, 0.01)))
    ok = grid_a + grid_b < 1
    grid_a, grid_b = grid_a[ok], grid_b[ok]

    def walk(a: np.ndarray, b: np.ndarray):
        q = np.repeat(base[None], len(a), axis=0)
        a, b = a[:, None, None], b[:, None, None]
        for t in range(t_len):
            if t:
                q = (1 - a - b) * base + a * np.outer(e[t - 1], e[t - 1]) + b * q
            d = np.sqrt(np.maximum(np.einsum("kii->ki", q), 1e-12))
            yield q / (d[:, :, None] * d[:, None, :])

    cost = np.zeros(len(grid_a))
    for t, r in enumerate(walk(grid_a, grid_b)):
        sign, logdet = np.linalg.slogdet(r)
        quad = np.einsum("i,ki->k", e[t], np.linalg.solve(r + 1e-10 * np.eye(n), np.repeat(e[t][None, :, None], len(r), axis=0))[..., 0])
        cost += np.where(sign > 0, logdet + quad, np.inf)
    k = int(np.argmin(cost)) if np.isfinite(cost).any() else -1
    a, b = (grid_a[k], grid_b[k]) if k >= 0 else (0.01, 0.95)
    path = np.concatenate(list(walk(np.array([a]), np.array([b]))))
    last = path[-1] * np.outer(sd[-1], sd[-1])
    return last, path, {"a": float(a), "b": float(b), "fallback": [i for i, f in enumerate(fitted) if f[1]]}


ESTIMATORS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "sample": sample,
    "ledoit_wolf": ledoit_wolf,
    "ewma": ewma,
    "rmt_denoised": rmt,
    "ledoit_wolf_nonlinear": nonlinear,
    "dcc_garch": lambda x: dcc(x)[0],
}


def estimator(name: str) -> Callable[[np.ndarray], np.ndarray]:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name!r}; choose one of {', '.join(ESTIMATORS)}")
    return ESTIMATORS[name]


def diagnostics(cov: np.ndarray) -> dict[str, float]:
    values = np.linalg.eigvalsh(cov)
    return {"trace": float(np.trace(cov)), "frobenius": float(np.linalg.norm(cov)), "condition": float(np.linalg.cond(cov)), "min_eig": float(values[0]), "max_eig": float(values[-1])}
