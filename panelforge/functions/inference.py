"""Hidden Markov regimes, least squares with robust errors, Sharpe-ratio tests (numpy)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()
EULER = 0.5772156649015329


def sharpe_se(sharpe: float, n: int, skew: float, excess_kurtosis: float) -> float:
    """Standard error of a per-period Sharpe ratio; 0 if it cannot be had."""
    if n < 2:
        return 0.0
    inner = (1 - skew * sharpe + (excess_kurtosis + 2) / 4 * sharpe**2) / (n - 1)
    return math.sqrt(inner) if inner >= 0 else 0.0


def probabilistic_sharpe(sharpe: float, benchmark: float, se: float) -> float:
    return 0.5 if se == 0 else NORMAL.cdf((sharpe - benchmark) / se)


def expected_best(trials: int, se: float) -> float:
    """Expected maximum of ``trials`` Sharpe ratios of no merit."""
    if trials <= 1:
        return 0.0
    return se * ((1 - EULER) * NORMAL.inv_cdf(1 - 1 / trials) + EULER * NORMAL.inv_cdf(1 - 1 / (trials * math.e)))


def minimum_length(sharpe: float, skew: float, excess_kurtosis: float, alpha: float = 0.05) -> float:
    """Periods until a per-period Sharpe ratio is significant; infinite for 0."""
    if sharpe == 0:
        return math.inf
    return 1 + (1 - skew * sharpe + (excess_kurtosis + 2) / 4 * sharpe**2) * (NORMAL.inv_cdf(1 - alpha) / sharpe) ** 2


class GaussianHmm:
    """Gaussian hidden Markov model with full covariances, by expectation-maximisation with scaled passes."""

    def __init__(self, states: int, rounds: int = 100, close: float = 1e-4):
        self.k, self.rounds, self.close = states, rounds, close

    def _start(self, x: np.ndarray) -> None:
        order = np.argsort(x[:, -1], kind="stable")
        parts = np.array_split(order, self.k)
        self.means = np.stack([x[p].mean(axis=0) for p in parts])
        common = np.cov(x, rowvar=False) + 1e-3 * np.eye(x.shape[1])
        self.covs = np.repeat(common[None], self.k, axis=0)
        self.start = np.full(self.k, 1 / self.k)
        self.trans = np.full((self.k, self.k), 0.1 / max(1, self.k - 1))
        np.fill_diagonal(self.trans, 0.9)

    def _log_emission(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.k))
        for j in range(self.k):
            c = self.covs[j]
            d = x - self.means[j]
            out[:, j] = -0.5 * (np.einsum("ti,ij,tj->t", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1] + x.shape[1] * math.log(2 * math.pi))
        return out

    def _passes(self, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        log_e = self._log_emission(x)
        top = log_e.max(axis=1, keepdims=True)
        e = np.exp(log_e - top)
        n = len(x)
        alpha, scale = np.empty((n, self.k)), np.empty(n)
        a = self.start * e[0]
        for t in range(n):
            if t:
                a = (alpha[t - 1] @ self.trans) * e[t]
            scale[t] = max(a.sum(), 1e-300)
            alpha[t] = a / scale[t]
        beta, pairs = np.ones(self.k), np.zeros((self.k, self.k))
        gamma = np.empty((n, self.k))
        gamma[-1] = alpha[-1]
        for t in range(n - 2, -1, -1):
            w = e[t + 1] * beta / scale[t + 1]
            pairs += np.outer(alpha[t], w) * self.trans
            beta = self.trans @ w
            gamma[t] = alpha[t] * beta
        return float(np.log(scale).sum() + top.sum()), gamma, pairs

    def fit(self, x: np.ndarray) -> GaussianHmm:
        self._start(x)
        last = -math.inf
        for _ in range(self.rounds):
            self.loglik, gamma, pairs = self._passes(x)
            self.start = gamma[0] / gamma[0].sum()
            self.trans = (pairs + 1e-10) / (pairs + 1e-10).sum(axis=1, keepdims=True)
            weight = gamma.sum(axis=0) + 1e-10
            self.means = gamma.T @ x / weight[:, None]
            for j in range(self.k):
                d = x - self.means[j]
                self.covs[j] = (d * gamma[:, j : j + 1]).T @ d / weight[j] + 1e-6 * np.eye(x.shape[1])
            if self.loglik - last < self.close:
                break
            last = self.loglik
        return self

    def bic(self, x: np.ndarray) -> float:
        k, d = self.k, x.shape[1]
        free = (k - 1) + k * (k - 1) + k * d + k * d * (d + 1) // 2
        return -2 * self.loglik + free * math.log(len(x))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most likely path of states."""
        with np.errstate(divide="ignore"):
            log_t, score = np.log(self.trans), np.log(self.start)
        log_e = self._log_emission(x)
        back = np.zeros((len(x), self.k), dtype=int)
        score = score + log_e[0]
        for t in range(1, len(x)):
            step = score[:, None] + log_t
            back[t] = step.argmax(axis=0)
            score = step.max(axis=0) + log_e[t]
        path = [int(score.argmax())]
        for t in range(len(x) - 1, 0, -1):
            path.append(int(back[t, path[-1]]))
        return np.array(path[::-1])


def regimes(returns: np.ndarray, window: int = 20) -> tuple[np.ndarray, np.ndarray, list[str], dict]:
    """(positions, state per position, labels by state, facts) of the better of two and three states; states ordered by mean volatility."""
    n = len(returns)
    if n < window + 10:
        raise ValueError("too few returns for regimes")
    view = np.lib.stride_tricks.sliding_window_view(returns, window)
    vol = view.std(axis=1, ddof=1) * math.sqrt(252)
    raw = np.stack([returns[window - 1 :], vol], axis=1)
    sd = raw.std(axis=0)
    x = (raw - raw.mean(axis=0)) / np.where(sd < 1e-10, 1.0, sd)
    fits = [GaussianHmm(k).fit(x) for k in (2, 3)]
    best = fits[0] if fits[0].bic(x) <= fits[1].bic(x) else fits[1]
    path = best.decode(x)
    level = [raw[path == j, 1].mean() if (path == j).any() else math.inf for j in range(best.k)]
    order = np.argsort(level, kind="stable")
    rank = np.empty(best.k, dtype=int)
    rank[order] = np.arange(best.k)
    labels = ["low_vol", "high_vol"] if best.k == 2 else ["low_vol", "mid_vol", "high_vol"]
    return np.arange(window - 1, n), rank[path], labels, {"transition": best.trans[np.ix_(order, order)], "means": best.means[order], "bic": best.bic(x)}


def ols(y: np.ndarray, x: np.ndarray, lags: int | None = None) -> dict:
    """Least squares of ``y`` on ``x`` (with its constant); Newey-West errors for ``lags``, else classical ones."""
    n, k = x.shape
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ (x.T @ y)
    e = y - x @ beta
    if lags is None:
        cov = inverse * (e @ e) / max(1, n - k)
    else:
        xe = x * e[:, None]
        meat = xe.T @ xe
        for lag in range(1, lags + 1):
            g = xe[lag:].T @ xe[:-lag]
            meat += (1 - lag / (lags + 1)) * (g + g.T)
        cov = inverse @ meat @ inverse
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    t = np.divide(beta, se, out=np.zeros_like(beta), where=se > 0)
    spread = ((y - y.mean()) ** 2).sum()
    return {"beta": beta, "se": se, "t": t, "p": np.array([2 * (1 - NORMAL.cdf(abs(v))) for v in t]), "r2": 1 - (e @ e) / spread if spread > 0 else 0.0, "residual": e, "n": n}
