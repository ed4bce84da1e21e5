"""Portfolio weights from means and covariances (numpy; used inside grouped functions)."""

from __future__ import annotations

import numpy as np


def cap_turnover(target: np.ndarray, current: np.ndarray, most: float | None) -> np.ndarray:
    """Move from ``current`` towards ``target`` until one-way turnover reaches ``most``; never below zero."""
    if most is None:
        return target
    trade = target - current
    one_way = np.abs(trade).sum() / 2
    if one_way <= most or one_way <= 1e-10:
        return target
    return np.maximum(current + trade * (most / one_way), 0.0)


def solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of a linear system; least squares where the matrix is singular."""
    try:
        return np.linalg.solve(matrix, right)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(matrix, right, rcond=None)[0]


def kelly(mean: np.ndarray, cov: np.ndarray, rf: float = 0.04, fraction: float = 0.5, cap: float = 0.4, leverage: float = 1.5, current: np.ndarray | None = None, turnover: float | None = None) -> np.ndarray:
    """Fractional Kelly weights over the assets with positive excess return, capped, levered and turnover-limited.

    No asset with positive excess: all zero, without regard to turnover.
    """
    excess = mean - rf
    active = excess > 0
    weights = np.zeros(len(mean))
    if not active.any():
        return weights
    full = solve(cov[np.ix_(active, active)], excess[active])
    weights[active] = np.clip(fraction * full, 0.0, cap)
    total = weights.sum()
    if total > leverage:
        weights *= leverage / total
    return weights if current is None else cap_turnover(weights, current, turnover)


def equilibrium(cov: np.ndarray, market: np.ndarray, aversion: float = 2.5) -> np.ndarray:
    """Returns at which holding the market is optimal."""
    total = market.sum()
    return aversion * cov @ (market / total if total > 0 else market)


def momentum_views(returns: np.ndarray, cov: np.ndarray, lookback: int = 252, tau: float = 0.05, confidence: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """One absolute view per asset: its annualised trailing log return, and the view's variance."""
    if not 0 < confidence <= 1:
        raise ValueError("confidence lies in (0, 1]")
    window = min(lookback, len(returns))
    return returns[-window:].sum(axis=0) * (lookback / window), np.diag(cov) * tau * (1 / confidence - 1)


def posterior(cov: np.ndarray, prior: np.ndarray, views: np.ndarray, variance: np.ndarray, tau: float = 0.05, pick: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of expected returns after views with independent errors."""
    if (variance <= 0).any():
        raise ValueError("view variances are positive")
    pick = np.eye(len(prior)) if pick is None else pick
    weighted = pick.T / variance
    precision_prior = np.linalg.inv(tau * cov)
    precision = precision_prior + weighted @ pick
    spread = np.linalg.inv(precision)
    return spread @ (precision_prior @ prior + weighted @ views), spread


def black_litterman(returns: np.ndarray, cov: np.ndarray, market: np.ndarray, use_views: bool = True, tau: float = 0.05, confidence: float = 0.25) -> np.ndarray:
    """Posterior expected returns from momentum views; the equilibrium where views are off or the system is singular."""
    prior = equilibrium(cov, market)
    if not use_views:
        return prior
    views, variance = momentum_views(returns, cov, tau=tau, confidence=confidence)
    try:
        return posterior(cov, prior, views, variance, tau)[0]
    except np.linalg.LinAlgError:
        return prior


def correlation(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    out = np.clip(cov / np.outer(sd, sd), -1.0, 1.0)
    np.fill_diagonal(out, 1.0)
    return out


def linkage(distance: np.ndarray, method: str = "ward") -> np.ndarray:
    """Agglomerative clustering of a distance matrix: rows ``(a, b, distance, size)``; of equal distances the pair with the smaller numbers merges.

    Methods: ward, single, complete, average (Lance-Williams updates).
    """
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    label, size, alive = list(range(n)), [1] * n, list(range(n))
    rows = []
    for step in range(n - 1):
        sub = d[np.ix_(alive, alive)]
        i, j = divmod(int(np.argmin(np.triu(sub, 1) + np.tril(np.full_like(sub, np.inf)))), len(alive))
        a, b = alive[i], alive[j]
        gap = d[a, b]
        for k in alive:
            if k in (a, b):
                continue
            x, y = d[a, k], d[b, k]
            if method == "single":
                new = min(x, y)
            elif method == "complete":
                new = max(x, y)
            elif method == "average":
                new = (size[a] * x + size[b] * y) / (size[a] + size[b])
            elif method == "ward":
                t = size[a] + size[b] + size[k]
                new = np.sqrt(((size[a] + size[k]) * x * x + (size[b] + size[k]) * y * y - size[k] * gap * gap) / t)
            else:
                raise ValueError(f"unknown linkage method {method!r}; choose ward, single, complete or average")
            d[a, k] = d[k, a] = new
        first, second = sorted((label[a], label[b]))
        size[a] += size[b]
        label[a] = n + step
        alive.remove(b)
        rows.append((first, second, gap, size[a]))
    return np.array(rows, dtype=float).reshape(-1, 4)


def leaf_order(merges: np.ndarray, n: int) -> list[int]:
    """Leaves from left to right."""
    if n <= 1:
        return list(range(n))
    order, stack = [], [2 * n - 2]
    while stack:
        node = stack.pop()
        if node < n:
            order.append(node)
        else:
            a, b = merges[node - n, :2].astype(int)
            stack += [b, a]
    return order


def hrp(cov: np.ndarray, method: str = "ward") -> tuple[np.ndarray, np.ndarray]:
    """Hierarchical risk parity weights and the dendrogram's merges."""
    n = len(cov)
    if n < 2:
        return np.ones(n), np.zeros((0, 4))
    merges = linkage(np.sqrt(np.maximum(0.5 * (1 - correlation(cov)), 0.0)), method)

    def variance(members: list[int]) -> float:
        inner = cov[np.ix_(members, members)]
        inverse = 1 / np.maximum(np.diag(inner), 1e-300)
        share = inverse / inverse.sum()
        return max(float(share @ inner @ share), 1e-15)

    weights, todo = np.ones(n), [leaf_order(merges, n)]
    while todo:
        members = todo.pop()
        if len(members) < 2:
            continue
        left, right = members[: len(members) // 2], members[len(members) // 2 :]
        a, b = 1 / variance(left), 1 / variance(right)
        weights[left] *= a / (a + b)
        weights[right] *= b / (a + b)
        todo += [left, right]
    return weights, merges


def risk_budget(cov: np.ndarray, budgets: np.ndarray | None = None, rounds: int = 500, close: float = 1e-12) -> np.ndarray:
    """Long-only weights whose risk contributions stand in the ratio of ``budgets`` (equal by default).

    Cyclical coordinate descent on half the variance less the budget-weighted
    logarithms of the weights, which is convex; each coordinate has a closed form.
    """
    n = len(cov)
    if n < 2:
        return np.ones(n)
    b = np.full(n, 1.0 / n) if budgets is None else np.asarray(budgets, dtype=float)
    if len(b) != n or (b <= 0).any() or abs(b.sum() - 1) > 1e-6:
        raise ValueError("budgets are positive, one per asset, and sum to 1")
    x = 1 / np.sqrt(np.diag(cov))
    x /= np.sqrt(x @ cov @ x)
    for _ in range(rounds):
        last = x.copy()
        for i in range(n):
            other = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-other + np.sqrt(other * other + 4 * cov[i, i] * b[i])) / (2 * cov[i, i])
        if np.abs(x - last).max() <= close * np.abs(x).max():
            break
    return x / x.sum()


def vol_leverage(weights: np.ndarray, cov: np.ndarray, target: float = 0.10, most: float = 1.5) -> float:
    """Leverage that brings the portfolio to the target volatility, at most ``most``; 1 without variance."""
    variance = float(weights @ cov @ weights)
    return 1.0 if variance < 1e-20 else min(target / np.sqrt(variance), most)
