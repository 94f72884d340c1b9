"""Plain numpy versions of fitted models, for small fixtures."""

from __future__ import annotations

import numpy as np


def _fit(y: np.ndarray, lags: list[int], start: int) -> tuple[np.ndarray, float]:
    """Least-squares autoregression on y[start:] and its corrected information criterion."""
    x, t = np.column_stack([np.ones(len(y) - start)] + [y[start - k:len(y) - k] for k in lags]), y[start:]
    n, k = x.shape
    if n <= k + 1:
        raise ValueError("history too short")
    coef = np.linalg.lstsq(x, t, rcond=None)[0]
    rss = float(np.sum((t - x @ coef) ** 2))
    p = k + 1
    score = n * np.log(max(rss, 1e-12) / n) + 2 * p
    return coef, score + (2 * p * (p + 1) / (n - p - 1) if n > p + 1 else np.inf)


def _choose(y: np.ndarray, order: int, seasons: tuple[int, ...]) -> tuple[np.ndarray, list[int], int]:
    """Coefficients, lags and season of lowest criterion.

    All candidates are scored on the rows that the longest one leaves, so that criteria can be compared; the chosen one is then fitted
    on all rows it has. A season of a year needs two years; any other one is left out only where its lag leaves too few rows to fit.
    """
    base = list(range(1, order + 1))
    open_ = {0: base} | {s: sorted({*base, s}) for s in seasons if len(y) - max(s, order) > len({*base, s}) + 2 and (s < 52 or len(y) >= 104)}
    start = max(max(lags) for lags in open_.values())
    best = min(open_, key=lambda s: (_fit(y, open_[s], start)[1], s)) if len(open_) > 1 else 0
    return _fit(y, open_[best], max(open_[best]))[0], open_[best], best


def _paths(y: np.ndarray, at: np.ndarray, coef: np.ndarray, lags: list[int], steps: int) -> np.ndarray:
    """Forecasts 1..steps ahead from every position in ``at`` at once (rows)."""
    out = np.zeros((len(at), steps))
    for h in range(steps):
        out[:, h] = coef[0] + sum(c * (y[at + h + 1 - k] if h < k else out[:, h - k]) for c, k in zip(coef[1:], lags))
    return out


def per_series(qty, cut, horizons, seasons=(), order=2):
    """Status, season and raw forecasts (origin, horizon) of one series of weekly quantities whose first ``cut`` weeks are known."""
    logs = np.floor(np.log1p(np.maximum(qty, 0)) * 1000 + 0.5) / 1000
    known, last = logs[:cut], max(horizons)
    level = float(np.mean(qty[:cut])) if cut else 0.0
    at = np.arange(cut, len(qty))
    raw, status, season = np.full((len(at), last), level), "fitted", 0
    if len(known) and min(qty[:cut]) == max(qty[:cut]):
        status = "constant history"
    elif len(known) <= 2 * order + 2:
        status = "history too short"
    else:
        coef, lags, season = _choose(known, order, seasons)
        able = at + 1 >= max(lags)
        raw[able] = np.expm1(_paths(logs, at[able], coef, lags, last))
    return status, season, raw[:, [h - 1 for h in horizons]]
