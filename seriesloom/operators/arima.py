"""Seasonal autoregressive moving-average forecasts of many series at once: orders by least squares, weights by the exact likelihood.

Arrays have a row for each series. Shorter ones stand at the end of their row; what lies before them is at the mean and has no error. Ordinary
and seasonal polynomials of lags are multiplied out. Each polynomial is given by partial autocorrelations within (-1, 1), so every set of
parameters is stationary and invertible.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

# Largest orders (values, errors, seasonal values, seasonal errors), where the search starts, and the 5 % point of the test of a constant level.
MOST = (3, 3, 2, 2)
STARTS = ((0, 0, 0, 0), (2, 2, 1, 1), (1, 0, 1, 0), (0, 1, 0, 1))
LEVEL_TEST = 0.463
#: Steps from an order to its neighbours: one place, or both ordinary or both seasonal ones the same way.
MOVES = tuple(tuple(s * x for x in m) for m in ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (1, 1, 0, 0), (0, 0, 1, 1)) for s in (1, -1))
#: Partial autocorrelations are kept this far from 1.
INSIDE = 0.995
#: Series of a batch; its arrays of states hold so many numbers at most.
SERIES, NUMBERS = 512, 1 << 22


class Batch(NamedTuple):
    """Differenced series at the end of their rows, where each begins, and the season."""

    z: np.ndarray
    begin: np.ndarray
    season: int

    @property
    def there(self) -> np.ndarray:
        return np.arange(self.z.shape[1]) >= self.begin[:, None]


def from_partial(r: np.ndarray) -> np.ndarray:
    """Weights of lags 1, 2, ... from partial autocorrelations, by the recursion of Durbin and Levinson."""
    out = np.zeros_like(r)
    for k in range(r.shape[1]):
        before = out[:, :k].copy()
        out[:, :k] = before - r[:, k : k + 1] * before[:, ::-1]
        out[:, k] = r[:, k]
    return out


def multiplied(r: np.ndarray, seasonal: np.ndarray, season: int) -> np.ndarray:
    """(1 - w1 B - w2 B^2 ...)(1 - W1 B^s - ...) as coefficients of B^0, B^1, ..., with the weights of either from their partial autocorrelations."""
    p, ps = r.shape[1], seasonal.shape[1]
    short, out = np.ones((len(r), p + 1)), np.zeros((len(r), p + ps * season + 1))
    short[:, 1:] = -from_partial(r)
    out[:, : p + 1] = short
    for k, w in enumerate(from_partial(seasonal).T, 1):
        out[:, k * season : k * season + p + 1] -= w[:, None] * short
    return out


def unpacked(u: np.ndarray, order: tuple, season: int, with_mean: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mean, coefficients of values, coefficients of errors (either with a leading 1) from unbounded parameters."""
    p, q, ps, qs = order
    mean = u[:, 0] if with_mean else np.zeros(len(u))
    parts = np.split(INSIDE * np.tanh(u[:, int(with_mean) :]), np.cumsum([p, q, ps]), axis=1)
    return mean, multiplied(parts[0], parts[2], season), multiplied(parts[1], parts[3], season)


def centred(batch: Batch, mean: np.ndarray) -> np.ndarray:
    return np.where(batch.there, batch.z - mean[:, None], 0.0)


def conditional_errors(batch: Batch, mean: np.ndarray, values: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """One-step errors if all errors before a series' first value are 0."""
    y = centred(batch, mean)
    e = np.zeros_like(y)
    for k in np.flatnonzero(values.any(0)):
        if k < y.shape[1]:
            e[:, k:] += values[:, k : k + 1] * y[:, : y.shape[1] - k]
    e = np.where(batch.there, e, 0.0).T.copy()
    lags = np.flatnonzero(errors.any(0))[1:]
    if len(lags):
        weights = errors[:, lags].T
        padded = np.concatenate((np.zeros((lags[-1], len(y))), e))
        start, there = lags[-1], batch.there.T
        for t in range(len(e)):
            padded[start + t] -= np.where(there[t], (weights * padded[start + t - lags]).sum(0), 0.0)
        e = padded[start:]
    return e.T


def stationary(values: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transition weights, error weights, covariance of the state before the first value) of the state-space form.

    The covariance is the sum of T^k R R' T'^k over all k; each step doubles the number of its terms.
    """
    n, size = len(values), max(values.shape[1] - 1, errors.shape[1])
    phi, r = np.zeros((n, size)), np.zeros((n, size))
    phi[:, : values.shape[1] - 1], r[:, : errors.shape[1]] = -values[:, 1:], errors
    t = np.zeros((n, size, size))
    t[:, :, 0] = phi
    t[:, np.arange(size - 1), np.arange(1, size)] = 1.0
    cov = r[:, :, None] * r[:, None, :]
    for _ in range(16):
        more = t @ cov @ t.transpose(0, 2, 1)
        cov = cov + more
        if np.abs(more).max() <= 1e-12 * np.abs(cov).max():
            break
        t = t @ t
    return phi, r, cov


def filtered(batch: Batch, mean: np.ndarray, values: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kalman filter: (one-step errors, their variances as multiples of the error variance, state after the last value).

    Values are seen without noise, so what is left of the state's covariance after one has no first row, and the transition only moves it up.
    """
    y = centred(batch, mean).T
    phi, r, cov = stationary(values, errors)
    new = r[:, :, None] * r[:, None, :]
    state, before = np.zeros_like(phi), cov
    v, f = np.zeros_like(y), np.ones_like(y)
    whole = int(batch.begin.max())
    for t in range(len(y)):
        seen = batch.begin <= t
        v[t] = np.where(seen, y[t] - state[:, 0], 0.0)
        f[t] = np.where(seen, cov[:, 0, 0], 1.0)
        gain = cov[:, :, 0] / cov[:, :1, 0]
        state = state + gain * v[t][:, None]
        if t + 1 < len(y):
            state = np.append(state[:, 1:], np.zeros((len(state), 1)), 1) + phi * state[:, :1]
            moved = new.copy()
            moved[:, :-1, :-1] += cov[:, 1:, 1:] - gain[:, 1:, None] * cov[:, :1, 1:]
            cov = moved if t >= whole else np.where(seen[:, None, None], moved, before)
            state = np.where(seen[:, None], state, 0.0)
    return v.T, f.T, state


def log_likelihood(batch: Batch, mean: np.ndarray, values: np.ndarray, errors: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """The exact Gaussian log-likelihood of each series."""
    v, f, _ = filtered(batch, mean, values, errors)
    each = np.log(2 * np.pi * variance[:, None] * f) + v**2 / (f * variance[:, None])
    return -0.5 * np.where(batch.there, each, 0.0).sum(1)


def exact_errors(batch: Batch, mean: np.ndarray, values: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """Errors whose squares sum to what the largest likelihood over all error variances falls with."""
    v, f, _ = filtered(batch, mean, values, errors)
    f = np.maximum(f, 1e-12)
    n = batch.z.shape[1] - batch.begin
    return v / np.sqrt(f) * np.exp(np.where(batch.there, np.log(f), 0.0).sum(1) / (2 * n))[:, None]


def least_squares(of: Callable[[np.ndarray, np.ndarray], np.ndarray], u: np.ndarray, rounds: int, step: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, sums of squares) after damped Gauss-Newton steps, each series with its own damping. of(rows, parameters of these rows): errors."""
    u, damping, rows = u.copy(), np.full(len(u), 1e-3), np.arange(len(u))
    e = of(rows, u)
    least = (e**2).sum(1)
    for _ in range(rounds if u.shape[1] else 0):
        at, here = u[rows], e[rows]
        moved = (at + step * np.eye(u.shape[1])[:, None]).reshape(-1, u.shape[1])  # all directions in one call
        slopes = ((of(np.tile(rows, u.shape[1]), moved).reshape(u.shape[1], *here.shape) - here) / step).transpose(1, 2, 0)
        square = slopes.transpose(0, 2, 1) @ slopes
        side = square[:, range(u.shape[1]), range(u.shape[1])]
        square[:, range(u.shape[1]), range(u.shape[1])] += damping[rows, None] * side + 1e-10 * (1 + side.max(1, keepdims=True))
        move = -np.linalg.solve(square, slopes.transpose(0, 2, 1) @ here[:, :, None])[:, :, 0]
        tried = np.clip(at + np.clip(move, -1.0, 1.0), -6.0, 6.0)
        new = of(rows, tried)
        total = (new**2).sum(1)
        good = total < least[rows]
        gain = np.where(good, 1 - total / np.maximum(least[rows], 1e-300), 0.0)
        won = rows[good]
        u[won], e[won], least[won] = tried[good], new[good], total[good]
        damping[rows] = np.where(good, damping[rows] / 10, damping[rows] * 10)
        rows = rows[(gain > 1e-7) | (~good & (damping[rows] < 1e4))]  # the others are done
        if not len(rows):
            break
    return u, least


def penalised(total: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The corrected information criterion of n errors and k parameters."""
    room = n - k - 1
    return np.where(room > 0, n * np.log(np.maximum(total / n, 1e-12)) + 2 * k + 2 * k * (k + 1) / np.maximum(room, 1), np.inf)


def constant_level(y: np.ndarray) -> bool:
    """Whether y may have a constant level (the test of Kwiatkowski, Phillips, Schmidt and Shin)."""
    e, n = y - y.mean(), len(y)
    reach = int(3 * np.sqrt(n) / 13)
    spread = (e @ e + 2 * sum((1 - k / (reach + 1)) * (e[k:] @ e[:-k]) for k in range(1, reach + 1))) / n
    return spread <= 1e-12 or float((np.cumsum(e) ** 2).sum()) / (n * n * spread) <= LEVEL_TEST


def strongly_seasonal(y: np.ndarray, season: int) -> bool:
    """Whether means by place in the season take off 64 % of the variance around a straight line."""
    at = np.arange(len(y))
    rest = y - np.polyval(np.polyfit(at, y, 1), at)
    means = np.array([rest[p::season].mean() for p in range(season)])
    return rest.var() > 1e-12 and 1 - (rest - means[at % season]).var() / rest.var() > 0.64


class Prepared(NamedTuple):
    """A series whose level is constant: differences by the polynomial whole, scaled to a spread of 1; whether it has a mean, and a season."""

    z: np.ndarray
    whole: np.ndarray
    scale: float
    with_mean: bool
    seasonal: bool


def prepared(y: np.ndarray, season: int) -> Prepared:
    """Differences until the level is constant (2 at most), and one seasonal difference if the season is strong."""
    whole = np.ones(1)
    if len(y) >= 3 * season and strongly_seasonal(y, season):
        whole = np.concatenate([[1.0], np.zeros(season - 1), [-1.0]])
    z = np.convolve(y, whole, "valid")
    taken = int(len(whole) > 1)
    for _ in range(2):
        if len(z) > 4 and not constant_level(z):
            z, whole, taken = np.diff(z), np.convolve(whole, [1.0, -1.0]), taken + 1
    spread = float(z.std() if taken <= 1 else np.sqrt((z**2).mean()))
    scale = spread if spread > 1e-9 * max(1.0, float(np.abs(y).max())) else 1.0
    return Prepared(z / scale, whole, scale, taken <= 1, season > 1 and len(y) >= 2 * season)


def batch_of(some: list[Prepared], season: int) -> Batch:
    most = max(len(s.z) for s in some)
    z = np.zeros((len(some), most))
    for row, s in zip(z, some, strict=True):
        row[most - len(s.z) :] = s.z
    return Batch(z, np.array([most - len(s.z) for s in some]), season)


def start_of(batch: Batch, order: tuple, with_mean: bool) -> np.ndarray:
    u = np.zeros((len(batch.z), int(with_mean) + sum(order)))
    if with_mean:
        u[:, 0] = batch.z.sum(1) / (batch.z.shape[1] - batch.begin)
    return u


def fitted(batch: Batch, order: tuple, with_mean: bool, rounds: int = 12, exact: bool = False, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, sums of squares): by conditional errors, or by the exact likelihood."""
    errors_of = exact_errors if exact else conditional_errors

    def of(rows: np.ndarray, u: np.ndarray) -> np.ndarray:
        return errors_of(Batch(batch.z[rows], batch.begin[rows], batch.season), *unpacked(u, order, batch.season, with_mean))

    return least_squares(of, start_of(batch, order, with_mean) if start is None else start, rounds)


def best_orders(series: list[Prepared], season: int) -> list[tuple[tuple, np.ndarray]]:
    """(order, parameters) of each series with the least corrected information criterion along a stepwise search by conditional errors.

    In each round, all series that want to try an order are fitted together.
    """
    found: list[dict] = [{} for _ in series]
    best: list[tuple | None] = [None] * len(series)
    wanted = [{s if p.seasonal else (*s[:2], 0, 0) for s in STARTS} for p in series]
    while any(wanted):
        by_order = defaultdict(list)
        for i, orders in enumerate(wanted):
            for order in orders:
                by_order[order, series[i].with_mean].append(i)
        for (order, with_mean), which in by_order.items():
            k = sum(order) + with_mean + 1
            reach = max(order[0] + season * order[2], order[1] + season * order[3])
            can = [i for i in which if len(series[i].z) - k - 1 > 0 and reach < len(series[i].z)]
            for i in set(which) - set(can):
                found[i][order] = np.inf, None
            if can:
                batch = batch_of([series[i] for i in can], season)
                u, total = fitted(batch, order, with_mean)
                for i, row, c in zip(can, u, penalised(total, batch.z.shape[1] - batch.begin, k), strict=True):
                    found[i][order] = float(c), row
        for i, tried in enumerate(found):
            if wanted[i]:
                now = min(tried, key=lambda o: (tried[o][0], sum(o), o))
                near = [tuple(a + b for a, b in zip(now, m, strict=True)) for m in MOVES if series[i].seasonal or not any(m[2:])] if now != best[i] else []
                best[i] = now
                wanted[i] = {o for o in near if o not in tried and all(0 <= a <= most for a, most in zip(o, MOST, strict=True))}
    nothing = (0, 0, 0, 0)
    return [(b, f[b][1]) if f[b][1] is not None else (nothing, np.full(int(p.with_mean), p.z.mean() if len(p.z) else 0.0)) for b, f, p in zip(best, found, series, strict=True)]


def steps_ahead(batch: Batch, order: tuple, with_mean: bool, u: np.ndarray, n: int) -> np.ndarray:
    """The next n values of the differenced series, with later errors 0."""
    mean, values, errors = unpacked(u, order, batch.season, with_mean)
    *_, state = filtered(batch, mean, values, errors)
    phi, out = stationary(values, errors)[0], np.zeros((len(u), n))
    for t in range(n):
        state = np.append(state[:, 1:], np.zeros((len(state), 1)), 1) + phi * state[:, :1]
        out[:, t] = state[:, 0] + mean
    return out


def undone(y: np.ndarray, whole: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Values whose differences by the polynomial whole go on with ahead."""
    values = [*map(float, y[len(y) - len(whole) + 1 :])]
    for z in ahead:
        values.append(float(z) - sum(c * values[-k] for k, c in enumerate(whole) if k and c))
    return np.array(values[len(whole) - 1 :])


def arima_forecasts(histories: list[np.ndarray], ahead: list[int], season: int) -> list[np.ndarray]:
    """For each history (at least one value) the next values, as many as ahead says.

    Up to 3 lags of values and of errors and up to 2 seasonal ones of each. A season counts from two whole seasons of history on. Orders are
    chosen by conditional least squares, and the chosen model's weights are those of the largest exact likelihood.
    """
    out: list[np.ndarray] = [np.zeros(0)] * len(histories)
    by_length = sorted(range(len(histories)), key=lambda i: len(histories[i]))
    size = max(1, min(SERIES, NUMBERS // max(1, len(histories[by_length[-1]]) + 30**2))) if histories else 1
    for at in range(0, len(by_length), size):
        which = by_length[at : at + size]
        series = [prepared(np.asarray(histories[i], float), season) for i in which]
        by_order = defaultdict(list)
        for k, (order, u) in enumerate(best_orders(series, season)):
            by_order[order, series[k].with_mean].append((k, u))
        for (order, with_mean), some in by_order.items():
            batch = batch_of([series[k] for k, _ in some], season)
            start = np.stack([u for _, u in some])
            u, total = fitted(batch, order, with_mean, 8, True, start)
            u = np.where(np.isfinite(total)[:, None], u, start)
            for (k, _), z in zip(some, steps_ahead(batch, order, with_mean, u, max(ahead[which[k]] for k, _ in some)), strict=True):
                i = which[k]
                out[i] = undone(np.asarray(histories[i], float), series[k].whole, z[: ahead[i]] * series[k].scale)
    return out


def arima_forecast(history: np.ndarray, n: int, season: int) -> np.ndarray:
    """n steps ahead of one history."""
    return arima_forecasts([history], [n], season)[0]
