"""Fitting one series: least squares over many candidate models at once.

All candidates of a series are fitted side by side: a pass over the series moves
every candidate (and every finite-difference copy of it) one step, so a grid of
models costs about as much as one."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np

from tideline.functions.recursion import STRETCH, Family, normal_sums, series_sums

BUMP = 1e-6
EXACT_ROUNDS = 15  # steps of the exact search, which starts where the squares are least
EXACT_ROWS = 10_000  # rows up to which seasonal models are fitted by their exact likelihood
EDGE = 0.9999  # partial autocorrelations stay this far inside the unit circle


def least_squares(residuals, start: np.ndarray, free: np.ndarray, rounds: int = 40):
    """Levenberg-Marquardt for many problems at once.

    ``residuals(params, lane)`` maps parameters ``(copies, size)`` of the problems
    ``lane`` to residuals ``(n, copies)``. ``free`` marks the parameters in use.
    Returns the parameters and the sum of squares per problem."""
    lanes, size = start.shape
    lane = np.repeat(np.arange(lanes), size + 1)
    bumps = np.vstack([np.zeros((1, size)), BUMP * np.eye(size)])

    def evaluate(at):
        copies = (at[:, None, :] + bumps[None]).reshape(-1, size)
        return normal_sums(residuals(copies, lane), lanes, BUMP, free)

    return descend(evaluate, start, free, rounds)


def descend(evaluate, start: np.ndarray, free: np.ndarray, rounds: int = 40):
    """Levenberg-Marquardt where ``evaluate(params)`` gives the sum of squares and the sums of the
    normal equations per problem, wherever they are added up."""
    size = start.shape[1]
    with np.errstate(all="ignore"):
        at = start * free
        cost, square, pull = evaluate(at)
        damping = np.full(len(start), 1e-3)
        for _ in range(rounds):
            scale = np.maximum(np.einsum("lii->li", square), 1e-12)
            system = square + (damping[:, None] * scale)[:, :, None] * np.eye(size)
            system[~np.isfinite(system)] = 0.0
            move = -np.einsum("lij,lj->li", np.linalg.pinv(system), np.nan_to_num(pull)) * free
            new_cost, new_square, new_pull = evaluate(at + move)
            better = np.isfinite(new_cost) & ~(new_cost >= cost)
            settled = np.abs(cost - new_cost) <= 1e-10 * np.abs(cost)
            at = np.where(better[:, None], at + move, at)
            cost = np.where(better, new_cost, cost)
            square = np.where(better[:, None, None], new_square, square)
            pull = np.where(better[:, None], new_pull, pull)
            damping = np.where(better, damping / 5, damping * 5)
            if np.all(settled | (damping > 1e8)):
                break
    return at, cost


def _from_partials(u: np.ndarray) -> np.ndarray:
    """Unbounded numbers to coefficients of a stationary polynomial (Jones, 1980)."""
    partial = EDGE * np.tanh(u)
    out = np.zeros_like(partial)
    for k in range(u.shape[1]):
        out[:, :k] = out[:, :k] - partial[:, k : k + 1] * out[:, :k][:, ::-1]
        out[:, k] = partial[:, k]
    return out


def _exact_residuals(w: np.ndarray, width: int, mean: bool):
    """Scaled one-step errors whose sum of squares is the exact Gaussian likelihood
    (Gardner, Harvey and Phillips, 1980) with the variance profiled out."""

    def run(params, lane):
        copies = len(params)
        ar, ma = _from_partials(params[:, :width]), -_from_partials(params[:, width : 2 * width])
        centred = w[:, None] - (params[:, -1] if mean else 0.0)
        size = width + 1
        move = np.zeros((copies, size, size))
        move[:, :width, 0] = ar
        move[:, np.arange(width), np.arange(width) + 1] = 1.0
        shock = np.concatenate([np.ones((copies, 1)), ma], axis=1)
        noise = shock[:, :, None] * shock[:, None, :]
        kron = np.einsum("lij,lkm->likjm", move, move).reshape(copies, size * size, size * size)
        spread = np.linalg.solve(np.eye(size * size) - kron, noise.reshape(copies, -1, 1)).reshape(copies, size, size)
        state = np.zeros((copies, size))
        errors = np.empty((len(w), copies))
        log_f = np.zeros(copies)
        turned = move.transpose(0, 2, 1)
        steady = False
        for t in range(len(w)):
            miss = centred[t] - state[:, 0]
            if not steady:
                f = spread[:, 0, 0]
                gain = np.matmul(move, spread[:, :, :1])[:, :, 0] / f[:, None]
                new = np.matmul(np.matmul(move, spread), turned) + noise - gain[:, :, None] * gain[:, None, :] * f[:, None, None]
                steady = bool(np.all(np.abs(new - spread) < 1e-10))
                spread = new
                root, log_one = np.sqrt(f), np.log(f)
            log_f += log_one
            errors[t] = miss / root
            ahead = state[:, :1] * ar
            state[:, :-1] = state[:, 1:] + ahead
            state[:, -1] = 0.0
            state += gain * miss[:, None]
        return errors * np.exp(0.5 * log_f / len(w))

    return run


def _seasonal_terms(params: np.ndarray):
    """Lag coefficients of ``(1 - a1 B - a2 B^2)(1 - A B^m)`` and ``(1 + b1 B + b2 B^2)(1 + B' B^m)``
    at lags ``1, 2, m, m + 1, m + 2``."""
    a1, a2, b1, b2, sa, sb = params.T
    ar = np.stack([a1, a2, sa, -a1 * sa, -a2 * sa])
    ma = np.stack([b1, b2, sb, b1 * sb, b2 * sb])
    return ar, ma


def _seasonal_parameters(u: np.ndarray) -> np.ndarray:
    """Unbounded numbers to ``a1, a2, b1, b2, A, B`` of stationary and invertible polynomials."""
    return np.concatenate([_from_partials(u[:, :2]), -_from_partials(u[:, 2:4]), EDGE * np.tanh(u[:, 4:])], axis=1)


def _seasonal_start(params: np.ndarray) -> np.ndarray:
    """Unbounded numbers near given ``a1, a2, b1, b2, A, B``, moved well inside the bounds."""
    a1, a2, b1, b2, sa, sb = np.nan_to_num(params).T
    inside = lambda x: np.arctanh(np.clip(x, -0.95, 0.95))
    first = lambda one, two: one / np.maximum(1 - np.clip(two, -0.95, 0.95), 0.05)
    return np.stack([inside(first(a1, a2)), inside(a2), inside(first(-b1, -b2)), inside(-b2), inside(sa), inside(sb)], axis=1)


def _seasonal_innovations(w: np.ndarray, m: int, params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors of the stationary state space and their variances (in units of the shock's).

    The state has a place per lag, ``m + 3`` in all. Its covariance changes from step to step by a matrix of
    rank one, so that change is carried as a vector (Chandrasekhar's recursions: Morf, Sidhu and Kailath, 1974)
    and a step costs as much as the state is long, not its square."""
    copies, size = len(params), m + 3
    ar, ma = _seasonal_terms(params)
    phi, theta = np.zeros((copies, size + 1)), np.zeros((copies, size + 1))
    theta[:, 0] = 1.0
    for lag, a, b in zip((1, 2, m, m + 1, m + 2), ar, ma):
        phi[:, lag] += a
        theta[:, lag] += b
    impulse = np.zeros((copies, size + 1))
    for k in range(size + 1):
        impulse[:, k] = theta[:, k] + np.einsum("ci,ci->c", phi[:, 1 : k + 1], impulse[:, :k][:, ::-1])
    # autocovariances 0 .. size from the equations that tie them together
    system = np.broadcast_to(np.eye(size + 1), (copies, size + 1, size + 1)).copy()
    known = np.zeros((copies, size + 1))
    for k in range(size + 1):
        for j in range(1, size + 1):
            system[:, k, abs(k - j)] -= phi[:, j]
        known[:, k] = np.einsum("cj,cj->c", theta[:, k:], impulse[:, : size + 1 - k])
    gamma = np.linalg.solve(system, known[:, :, None])[:, :, 0]
    first = gamma[:, :size].copy()  # covariance of each place of the state with the value
    for i in range(2, size + 1):
        first[:, i - 1] = np.einsum("cj,cj->c", phi[:, i:size], gamma[:, 1 : size - i + 1])
        first[:, i - 1] += np.einsum("cj,cj->c", theta[:, i - 1 : size], impulse[:, : size - i + 1])
    weights = phi[:, 1 : size + 1]

    def ahead(state: np.ndarray) -> np.ndarray:
        out = weights * state[:, :1]
        out[:, :-1] += state[:, 1:]
        return out

    spread = first[:, 0]
    gain = ahead(first)
    change, factor = gain, -1.0 / spread
    state = np.zeros((copies, size))
    errors, variances = np.empty((len(w), copies)), np.empty((len(w), copies))
    steady = False
    for t in range(len(w)):
        errors[t] = w[t] - state[:, 0]
        variances[t] = spread
        state = ahead(state) + gain * (errors[t] / spread)[:, None]
        if steady:
            continue
        z = change[:, 0]
        moved_on = ahead(change)
        new = spread + z * z * factor
        gain = gain + moved_on * (factor * z)[:, None]
        change = moved_on - gain * (z / new)[:, None]
        factor = factor + factor * z / spread * z * factor
        spread = new
        steady = t % 16 == 0 and bool(np.all(np.abs(change).max(axis=1) ** 2 * np.abs(factor) < 1e-14))
    return errors, variances


def _seasonal_residuals(w: np.ndarray, m: int):
    """Scaled one-step errors whose sum of squares is the exact Gaussian likelihood with the variance profiled out."""

    def run(u, lane):
        errors, variances = _seasonal_innovations(w, m, _seasonal_parameters(u))
        return errors / np.sqrt(variances) * np.exp(0.5 * np.log(variances).mean(axis=0))

    return run


def _conditional_residuals(w: np.ndarray, m: int, skip: np.ndarray):
    """One-step errors given the first ``skip`` values of each candidate."""
    lags = np.array([1, 2, m, m + 1, m + 2])
    deepest = int(lags[-1])

    def run(params, lane):
        ar, ma = _seasonal_terms(params)
        errors = np.zeros((len(w) + deepest, len(params)))
        own = np.repeat(w[:, None], len(params), axis=1)
        for lag, coefficient in zip(lags, ar):
            own[lag:] -= coefficient * w[:-lag, None]
        own[np.arange(len(w))[:, None] < skip[lane][None, :]] = 0.0
        if not ma.any():
            return own
        ma = ma.copy()
        for t in range(len(w)):
            back = errors[t + deepest - lags]
            errors[t + deepest] = own[t] - np.einsum("kl,kl->l", ma, back)
        errors = errors[deepest:]
        errors[np.arange(len(w))[:, None] < skip[lane][None, :]] = 0.0
        return errors

    return run


def _difference(y: np.ndarray, d: int, seasonal: int, m: int) -> np.ndarray:
    for _ in range(seasonal):
        y = y[m:] - y[:-m]
    return np.diff(y, d)


def _lag_polynomial(coefficients, lags, size: int, sign: float) -> np.ndarray:
    out = np.zeros(size + 1)
    out[0] = 1.0
    for c, lag in zip(coefficients, lags):
        out[lag] += sign * c
    return out


class Fit:
    """A fitted candidate: forecasts and intervals from its lag polynomials."""

    def __init__(self, order, y, ar, ma, mean, errors, variance, aic, m=1, d=0, seasonal=0):
        for _ in range(d):
            ar = np.convolve(ar, [1.0, -1.0])
        for _ in range(seasonal):
            ar = np.convolve(ar, np.r_[1.0, np.zeros(m - 1), -1.0])
        self.order, self.y, self.ar, self.ma = order, y, np.trim_zeros(ar, "b"), np.trim_zeros(ma, "b")
        self.mean, self.errors, self.variance, self.aic = mean, errors, variance, aic

    def forecast(self, steps: int) -> np.ndarray:
        p, q = len(self.ar) - 1, len(self.ma) - 1
        past = np.concatenate([np.zeros(p), self.y - self.mean, np.zeros(steps)])
        shocks = np.concatenate([np.zeros(q), self.errors, np.zeros(steps)])
        at, et = p + len(self.y), q + len(self.errors)
        for h in range(steps):
            value = -self.ar[1:] @ past[at + h - p : at + h][::-1] if p else 0.0
            past[at + h] = value + (self.ma[1:] @ shocks[et + h - q : et + h][::-1] if q else 0.0)
        return past[at:] + self.mean

    def interval(self, steps: int, level: float) -> np.ndarray:
        """Half widths of the forecast interval."""
        impulse = np.zeros(steps)
        for h in range(steps):
            value = self.ma[h] if h < len(self.ma) else 0.0
            reach = min(h, len(self.ar) - 1)
            impulse[h] = value - (self.ar[1 : reach + 1] @ impulse[h - reach : h][::-1] if reach else 0.0)
        width = np.sqrt(self.variance * np.cumsum(impulse**2))
        return NormalDist().inv_cdf(0.5 + level / 2) * width


def fit_arima(y: np.ndarray, d: int, orders: list[tuple[int, int]]) -> list[Fit]:
    """Exact maximum likelihood for every ``(p, q)``; a mean is included when ``d`` is 0."""
    w = np.diff(y, d)
    width = max(max(p, q) for p, q in orders) or 1
    scale = w.std() or 1.0
    z = (w - (w.mean() if d == 0 else 0.0)) / scale
    free = np.array([[i < p for i in range(width)] + [i < q for i in range(width)] + [d == 0] for p, q in orders], float)
    run = _exact_residuals(z, width, d == 0)
    params, cost = least_squares(run, np.full(free.shape, 0.1), free)
    with np.errstate(all="ignore"):
        errors = run(params, np.arange(len(orders)))
    ar, ma = _from_partials(params[:, :width]), -_from_partials(params[:, width : 2 * width])
    fits = []
    for i, (p, q) in enumerate(orders):
        if not np.isfinite(cost[i]) or cost[i] <= 0:
            continue
        n, count = len(w), p + q + (d == 0) + 1
        variance = cost[i] / n * scale**2
        mean = (w.mean() + params[i, -1] * scale) if d == 0 else 0.0
        aic = n * (np.log(2 * np.pi * variance) + 1) + 2 * count
        lags = range(1, width + 1)
        fits.append(
            Fit(
                (p, d, q, 0, 0, 0, 0), y, _lag_polynomial(ar[i], lags, width, -1), _lag_polynomial(ma[i], lags, width, 1),
                mean, errors[:, i] * scale, variance, aic, d=d,
            )
        )
    return fits


def fit_sarima(y: np.ndarray, d: int, m: int, orders: list[tuple[int, int, int, int]], exact: bool | None = None) -> list[Fit]:
    """Every ``(p, q, P, Q)``, differenced ``d`` times both ways: by maximum likelihood of the stationary
    state space (``exact``, by default up to ``EXACT_ROWS`` rows), or by least squares given the first values."""
    w = _difference(y, d, d, m)
    skip = np.array([p + m * sp for p, q, sp, sq in orders])
    if len(w) <= skip.max() + 10:
        raise ValueError("too few points after seasonal differencing")
    exact = len(y) <= EXACT_ROWS if exact is None else exact
    scale = w.std() or 1.0
    free = np.array([[p > 0, p > 1, q > 0, q > 1, sp > 0, sq > 0] for p, q, sp, sq in orders], float)
    run = _conditional_residuals(w / scale, m, skip)
    params, cost = least_squares(run, np.full(free.shape, 0.1), free)
    if exact:  # the squares give the start
        params, cost = least_squares(_seasonal_residuals(w / scale, m), _seasonal_start(params), free, EXACT_ROUNDS)
    with np.errstate(all="ignore"):
        if exact:
            params = _seasonal_parameters(params)
            errors, spreads = _seasonal_innovations(w / scale, m, params)
        else:
            errors = run(params, np.arange(len(orders)))
    ar, ma = _seasonal_terms(params)
    lags, size = [1, 2, m, m + 1, m + 2], m + 2
    fits = []
    for i, (p, q, sp, sq) in enumerate(orders):
        if not np.isfinite(cost[i]) or cost[i] <= 0:
            continue
        n = len(w) - (0 if exact else skip[i])
        variance = cost[i] / n * scale**2
        if exact:  # the likelihood's own variance: the scaled errors carry the determinant
            variance /= float(np.exp(np.log(spreads[:, i]).mean()))
        aic = n * (np.log(2 * np.pi * cost[i] / n * scale**2) + 1) + 2 * (p + q + sp + sq + 1)
        fits.append(
            Fit(
                (p, d, q, sp, d, sq, m), y, _lag_polynomial(ar[:, i], lags, size, -1), _lag_polynomial(ma[:, i], lags, size, 1),
                0.0, errors[:, i] * scale, variance, aic, m=m, d=d, seasonal=d,
            )
        )
    return fits


def arima_family(orders: list[tuple[int, int]], mean: bool) -> Family:
    """ARMA candidates ``(p, q)`` given their first ``p`` values."""
    width = max(max(p, q) for p, q in orders) or 1
    free = np.array([[i < p for i in range(width)] + [i < q for i in range(width)] + [mean] for p, q in orders], float)

    def terms(params):
        ar, ma = _from_partials(params[:, :width]), -_from_partials(params[:, width : 2 * width])
        return ar.T, ma.T, params[:, -1] * mean

    return Family(np.arange(1, width + 1), free, np.array([p for p, _ in orders]), terms)


def sarima_family(orders: list[tuple[int, int, int, int]], m: int) -> Family:
    """Seasonal candidates ``(p, q, P, Q)`` given their first ``p + m P`` values."""
    free = np.array([[p > 0, p > 1, q > 0, q > 1, sp > 0, sq > 0] for p, q, sp, sq in orders], float)
    skip = np.array([p + m * sp for p, q, sp, sq in orders])
    return Family(np.array([1, 2, m, m + 1, m + 2]), free, skip, lambda params: (*_seasonal_terms(params), np.zeros(len(params))))


def named_orders(orders, d: int, m: int) -> list[tuple]:
    """Orders ``(p, d, q, P, D, Q, m)`` of candidates ``(p, q)`` or ``(p, q, P, Q)``."""
    return [(o[0], d, o[1], o[2], d, o[3], m) if len(o) == 4 else (o[0], d, o[1], 0, 0, 0, 0) for o in orders]


def fits_of(family: Family, names: list[tuple], params, cost, n: int, scale: float, centre: float, tail: np.ndarray, last) -> list[Fit]:
    """The fitted candidates: ``n`` rows after differencing, the last values ``tail`` of the series
    itself, and the last errors ``last(i)`` of candidate ``i`` in units of ``scale``."""
    ar, ma, mean = family.terms(params)
    fits = []
    for i, (name, free) in enumerate(zip(names, family.free)):
        if not np.isfinite(cost[i]) or cost[i] <= 0:
            continue
        d, seasonal, m = name[1], name[4], name[6]
        rows = n - family.skip[i]
        variance = cost[i] / rows * scale**2
        counted = rows if seasonal or m else n  # the same rows for candidates that are compared
        aic = counted * (np.log(2 * np.pi * variance) + 1) + 2 * (free.sum() + 1)
        lags, size = family.lags, family.deepest
        fits.append(
            Fit(
                name, tail, _lag_polynomial(ar[:, i], lags, size, -1), _lag_polynomial(ma[:, i], lags, size, 1),
                centre + mean[i] * scale, last(i) * scale, variance, aic, m=max(m, 1), d=d, seasonal=seasonal,
            )
        )
    return fits


def fit_long(y: np.ndarray, d: int, orders: list[tuple], m: int = 0) -> list[Fit]:
    """Conditional least squares for every candidate over all of a long series: ``(p, q)``, or
    ``(p, q, P, Q)`` with a season of ``m`` rows. Memory holds the series and one block of errors."""
    seasonal = m > 0
    family = sarima_family(orders, m) if seasonal else arima_family(orders, d == 0)
    w = _difference(y, d, d if seasonal else 0, m)
    centre = w.mean() if d == 0 and not seasonal else 0.0
    scale = w.std() or 1.0
    rows = np.concatenate([np.zeros(family.deepest), (w - centre) / scale])
    params, cost = descend(lambda at: series_sums(family, rows, at, BUMP)[0], np.full(family.free.shape, 0.1), family.free)
    with np.errstate(all="ignore"):
        _, state = series_sums(family, rows, params, BUMP)
    last = state[:, :: params.shape[1] + 1]
    keep = family.deepest + d * (1 + m) + 1
    return fits_of(family, named_orders(orders, d, m), params, cost, len(w), scale, centre, y[-keep:], lambda i: last[:, i])


class HoltWinters:
    """Additive exponential smoothing minimising squared one-step errors.

    For given smoothing weights the errors are linear in the starting state, so the
    state is solved for exactly and only the weights are searched."""

    def __init__(self, y: np.ndarray, trend: bool, season: int):
        self.y, self.trend, self.season = y, trend, season
        starts = np.array([[-2.0, -2.0, -2.0], [0.0, -2.0, -2.0], [2.0, -2.0, -3.0]])
        free = np.tile([1.0, float(trend), float(season > 0)], (3, 1))
        params, cost = least_squares(lambda u, lane: self._errors(u)[0], starts, free, rounds=25)
        best = int(np.nanargmin(np.where(np.isfinite(cost), cost, np.inf)))
        self.sse = float(cost[best])
        if not np.isfinite(self.sse):
            raise ValueError("smoothing did not converge")
        _, states = self._errors(params[best : best + 1])
        self.level, self.slope, self.seasons = (s[..., 0] for s in states)

    @staticmethod
    def weights(u: np.ndarray):
        """Level, trend and season weights with the usual bounds built in."""
        share = 1 / (1 + np.exp(-np.clip(u, -30, 30)))
        alpha = share[:, 0]
        return alpha, alpha * share[:, 1], (1 - alpha) * share[:, 2]

    def _steps(self, u: np.ndarray, y: np.ndarray, states: list[np.ndarray]):
        """Errors ``(steps, copies, columns)`` and the states after ``y`` (steps, columns) for state columns side by side."""
        m = self.season
        alpha, beta, gamma = (w[:, None] for w in self.weights(u))
        beta, gamma = beta * self.trend, gamma * (m > 0)
        level, slope, seasons = states
        errors = np.empty((len(y), *level.shape))
        for t in range(len(y)):
            spot = t % m if m else 0
            base = level + slope
            e = y[t] - base - seasons[spot]
            errors[t] = e
            level = base + alpha * e
            slope = slope + beta * e
            seasons[spot] = seasons[spot] + gamma * e
        return errors, [level, slope, seasons]

    def _vectors(self, states: list[np.ndarray]) -> np.ndarray:
        """States as vectors ``(copies, units, columns)``: level, slope with a trend, seasons."""
        level, slope, seasons = states
        parts = [level[:, None], slope[:, None]][: 1 + int(self.trend)]
        return np.concatenate(parts + [seasons[: self.season].transpose(1, 0, 2)], axis=1)

    def _states(self, vectors: np.ndarray) -> list[np.ndarray]:
        copies, _, columns = vectors.shape
        slope = vectors[:, 1] if self.trend else np.zeros((copies, columns))
        seasons = vectors[:, 1 + int(self.trend) :].transpose(1, 0, 2) if self.season else np.zeros((1, copies, columns))
        return [vectors[:, 0].copy(), slope.copy(), seasons.copy()]

    def _errors(self, u: np.ndarray):
        """Errors ``(n, copies)`` and the last states, from the best starting state of each copy.

        Stretches of the series run side by side from a zero state, next to each unit state on zeros;
        the states before the stretches follow as affine functions of the first one."""
        y, m, copies = self.y, self.season, len(u)
        units = 1 + int(self.trend) + m
        steps = max(m, 1) * -(-STRETCH // max(m, 1))
        full = len(y) // steps if len(y) >= 2 * steps else 0
        eye = np.broadcast_to(np.eye(units), (copies, units, units))
        fixed, moves = np.zeros((copies, units, 1)), eye  # state here: fixed + moves @ first
        designs, targets, stretches = [], [], []
        if full:
            inputs = np.zeros((steps, full + units))
            inputs[:, :full] = y[: full * steps].reshape(full, steps).T
            zero = np.concatenate([np.zeros((copies, units, full)), eye], axis=2)
            errors, after = self._steps(u, inputs, self._states(zero))
            after = self._vectors(after)
            response = errors[:, :, full:].transpose(1, 0, 2)  # copies, steps, units
            q, r = np.linalg.qr(response) if np.isfinite(response).all() else (response * np.nan, eye * np.nan)
            for j in range(full):
                base = errors[:, :, j].T[:, :, None] + response @ fixed
                stretches.append((base, moves))
                designs.append(r @ moves)
                targets.append(-(q.transpose(0, 2, 1) @ base))
                fixed = after[:, :, full:] @ fixed + after[:, :, j : j + 1]
                moves = after[:, :, full:] @ moves
        rest = y[full * steps :]
        inputs = np.zeros((len(rest), 1 + units))
        inputs[:, 0] = rest
        errors, after = self._steps(u, inputs, self._states(np.concatenate([fixed, moves], axis=2)))
        tail = errors.transpose(1, 0, 2)
        designs.append(tail[:, :, 1:])
        targets.append(-tail[:, :, :1])
        design, target = np.concatenate(designs, axis=1), np.concatenate(targets, axis=1)[:, :, 0]
        first = np.full((copies, units), np.nan)
        for c in range(copies):
            if np.isfinite(design[c]).all() and np.isfinite(target[c]).all():
                first[c] = np.linalg.lstsq(design[c], target[c], rcond=1e-10)[0]
        mix = np.concatenate([np.ones((copies, 1)), first], axis=1)
        parts = [(base[:, :, 0] + (response @ (move @ first[:, :, None]))[:, :, 0]) for base, move in stretches]
        out = np.concatenate([*parts, (tail @ mix[:, :, None])[:, :, 0]], axis=1).T
        last = self._vectors(after) @ mix[:, :, None]
        level, slope, seasons = self._states(last)
        return out, [level[:, 0], slope[:, 0], seasons[:, :, 0]]

    def forecast(self, steps: int) -> np.ndarray:
        ahead = np.arange(1, steps + 1)
        season = self.seasons[(len(self.y) + ahead - 1) % self.season] if self.season else 0.0
        return self.level + self.slope * ahead + season
