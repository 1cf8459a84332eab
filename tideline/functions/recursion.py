"""Lag recursions over long series.

The errors of a moving-average recursion are an affine function of the errors before them. So a
series is cut into stretches that run side by side from zero errors; the state each
leaves behind follows along the stretches from the one before (the same map for all of them), and
adding the response to the right starting state gives the errors of the sequential pass. The same
holds one level up, for the chunks of a series that lie in different tasks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

STRETCH = 256  # least steps of a stretch
BLOCK = 65_536  # rows of a long series worked on at once


def responses(lags: np.ndarray, ma: np.ndarray, steps: int) -> np.ndarray:
    """Errors ``(steps, deepest, copies)`` that follow a single unit error in each of the
    ``deepest`` places before, with no input."""
    deepest, copies = int(max(lags)), ma.shape[1]
    out = np.zeros((deepest + steps, deepest, copies))
    out[np.arange(deepest), np.arange(deepest)] = 1.0
    for t in range(deepest, deepest + steps):
        out[t] = -np.einsum("kc,kqc->qc", ma, out[t - lags])
    return out[deepest:]


def lag_errors(own: np.ndarray, lags: np.ndarray, ma: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Errors ``e[t] = own[t] - sum_k ma[k] e[t - lags[k]]`` and the last ``deepest`` of them.

    ``own`` is ``(n, copies)``, ``ma`` ``(len(lags), copies)``, ``start`` ``(deepest, copies)`` the errors before."""
    n, copies = own.shape
    deepest = int(max(lags))
    if not ma.any():
        return own, np.concatenate([start, own])[-deepest:]
    steps = max(STRETCH, 2 * deepest)
    count = -(-n // steps)
    rows = np.zeros((count * steps, copies))
    rows[:n] = own
    rows = rows.reshape(count, steps, copies)
    errors = np.zeros((deepest + steps, count, copies))
    for t in range(steps):
        now = rows[:, t].copy()
        for lag, weight in zip(lags, ma):
            now -= weight * errors[deepest + t - lag]
        errors[deepest + t] = now
    response = responses(lags, ma, steps)
    move = response[-deepest:]  # state behind a stretch, by the state before it
    starts = np.empty((deepest, count, copies))
    state = start
    for j in range(count):
        starts[:, j] = state
        state = errors[-deepest:, j] + np.einsum("rqc,qc->rc", move, state)
    out = errors[deepest:]
    for q in range(deepest):
        if starts[q].any():
            out += response[:, q, None, :] * starts[q][None]
    out = out.transpose(1, 0, 2).reshape(count * steps, copies)[:n]
    return out, np.concatenate([start, out])[-deepest:]


@dataclass(frozen=True)
class Family:
    """Candidates of one kind of model: their free parameters, the rows each leaves out at the
    start, and the lag coefficients ``terms(params) -> ar, ma, mean`` at ``lags``."""

    lags: np.ndarray
    free: np.ndarray
    skip: np.ndarray
    terms: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]

    @property
    def deepest(self) -> int:
        return int(max(self.lags))

    def copies(self, at: np.ndarray, bump: float) -> np.ndarray:
        """Each candidate's parameters, then with each parameter moved by ``bump``."""
        size = at.shape[1]
        moves = np.vstack([np.zeros((1, size)), bump * np.eye(size)])
        return (at[:, None, :] + moves[None]).reshape(-1, size)

    def inputs(self, params: np.ndarray, rows: np.ndarray, first: int) -> np.ndarray:
        """What each copy's errors are made of: ``rows`` holds ``deepest`` rows of context, then the rows
        from place ``first`` on."""
        ar, _, mean = self.terms(params)
        deepest, n = self.deepest, len(rows) - self.deepest
        own = rows[deepest:, None] - mean
        for lag, weight in zip(self.lags, ar):
            own = own - weight * (rows[deepest - lag : deepest - lag + n, None] - mean)
        skip = np.repeat(self.skip, len(params) // len(self.skip))
        if first < skip.max():
            own[np.arange(first, first + n)[:, None] < skip[None, :]] = 0.0
        return own

    def errors(self, params: np.ndarray, rows: np.ndarray, first: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.inputs(params, rows, first)
        errors, end = lag_errors(own, self.lags, self.terms(params)[1], start)
        skip = np.repeat(self.skip, len(params) // len(self.skip))
        if first < skip.max():  # no error is made before a candidate's first row
            left = np.arange(first, first + len(own))[:, None] < skip[None, :]
            errors = np.where(left, 0.0, errors)
        return errors, end


def normal_sums(errors: np.ndarray, lanes: int, bump: float, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of squares, and the sums of the normal equations, of ``lanes`` candidates with their copies."""
    r = errors.reshape(len(errors), lanes, -1)
    base = r[:, :, 0]
    slopes = np.moveaxis((r[:, :, 1:] - base[:, :, None]) / bump * free, 1, 0)
    turned = slopes.transpose(0, 2, 1)
    return (base**2).sum(axis=0), np.matmul(turned, slopes), np.matmul(turned, base.T[:, :, None])[:, :, 0]


def blocks(rows: np.ndarray, deepest: int, first: int = 0):
    """``(place, rows with context)`` of consecutive parts; ``rows`` starts with the context."""
    for at in range(0, len(rows) - deepest, BLOCK):
        yield first + at, rows[at : at + BLOCK + deepest]


def series_sums(family: Family, rows: np.ndarray, at: np.ndarray, bump: float, first: int = 0, start: np.ndarray | None = None):
    """``normal_sums`` over all ``rows`` (context first), in parts that fit in memory, and the last errors."""
    params = family.copies(at, bump)
    state = np.zeros((family.deepest, len(params))) if start is None else start
    total = None
    for place, part in blocks(rows, family.deepest, first):
        errors, state = family.errors(params, part, place, state)
        sums = normal_sums(errors, len(at), bump, family.free)
        total = sums if total is None else tuple(a + b for a, b in zip(total, sums))
    return total, state


def ends(family: Family, rows: np.ndarray, at: np.ndarray, bump: float, first: int) -> np.ndarray:
    """The last errors ``(deepest, copies)`` behind ``rows`` if there were none before."""
    params = family.copies(at, bump)
    state = np.zeros((family.deepest, len(params)))
    for place, part in blocks(rows, family.deepest, first):
        own = family.inputs(params, part, place)
        _, state = lag_errors(own, family.lags, family.terms(params)[1], state)
    return state


def moved(family: Family, at: np.ndarray, bump: float, steps: int, state: np.ndarray) -> np.ndarray:
    """The last errors after ``steps`` rows without input behind ``state``."""
    ma = family.terms(family.copies(at, bump))[1]
    if not ma.any():
        return np.zeros_like(state)
    deepest, size = family.deepest, state.shape[1]
    power = np.zeros((size, deepest, deepest))
    power[:, np.arange(deepest - 1), np.arange(1, deepest)] = 1.0
    for lag, weight in zip(family.lags, ma):
        power[:, -1, deepest - lag] -= weight
    result = state.T[:, :, None]
    while steps:
        if steps & 1:
            result = power @ result
        power = power @ power
        steps >>= 1
    return result[:, :, 0].T
