"""Leading eigenpairs of a symmetric matrix by spectrum slicing, each on its own.

The inertia of ``V - s I`` (signs of D in its LDL^T factors) counts the eigenvalues above s. Bisection
on that count isolates the k-th largest eigenvalue without knowing any other, Rayleigh quotient
iteration closes in on it, and two last counts, just above and just below, certify its number.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(float).eps)
#: Eigenvalues nearer than this share of the norm are solved together, as one subspace.
CLUSTER = 1e-11
GROWTH = (1 + math.sqrt(17)) / 8


def count_above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``v`` above ``shift``: positive pivots of LDL^T with 1x1 and 2x2 pivots (Bunch-Kaufman)."""
    a = v - shift * np.eye(len(v))
    tiny = EPS * (np.abs(v).max(initial=0.0) + abs(shift)) or EPS
    positive, n, k = 0, len(a), 0
    while k < n:
        col = np.abs(a[k + 1:, k])
        two = False
        if len(col) and (most := col.max()) > 0:
            r = k + 1 + int(col.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            if abs(a[k, k]) * row.max() < GROWTH * most * most:
                if abs(a[r, r]) >= GROWTH * row.max():
                    _swap(a, k, r)
                else:
                    _swap(a, k + 1, r)
                    two = True
        if two:     # a 2x2 pivot of this kind always has one eigenvalue of each sign
            positive += 1
            block = a[k + 2:, k:k + 2]
            a[k + 2:, k + 2:] -= block @ np.linalg.solve(a[k:k + 2, k:k + 2], block.T)
            k += 2
        else:
            d = a[k, k] if abs(a[k, k]) > tiny * EPS else -tiny
            positive += d > 0
            a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k] / d, a[k + 1:, k])
            k += 1
    return positive


def _swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


def eigenpair(v: np.ndarray, k: int) -> tuple[float, np.ndarray, bool]:
    """The ``k``-th largest eigenvalue of ``v`` (from 1), its unit vector, and whether the counts certify the number.

    Members of a cluster that no shift in double precision separates are numbered by Ritz value; each call on a
    member finds the same subspace, so calls need not know of each other.
    """
    n = len(v)
    norm = float(np.abs(v).sum(1).max()) or 1.0
    lo, hi = -norm * (1 + 4 * EPS), norm * (1 + 4 * EPS)
    above_lo, above_hi = n, 0                                       # count(lo) >= k > count(hi)
    while hi - lo > CLUSTER * norm:
        if above_lo == k and above_hi == k - 1 and (pair := _rayleigh(v, lo, hi, norm)) is not None:
            value, vector, slack = pair
            sure = count_above(v, value - slack) >= k > count_above(v, value + slack)
            if sure:
                return value, vector, True
        mid = (lo + hi) / 2
        c = count_above(v, mid)
        if c >= k:
            lo, above_lo = mid, c
        else:
            hi, above_hi = mid, c
    return _cluster(v, k, lo, hi, above_hi, norm)


def _rayleigh(v: np.ndarray, lo: float, hi: float, norm: float):
    """Rayleigh quotient iteration from the middle of an interval with one eigenvalue: (value, vector,
    bound of the error), or None if it left the interval."""
    eye, x = np.eye(len(v)), _start(len(v), 1)[:, 0]
    shift = (lo + hi) / 2
    for turn in range(40):
        x = _solved(v, shift, x, norm, eye)
        value = float(x @ v @ x)
        if not lo <= value <= hi:
            return None
        rest = float(np.linalg.norm(v @ x - value * x))
        if rest <= 8 * EPS * norm * math.sqrt(len(v)):
            return value, x, max(rest, 4 * EPS * norm * len(v))
        if turn >= 2:       # the first solves keep the middle as shift, to fall into the right direction
            shift = value
    return None


def _cluster(v: np.ndarray, k: int, lo: float, hi: float, above: int, norm: float) -> tuple[float, np.ndarray, bool]:
    """The k-th pair from the joint subspace of all eigenvalues that lie within ``CLUSTER`` of [lo, hi]."""
    mid, gap = (lo + hi) / 2, 4 * CLUSTER * norm
    while True:             # the edges must lie in gaps, so that all members see the same subspace
        first, last = count_above(v, mid + gap), count_above(v, mid - gap)
        if (first, last) == (count_above(v, mid + 2 * gap), count_above(v, mid - 2 * gap)):
            break
        gap *= 2
    size, eye = last - first, np.eye(len(v))
    q = _start(len(v), size)
    for _ in range(4):
        q = np.linalg.qr(_solved(v, mid, q, norm, eye))[0]
    # Ritz pairs: the projected matrix is as small as the cluster
    values, turn = np.linalg.eigh(q.T @ v @ q)
    at = size - 1 - (k - 1 - first)
    vector = q @ turn[:, at]
    return float(values[at]), vector, first < k <= last


def _start(n: int, size: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(1).standard_normal((n, size)))[0]


def _solved(v, shift, x, norm, eye) -> np.ndarray:
    """A step of inverse iteration, scaled to norm 1; a shift that hits an eigenvalue is lifted by a rounding error."""
    for lift in (0.0, EPS * norm, 8 * EPS * norm):
        try:
            y = np.linalg.solve(v - (shift + lift) * eye, x)
        except np.linalg.LinAlgError:
            continue
        size = float(np.linalg.norm(y))
        if math.isfinite(size) and size > 0:
            return y / size
    return x
