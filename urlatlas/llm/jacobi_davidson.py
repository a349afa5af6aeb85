"""Jacobi-Davidson for the leading eigenpairs of a symmetric operator that is only known by its products.

The operator is a function ``product(block)`` that multiplies a ``d x b``
block; every call is one pass over the data, so all correction equations of a
step share their passes. What is held here is ``d`` times the size of the
search space, independent of the number of rows behind the operator.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

Product = Callable[[np.ndarray], np.ndarray]


class Eigenpairs(NamedTuple):
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int


def _away(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``block`` without its part in the span of the orthonormal ``basis`` (twice, against rounding)."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def _extend(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span ``block`` beyond ``basis``; columns that add nothing are left out."""
    new = np.zeros((len(basis), 0))
    for column in block.T:
        size = np.linalg.norm(column)
        if not np.isfinite(size) or size == 0:
            continue
        v = _away((column / size)[:, None], np.hstack([basis, new]))
        size = np.linalg.norm(v)
        if size > 1e-8:
            v = _away(v / size, np.hstack([basis, new]))
            new = np.hstack([new, v / np.linalg.norm(v)])
    return new


def minres(apply: Product, right: np.ndarray, steps: int, rtol: float) -> np.ndarray:
    """MINRES on the columns of ``right``, each a system of its own, side by side.

    ``apply(block)`` multiplies column ``j`` by the symmetric operator of
    system ``j``. Stops after ``steps`` or when every column's residual fell
    by ``rtol``; columns that ended early keep their solution.
    """
    n, b = right.shape
    x = np.zeros((n, b))
    beta = np.linalg.norm(right, axis=0)
    start = beta.copy()
    live = beta > 0
    v_old, v = np.zeros((n, b)), right / np.where(live, beta, 1)
    d_old, d_older = np.zeros((n, b)), np.zeros((n, b))
    c, s, c_old, s_old = np.ones(b), np.zeros(b), np.ones(b), np.zeros(b)
    eta, beta = beta.copy(), np.zeros(b)
    for _ in range(steps):
        if not live.any():
            break
        w = apply(v) - v_old * beta
        alpha = np.sum(w * v, axis=0)
        w = w - v * alpha
        beta_new = np.linalg.norm(w, axis=0)
        # Givens rotations of the last two steps applied to the new column of the tridiagonal matrix
        r3 = s_old * beta
        r2 = s * alpha + c_old * c * beta
        r1 = c * alpha - c_old * s * beta
        size = np.hypot(r1, beta_new)
        ok = live & (size > 0)
        inv = np.where(ok, 1 / np.where(size > 0, size, 1), 0)
        c_old, s_old = c, s
        c, s = np.where(ok, r1 * inv, 1), np.where(ok, beta_new * inv, 0)
        direction = (v - d_old * r2 - d_older * r3) * inv
        x = x + direction * np.where(ok, c * eta, 0)
        eta = np.where(ok, -s * eta, eta)
        d_older, d_old = d_old, direction
        live = ok & (np.abs(eta) > rtol * start) & (beta_new > 1e-14 * start)
        v_old, v = v, w / np.where(beta_new > 0, beta_new, 1)
        beta = beta_new
    return x


def leading_eigenpairs(product: Product, d: int, wanted: int, trace: float, block: int = 16, inner: int = 6,
                       tolerance: float | None = None, max_steps: int = 500) -> Eigenpairs:
    """The ``wanted`` largest eigenvalues (falling) and unit eigenvectors of a positive semi-definite operator.

    Each step takes Ritz pairs from the search space, locks the leading ones
    whose residual norm is within ``tolerance`` (default: double precision of
    the largest eigenvalue), solves the projected correction equations of the
    next ``block`` pairs by ``inner`` steps of MINRES, and extends the search
    space by the solutions. Beyond a bound the space is thinned to its leading
    Ritz vectors. The result is checked against all of the search space at
    every step, so a pair is locked only if no larger one is still open.
    ``trace`` bounds the eigenvalues (a zero trace has no pairs).
    """
    wanted = min(wanted, d)
    if wanted == 0 or not trace > 0:
        return Eigenpairs(np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0)
    calls = 0

    def times(m: np.ndarray) -> np.ndarray:
        nonlocal calls
        calls += 1
        return product(m)

    widest = min(d, max(3 * block, wanted + 2 * block))
    noise = np.random.default_rng(12)  # a fixed start: the same data give the same components
    locked, values = np.zeros((d, 0)), np.zeros(0)
    space = _extend(locked, noise.standard_normal((d, min(d, block))))
    image = times(space)
    for _ in range(max_steps):
        h = space.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-theta, kind="stable")
        theta, y = theta[order], y[:, order]
        space, image = space @ y, image @ y  # Ritz vectors and their products
        rest = image - space * theta
        rest = rest - locked @ (locked.T @ rest)
        size = np.linalg.norm(rest, axis=0)
        top = max(theta[0] if len(theta) else 0.0, values[0] if len(values) else 0.0)
        bound = tolerance if tolerance is not None else 4 * np.sqrt(d) * np.finfo(float).eps * top
        full = locked.shape[1] + space.shape[1] == d  # the space is everything: Ritz pairs are exact
        k = 0
        while k < len(theta) and locked.shape[1] + k < wanted and (size[k] <= bound or full):
            k += 1
        if k:
            locked, values = np.hstack([locked, space[:, :k]]), np.append(values, theta[:k])
            space, image, theta, rest = space[:, k:], image[:, k:], theta[k:], rest[:, k:]
        if locked.shape[1] == wanted:
            break
        open_pairs = min(block, len(theta), max(1, d - locked.shape[1] - space.shape[1]))
        if open_pairs:
            u, shift, right = space[:, :open_pairs], theta[:open_pairs], -rest[:, :open_pairs]
            near = np.hstack([locked, u])

            def corrected(m: np.ndarray) -> np.ndarray:
                m = _away(m, near)
                return _away(times(m) - m * shift, near)

            more = minres(corrected, _away(right, near), inner, 1e-2)
            more = np.hstack([more, right])  # the residual itself, for a correction that stalled
        else:
            more = noise.standard_normal((d, block))
        if space.shape[1] + open_pairs > widest - locked.shape[1] and not full:
            keep = max(widest - locked.shape[1] - 2 * block, open_pairs + 1, 1)
            space, image = space[:, :keep], image[:, :keep]
        new = _extend(np.hstack([locked, space]), more)[:, :d - locked.shape[1] - space.shape[1]]
        if not new.shape[1]:
            new = _extend(np.hstack([locked, space]), noise.standard_normal((d, block)))
            if not new.shape[1]:
                break
        space, image = np.hstack([space, new]), np.hstack([image, times(new)])
    else:
        raise ArithmeticError(f"{wanted - locked.shape[1]} eigenpairs did not reach residual {bound}")
    # the larger value first, also where rounding let two close pairs be locked the other way round
    order = np.argsort(-values, kind="stable")
    locked, values = locked[:, order], values[order]
    rest = times(locked) - locked * values
    return Eigenpairs(values, locked, np.linalg.norm(rest, axis=0), calls)
