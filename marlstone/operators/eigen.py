"""Leading eigenpairs of a matrix that is only known by its products with blocks of vectors (LOBPCG)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Residual over the largest eigenvalue: what is aimed at, what is certified at least; and products at most.
AIM, CERTIFIED, STEPS = 2e-15, 1e-11, 500


def orthonormal(base: np.ndarray, block: np.ndarray) -> np.ndarray:
    """base with the directions of block that it lacks; base is orthonormal."""
    norms = np.linalg.norm(block, axis=0)
    new = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        new = new - base @ (base.T @ new)
    if not new.shape[1]:
        return base
    u, s, _ = np.linalg.svd(new, full_matrices=False)
    u = u[:, s > 1e-10]
    u = u - base @ (base.T @ u)
    return np.linalg.qr(np.hstack([base, u]))[0][:, : min(len(base), base.shape[1] + u.shape[1])] if u.shape[1] else base


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, want: int, block: int = 16, seed: int = 17, aim: float = AIM, certified: float = CERTIFIED) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(eigenvalues falling, eigenvectors as columns, worst certified residual over the largest eigenvalue, products made).

    product(B) is a symmetric, positive semi-definite d x d matrix times a d x m block. Every Rayleigh-Ritz problem, on iterate,
    residual and previous direction, is solved on an orthonormal basis whose product is made anew, so no error of earlier
    steps is carried on. The driver holds d x 3m numbers.
    """
    m = min(d, max(want, block))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, m)))[0]
    x, best, made, since = None, (np.inf, None, None), 0, 0
    while made < STEPS:
        image = product(basis)
        made += 1
        t = basis.T @ image
        values, c = np.linalg.eigh((t + t.T) / 2)
        values, c = values[::-1][:m], c[:, ::-1][:, :m]
        new, image = basis @ c, image @ c
        residual = image - new * values
        top = max(values[0], 0.0)
        worst = float(np.linalg.norm(residual[:, :want], axis=0).max() / top) if top > 0 else 0.0
        since = 0 if worst < 0.5 * best[0] else since + 1
        if worst < best[0]:
            best = (worst, values, new)
        # the whole space is settled by its first problem; else until rounding stops the fall
        if worst <= aim or basis.shape[1] == d or (since >= 3 and best[0] <= certified):
            break
        previous = new - x @ (x.T @ new) if x is not None else new[:, :0]
        x = np.linalg.qr(new)[0]
        basis = orthonormal(orthonormal(x, residual), previous)
    worst, values, vectors = best
    if worst > certified:
        raise ArithmeticError(f"residual {worst:.1e} after {made} products")
    return values[:want], vectors[:, :want], worst, made
