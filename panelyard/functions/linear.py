"""Normal-equation systems of a few terms, in numpy."""

from __future__ import annotations

import numpy as np


def pairs(k: int) -> list[tuple[int, int]]:
    """Upper-triangle index pairs of the response (0) and k terms."""
    return [(i, j) for i in range(k + 1) for j in range(i, k + 1)]


def solve(matrix: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solve a normal-equation system; collinear terms are an error."""
    scale = np.sqrt(np.diag(matrix))
    if not np.all(scale > 0) or np.linalg.cond(matrix / np.outer(scale, scale)) > 1e12:
        raise ValueError("terms are constant or collinear")
    scaled = matrix / np.outer(scale, scale)
    rhs = np.asarray(rhs)
    divide = scale if rhs.ndim == 1 else scale[:, None]
    return np.linalg.solve(scaled, rhs / divide) / divide


def inverse(matrix: np.ndarray) -> np.ndarray:
    return solve(matrix, np.eye(len(matrix)))
