"""Cubic interpolation with not-a-knot ends, as a dense solve over a few knots."""

from __future__ import annotations

import numpy as np


def cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at ``at`` of the not-a-knot cubic through (x, y); at least four knots."""
    n, h = len(x), np.diff(x)
    a, rhs = np.zeros((n, n)), np.zeros(n)
    slope = np.diff(y) / h
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 6 * (slope[i] - slope[i - 1])
    # the third derivative is continuous at the second and the last but one knot
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, rhs)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    left, right = at - x[i], x[i + 1] - at
    return (m[i] * right**3 + m[i + 1] * left**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * right + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * left
