"""AC and DC power flow on one island: Newton variants, Gauss-Seidel and Jacobi, decoupled methods.

A case is an admittance matrix Y (sparse or dense; all methods work on its entries), injections S (per unit), a start vector V and bus kinds.  Every
solver returns a Result and never raises on numerical trouble.  Stop rules: largest mismatch below
``tol``; divergence beyond ten times the first mismatch; not a number; a singular matrix.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from . import sparse
from .sparse import Factors, Matrix


@dataclass
class Case:
    y: np.ndarray | Matrix
    s: np.ndarray
    v: np.ndarray
    slack: np.ndarray
    pv: np.ndarray
    pq: np.ndarray

    @property
    def free(self) -> np.ndarray:
        return np.r_[self.pv, self.pq]


@dataclass
class Result:
    v: np.ndarray
    converged: bool
    iterations: int
    reason: str = ""
    history: list[float] = field(default_factory=list)


def mismatch(c: Case, v: np.ndarray, s: np.ndarray | None = None) -> np.ndarray:
    d = v * np.conj(c.y @ v) - (c.s if s is None else s)
    return np.r_[d[c.free].real, d[c.pq].imag]


def jacobian(c: Case, v: np.ndarray) -> Matrix:
    y, own = Matrix.of(c.y), np.arange(len(v))
    i, unit = y @ v, v / np.abs(v)
    row, col = np.r_[y.row, own], np.r_[y.col, own]
    by_angle = np.r_[-1j * v[y.row] * np.conj(y.val * v[y.col]), 1j * v * np.conj(i)]
    by_size = np.r_[v[y.row] * np.conj(y.val * unit[y.col]), np.conj(i) * unit]
    n, m = len(c.free), len(c.free) + len(c.pq)
    f, q = sparse.places(c.free, len(v)), sparse.places(c.pq, len(v))
    q = np.where(q < 0, q, q + n)
    return Matrix.joined((m, m), [(f[row], f[col], by_angle.real), (f[row], q[col], by_size.real), (q[row], f[col], by_angle.imag), (q[row], q[col], by_size.imag)])


def moved(c: Case, v: np.ndarray, step: np.ndarray) -> np.ndarray:
    angle, size, n = np.angle(v), np.abs(v), len(c.free)
    angle[c.free] += step[:n]
    size[c.pq] += step[n:]
    return size * np.exp(1j * angle)


def drive(c: Case, step: Callable[[int, np.ndarray, np.ndarray], np.ndarray], tol: float, most: int) -> Result:
    """Apply ``step`` (iteration, v, mismatch) -> v until a stop rule holds."""
    v, f = c.v.copy(), mismatch(c, c.v)
    history = [float(np.abs(f).max(initial=0))]
    for k in range(most + 1):
        if history[-1] < tol:
            return Result(v, True, k, "", history)
        if k == most:
            break
        try:
            with np.errstate(all="ignore"):
                v = step(k, v, f)
                f = mismatch(c, v)
        except np.linalg.LinAlgError:
            return Result(v, False, k, "singular matrix", history)
        history.append(float(np.abs(f).max(initial=0)))
        if not np.isfinite(history[-1]):
            return Result(v, False, k + 1, "not a number", history)
        if history[-1] > 10 * history[0]:
            return Result(v, False, k + 1, "diverged", history)
    return Result(v, False, most, "iteration limit", history)


def newton(c: Case, tol: float, most: int) -> Result:
    return drive(c, lambda k, v, f: moved(c, v, sparse.solve(jacobian(c, v), -f)), tol, most)


def newton_line_search(c: Case, tol: float, most: int) -> Result:
    def step(k: int, v: np.ndarray, f: np.ndarray) -> np.ndarray:
        d, a, n0 = sparse.solve(jacobian(c, v), -f), 1.0, np.linalg.norm(f)
        for _ in range(10):
            w = moved(c, v, a * d)
            if np.linalg.norm(mismatch(c, w)) <= (1 - 1e-4 * a) * n0:
                break
            a /= 2
        return w

    return drive(c, step, tol, most)


def newton_iwamoto(c: Case, tol: float, most: int) -> Result:
    def step(k: int, v: np.ndarray, f: np.ndarray) -> np.ndarray:
        d = sparse.solve(jacobian(c, v), -f)
        f0, half, one = (float(np.sum(mismatch(c, moved(c, v, a * d)) ** 2)) for a in (0.0, 0.5, 1.0))
        a, b = 2 * one + 2 * f0 - 4 * half, 4 * half - one - 3 * f0
        return moved(c, v, (np.clip(-b / (2 * a), 0.05, 1.0) if a > 1e-16 else 1.0) * d)

    return drive(c, step, tol, most)


def newton_dishonest(c: Case, tol: float, most: int) -> Result:
    held: dict[str, Factors] = {}

    def step(k: int, v: np.ndarray, f: np.ndarray) -> np.ndarray:
        if k % 3 == 0:
            held["j"] = Factors(jacobian(c, v))
        return moved(c, v, held["j"].solve(-f))

    return drive(c, step, tol, most)


def newton_levenberg(c: Case, tol: float, most: int) -> Result:
    state = {"l": 1e-3}

    def step(k: int, v: np.ndarray, f: np.ndarray) -> np.ndarray:
        j = jacobian(c, v)
        h, g, n0 = j.squared(), np.bincount(j.col, j.val * f[j.row], j.shape[1]), np.linalg.norm(f)
        own = np.arange(len(g))
        for _ in range(5):
            raised = Matrix(h.shape, np.r_[h.row, own], np.r_[h.col, own], np.r_[h.val, state["l"] * h.diagonal()])
            w = moved(c, v, sparse.solve(raised, -g))
            if np.linalg.norm(mismatch(c, w)) < n0:
                state["l"] = max(state["l"] / 10, 1e-12)
                break
            state["l"] = min(state["l"] * 10, 1e6)
        return w

    return drive(c, step, tol, most)


def newton_rectangular(c: Case, tol: float, most: int) -> Result:
    spec = np.abs(c.v)

    def step(k: int, v: np.ndarray, f_: np.ndarray) -> np.ndarray:
        y, free, own = Matrix.of(c.y), c.free, np.arange(len(v))
        i, n, m = y @ v, len(free), len(c.pq)
        row, col = np.r_[y.row, own], np.r_[y.col, own]
        real, imag = np.r_[v[y.row] * np.conj(y.val), np.conj(i)], np.r_[v[y.row] * np.conj(1j * y.val), 1j * np.conj(i)]
        f, q = sparse.places(free, len(v)), sparse.places(c.pq, len(v))
        q, right = np.where(q < 0, q, q + n), np.where(f < 0, f, f + n)
        last = n + m + np.arange(len(c.pv))
        j = Matrix.joined((2 * n, 2 * n), [(f[row], f[col], real.real), (f[row], right[col], imag.real), (q[row], f[col], real.imag), (q[row], right[col], imag.imag), (last, f[c.pv], 2 * v[c.pv].real), (last, right[c.pv], 2 * v[c.pv].imag)])
        d = sparse.solve(j, -np.r_[f_, np.abs(v[c.pv]) ** 2 - spec[c.pv] ** 2])
        v = v.copy()
        v[free] += d[: len(free)] + 1j * d[len(free) :]
        return v

    return drive(c, step, tol, most)


def newton_current(c: Case, tol: float, most: int) -> Result:
    """Current-injection form: PQ buses by current mismatch, PV buses by active power and size."""
    spec = np.abs(c.v)

    def step(k: int, v: np.ndarray, f: np.ndarray) -> np.ndarray:
        y, free, n = Matrix.of(c.y), c.free, len(c.free)
        i = y @ v
        s = c.s.copy()
        s[c.pv] = s[c.pv].real + 1j * (v * np.conj(i))[c.pv].imag
        d = i - np.conj(s / v)
        f, q, g = (sparse.places(x, len(v)) for x in (free, c.pq, c.pv))  # pv buses come first among the free
        q, col, below = np.where(q < 0, q, q + len(c.pv)), f[y.col], np.where(f < 0, f, f + n)
        right, w = below[y.col], (np.conj(s) / np.conj(v) ** 2)[c.pq]  # d conj(S/V) by conj(V), negative
        low, qr, row = np.where(q < 0, q, q + n), q[y.row], v[y.row] * np.conj(y.val)
        at, pq, lowq, sizes = g[y.row], f[c.pq], below[c.pq], below[c.pv]
        # a PV bus swaps its second row for the size equation and its first for power
        j = Matrix.joined((2 * n, 2 * n), [
            (qr, col, y.val.real), (qr, right, -y.val.imag), (low[y.row], col, y.val.imag), (low[y.row], right, y.val.real),
            (pq, pq, w.real), (pq, lowq, w.imag), (lowq, pq, w.imag), (lowq, lowq, -w.real),
            (at, col, row.real), (at, right, (v[y.row] * np.conj(1j * y.val)).real), (f[c.pv], f[c.pv], i[c.pv].real), (f[c.pv], sizes, i[c.pv].imag),
            (sizes, f[c.pv], 2 * v[c.pv].real), (sizes, sizes, 2 * v[c.pv].imag),
        ])
        rhs = np.r_[d[free].real, d[free].imag]
        rhs[f[c.pv]], rhs[sizes] = (v * np.conj(i) - c.s)[c.pv].real, np.abs(v[c.pv]) ** 2 - spec[c.pv] ** 2
        out = sparse.solve(j, -rhs)
        v = v.copy()
        v[free] += out[:n] + 1j * out[n:]
        return v

    return drive(c, step, tol, most)


def sweep(relax: float, at_once: bool) -> Callable[[Case, float, int], Result]:
    """Gauss-Seidel (each bus sees the new ones) or Jacobi, with a relaxation factor."""

    def solve(c: Case, tol: float, most: int) -> Result:
        size, y = np.abs(c.v).tolist(), Matrix.of(c.y)
        starts = np.searchsorted(y.row, np.arange(len(c.v) + 1)).tolist()
        near, ys, own, power = y.col.tolist(), y.val.tolist(), y.diagonal().tolist(), c.s.tolist()

        def step(k: int, v: np.ndarray, f: np.ndarray) -> np.ndarray:
            old, new = v.tolist(), v.tolist()
            for b in free:
                seen = old if at_once else new
                ybb = own[b]
                if abs(ybb) < 1e-20:
                    continue
                flow = sum(ys[e] * seen[near[e]] for e in range(starts[b], starts[b + 1]))
                s = power[b]
                if b in pv:
                    s = s.real + 1j * (seen[b] * flow.conjugate()).imag
                x = seen[b] + ((s / seen[b]).conjugate() - flow) / ybb
                x = seen[b] + relax * (x - seen[b])
                new[b] = x / abs(x) * size[b] if b in pv else x
            return np.array(new)

        pv, free = set(c.pv.tolist()), c.free.tolist()
        return drive(c, step, tol, most)

    return solve


def susceptance(y: Matrix) -> Matrix:
    """The negative imaginary part, its diagonal such that rows sum to zero."""
    b, off = -y.val.imag, y.row != y.col
    own = np.arange(y.shape[0])
    return Matrix(y.shape, np.r_[y.row[off], own], np.r_[y.col[off], own], np.r_[b[off], -np.bincount(y.row[off], b[off], len(own))])


def decoupled(variant: str) -> Callable[[Case, float, int], Result]:
    """Fast decoupled with constant matrices: BX ignores nothing in the second, XB in the first."""

    def solve(c: Case, tol: float, most: int) -> Result:
        y = Matrix.of(c.y)
        b, rowsum = Matrix(y.shape, y.row, y.col, -y.val.imag), susceptance(y)
        first, second = (rowsum, b) if variant == "bx" else (b, rowsum)
        held: list[Factors] = []

        def step(k: int, v: np.ndarray, f: np.ndarray) -> np.ndarray:
            n = len(c.free)
            if not held:
                held.extend((Factors(first.part(c.free, c.free)), Factors(second.part(c.pq, c.pq))))
            v = moved(c, v, np.r_[held[0].solve(-f[:n] / np.abs(v[c.free])), np.zeros(len(c.pq))])
            f = mismatch(c, v)
            return moved(c, v, np.r_[np.zeros(n), held[1].solve(-f[n:] / np.abs(v[c.pq]))]) if len(c.pq) else v

        return drive(c, step, tol, most)

    return solve


def newton_decoupled(c: Case, tol: float, most: int) -> Result:
    def step(k: int, v: np.ndarray, f: np.ndarray) -> np.ndarray:
        n = len(c.free)
        angles, sizes = np.arange(n), n + np.arange(len(c.pq))
        v = moved(c, v, np.r_[sparse.solve(jacobian(c, v).part(angles, angles), -f[:n]), np.zeros(len(c.pq))])
        f = mismatch(c, v)
        return moved(c, v, np.r_[np.zeros(n), sparse.solve(jacobian(c, v).part(sizes, sizes), -f[n:])]) if len(c.pq) else v

    return drive(c, step, tol, most)


def continuation(c: Case, tol: float, most: int) -> Result:
    """Load and generation are raised in steps; each is corrected by a few Newton steps."""
    steps, v, history, total = min(most, 10), c.v.copy(), [], 0
    for k in range(1, steps + 1):
        part = Case(c.y, c.s * k / steps, v, c.slack, c.pv, c.pq)
        r = newton(part, tol, max(most // steps, 3) if k < steps else most)
        total, v, history = total + r.iterations, r.v, history + r.history
        if not np.isfinite(r.history[-1]) or r.history[-1] > 1e3 * max(tol, 1e-3):
            return Result(v, False, total, "step failed", history)
    return Result(v, history[-1] < tol, total, "" if history[-1] < tol else "iteration limit", history)


def dc(y: np.ndarray | Matrix, p: np.ndarray, slack: int) -> np.ndarray:
    """Angles of the linear flow, zero at the slack."""
    keep = np.delete(np.arange(len(p)), slack)
    theta = np.zeros(len(p))
    if len(keep):
        theta[keep] = sparse.solve(susceptance(Matrix.of(y)).part(keep, keep), p[keep])
    return theta


@dataclass(frozen=True)
class Method:
    name: str
    category: str
    description: str
    solve: Callable[[Case, float, int], Result]


METHODS: dict[str, Method] = {}


def register(name: str, category: str, description: str, solve: Callable[[Case, float, int], Result]) -> None:
    """Add a solver; the category must be one of newton, iterative, decoupled."""
    if category not in ("newton", "iterative", "decoupled"):
        raise ValueError(f"unknown category {category}")
    METHODS[name] = Method(name, category, description, solve)


def method(name: str) -> Method:
    if name not in METHODS:
        raise KeyError(f"no method {name}; there are {sorted(METHODS)}")
    return METHODS[name]


def methods(category: str | None = None) -> list[Method]:
    rank = {"newton": 0, "iterative": 1, "decoupled": 2}
    return sorted((m for m in METHODS.values() if category in (None, m.category)), key=lambda m: (rank[m.category], m.name))


for _name, _category, _text, _solve in [
    ("newton", "newton", "full Newton-Raphson, polar", newton), ("newton_line_search", "newton", "backtracking line search", newton_line_search), ("newton_iwamoto", "newton", "optimal multiplier", newton_iwamoto),
    ("newton_rectangular", "newton", "rectangular coordinates", newton_rectangular), ("newton_current", "newton", "current injection", newton_current), ("newton_dishonest", "newton", "matrix kept for three steps", newton_dishonest),
    ("newton_levenberg", "newton", "Levenberg-Marquardt", newton_levenberg), ("gauss_seidel", "iterative", "Gauss-Seidel", sweep(1.0, False)), ("gauss_seidel_accelerated", "iterative", "factor 1.6", sweep(1.6, False)),
    ("jacobi", "iterative", "Jacobi", sweep(1.0, True)), ("gauss_seidel_sor", "iterative", "factor 1.5", sweep(1.5, False)), ("fast_decoupled_bx", "decoupled", "BX matrices", decoupled("bx")),
    ("fast_decoupled_xb", "decoupled", "XB matrices", decoupled("xb")), ("newton_decoupled", "decoupled", "angle and size in turn", newton_decoupled), ("continuation", "decoupled", "load raised in steps", continuation),
]:
    register(_name, _category, _text, _solve)
