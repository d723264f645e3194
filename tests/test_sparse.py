"""Sparse factors and power flow on networks too large for dense matrices."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from gridweave.kernels import powerflow as K
from gridweave.kernels.sparse import Factors, Matrix
from gridweave.operators.powerflow import case_of


@pytest.mark.parametrize("kind", ["chain", "mesh", "permuted", "tiny diagonal"])
def test_solves_as_dense(kind):
    rng, n = np.random.default_rng(2), 900
    a, b = np.arange(n - 1), np.arange(1, n)
    if kind == "mesh":
        a, b = np.r_[a, np.arange(n - 30)], np.r_[b, np.arange(30, n)]
    m = np.zeros((n, n))
    m[a, b], m[b, a] = rng.normal(size=len(a)), rng.normal(size=len(a))
    m[np.arange(n), np.arange(n)] = 1e-12 * rng.random(n) if kind == "tiny diagonal" else 4 + rng.random(n)
    m = m[rng.permutation(n)] if kind == "permuted" else m
    x = rng.normal(size=n)
    got = Factors(Matrix.of(m)).solve(m @ x)
    assert np.abs(m @ got - m @ x).max() < 1e-6 * max(1, np.abs(got).max())


def test_empty_rows_are_singular():
    m = np.eye(500)
    m[3, 3] = 0
    with pytest.raises(np.linalg.LinAlgError):
        Factors(Matrix.of(m))


def chain(n, extra=0):
    rng = np.random.default_rng(1)
    k = np.arange(1, n + 1)
    kind = np.where(k == 1, 3, np.where(k % 4 == 0, 2, 1))
    # injections that a long chain can carry
    buses = pd.DataFrame({"id": k * 3, "kind": kind, "p": np.where(kind == 2, 0.006, -0.004), "q": np.where(kind == 1, -0.001, 0.0), "vm": 1.0})
    a, b = np.r_[k[:-1], rng.integers(1, n + 1, extra)] * 3, np.r_[k[1:], rng.integers(1, n + 1, extra)] * 3
    return case_of(buses, pd.DataFrame({"a": a, "b": b, "r": 0.001, "x": 0.004}))[0]


@pytest.mark.parametrize("name", sorted(K.METHODS))
def test_large_region_by_every_method(name):
    """6000 buses: a dense complex matrix alone would be 576 MB."""
    c = chain(6000)
    tracemalloc.start()
    K.method(name).solve(c, 1e-8, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


@pytest.mark.parametrize("extra", [0, 60])
def test_methods_agree_on_a_region_of_sparse_factors(extra):
    c = chain(300, extra)
    want = K.newton(c, 1e-10, 20)
    assert want.converged
    # by its own definition, not by the entries that the solvers share
    y = c.y.dense()
    d = want.v * np.conj(y @ want.v) - c.s
    assert np.abs(np.r_[d[c.free].real, d[c.pq].imag]).max() < 1e-9
    for name in ("newton_line_search", "newton_iwamoto", "newton_rectangular", "newton_current", "newton_dishonest", "newton_levenberg", "fast_decoupled_bx", "fast_decoupled_xb", "newton_decoupled", "continuation"):
        got = K.method(name).solve(c, 1e-9, 200)
        assert got.converged and np.abs(got.v - want.v).max() < 1e-5, (name, got.reason)
