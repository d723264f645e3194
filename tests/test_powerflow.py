import numpy as np
import pytest

from gridweave.kernels import powerflow as K


def three_buses():
    """A slack, a PV and a PQ bus on lossy lines."""
    y = np.zeros((3, 3), complex)
    for a, b, z in ((0, 1, 0.02 + 0.08j), (1, 2, 0.02 + 0.08j), (0, 2, 0.03 + 0.12j)):
        y[a, a] += 1 / z
        y[b, b] += 1 / z
        y[a, b] -= 1 / z
        y[b, a] -= 1 / z
    i = lambda *x: np.array(x)
    return K.Case(y, np.array([0, 0.4, -0.6 - 0.2j]), np.array([1.02, 1.01, 1.0], complex), i(0), i(1), i(2))


@pytest.mark.parametrize("name", sorted(K.METHODS))
def test_methods_agree(name):
    c = three_buses()
    want = K.newton(c, 1e-10, 20)
    assert want.converged and want.iterations <= 5
    got = K.method(name).solve(c, 1e-8, 2000)  # the simple iterations need hundreds
    assert got.converged, (name, got.reason, got.history[-3:])
    assert np.abs(got.v - want.v).max() < 1e-5


def test_failures_are_results():
    c = three_buses()
    c.s = c.s * 100
    assert not K.newton(c, 1e-8, 20).converged
    c.y = c.y * 0
    assert K.newton(c, 1e-8, 20).reason in ("singular matrix", "not a number")
    with pytest.raises(KeyError):
        K.method("none")


def test_dc_balances():
    c = three_buses()
    theta = K.dc(c.y, c.s.real, 0)
    b = -c.y.imag
    flow = sum(-b[1, j] * 0 + (-b[1, j]) * (theta[1] - theta[j]) for j in (0, 2))
    assert abs(flow - c.s[1].real) < 1e-9
