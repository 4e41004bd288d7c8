"""Tails at degrees of freedom of very large tables."""

import math

import pytest

from panelyard.functions.tails import chi2_tail, f_tail, t_tail


@pytest.mark.parametrize("df", [1e5, 1e6, 1e8, 1e10, 1e12, 1e14, 1e15, 1e17])
@pytest.mark.parametrize("s", [0.1, 1.0, 1.5, 1.7, 2.0, 5.0])
def test_t_against_its_normal_expansion(df, s):
    density = math.exp(-s * s / 2) / math.sqrt(2 * math.pi)
    more = s * (s * s + 1) / (4 * df) + s * (3 * s**6 - 7 * s**4 - 5 * s * s - 3) / (96 * df * df)
    want = math.erfc(s / math.sqrt(2)) + 2 * density * more
    assert float(t_tail(s, df)) == pytest.approx(want, rel=1e-9 if df > 1e5 else 1e-6)


@pytest.mark.parametrize("df", [5, 1e3, 9_999, 10_001, 1e6, 1e9, 1e12, 1e15])
@pytest.mark.parametrize("f", [0.01, 0.5, 1.0, 3.0, 10.0])
def test_f_with_two_degrees_against_its_closed_form(df, f):
    assert float(f_tail(f, 2, df)) == pytest.approx(math.exp(-df / 2 * math.log1p(2 * f / df)), rel=1e-9)


@pytest.mark.parametrize("s", [0.1, 1.0, 3.0, 50.0])
def test_small_degrees_against_closed_forms(s):
    assert float(t_tail(s, 1)) == pytest.approx(1 - 2 * math.atan(s) / math.pi, rel=1e-10)
    assert float(t_tail(s, 2)) == pytest.approx(1 - s / math.sqrt(2 + s * s), rel=1e-8)


def test_chi_square_of_many_degrees_ends():
    assert float(chi2_tail(1e6 + 3000, 1e6)) == pytest.approx(0.01702, rel=1e-3)
    assert float(chi2_tail(4.0, 2)) == pytest.approx(math.exp(-2.0), rel=1e-12)
