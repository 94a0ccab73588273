"""Quantiles of the t law and the studentized range, for result rows only."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_erf = np.vectorize(math.erf, otypes=[float])


def normal_quantile(p: float) -> float:
    from statistics import NormalDist
    return NormalDist().inv_cdf(p)


def t_upper_area(t: float, dof: float) -> float:
    """P(T > t) for t >= 0 by quadrature over theta = atan(t / sqrt(dof))."""
    nodes, weights = np.polynomial.legendre.leggauss(80)
    # mass sits within a few standard deviations: integrate the density on [0, t]
    x = (nodes + 1) / 2 * t
    logc = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi)
    dens = np.exp(logc - (dof + 1) / 2 * np.log1p(x * x / dof))
    return 0.5 - float(np.sum(weights * dens)) * t / 2


def t_quantile(p: float, dof: float) -> float:
    """Upper quantile for p >= 0.5."""
    if dof > 1e7:
        z = normal_quantile(p)
        return z + (z ** 3 + z) / (4 * dof)
    lo, hi = 0.0, 1.0
    while t_upper_area(hi, dof) > 1 - p and hi < 1e6:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_upper_area(mid, dof) > 1 - p else (lo, mid)
    return (lo + hi) / 2


_Z, _ZW = np.polynomial.legendre.leggauss(120)
_Z, _ZW = _Z * 8.5, _ZW * 8.5
_PHI = np.exp(-_Z * _Z / 2) / math.sqrt(2 * math.pi)
_CDF = (1 + _erf(_Z / math.sqrt(2))) / 2


def _range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals <= w)."""
    lower = (1 + _erf((_Z[None, :] - w[:, None]) / math.sqrt(2))) / 2
    inner = np.clip(_CDF[None, :] - lower, 0, 1) ** (k - 1)
    return k * np.sum(_ZW * _PHI * inner, axis=1)


def studentized_range_sf(q: float, k: int, dof: float) -> float:
    """P(Q > q) for k means and dof residual degrees of freedom."""
    if not (q > 0 and k >= 2 and dof > 0) or not math.isfinite(q):
        return float("nan") if not q == 0 else 1.0
    if dof > 2e5:
        return float(max(0.0, 1 - _range_cdf(np.array([q]), k)[0]))
    sd = 1 / math.sqrt(2 * dof)
    lo, hi = max(1e-8, 1 - 9 * sd), 1 + (9 if dof > 10 else 14) * sd
    x, wx = np.polynomial.legendre.leggauss(64)
    s = lo + (x + 1) / 2 * (hi - lo)
    logd = (dof / 2 * math.log(dof) - math.lgamma(dof / 2) - (dof / 2 - 1) * math.log(2)
            + (dof - 1) * np.log(s) - dof * s * s / 2)
    dens = np.exp(logd) * wx * (hi - lo) / 2
    return float(min(1.0, max(0.0, np.sum(dens * (1 - _range_cdf(q * s, k))))))


def studentized_range_quantile(p: float, k: int, dof: float) -> float:
    """q with P(Q <= q) = p, by bisection."""
    lo, hi = 0.0, 4.0
    while studentized_range_sf(hi, k, dof) > 1 - p and hi < 1e4:
        hi *= 2
    for _ in range(45):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if studentized_range_sf(mid, k, dof) > 1 - p else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def range_tail(q: pd.Series, k: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([studentized_range_sf(a, int(b), c) if pd.notna(a) and pd.notna(c) else None
                      for a, b, c in zip(q, k, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def range_point(p: pd.Series, k: pd.Series, dof: pd.Series) -> pd.Series:
    seen: dict = {}
    out = []
    for a, b, c in zip(p, k, dof):
        key = (a, int(b), c)
        if key not in seen:
            seen[key] = studentized_range_quantile(*key)
        out.append(seen[key])
    return pd.Series(out, dtype="float64")
