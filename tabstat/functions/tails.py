"""Tail probabilities as column expressions.

They are evaluated in the JVM by the Apache Commons Math library that Spark
ships, called through the built-in ``try_reflect`` SQL function. They are meant
for result rows (tens), not for table rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = "org.apache.commons.math3.special."


def _call(cls: str, method: str, *args: Column) -> Column:
    args = [a.cast("double") for a in args]
    value = F.try_reflect(F.lit(_SPECIAL + cls), F.lit(method), *args).cast("double")
    ok = F.lit(True)
    for a in args:
        ok = ok & a.isNotNull()
    return F.when(ok, value)


def normal_two_sided(z: Column) -> Column:
    return _call("Erf", "erfc", F.abs(z) / math.sqrt(2.0))


def normal_cdf(z: Column) -> Column:
    return _call("Erf", "erfc", -z / math.sqrt(2.0)) / 2.0


def t_two_sided(t: Column, dof: Column) -> Column:
    dof = dof.cast("double")
    return _call("Beta", "regularizedBeta", F.try_divide(dof, dof + t * t), dof / 2.0, F.lit(0.5))


def f_upper(f: Column, d1: Column, d2: Column) -> Column:
    d1, d2 = d1.cast("double"), d2.cast("double")
    return _call("Beta", "regularizedBeta", F.try_divide(d2, d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def chi2_upper(x: Column, dof: Column) -> Column:
    p = _call("Gamma", "regularizedGammaQ", dof.cast("double") / 2.0, x / 2.0)
    return F.when(dof == 0, F.lit(1.0)).otherwise(p)
