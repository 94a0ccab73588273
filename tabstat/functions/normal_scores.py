"""The quantile function of the standard normal law for table rows: plain arithmetic that stays in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rational approximations published as AS 241 (Wichura 1988), relative error about 1e-16.
# Coefficients from the highest power down: numerator and denominator of each of the three ranges.
CENTRE = ([2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125,
           1971.5909503065514427, 133.14166789178437745, 3.387132872796366608],
          [5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077,
           687.1870074920579083, 42.313330701600911252, 1.0])
MIDDLE = ([7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504,
           5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734],
          [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455,
           1.6763848301838038494, 2.05319162663775882187, 1.0])
TAIL = ([2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123,
         1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772],
        [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525,
         0.13692988092273580531, 0.59983220655588793769, 1.0])


def _ratio(parts: tuple[list[float], list[float]], r: str) -> str:
    """Both polynomials by Horner's rule; numbers in exponent form are doubles in every dialect."""
    top, bottom = (reduce(lambda a, c: f"({a} * {r} + {c:.17e})", p[1:], f"{p[0]:.17e}") for p in parts)
    return f"{top} / {bottom}"


def normal_quantile_sql(p: str) -> str:
    """SQL text, for Spark and others alike, of the quantile at the probability ``p`` (a column name); null outside 0 to 1."""
    r = f"sqrt(-ln(least({p}, 1e0 - {p})))"
    return (f"CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN abs({p} - 0.5e0) <= 0.425e0 THEN ({p} - 0.5e0) * {_ratio(CENTRE, f'(0.180625e0 - ({p} - 0.5e0) * ({p} - 0.5e0))')}"
            f" ELSE (CASE WHEN {p} < 0.5e0 THEN -1e0 ELSE 1e0 END) * CASE WHEN {r} <= 5e0 THEN {_ratio(MIDDLE, f'({r} - 1.6e0)')} ELSE {_ratio(TAIL, f'({r} - 5e0)')} END END END")


def normal_quantile(p: str) -> Column:
    """The quantile at the probabilities of a column."""
    return F.expr(normal_quantile_sql(f"`{p}`"))
