"""NULL-safe arithmetic shared by every operator.

Spark runs with ANSI mode on, so a plain ``/`` by zero and a plain ``CAST`` of
bad text raise. The helpers below are the one place where those rules live.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den``; NULL where the denominator is zero or either side is NULL."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def add_all(cols: list[str | Column]) -> Column:
    """Sum of columns in which one NULL makes the result NULL."""
    return reduce(add, [as_col(c) for c in cols])


def zero_sum(c: str | Column) -> Column:
    """Sum that skips NULLs and is 0 for an all-NULL group."""
    return F.coalesce(F.sum(as_col(c)), F.lit(0))


def strict_sum(c: str | Column) -> Column:
    """Sum that is NULL as soon as one row of the group is NULL."""
    c = as_col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def strict_weighted_mean(x: str | Column, w: str | Column) -> Column:
    """``sum(x*w)/sum(w)``; NULL if any term of the group is NULL."""
    x, w = as_col(x).cast("double"), as_col(w).cast("double")
    return ratio(strict_sum(x * w), strict_sum(w))


def clamp_zero(c: str | Column) -> Column:
    """Negative values become 0, NULL stays NULL."""
    c = as_col(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def log_guard(c: str | Column, constant: float) -> Column:
    """``log(c + constant)``, the guard used for shares that can be zero."""
    return F.log(as_col(c).cast("double") + F.lit(float(constant)))


def per_unit(count: str | Column, size: str | Column, unit: float = 1.0) -> Column:
    """Density: ``unit * count / size`` (10,000 people, 1 square kilometre...)."""
    return ratio(F.lit(float(unit)) * as_col(count), size)


# Abramowitz & Stegun 7.1.26: fixed coefficients of the rational approximation.
_ERF_P = 0.3275911
_ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: str | Column) -> Column:
    """Standard normal distribution function, absolute error below 1.5e-7."""
    z = as_col(z)
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(_ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(_ERF_A):
        poly = (poly + F.lit(a)) * t
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.lit(0.5) * (F.lit(1.0) + F.when(z < 0, -erf).otherwise(erf))
