"""Collinearity, correlation and normality checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import normal_cdf, ratio
from .ranks import cumulative_counts, exact_quantiles, with_group_totals


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def _pairs(columns: Sequence[str]) -> list[tuple[int, int]]:
    return [(a, b) for a in range(len(columns)) for b in range(a, len(columns))]


def cross_moments(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> np.ndarray:
    """(Weighted) covariance matrix, p x p, from one aggregate over the rows.

    With weights the columns are centred at their weighted means first.
    """
    cols = list(columns)
    if weight is None:
        row = df.agg(*[F.covar_pop(cols[a], cols[b]).alias(f"m{a}_{b}") for a, b in _pairs(cols)]).first()
    else:
        w = F.col(weight)
        means = df.agg(F.struct(*[ratio(F.sum(w * F.col(c)), F.sum(w)).alias(c) for c in cols])).scalar()
        centred = df.select(w.alias("_w"), *[(F.col(c) - means.getField(c)).alias(c) for c in cols])
        row = centred.agg(
            *[ratio(F.sum(F.col("_w") * F.col(cols[a]) * F.col(cols[b])), F.sum("_w")).alias(f"m{a}_{b}") for a, b in _pairs(cols)]
        ).first()
    m = np.empty((len(cols), len(cols)))
    for a, b in _pairs(cols):
        v = row[f"m{a}_{b}"]
        m[a, b] = m[b, a] = np.nan if v is None else v
    return m


def means_and_moments(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, float], np.ndarray]:
    """Means and covariance matrix from one aggregate over the rows."""
    cols = list(columns)
    row = df.agg(
        *[F.avg(c).alias(f"a{i}") for i, c in enumerate(cols)], *[F.covar_pop(cols[a], cols[b]).alias(f"m{a}_{b}") for a, b in _pairs(cols)]
    ).first()
    m = np.empty((len(cols), len(cols)))
    for a, b in _pairs(cols):
        v = row[f"m{a}_{b}"]
        m[a, b] = m[b, a] = 0.0 if v is None else v
    return {c: 0.0 if row[f"a{i}"] is None else row[f"a{i}"] for i, c in enumerate(cols)}, m


def correlation_matrix(m: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(m))
    return m / np.outer(sd, sd)


def vif(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """Variance inflation factors: diagonal of the inverse correlation matrix.

    Complete rows only. For a generalised linear model pass the fitted mean as
    ``weight``. Only the p x p moments reach the driver.
    """
    need = [*columns, *([weight] if weight else [])]
    r = correlation_matrix(cross_moments(complete_rows(df, need), columns, weight))
    values = np.diag(np.linalg.inv(r))
    return df.sparkSession.createDataFrame(
        [(c, float(v)) for c, v in zip(columns, values)], "term string, vif double"
    )


def correlations(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Correlation matrix on complete rows as (x, y, r), rounded; one aggregate."""
    cols = list(columns)
    pairs = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.corr(a, b).alias("r")) for a in cols for b in cols
    ]
    return (
        complete_rows(df, cols)
        .agg(F.array(*pairs).alias("p"))
        .select(F.explode("p").alias("p"))
        .select("p.x", "p.y", F.round("p.r", digits).alias("r"))
    )


def _kolmogorov_p(d, n, terms: int = 100):
    """Asymptotic p-value ``2 sum (-1)^(k-1) exp(-2 k^2 n d^2)``, kept in [0, 1]."""
    k = F.sequence(F.lit(1), F.lit(terms))
    term = lambda acc, i: acc + F.when(i % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * i * i * n * d * d)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(k, F.lit(0.0), term)))


def kolmogorov_cdf(n: int, d: float) -> float:
    """P(D_n < d), exact: the middle entry of the n-th power of a banded matrix
    (Marsaglia, Tsang and Wang, 2003), scaled as it grows."""
    if d <= 0.5 / n:
        return 0.0
    if d >= 1:
        return 1.0
    k = int(n * d) + 1
    h, m = k - n * d, 2 * k - 1
    factorial = np.array([math.factorial(i) for i in range(m + 2)], float)
    i, j = np.indices((m, m))
    step = np.tril(np.ones((m, m)), 1)
    powers = h ** np.arange(1, m + 1)
    step[:, 0] -= powers
    step[-1] -= powers[::-1]
    step[-1, 0] += max(2 * h - 1, 0.0) ** m
    step /= np.where(i - j + 1 > 0, factorial[np.maximum(i - j + 1, 0)], 1.0)
    power, exponent, out, shift = step, 0, np.eye(m), 0
    left = n
    while left:
        if left & 1:
            out, shift = out @ power, shift + exponent
        power, exponent, left = power @ power, 2 * exponent, left >> 1
        if power[k - 1, k - 1] > 1e140:
            power, exponent = power / 1e140, exponent + 140
        if out[k - 1, k - 1] > 1e140:
            out, shift = out / 1e140, shift + 140
    return float(min(1.0, math.exp(math.log(out[k - 1, k - 1]) + shift * math.log(10) + math.lgamma(n + 1) - n * math.log(n))))


@F.pandas_udf(T.DoubleType())
def _exact_p(n: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(k) else 1 - kolmogorov_cdf(int(k), float(x)) for k, x in zip(n, d)], dtype="float64")


#: Groups of fewer values, without ties, get the exact distribution.
EXACT = 100


def ks_normal(df: DataFrame, value: str, by: Sequence[str] = (), exact: int = EXACT) -> DataFrame:
    """One-sample Kolmogorov-Smirnov distance from N(mean, sd) per group.

    Ties and hot groups are handled by exact distributed cumulative counts. The
    p-value is that of the exact distribution in groups of fewer than ``exact``
    values without ties, else that of the asymptotic series; ``method`` says which.
    """
    by = list(by)
    known = df.where(F.col(value).isNotNull()).select(*by, value)
    counts = cumulative_counts(known, value, by)
    n, mean = F.sum("n"), F.sum(F.col(value) * F.col("n")) / F.sum("n")
    stats = with_group_totals(counts, by, {"_m": mean}) if by else counts.withColumn("_m", counts.agg(mean).scalar())
    dev = F.sum(F.col("n") * F.pow(F.col(value) - F.col("_m"), 2))
    sd = F.sqrt(ratio(dev, n - 1))
    stats = with_group_totals(stats, by, {"_sd": sd}) if by else stats.withColumn("_sd", stats.agg(sd).scalar())
    cdf = normal_cdf(ratio(F.col(value) - F.col("_m"), "_sd"))
    gap = F.greatest(F.col("cum") / F.col("total") - cdf, cdf - (F.col("cum") - F.col("n")) / F.col("total"))
    out = stats.groupBy(*by).agg(F.max("total").alias("n"), F.max(gap).alias("d"), F.max("n").alias("_ties"))
    small = (F.col("n") < exact) & (F.col("_ties") == 1)
    series = _kolmogorov_p(F.col("d"), F.col("n"))
    return out.withColumn("_e", _exact_p(F.when(small, F.col("n")), F.when(small, F.col("d")))).select(
        *by, "n", "d", F.when(small, F.col("_e")).otherwise(series).alias("p_value"), F.when(small, "exact").otherwise("asymptotic").alias("method")
    )


def jarque_bera(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Jarque-Bera statistic and its chi-square (2 df) p-value."""
    s, k, n = F.skewness(value), F.kurtosis(value), F.count(value)
    out = df.groupBy(*by).agg((n / 6 * (s * s + k * k / 4)).alias("jb"))
    return out.select(*by, "jb", F.exp(-F.col("jb") / 2).alias("p_value"))


def sample_skewness(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Skewness with the divisor-by-sd convention: ``g1 * ((n-1)/n)^1.5``."""
    n = F.count(value)
    return df.groupBy(*by).agg((F.skewness(value) * F.pow((n - 1) / n, F.lit(1.5))).alias("skewness"))


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal-width bins over the whole range; the last bin is closed.

    Every group has all bins, empty ones with 0. Values that are all equal fall in
    the first bin; without values there is no row.
    """
    rng = df.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))).scalar()
    lo, hi = rng.getField("lo"), rng.getField("hi")
    # the range as columns, so the scalar is computed once
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), lo.alias("_lo"), hi.alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.coalesce(F.least(F.floor(ratio(F.col("_v") - F.col("_lo"), width)), F.lit(bins - 1).cast("long")), F.lit(0).cast("long"))
    # all bins come out of one row per group: counts by bin as a map
    counts = d.groupBy(*by, b.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy(*by, "_lo", "_hi").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_c"))
    every = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")).alias("bin"))
    n = F.coalesce(F.try_element_at("_c", F.col("bin")), F.lit(0))
    return every.select(
        *by, "bin", (F.col("_lo") + F.col("bin") * width).alias("left"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("right"), n.cast("long").alias("n")
    )


def density(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 512, grid: int = 64) -> DataFrame:
    """Gaussian kernel density on an even grid per group.

    Rows are first counted in ``bins`` narrow bins of their group, so the kernel
    sums touch at most ``bins * grid`` pairs per group however large it is.
    Bandwidth: 0.9 * min(sd, IQR / 1.34) * n^(-1/5), with the sd alone where the
    IQR is 0 (the usual plotting default). A group of equal values has no density:
    its rows are NULL.
    """
    by = list(by)
    v = F.col(value).cast("double")
    known = df.where(v.isNotNull()).select(*by, v.alias("_v"))
    aggs = {"_lo": F.min("_v"), "_hi": F.max("_v"), "_n": F.count("_v"), "_sd": F.stddev_samp("_v")}
    if by:
        d = with_group_totals(known, by, aggs)
    else:
        s = known.agg(F.struct(*[a.alias(n) for n, a in aggs.items()])).scalar()
        d = known.select("*", *[s.getField(n).alias(n) for n in aggs])
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.least(F.floor(ratio(F.col("_v") - F.col("_lo"), width)), F.lit(bins - 1).cast("long"))
    binned = d.groupBy(*by, "_lo", "_hi", "_n", "_sd", b.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    quarters = exact_quantiles(known, "_v", {"_q1": 0.25, "_q3": 0.75}, by)
    if by:
        renamed = quarters.withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(by)})
        same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
        binned = binned.join(renamed, reduce(lambda a, c: a & c, same))
    else:
        both = quarters.agg(F.struct(F.max("_q1").alias("_q1"), F.max("_q3").alias("_q3"))).scalar()
        binned = binned.select("*", both.getField("_q1").alias("_q1"), both.getField("_q3").alias("_q3"))
    quarter = F.nullif((F.col("_q3") - F.col("_q1")) / F.lit(1.34), F.lit(0.0))
    spread = F.nullif(F.least("_sd", F.coalesce(quarter, "_sd")), F.lit(0.0))
    h = F.lit(0.9) * spread * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    # the columns of the sums below
    binned = binned.select(*by, "_lo", "_hi", "_n", "_b", "_c", h.alias("_h"))
    h = F.col("_h")
    x = F.col("_lo") - 3 * h + F.col("_g") * (F.col("_hi") - F.col("_lo") + 6 * h) / F.lit(float(grid - 1))
    centre = F.col("_lo") + (F.col("_b") + 0.5) * width
    z = ratio(x - centre, h)
    kernel = F.col("_c") * F.exp(-z * z / 2) / F.lit((2 * np.pi) ** 0.5)
    return (
        binned.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
        .groupBy(*by, F.col("_g").alias("grid"), x.alias("x"))
        .agg(ratio(F.sum(kernel), F.max(F.col("_n") * h)).alias("density"))
    )
