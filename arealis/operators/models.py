"""Regression, principal-component index and Gaussian smoothing as Spark jobs.

These are the data-parallel parts of a latent Gaussian area-year model: fixed
effects, and the posterior mean of random effects at *given* precisions. They do
not estimate hyperparameters; results are therefore not those of a full Bayesian
fit.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from . import blocks
from .diagnostics import complete_rows, correlation_matrix, means_and_moments, vif
from .ranks import reliable_checkpoint, with_group_totals

# ------------------------------------------------------------------ fixed effects


@dataclass
class LinearFit:
    """Coefficients by term; ``intercept`` is the term '(Intercept)'."""

    terms: dict[str, float]

    @property
    def intercept(self) -> float:
        return self.terms["(Intercept)"]

    def linear_predictor(self) -> Column:
        out = F.lit(self.intercept)
        for term, b in self.terms.items():
            if term != "(Intercept)":
                out = out + F.lit(b) * F.col(term)
        return out

    def table(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in self.terms.items()], "term string, estimate double"
        )


def linear_regression(df: DataFrame, label: str, features: Sequence[str]) -> LinearFit:
    """Gaussian regression from the moments of one aggregate (complete rows)."""
    cols = [*features, label]
    means, m = means_and_moments(complete_rows(df, cols), cols)
    p = len(features)
    if p and not np.linalg.matrix_rank(m[:p, :p]) == p:
        raise ValueError(f"no unique fit: {list(features)} are linearly dependent or without rows")
    beta = np.linalg.solve(m[:p, :p], m[:p, p]) if p else np.empty(0)
    intercept = means[label] - sum(b * means[f] for b, f in zip(beta, features))
    return LinearFit({"(Intercept)": float(intercept), **{f: float(b) for f, b in zip(features, beta)}})


def poisson_regression(df: DataFrame, label: str, features: Sequence[str], offset: str, max_iter: int = 50, tol: float = 1e-10) -> LinearFit:
    """Poisson log-link regression with an offset column (complete rows)."""
    rows = complete_rows(df, [label, *features, offset])
    frame = VectorAssembler(inputCols=list(features), outputCol="_features").transform(
        rows.select(*features, F.col(label).cast("double").alias("_label"), F.col(offset).cast("double").alias("_offset"))
    )
    fit = GeneralizedLinearRegression(
        family="poisson",
        link="log",
        featuresCol="_features",
        labelCol="_label",
        offsetCol="_offset",
        maxIter=max_iter,
        tol=tol,
    ).fit(frame)
    if fit.summary.numIterations >= max_iter:
        raise RuntimeError(f"not converged: {max_iter} steps")
    return LinearFit(
        {"(Intercept)": float(fit.intercept), **{f: float(b) for f, b in zip(features, fit.coefficients.toArray())}}
    )


def poisson_vif(df: DataFrame, label: str, features: Sequence[str], offset: str) -> DataFrame:
    """Variance inflation of a Poisson regression: weighted by the fitted mean."""
    fit = poisson_regression(df, label, features, offset)
    rows = complete_rows(df, [label, *features, offset])
    return vif(rows.withColumn("_mu", F.exp(fit.linear_predictor() + F.col(offset))), features, "_mu")


# ------------------------------------------------------------ composite index


@dataclass
class Components:
    """Principal components of standardised columns. A missing value scores as
    the column's mean."""

    columns: list[str]
    mean: list[float]
    sd: list[float]
    vectors: np.ndarray
    eigenvalues: np.ndarray

    def score(self, k: int = 0) -> Column:
        out = F.lit(0.0)
        for c, m, s, v in zip(self.columns, self.mean, self.sd, self.vectors[:, k]):
            out = out + F.coalesce((F.col(c) - F.lit(m)) / F.lit(s), F.lit(0.0)) * F.lit(float(v))
        return out

    def loadings(self, df: DataFrame) -> DataFrame:
        """Correlation of each column with each component."""
        load = self.vectors * np.sqrt(np.maximum(self.eigenvalues, 0))
        rows = [(c, k + 1, float(load[i, k])) for i, c in enumerate(self.columns) for k in range(load.shape[1])]
        return df.sparkSession.createDataFrame(rows, "variable string, component int, loading double")

    def eigen_table(self, df: DataFrame) -> DataFrame:
        pct = 100 * self.eigenvalues / self.eigenvalues.sum()
        rows = [(k + 1, float(e), float(p), float(c)) for k, (e, p, c) in enumerate(zip(self.eigenvalues, pct, pct.cumsum()))]
        return df.sparkSession.createDataFrame(rows, "component int, eigenvalue double, percent double, cumulative double")


def principal_components(df: DataFrame, columns: Sequence[str], missing: str = "mean") -> Components:
    """Components of the correlation matrix; population standard deviations.

    The sign of each vector makes its largest absolute loading positive (the first
    of equal ones). ``missing='mean'`` keeps every row and puts the column's mean
    in place of what is missing; ``missing='drop'`` takes complete rows only.
    """
    cols = list(columns)
    if missing not in ("mean", "drop"):
        raise ValueError("missing must be 'mean' or 'drop'")
    if missing == "mean":
        average = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()
        rows = df.select(*[F.coalesce(F.col(c).cast("double"), average.getField(c)).alias(c) for c in cols])
    else:
        rows = complete_rows(df, cols)
    means, m = means_and_moments(rows, cols)
    values, vectors = np.linalg.eigh(correlation_matrix(m))
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    for k in range(len(cols)):
        size = np.abs(vectors[:, k])
        if vectors[np.flatnonzero(size >= size.max() * (1 - 1e-9))[0], k] < 0:
            vectors[:, k] *= -1
    return Components(cols, [float(means[c]) for c in cols], [float(s) for s in np.sqrt(np.diag(m))], vectors, values)


def supplementary(df: DataFrame, pc: Components, numeric: Sequence[str] = (), categorical: Sequence[str] = (), k: int = 3) -> DataFrame:
    """Columns that take no part in the components, on the first ``k`` of them:
    (variable, level, component, value, n).

    A numeric column has its correlation with the scores, over the rows where it is
    known. A category has its barycentre, the mean score of its rows; a missing one
    is a level of its own, NULL.
    """
    k = min(k, len(pc.columns))
    d = df.select(*numeric, *categorical, *[pc.score(i).alias(f"_s{i}") for i in range(k)])
    out = None
    if numeric:
        cells = [
            F.struct(F.lit(c).alias("variable"), F.lit(None).cast("string").alias("level"), F.lit(i + 1).alias("component"),
                     F.corr(c, f"_s{i}").alias("value"), F.count(c).alias("n"))
            for c in numeric for i in range(k)
        ]
        out = d.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    for c in categorical:
        means = d.groupBy(F.col(c).cast("string").alias("level")).agg(*[F.avg(f"_s{i}").alias(f"m{i}") for i in range(k)], F.count(F.lit(1)).alias("n"))
        cells = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col(f"m{i}").alias("value")) for i in range(k)])
        part = means.select(F.lit(c).alias("variable"), "level", "n", F.inline(cells)).select("variable", "level", "component", "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


def composite_index(df: DataFrame, columns: Sequence[str], name: str = "SES") -> DataFrame:
    """First component score as a column; older columns of that prefix go."""
    pc = principal_components(df, columns)
    kept = [c for c in df.columns if not c.startswith(name)]
    return df.select(*kept, pc.score().alias(name))


# ------------------------------------------------------- Gaussian smoothing


@dataclass
class Solution:
    """Posterior means and how the solver stopped."""

    values: DataFrame
    iterations: int
    residual: float
    history: list[float] = field(default_factory=list)
    tol: float = float("inf")

    @property
    def converged(self) -> bool:
        return self.residual <= self.tol

    def checked(self) -> Solution:
        """This solution, or an error if the solver stopped at its cap."""
        if not self.converged:
            raise RuntimeError(f"not converged: relative residual {self.residual:.3g} after {self.iterations} steps, wanted {self.tol:.3g}")
        return self

    def reported(self) -> DataFrame:
        """The values with ``iterations``, ``residual`` and ``converged``."""
        return self.values.withColumns({"iterations": F.lit(self.iterations), "residual": F.lit(self.residual), "converged": F.lit(self.converged)})


def rw1_matrix(t: int) -> np.ndarray:
    d = np.diff(np.eye(t), axis=0)
    return d.T @ d


def _wide(df: DataFrame, area: str, year: str, years: Sequence[int], columns: Mapping[str, str]) -> DataFrame:
    """One row per area, one column per year and quantity (0 where missing).

    A row of a year that is not listed raises.
    """
    known = F.col(year).isin([int(y) for y in years])
    df = df.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a year that is not listed: "), F.coalesce(F.col(year).cast("string"), F.lit("NULL"))))))
    return df.groupBy(area).agg(
        *[
            F.coalesce(F.sum(F.when(F.col(year) == y, F.col(c))), F.lit(0.0)).cast("double").alias(f"{p}{k}")
            for p, c in columns.items()
            for k, y in enumerate(years)
        ]
    )


def _in_blocks(state: DataFrame, edges: DataFrame, area: str, k1: np.ndarray, tol: float, max_iter: int) -> Solution:
    """Solve ``diag(w_k) + K1 (x) L`` for ``state(area, w0.., b0..)``, in blocks of areas."""
    t = len(k1)
    zero = F.lit(0.0)
    w = F.array(*[F.col(f"w{k}") if k == l else zero for k in range(t) for l in range(t)])
    systems = state.select(area, w.alias("w"), F.array(*[F.col(f"b{k}") for k in range(t)]).alias("b"))
    sol = blocks.solve(systems, blocks.dealt(edges, state.select(area), t), k1, None, tol, max_iter)
    values = sol.values.select(area, *[F.get("x", F.lit(k)).alias(f"x{k}") for k in range(t)])
    return Solution(values, sol.iterations, sol.residual, sol.history, tol).checked()


def smooth_areas(
    df: DataFrame,
    edges: DataFrame,
    weight: str,
    value: str,
    tau: float,
    area: str = "area",
    tol: float = 1e-8,
    max_iter: int = 500,
) -> Solution:
    """Structured area effect: solve ``(diag(w) + tau L) x = w y``.

    ``df`` may hold many rows per area; they are reduced to the moments
    ``sum w`` and ``sum w*y`` first. Column ``x0`` is the effect. A solver that
    does not reach ``tol`` within ``max_iter`` steps raises.
    """
    state = df.groupBy(area).agg(
        F.coalesce(F.sum(weight), F.lit(0.0)).cast("double").alias("w0"),
        F.coalesce(F.sum(F.col(weight) * F.col(value)), F.lit(0.0)).cast("double").alias("b0"),
    )
    return _in_blocks(reliable_checkpoint(state), edges, area, np.array([[float(tau)]]), tol, max_iter)


def slope_moments(df: DataFrame, area: str, x: str, y: str) -> DataFrame:
    """Per area ``sum x^2``, ``sum x*y`` and the pseudo-observation of a slope."""
    sxx, sxy = F.sum(F.col(x) * F.col(x)), F.sum(F.col(x) * F.col(y))
    return df.groupBy(area).agg(sxx.alias("sxx"), sxy.alias("sxy"), ratio(sxy, sxx).alias("slope"))


def smooth_slopes(df: DataFrame, edges: DataFrame, x: str, y: str, tau: float, area: str = "area", **kw) -> Solution:
    """Spatially varying slope of ``x`` on ``y``: the area smoother on the moments."""
    state = slope_moments(df, area, x, y).select(
        area, F.col("sxx").cast("double").alias("w0"), F.col("sxy").cast("double").alias("b0")
    )
    return _in_blocks(reliable_checkpoint(state), edges, area, np.array([[float(tau)]]), kw.get("tol", 1e-8), kw.get("max_iter", 500))


def smooth_years(df: DataFrame, weight: str, value: str, tau: float, year: str = "year") -> dict[int, float]:
    """Random-walk year effect at a fixed precision. The t x t system is tiny;
    only one row per year reaches the driver. The walk goes over every year from
    the first to the last: one without rows has weight 0 and its own effect."""
    rows = (
        df.groupBy(year)
        .agg(F.sum(weight).alias("w"), F.sum(F.col(weight) * F.col(value)).alias("b"))
        .orderBy(year)
        .collect()
    )
    rows = [r for r in rows if r[year] is not None]
    if not rows:
        return {}
    first = rows[0][year]
    t = rows[-1][year] - first + 1
    w, b = np.zeros(t), np.zeros(t)
    for r in rows:
        w[r[year] - first], b[r[year] - first] = r["w"] or 0.0, r["b"] or 0.0
    x = np.linalg.solve(np.diag(w) + tau * rw1_matrix(t), b) if w.any() else np.zeros(t)
    return {first + k: float(v) for k, v in enumerate(x)}


def smooth_interaction(
    df: DataFrame,
    edges: DataFrame,
    kind: str,
    weight: str,
    value: str,
    tau: float,
    years: Sequence[int],
    area: str = "area",
    year: str = "year",
    tol: float = 1e-8,
    max_iter: int = 500,
) -> Solution:
    """Space-time interaction I-IV at a fixed precision: ``(W + tau R) x = w y``.

    The result has one row per area and a column ``x<k>`` per year. I is closed
    form. II couples only the years of one area, so each area is solved on its
    own. III and IV are systems over the graph, solved in blocks.
    """
    t = len(years)
    rows = df.select(area, year, F.col(weight).cast("double").alias("_w"), (F.col(weight) * F.col(value)).cast("double").alias("_b"))
    state = _wide(rows, area, year, years, {"w": "_w", "b": "_b"})
    ks = range(t)
    if kind == "I":
        x = [F.coalesce(ratio(f"b{k}", F.col(f"w{k}") + F.lit(float(tau))), F.lit(0.0)).alias(f"x{k}") for k in ks]
        return Solution(state.select(area, *x), 0, 0.0)
    if kind == "II":
        return Solution(_solve_each_area(state, area, t, tau), 0, 0.0)
    if kind not in ("III", "IV"):
        raise ValueError("kind must be I, II, III or IV")
    k1 = float(tau) * (np.eye(t) if kind == "III" else rw1_matrix(t))
    return _in_blocks(reliable_checkpoint(state), edges, area, k1, tol, max_iter)


def _solve_each_area(state: DataFrame, area: str, t: int, tau: float) -> DataFrame:
    """Random walk in time for every area on its own, batch by batch in Arrow."""
    r = tau * rw1_matrix(t)
    names = [f"x{k}" for k in range(t)]

    def solve(batches):
        for pdf in batches:
            w = pdf[[f"w{k}" for k in range(t)]].to_numpy(float)
            b = pdf[[f"b{k}" for k in range(t)]].to_numpy(float)
            a = np.einsum("nk,kl->nkl", w, np.eye(t)) + r
            dead = w.sum(axis=1) == 0  # no data at all: the walk is not anchored
            a[dead] = np.eye(t)
            x = np.linalg.solve(a, b[:, :, None])[:, :, 0]
            out = pdf[[area]].copy()
            out[names] = x
            yield out

    key = state.schema[area].dataType.simpleString()
    return state.mapInPandas(solve, f"{area} {key}, " + ", ".join(f"{n} double" for n in names))


def to_area_year(values: DataFrame, years: Sequence[int], area: str = "area", name: str = "effect") -> DataFrame:
    """Wide solution (one column per year) to (area, year, effect)."""
    cells = F.array(*[F.struct(F.lit(y).alias("year"), F.col(f"x{k}").alias(name)) for k, y in enumerate(years)])
    return values.select(area, F.explode(cells).alias("c")).select(area, "c.year", f"c.{name}")


def centre(effects: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum-to-zero: subtract the (group) mean."""
    if not by:
        m = effects.agg(F.avg(value)).scalar()
        return effects.select(*[(F.col(c) - m).alias(c) if c == value else F.col(c) for c in effects.columns])
    d = with_group_totals(effects, by, {"_m": F.avg(value)})
    return d.select(*[(F.col(c) - F.col("_m")).alias(c) if c == value else F.col(c) for c in effects.columns])


# --------------------------------------------------------- repeated and nested fits


@dataclass
class Repeated:
    result: object
    iterations: int
    converged: bool


def repeat_until(step: Callable[[object, int], object], start: object, done: Callable[[object], bool], max_iter: int = 20) -> Repeated:
    """Refit until a criterion holds, but never more than ``max_iter`` times."""
    state, i = start, 0
    while not done(state) and i < max_iter:
        i += 1
        state = step(state, i)
    return Repeated(state, i, done(state))


@dataclass(frozen=True)
class ModelSpec:
    """Terms of one model of a family. ``interaction`` is None or a type I-IV."""

    name: str
    area_slope: bool = False
    year_slope: bool = False
    interaction: str | None = None
    area: bool = True
    year: bool = True


# the nested family: base, one slope, the other, both, and both with each type
MODEL_FAMILY = (
    ModelSpec("base"),
    ModelSpec("area_slope", area_slope=True),
    ModelSpec("year_slope", year_slope=True),
    ModelSpec("both_slopes", area_slope=True, year_slope=True),
    *[ModelSpec(f"both_slopes_{k}", True, True, k) for k in ("I", "II", "III", "IV")],
)


# A term is fitted to what the terms before it leave, in the order below.


def _terms(spec: ModelSpec) -> tuple[str, ...]:
    out = ["fixed", "area", "year"]
    if spec.area_slope:
        out.append("area_slope")
    if spec.year_slope:
        out.append("year_slope")
    if spec.interaction:
        out.append(f"interaction:{spec.interaction}")
    return tuple(out)


@dataclass
class FamilyFit:
    """Forward fits of a family of models on one panel.

    Models that share their first terms share the work: each prefix of terms is
    fitted once and kept with its running fit in column ``fitted``.
    """

    panel: DataFrame
    edges: DataFrame
    label: str
    slope: str
    features: Sequence[str]
    tau: Mapping[str, float]
    years: Sequence[int]
    area: str = "area"
    year: str = "year"
    tol: float = 1e-6
    max_iter: int = 200
    _done: dict[tuple[str, ...], DataFrame] = field(default_factory=dict)

    def fitted(self, spec: ModelSpec) -> DataFrame:
        return self._prefix(_terms(spec))

    def _prefix(self, terms: tuple[str, ...]) -> DataFrame:
        if terms not in self._done:
            self._done[terms] = reliable_checkpoint(self._add(terms[:-1], terms[-1]))
        return self._done[terms]

    def _add(self, before: tuple[str, ...], term: str) -> DataFrame:
        if term == "fixed":
            fit = linear_regression(self.panel, self.label, self.features)
            return self.panel.withColumn("fitted", fit.linear_predictor())
        d = self._prefix(before)
        x = F.col(self.slope) if term.endswith("slope") or term.startswith("interaction") else F.lit(1.0)
        # regression through the origin on x: weight x^2, pseudo-observation res/x
        left = d.withColumn("_w", (x * x).cast("double")).withColumn("_y", ratio(F.col(self.label) - F.col("fitted"), x))
        tau = self.tau[term.split(":")[0]]
        if term in ("year", "year_slope"):
            return d.withColumn("fitted", F.col("fitted") + _by_year(smooth_years(left, "_w", "_y", tau, self.year), self.year) * x)
        if term in ("area", "area_slope"):
            effect = smooth_areas(left, self.edges, "_w", "_y", tau, self.area, self.tol, self.max_iter).values
            joined = d.join(effect.withColumnRenamed("x0", "_t"), self.area, "left")
        else:
            kind = term.split(":")[1]
            sol = smooth_interaction(
                left, self.edges, kind, "_w", "_y", tau, self.years, self.area, self.year, tol=self.tol, max_iter=self.max_iter
            )
            effect = to_area_year(sol.values, self.years, self.area, "_t").withColumnRenamed("year", self.year)
            joined = d.join(effect, [self.area, self.year], "left")
        return joined.withColumn("fitted", F.col("fitted") + F.coalesce("_t", F.lit(0.0)) * x).drop("_t")


def _by_year(effects: Mapping[int, float], year: str) -> Column:
    out = F.lit(0.0)
    for y, v in effects.items():
        out = F.when(F.col(year) == y, F.lit(v)).otherwise(out)
    return out


def compare_models(fits: FamilyFit, family: Sequence[ModelSpec] = MODEL_FAMILY) -> DataFrame:
    """Residual sum of squares and RMSE of every model of a family."""
    out = None
    for spec in family:
        d = F.col(fits.label) - F.col("fitted")
        row = fits.fitted(spec).agg(F.count(d).alias("n"), F.sum(d * d).alias("rss"), F.sqrt(F.avg(d * d)).alias("rmse"))
        row = row.select(F.lit(spec.name).alias("model"), "n", "rss", "rmse")
        out = row if out is None else out.unionByName(row)
    return out


# ------------------------------------------------------------ information criteria


def pointwise_criteria(draws: DataFrame, obs: str = "obs", loglik: str = "loglik") -> DataFrame:
    """Per observation: log mean likelihood, variance of the log-likelihood, CPO.

    The likelihood means are shifted by the extreme log-likelihood of the
    observation, so no exponent overflows. Two aggregates, both map-side.
    """
    ext = draws.groupBy(obs).agg(F.max(loglik).alias("_hi"), F.min(loglik).alias("_lo")).withColumnRenamed(obs, "_obs")
    d = draws.join(ext, F.col(obs) == F.col("_obs"))
    return d.groupBy(obs).agg(
        (F.max("_hi") + F.log(F.avg(F.exp(F.col(loglik) - F.col("_hi"))))).alias("lppd"),
        F.var_samp(loglik).alias("p_waic"),
        F.exp(F.max("_lo") - F.log(F.avg(F.exp(F.col("_lo") - F.col(loglik))))).alias("cpo"),
    )


def information_criteria(draws: DataFrame, at_mean: DataFrame, obs: str = "obs", loglik: str = "loglik") -> DataFrame:
    """WAIC and DIC from log-likelihood draws and the log-likelihood at the
    posterior mean (obs, loglik_at_mean)."""
    point = pointwise_criteria(draws, obs, loglik).agg(
        F.sum("lppd").alias("lppd"), F.sum("p_waic").alias("p_waic"), F.sum(F.log("cpo")).alias("log_cpo")
    )
    # the mean of each observation over its own draws, so one that lacks some counts fully
    total = draws.groupBy(obs).agg(F.avg(loglik).alias("_m")).agg((F.lit(-2.0) * F.sum("_m")).alias("d_bar"))
    mean = at_mean.agg((F.lit(-2.0) * F.sum("loglik_at_mean")).alias("d_hat"))
    d_bar, d_hat = total.scalar(), mean.scalar()
    return point.select(
        (F.lit(-2.0) * (F.col("lppd") - F.col("p_waic"))).alias("waic"),
        "p_waic",
        d_bar.alias("d_bar"),
        (d_bar - d_hat).alias("p_d"),
        (2 * d_bar - d_hat).alias("dic"),
        "log_cpo",
    )
