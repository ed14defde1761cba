"""Joint area-year models at given precisions: Gaussian and Poisson.

The predictor of a row is ``offset + G beta + Z e``. ``beta`` holds the covariates, year
effects and year slopes; ``e`` holds what every area has for itself: its effect, its slope and
its space-time interaction (one value per year, on the slope variable). All terms of a model
are fitted together. The posterior at the given precisions is Gaussian (exactly, or around
the mode for Poisson counts), so its mean is one penalised solve, and draws are solves with
perturbed right-hand sides.

Rows are reduced to moments per area and year. The areas' part is a ``blocks`` system
with a right-hand side for the data, one for each draw and one for each column of beta;
what remains for the driver is a small dense system for beta. Hyperparameters are not
estimated.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .models import MODEL_FAMILY, ModelSpec, rw1_matrix
from .ranks import reliable_checkpoint

GAUSSIAN, POISSON = "gaussian", "poisson"
#: Largest change of a predictor in one step; larger steps are halved.
STEP = 2.0


@dataclass
class Fit:
    """A fitted model: rows with ``eta``, effects (area, e) and beta; the first of the
    values is the posterior mean (mode), draws follow."""

    model: PanelModel
    spec: ModelSpec
    rows: DataFrame
    effects: DataFrame
    beta: np.ndarray
    names: list[str]
    steps: int
    change: float
    #: rows before ``eta`` was joined
    data: DataFrame

    def coefficients(self) -> DataFrame:
        spark = self.rows.sparkSession
        return spark.createDataFrame([(n, float(b)) for n, b in zip(self.names, self.beta[:, 0])], "term string, estimate double")

    def area_effects(self) -> DataFrame:
        """(area, effect[, slope][, interaction array]): posterior means."""
        m, parts = self.beta.shape[1], self.model.unknowns(self.spec)
        at = lambda k: F.element_at("e", k * m + 1)
        out, k = [], 0
        for name, n in parts:
            out.append((at(k) if n == 1 else F.array(*[at(k + i) for i in range(n)])).alias(name))
            k += n
        return self.effects.select(self.model.area, *out)


@dataclass
class PanelModel:
    """A family of models of ``label`` on one panel; see the module.

    ``tau`` gives the precision of every term; ``precision`` that of a Gaussian row.
    Areas are those of the panel or of ``edges``: an area without rows borrows from its
    neighbours. ``years`` are all years in order; rows of another year raise.
    """

    panel: DataFrame
    edges: DataFrame
    label: str
    features: Sequence[str]
    slope: str
    tau: Mapping[str, float]
    years: Sequence[int]
    family: str = GAUSSIAN
    offset: str | None = None
    precision: float = 1.0
    area: str = "area"
    year: str = "year"
    tol: float = 1e-8
    max_steps: int = 50
    dense: int = blocks.DENSE
    _graphs: dict = field(default_factory=dict)
    _moments: DataFrame | None = None

    # ------------------------------------------------------------- structure

    def unknowns(self, spec: ModelSpec) -> list[tuple[str, int]]:
        """Names and numbers of what an area has for itself."""
        out = [("effect", 1)] if spec.area else []
        out += [("slope", 1)] if spec.area_slope else []
        return out + ([("interaction", len(self.years))] if spec.interaction else [])

    def _columns(self, spec: ModelSpec) -> list[str]:
        out = [] if spec.area else ["(Intercept)"]
        out += list(self.features)
        if spec.year:
            out += [f"year {y}" for y in self.years]
        return out + ([f"slope {y}" for y in self.years] if spec.year_slope else [])

    def _precisions(self, spec: ModelSpec) -> tuple[np.ndarray, np.ndarray]:
        """K1 and K0 of an area's unknowns."""
        t, parts = len(self.years), self.unknowns(spec)
        q = sum(n for _, n in parts)
        k1, k0 = np.zeros((q, q)), np.zeros((q, q))
        k = 0
        for name, n in parts:
            s = slice(k, k + n)
            if name != "interaction":
                k1[s, s] = self.tau["area" if name == "effect" else "area_slope"]
            else:
                r = rw1_matrix(t) if spec.interaction in ("II", "IV") else np.eye(t)
                (k1 if spec.interaction in ("III", "IV") else k0)[s, s] = self.tau["interaction"] * r
            k += n
        return k1, k0

    def _graph(self, q: int) -> blocks.Dealt:
        if q not in self._graphs:
            areas = self.panel.select(self.area).union(self.edges.select("i")).distinct()
            self._graphs[q] = blocks.dealt(self.edges, areas, q, self.dense)
        return self._graphs[q]

    def _index(self) -> Column:
        """Place of a row's year, from 0; another year raises."""
        k = F.array_position(F.array(*[F.lit(int(y)) for y in self.years]), F.col(self.year).cast("int"))
        return F.when(k > 0, k.cast("int") - 1).otherwise(F.raise_error(F.concat(F.lit("a year that is not listed: "), F.coalesce(F.col(self.year).cast("string"), F.lit("NULL")))))

    # --------------------------------------------------------------- solving

    def _cells(self, rows: DataFrame, graph: blocks.Dealt, w: Column, r: Column) -> DataFrame:
        """(area, cells): for each year the moments of (1, slope, features) and with r."""
        f = [F.lit(1.0), *[F.col(c).cast("double") for c in (self.slope, *self.features)]]
        d = len(f)
        lists = self._moments
        if lists is None:
            sums = [F.sum(w * f[a] * f[b]) for a in range(d) for b in range(a, d)]
            cells = rows.groupBy(self.area, F.col("_k").alias("k")).agg(F.array(*sums).alias("m"), F.array(*[F.sum(w * r * x) for x in f]).alias("v"))
            lists = cells.groupBy(self.area).agg(F.sort_array(F.collect_list(F.struct("k", "m", "v"))).alias("cells"))
            if self.family == GAUSSIAN:  # the same for every model
                lists = self._moments = reliable_checkpoint(lists)
        return graph.placed.select(self.area).join(lists, self.area, "left")

    def _solved(self, spec: ModelSpec, rows: DataFrame, w: Column, r: Column, draws: int, seed: int) -> tuple[DataFrame, np.ndarray]:
        """Effects (area, e) and beta: the solution and ``draws`` draws around it."""
        parts, t, p = self.unknowns(spec), len(self.years), len(self.features)
        q = sum(n for _, n in parts)
        k1, k0 = self._precisions(spec)
        r1, r0 = blocks.root(k1), blocks.root(k0)
        names = self._columns(spec)
        ng, d, m = len(names), 2 + p, 1 + draws
        has_area, has_year = spec.area, spec.year

        def design(k: int) -> tuple[np.ndarray, np.ndarray]:
            """What a row of year k takes of its (1, slope, features): Z (q x d), G (ng x d)."""
            z, at = np.zeros((q, d)), 0
            for name, n in parts:
                z[at + (k if n > 1 else 0), 0 if name == "effect" else 1] = 1
                at += n
            g, at = np.zeros((ng, d)), 0
            if not has_area:
                g[0, 0], at = 1, 1
            g[at : at + p, 2:] = np.eye(p)
            at += p
            if has_year:
                g[at + k, 0] = 1
                at += t
            if spec.year_slope:
                g[at + k, 1] = 1
            return z, g

        area, upper = self.area, np.triu_indices(d)

        def build(rows):
            n = len(rows)
            w_, b, c = np.zeros((n, q, q)), np.zeros((n, q, m)), np.zeros((n, q, ng))
            gg, gr = np.zeros((ng, ng)), np.zeros((ng, m))
            by_year: dict[int, list] = {}
            known: dict = {}
            for at, row in enumerate(rows):
                for cell in [] if row["cells"] is None else row["cells"]:
                    by_year.setdefault(cell["k"], []).append((at, row["key"], cell["m"], cell["v"]))
                if draws:
                    b[at, :, 1:] += blocks.prior_noise(row["key"], [] if row["near"] is None else list(row["near"]), r1, r0, draws, seed + 1, known)
            for k, cells in sorted(by_year.items()):
                at = np.array([x[0] for x in cells])
                mom = np.zeros((len(cells), d, d))
                mom[:, *upper] = [x[2] for x in cells]
                mom += np.triu(mom, 1).transpose(0, 2, 1)
                v = np.repeat(np.array([x[3] for x in cells])[:, :, None], m, axis=2)
                if draws:
                    normal = [np.random.default_rng([seed, x[1] & blocks._MASK, k]).standard_normal((d, draws)) for x in cells]
                    v[:, :, 1:] += blocks.root(mom) @ np.array(normal)
                z, g = design(k)
                w_[at] += z @ mom @ z.T
                b[at] += z @ v
                c[at] += z @ mom @ g.T
                gg += g @ mom.sum(0) @ g.T
                gr += g @ v.sum(0)
            return w_, np.concatenate([b, c], 2), np.hstack([gr, gg])

        graph = self._graph(q)
        cells = self._cells(rows, graph, w, r).withColumn("key", F.xxhash64(area))
        cells = cells.join(blocks.neighbours(self.edges, area), area, "left") if draws else cells.withColumn("near", F.lit(None).cast("array<long>"))
        kind = self.panel.schema[area].dataType.simpleString()
        x = blocks.solve(cells, graph, k1, k0, self.tol / 100, make=build, trail=ng)
        if x.residual > self.tol:
            raise RuntimeError(f"not converged: relative residual {x.residual:.3g} after {x.iterations} steps")
        beta = self._global(spec, names, x.left, draws, seed)

        def less(block, names, values, schema):
            e = values[:, :, :m] - values[:, :, m:] @ beta
            return pd.DataFrame({area: names, "e": list(e.reshape(len(e), -1))})

        return x.run(less, f"{area} {kind}, e array<double>"), beta

    def _global(self, spec, names, left, draws, seed) -> np.ndarray:
        """beta from what is left when the areas are eliminated; year terms sum to 0."""
        t, ng, m = len(self.years), len(names), 1 + draws
        if not ng:
            return np.zeros((0, m))
        s, b = left[:, m:].copy(), left[:, :m].copy()
        null = []
        rng = np.random.default_rng(seed + 2)
        for word, term in (("year ", "year"), ("slope ", "year_slope")):
            at = [k for k, n in enumerate(names) if n.startswith(word)]
            if at:
                tau = self.tau[term]
                s[np.ix_(at, at)] += tau * rw1_matrix(t)
                b[at, 1:] += math.sqrt(tau) * np.diff(np.eye(t), axis=0).T @ rng.standard_normal((t - 1, draws))
                null.append(np.isin(np.arange(ng), at).astype(float))
        n = np.array(null).reshape(-1, ng)
        system = np.block([[s, n.T], [n, np.zeros((len(n), len(n)))]])
        # a column that the areas' own terms hold already gets 0
        return np.linalg.lstsq(system, np.vstack([b, np.zeros((len(n), m))]), rcond=1e-10)[0][:ng]

    def _predictor(self, spec: ModelSpec, effects: DataFrame, beta: np.ndarray, rows: DataFrame) -> Column:
        """eta of the posterior mean for rows joined with their area's ``e``."""
        m, t = beta.shape[1], len(self.years)
        out, at, slope = F.lit(0.0), 0, F.col(self.slope)
        for name, n in self.unknowns(spec):
            place = (F.lit(at) + (F.col("_k") if n > 1 else F.lit(0))) * m + 1
            value = F.element_at("e", place.cast("int"))
            out = out + (value if name == "effect" else value * slope)
            at += n
        b, at = beta[:, 0].tolist(), 0
        if not spec.area:
            out, at = out + F.lit(b[0]), 1
        for f in self.features:
            out, at = out + F.lit(b[at]) * F.col(f), at + 1
        for some, x in ((spec.year, F.lit(1.0)), (spec.year_slope, slope)):
            if some:
                out = out + F.element_at(F.array(*[F.lit(v) for v in b[at : at + t]]), F.col("_k") + 1) * x
                at += t
        return out

    def fit(self, spec: ModelSpec, draws: int = 0, seed: int = 7) -> Fit:
        """Posterior mean (mode) and draws of one model. A mode that isn't reached raises."""
        used = [self.label, *self.features, self.slope, *([self.offset] if self.offset else [])]
        rows = self.panel.dropna(subset=used).withColumn("_k", self._index())
        y, off = F.col(self.label).cast("double"), F.col(self.offset) if self.offset else F.lit(0.0)
        w, r = F.lit(float(self.precision)), y - off

        def placed(effects, beta, rows):
            eta = self._predictor(spec, effects, beta, rows)
            return rows.join(effects, self.area).withColumn("_new", off + eta).drop("e")

        if self.family == GAUSSIAN:
            effects, beta = self._solved(spec, rows, w, r, draws, seed)
            # draws are made again where they are used, rather than stored
            effects = effects if draws else reliable_checkpoint(effects)
            return Fit(self, spec, placed(effects, beta, rows).withColumnRenamed("_new", "eta"), effects, beta, self._columns(spec), 1, 0.0, rows)
        if self.family != POISSON:
            raise ValueError("family must be gaussian or poisson")
        level = rows.agg(F.log(F.sum(y) / F.sum(F.exp(off)))).first()[0]
        if level is None:
            raise ValueError("counts without events have no mode")
        rows = rows.withColumn("eta", off + F.lit(float(level)))
        for step in range(1, self.max_steps + 1):
            mu = F.exp("eta")
            effects, beta = self._solved(spec, rows, mu, F.col("eta") - off + y / mu - 1, 0, seed)
            moved = reliable_checkpoint(placed(effects, beta, rows))
            change = float(moved.agg(F.max(F.abs(F.col("_new") - F.col("eta")))).first()[0])
            s = 1.0
            while s * change > STEP:
                s /= 2
            rows = moved.withColumn("eta", F.col("eta") + s * (F.col("_new") - F.col("eta"))).drop("_new")
            if change <= self.tol * 10:
                break
        else:
            raise RuntimeError(f"not converged: the predictor still changes by {change:.3g} after {self.max_steps} steps")
        mu = F.exp("eta")
        effects, beta = self._solved(spec, rows, mu, F.col("eta") - off + y / mu - 1, draws, seed)
        return Fit(self, spec, rows, effects if draws else reliable_checkpoint(effects), beta, self._columns(spec), step, change, rows)


# ----------------------------------------------------------------- criteria

_POINT = "loglik_at_mean double, mean_loglik double, lppd double, p_waic double, cpo double"


def pointwise(fit: Fit) -> DataFrame:
    """Per row: log-likelihood at the posterior mean, its mean over the draws, log mean
    likelihood, variance of the log-likelihood, and CPO."""
    model, spec, beta = fit.model, fit.spec, fit.beta
    m, t, p = beta.shape[1], len(model.years), len(model.features)
    if m < 3:
        raise ValueError("criteria need a fit with draws")
    parts = model.unknowns(spec)
    gaussian, phi = model.family == GAUSSIAN, model.precision

    def run(frames):
        for pdf in frames:
            for a in range(0, len(pdf), 500):
                d = pdf.iloc[a : a + 500]
                n, k, x = len(d), d["_k"].to_numpy(), d["x"].to_numpy(float)
                eta, at = d["off"].to_numpy(float)[:, None] + np.zeros((n, m)), 0
                for name, _ in parts:
                    value = np.stack(d[name].to_list())
                    eta += value if name == "effect" else value * x[:, None]
                if not spec.area:
                    eta, at = eta + beta[0], 1
                eta += np.stack(d["f"].to_list()).reshape(n, p) @ beta[at : at + p]
                at += p
                if spec.year:
                    eta += beta[at + k]
                    at += t
                if spec.year_slope:
                    eta += beta[at + k] * x[:, None]
                y = d["y"].to_numpy(float)[:, None]
                if gaussian:
                    ll = 0.5 * math.log(phi / (2 * math.pi)) - 0.5 * phi * (y - eta) ** 2
                else:
                    ll = y * eta - np.exp(eta) - np.array([math.lgamma(v + 1) for v in y[:, 0]])[:, None]
                s = ll[:, 1:]
                high, low = s.max(1, keepdims=True), s.min(1, keepdims=True)
                yield pd.DataFrame(
                    {
                        "loglik_at_mean": ll[:, 0],
                        "mean_loglik": s.mean(1),
                        "lppd": high[:, 0] + np.log(np.exp(s - high).mean(1)),
                        "p_waic": s.var(1, ddof=1),
                        "cpo": np.exp(low[:, 0] - np.log(np.exp(low - s).mean(1))),
                    }
                )

    # a row takes the values of its own year only
    own, at = [], 0
    for name, size in parts:
        place = F.lit(at) + (F.col("_k") if size > 1 else F.lit(0))
        own.append(F.slice("e", (place * m + 1).cast("int"), F.lit(m)).alias(name))
        at += size
    off = F.col(model.offset).cast("double") if model.offset else F.lit(0.0)
    rows = fit.data.join(fit.effects, model.area).select(
        F.col(model.label).cast("double").alias("y"), off.alias("off"), "_k", F.col(model.slope).cast("double").alias("x"),
        F.array(*[F.col(c).cast("double") for c in model.features]).cast("array<double>").alias("f"), *own,
    )
    return rows.mapInPandas(run, _POINT)


def criteria(fit: Fit) -> DataFrame:
    """One row: n, waic, p_waic, d_bar, p_d, dic and log_cpo of a fit with draws."""
    d = pointwise(fit).agg(
        F.count(F.lit(1)).alias("n"), F.sum("lppd").alias("l"), F.sum("p_waic").alias("p_waic"),
        (-2 * F.sum("mean_loglik")).alias("d_bar"), (-2 * F.sum("loglik_at_mean")).alias("d_hat"), F.sum(F.log("cpo")).alias("log_cpo"),
    )
    return d.select(
        "n", (-2 * (F.col("l") - F.col("p_waic"))).alias("waic"), "p_waic", "d_bar",
        (F.col("d_bar") - F.col("d_hat")).alias("p_d"), (2 * F.col("d_bar") - F.col("d_hat")).alias("dic"), "log_cpo",
    )


def compare(model: PanelModel, family: Sequence[ModelSpec] = MODEL_FAMILY, draws: int = 100, seed: int = 7) -> DataFrame:
    """WAIC and DIC of every model of a family."""
    out = None
    for spec in family:
        row = criteria(model.fit(spec, draws, seed)).select(F.lit(spec.name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def exceedance(effects: DataFrame, variances: DataFrame, area: str = "area", threshold: float = 0.0) -> DataFrame:
    """(area, mean, sd, q_low, q_high, p_below) of Gaussian effects ``(area, mean)``
    with ``variances(area, variance)``."""
    from ..functions.numeric import normal_cdf

    d = effects.join(variances, area).withColumn("sd", F.sqrt("variance"))
    half = F.lit(1.959963984540054) * F.col("sd")
    return d.select(
        area, "mean", "sd", (F.col("mean") - half).alias("q_low"), (F.col("mean") + half).alias("q_high"),
        normal_cdf((F.lit(float(threshold)) - F.col("mean")) / F.col("sd")).alias("p_below"),
    )
