"""Queries for panel preparation, models, posterior tables and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, diagnostics, latent, models, panel as panel_ops, posterior, reshape, structure
from . import fixtures as fx
from ..operators.ranks import reliable_checkpoint
from .areas import tract_graph
from .fixtures import with_ctes
from .registry import query, rnd, rounded

COVARIATES = ["ue", "elder", "income"]
_KEY = ["tract", "year", "disease"]

# ----------------------------------------------------------------- panel preparation

_IX = "ix AS (SELECT geoid AS g, row_number() OVER (ORDER BY geoid) AS area_index FROM (SELECT DISTINCT geoid FROM panel WHERE disease = 'Mentalhealth' AND year > 1996) a)"


@query(
    "pn1_panel_frame",
    with_ctes(
        "panel",
        f"""WITH {_IX} SELECT geoid, area_index, year - 1996 AS year_index, concat(area_index, '_', year - 1996) AS area_year,
        (year - 1997) * (SELECT count(*) FROM ix) + area_index AS row_ordinal, n_rec
        FROM panel JOIN ix ON geoid = g WHERE disease = 'Mentalhealth' AND year > 1996""",
    ),
)
def pn1(spark, sf):
    d = panel_ops.panel_frame(fx.panel(spark, sf), "Mentalhealth", 1996)
    return d.select("geoid", "area_index", "year_index", "area_year", "row_ordinal", "n_rec")


@query(
    "pn2_median_imputation",
    with_ctes("panel", f"SELECT tract, year, disease, {', '.join(f'{rnd(f"coalesce({c}, (SELECT median({c}) FROM panel))")} AS {c}' for c in COVARIATES)} FROM panel"),
)
def pn2(spark, sf):
    return rounded(panel_ops.impute_median(fx.panel(spark, sf).select(*_KEY, *COVARIATES), COVARIATES))


@query("pn3_log_outcome", with_ctes("panel", f"SELECT tract, year, disease, {rnd('ln(mortrate)')} AS mortrate FROM panel"))
def pn3(spark, sf):
    return rounded(fx.panel(spark, sf).select(*_KEY, F.log("mortrate").alias("mortrate")))


@query(
    "pn4_log_covariates",
    with_ctes(
        "panel",
        f"""SELECT tract, year, disease, {rnd('CASE WHEN (SELECT min(z) FROM (SELECT n_rec - (SELECT min(n_rec) FROM panel) AS z FROM panel) q) = 0 THEN ln(n_rec - (SELECT min(n_rec) FROM panel) + 1) END')} AS from_zero,
        {rnd('ln(income)')} AS income FROM panel""",
    ),
)
def pn4(spark, sf):
    p = fx.panel(spark, sf)
    low = p.agg(F.min("n_rec")).scalar()
    d = p.select(*_KEY, (F.col("n_rec") - low).alias("from_zero"), "income")
    return rounded(panel_ops.log_covariates(d, ["from_zero", "income"]))


@query(
    "pn5_z_scores",
    with_ctes("panel", f"SELECT tract, year, disease, {', '.join(f'{rnd(f"({c} - (SELECT avg({c}) FROM panel)) / nullif((SELECT stddev_samp({c}) FROM panel), 0)")} AS {c}' for c in [*COVARIATES, 'mortrate'])} FROM panel"),
)
def pn5(spark, sf):
    return rounded(panel_ops.zscore(fx.panel(spark, sf).select(*_KEY, *COVARIATES, "mortrate"), [*COVARIATES, "mortrate"]))


@query("pn6_exposure_and_offset", with_ctes("panel", f"SELECT tract, year, disease, n_rec AS outcome, {rnd('income')} AS exposure, {rnd('ln(pop)')} AS \"offset\" FROM panel"))
def pn6(spark, sf):
    d = panel_ops.with_exposure(fx.panel(spark, sf), "n_rec", "income", "pop")
    return rounded(d.select(*_KEY, "outcome", "exposure", "offset"))


# ----------------------------------------------------------------------------- models


def _poisson_panel(spark, sf):
    return fx.panel(spark, sf).withColumn("log_pop", F.log("pop"))


@query("md1_poisson_regression")
def md1(spark, sf):
    d = _poisson_panel(spark, sf)
    return rounded(models.poisson_regression(d, "n_rec", ["elder", "income"], "log_pop").table(d))


_CAUSES_SQL = """lv AS (SELECT disease, sum(n_rec) / sum(pop) AS rate FROM panel GROUP BY 1),
rt AS (SELECT max(rate) FILTER (disease = 'Neoplasms') AS base, max(rate) FILTER (disease = 'Allcauses') AS every, max(rate) FILTER (disease = 'Mentalhealth') AS mental FROM lv)"""
CAUSE_MARKS = ["every", "mental"]


def _cause_panel(spark, sf):
    marks = {"every": F.col("disease") == "Allcauses", "mental": F.col("disease") == "Mentalhealth"}
    return _poisson_panel(spark, sf).withColumns({k: c.cast("double") for k, c in marks.items()})


@query(
    "md1_poisson_by_cause",
    with_ctes(
        "panel",
        f"""WITH {_CAUSES_SQL} SELECT '(Intercept)' AS term, {rnd('ln(base)')} AS estimate FROM rt UNION ALL SELECT 'every', {rnd('ln(every / base)')} FROM rt
        UNION ALL SELECT 'mental', {rnd('ln(mental / base)')} FROM rt""",
    ),
)
def md1_causes(spark, sf):
    # a factor alone has a closed form: the log rates of its levels
    d = _cause_panel(spark, sf)
    return rounded(models.poisson_regression(d, "n_rec", CAUSE_MARKS, "log_pop").table(d))


@query("md1_poisson_score_sums", "SELECT unnest(['(Intercept)', 'elder', 'income']) AS term, CAST(0 AS DOUBLE) AS score")
def md1_scores(spark, sf):
    # at the maximum the residuals are orthogonal to every covariate
    d = _poisson_panel(spark, sf)
    fit = models.poisson_regression(d, "n_rec", ["elder", "income"], "log_pop")
    left = F.col("n_rec") - F.exp(fit.linear_predictor() + F.col("log_pop"))
    share = lambda x: F.sum(left * x) / F.sum(F.col("n_rec") * x)
    sums = d.agg(share(F.lit(1.0)).alias("a"), share(F.col("elder")).alias("b"), share(F.col("income")).alias("c"))
    named = F.array(*[F.struct(F.lit(t).alias("term"), F.col(c).alias("score")) for t, c in (("(Intercept)", "a"), ("elder", "b"), ("income", "c"))])
    return sums.select(F.inline(named)).select("term", (F.round("score", 6) + 0.0).alias("score"))


@query(
    "md2_gaussian_regression",
    with_ctes(
        "panel",
        f"SELECT '(Intercept)' AS term, {rnd('regr_intercept(mortrate, income)', 4)} AS estimate FROM panel UNION ALL SELECT 'income', {rnd('regr_slope(mortrate, income)', 4)} FROM panel",
    ),
)
def md2(spark, sf):
    d = fx.panel(spark, sf)
    return rounded(models.linear_regression(d, "mortrate", ["income"]).table(d), 4)


def _cramer_sql() -> str:
    """Three covariates by Cramer's rule on the covariances of complete rows."""
    x = COVARIATES
    cells = ", ".join(f"covar_pop({a}, {b}) AS {a}_{b}" for a in x for b in [*x, "mortrate"])
    means = ", ".join(f"avg({c}) AS m_{c}" for c in [*x, "mortrate"])

    def det(cols):
        a, b, c = ([f"{r}_{k}" for r in x] for k in cols)
        return f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {b[0]} * ({a[1]} * {c[2]} - {a[2]} * {c[1]}) + {c[0]} * ({a[1]} * {b[2]} - {a[2]} * {b[1]}))"

    betas = ", ".join(f"{det([*x[:i], 'mortrate', *x[i + 1:]])} / {det(x)} AS b_{c}" for i, c in enumerate(x))
    inner = f"cv AS (SELECT {cells}, {means} FROM panel WHERE ue IS NOT NULL), be AS (SELECT *, {betas} FROM cv)"
    fitted = " - ".join(f"b_{c} * m_{c}" for c in x)
    rows = [f"SELECT '(Intercept)' AS term, {rnd(f'm_mortrate - {fitted}', 4)} AS estimate FROM be", *[f"SELECT '{c}', {rnd(f'b_{c}', 4)} FROM be" for c in x]]
    return f"WITH {inner} " + " UNION ALL ".join(rows)


@query("md2_gaussian_regression_many", with_ctes("panel", _cramer_sql()))
def md2_many(spark, sf):
    d = fx.panel(spark, sf)
    return rounded(models.linear_regression(d, "mortrate", COVARIATES).table(d), 4)


def _scaled_panel(spark, sf):
    """One row per tract and year with standardised outcome and slope variable."""
    d = fx.panel(spark, sf).groupBy("tract", "year").agg(F.avg("mortrate").alias("y"), F.avg("elder").alias("x"), F.avg("income").alias("z"))
    d = reliable_checkpoint(d)  # moments, fits and what is left of them read it again
    return panel_ops.zscore(d, ["y", "x", "z"]).withColumn("w", F.lit(1.0)).withColumnRenamed("tract", "area")


def _years(spark, sf) -> list[int]:
    return [r["year"] for r in fx.prices(spark, sf).select("year").orderBy("year").collect()]


@query("md3_area_effect")
def md3_area(spark, sf):
    edges, _, _ = tract_graph(spark, sf)
    sol = models.smooth_areas(_scaled_panel(spark, sf), edges, "w", "y", tau=0.5, tol=1e-5)
    return rounded(sol.values.withColumnRenamed("x0", "effect"))


@query("md3_space_time_interaction")
def md3_types(spark, sf):
    edges, _, _ = tract_graph(spark, sf)
    edges = reliable_checkpoint(edges)
    d, years = _scaled_panel(spark, sf), _years(spark, sf)
    out = None
    for kind in structure.INTERACTION_TYPES:
        sol = models.smooth_interaction(d, edges, kind, "w", "y", 0.25, years, tol=1e-3)
        part = models.to_area_year(sol.values, years).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 3)


@query(
    "md3_unstructured_interaction",
    with_ctes(
        "panel",
        f"""WITH a AS (SELECT tract, year, avg(mortrate) AS y FROM panel GROUP BY 1, 2)
        SELECT tract AS area, year, {rnd('(y - (SELECT avg(y) FROM a)) / (SELECT stddev_samp(y) FROM a) / 1.25')} AS effect FROM a""",
    ),
)
def md3_type_one(spark, sf):
    # type I has a closed form: each cell is shrunk on its own
    d, years = _scaled_panel(spark, sf), _years(spark, sf)
    edges, _, _ = tract_graph(spark, sf)
    sol = models.smooth_interaction(d, edges, "I", "w", "y", 0.25, years)
    seen = d.select("area", "year")
    return rounded(models.to_area_year(sol.values, years).join(seen, ["area", "year"], "left_semi"))


@query(
    "md4_slope_moments",
    with_ctes("panel", f"SELECT tract, {rnd('sum(elder * elder)')} AS sxx, {rnd('sum(elder * income)')} AS sxy, {rnd('sum(elder * income) / nullif(sum(elder * elder), 0)')} AS slope FROM panel GROUP BY 1"),
)
def md4_moments(spark, sf):
    return rounded(models.slope_moments(fx.panel(spark, sf), "tract", "elder", "income"))


@query("md4_varying_slope")
def md4(spark, sf):
    edges, _, _ = tract_graph(spark, sf)
    sol = models.smooth_slopes(_scaled_panel(spark, sf), edges, "x", "y", tau=0.5, tol=1e-5)
    return rounded(sol.values.withColumnRenamed("x0", "slope"))


def _left_over(d, edges, effect, w, b, tau):
    """What the normal equations ``(w + tau (deg - A)) x = b`` leave per area."""
    deg = edges.groupBy(F.col("i").alias("_i")).agg(F.count(F.lit(1)).alias("deg"))
    around = edges.join(effect.select(F.col("area").alias("j"), "x0"), "j").groupBy(F.col("i").alias("_a")).agg(F.sum("x0").alias("near"))
    m = d.groupBy("area").agg(F.sum(w).alias("w"), F.sum(b).alias("b")).join(effect, "area")
    m = m.join(deg, F.col("area") == F.col("_i"), "left").join(around, F.col("area") == F.col("_a"), "left")
    rest = F.col("w") * F.col("x0") + F.lit(tau) * (F.coalesce("deg", F.lit(0)) * F.col("x0") - F.coalesce("near", F.lit(0.0))) - F.col("b")
    return m.select("area", (F.round(rest, 4) + 0.0).alias("left_over"))


_NOTHING_LEFT_SQL = "SELECT DISTINCT l_suppkey AS area, CAST(0 AS DOUBLE) AS left_over FROM lineitem"


@query("md3_area_normal_equations", _NOTHING_LEFT_SQL)
def md3_area_equations(spark, sf):
    edges, _, _ = tract_graph(spark, sf)
    d = _scaled_panel(spark, sf)
    effect = models.smooth_areas(d, edges, "w", "y", tau=0.5).values
    return _left_over(d, edges, effect, F.col("w"), F.col("w") * F.col("y"), 0.5)


@query("md4_slope_normal_equations", _NOTHING_LEFT_SQL)
def md4_equations(spark, sf):
    edges, _, _ = tract_graph(spark, sf)
    d = _scaled_panel(spark, sf)
    effect = models.smooth_slopes(d, edges, "x", "y", tau=0.5).values
    return _left_over(d, edges, effect, F.col("x") * F.col("x"), F.col("x") * F.col("y"), 0.5)


@query(
    "md3_interaction_normal_equations",
    """SELECT k.kind, s_suppkey AS area, CAST(y.year AS INTEGER) AS year, CAST(0 AS DOUBLE) AS left_over FROM supplier,
    (SELECT unnest(['II', 'III', 'IV']) AS kind) k, (SELECT DISTINCT year(l_shipdate) AS year FROM lineitem) y
    WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)""",
)
def md3_interaction_equations(spark, sf):
    # every cell of an area and year has weight 1 or, without a row, 0
    edges, n, t = tract_graph(spark, sf)
    edges = reliable_checkpoint(edges)
    d, years = _scaled_panel(spark, sf), _years(spark, sf)
    lap = structure.laplacian(edges)
    out = None
    for kind in ("II", "III", "IV"):
        sol = models.smooth_interaction(d, edges, kind, "w", "y", 0.25, years, tol=1e-6)
        x = models.to_area_year(sol.values, years).withColumn("i", (F.col("year") - years[0]) * n + F.col("area"))
        m, _ = structure.interaction(kind, lap, n, t)
        pull = m.join(x.select(F.col("i").alias("j"), "effect"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("effect")).alias("pull"))
        all_ = x.join(pull, "i", "left").join(d.select("area", "year", "y", "w"), ["area", "year"], "left")
        rest = F.coalesce("w", F.lit(0.0)) * (F.col("effect") - F.coalesce("y", F.lit(0.0))) + 0.25 * F.coalesce("pull", F.lit(0.0))
        part = all_.select(F.lit(kind).alias("kind"), "area", "year", (F.round(rest, 3) + 0.0).alias("left_over"))
        out = part if out is None else out.unionByName(part)
    return out


@query("md5_refit_until_criterion")
def md5(spark, sf):
    """Refit with a growing precision until the effects vary little enough."""
    edges, _, _ = tract_graph(spark, sf)
    d = _scaled_panel(spark, sf).select("area", "w", "y")

    def spread(effects) -> float:
        return effects.agg(F.stddev_pop("x0")).first()[0] or 0.0

    def step(state, i):
        sol = models.smooth_areas(d, edges, "w", "y", tau=0.5 * 2.0**i, tol=1e-3)
        return (i, sol.values, spread(sol.values))

    fit = models.repeat_until(step, (0, None, float("inf")), lambda s: s[2] < 0.25, max_iter=3)
    _, values, sd = fit.result
    return rounded(values.select("area", F.col("x0").alias("effect"), F.lit(fit.iterations).alias("iterations"), F.lit(fit.converged).alias("converged")), 4)


@query("md5_conserved_total", "SELECT CAST(0 AS DOUBLE) AS left_over, true AS converged FROM (SELECT 1)")
def md5_total(spark, sf):
    # the structure has zero column sums, so at any precision the sum of w * x is that of w * y
    edges, _, _ = tract_graph(spark, sf)
    d = _scaled_panel(spark, sf).select("area", "w", "y")

    def step(state, i):
        effect = models.smooth_areas(d, edges, "w", "y", tau=0.5 * 4.0**i).values
        return (i, effect, effect.agg(F.stddev_pop("x0")).first()[0] or 0.0)

    fit = models.repeat_until(step, (0, None, float("inf")), lambda s: s[2] < 0.5, max_iter=8)
    joined = d.join(fit.result[1], "area")
    rest = F.sum(F.col("w") * (F.col("x0") - F.col("y")))
    return joined.agg((F.round(rest, 3) + 0.0).alias("left_over")).withColumn("converged", F.lit(fit.converged))


_TAU = dict.fromkeys(("area", "year", "area_slope", "year_slope", "interaction"), 0.5)
_FAMILY = [m.name for m in models.MODEL_FAMILY]


def _gaussian_family(spark, sf) -> latent.PanelModel:
    edges, _, _ = tract_graph(spark, sf)
    d = reliable_checkpoint(_scaled_panel(spark, sf).select("area", "year", "y", "x", "z"))
    return latent.PanelModel(d, reliable_checkpoint(edges), "y", ["z"], "x", _TAU, _years(spark, sf))


def _poisson_family(spark, sf) -> latent.PanelModel:
    """Counts of all causes with log population as offset."""
    edges, _, _ = tract_graph(spark, sf)
    d = _poisson_panel(spark, sf).where("disease = 'Allcauses'").withColumnRenamed("tract", "area")
    d = reliable_checkpoint(panel_ops.zscore(d, ["elder", "income"]).select("area", "year", "n_rec", "elder", "income", "log_pop"))
    return latent.PanelModel(d, reliable_checkpoint(edges), "n_rec", ["income"], "elder", _TAU | {"area": 2.0, "interaction": 20.0}, _years(spark, sf), "poisson", "log_pop")


def _area_scores(model: latent.PanelModel, fit: latent.Fit):
    """Derivative of the penalised log-likelihood in the effect of every area."""
    fitted = F.col("eta") if model.family == "gaussian" else F.exp("eta")
    x = fit.area_effects().select("area", "effect")
    data = fit.rows.groupBy("area").agg(F.sum(F.col(model.label) - fitted).alias("d"))
    near = model.edges.join(x.select(F.col("area").alias("j"), F.col("effect").alias("u")), "j").groupBy(F.col("i").alias("area"))
    near = near.agg(F.count(F.lit(1)).alias("deg"), F.sum("u").alias("near"))
    all_ = x.join(data, "area", "left").join(near, "area", "left")
    pull = F.coalesce("deg", F.lit(0)) * F.col("effect") - F.coalesce("near", F.lit(0.0))
    return all_.select("area", (F.round(F.coalesce("d", F.lit(0.0)) - F.lit(model.tau["area"]) * pull, 4) + 0.0).alias("score"))


@query("md1_poisson_area_effects")
def md1_area_effects(spark, sf):
    """Area effects of a Poisson model with covariates, year effects and population offset."""
    model = _poisson_family(spark, sf)
    return rounded(model.fit(models.MODEL_FAMILY[0]).area_effects())


@query("md1_poisson_area_scores", "SELECT DISTINCT l_suppkey AS area, CAST(0 AS DOUBLE) AS score FROM lineitem")
def md1_area_scores(spark, sf):
    # at the mode, y - mu - tau * L x vanishes in every area
    model = _poisson_family(spark, sf)
    return _area_scores(model, model.fit(models.MODEL_FAMILY[0]))


@query(
    "md6_model_scores",
    f"""SELECT model, area, CAST(0 AS DOUBLE) AS score FROM (SELECT DISTINCT l_suppkey AS area FROM lineitem),
    (SELECT unnest(['{"', '".join(_FAMILY)}']) AS model)""",
)
def md6_scores(spark, sf):
    # all terms of a model are fitted together: none of its areas has anything left
    model = _gaussian_family(spark, sf)
    out = None
    for spec in models.MODEL_FAMILY:
        part = _area_scores(model, model.fit(spec)).select(F.lit(spec.name).alias("model"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("md6_model_family")
def md6(spark, sf):
    """WAIC, DIC and their parts for every model of the Gaussian family."""
    return rounded(latent.compare(_gaussian_family(spark, sf)), 3)


@query("md6_poisson_family")
def md6_poisson(spark, sf):
    """The same for counts, the base model, both slopes and the unstructured interaction."""
    family = [m for m in models.MODEL_FAMILY if m.name in ("base", "area_slope", "both_slopes_I")]
    return rounded(latent.compare(_poisson_family(spark, sf), family), 3)


@query(
    "md7_unstructured_complexity",
    with_ctes(
        "panel",
        """SELECT count(*) AS n, round(count(*) / 1.25, 6) AS p_d, true AS near FROM (SELECT DISTINCT tract, year FROM panel)""",
    ),
)
def md7_type_one(spark, sf):
    # type I alone has p_d = sum of w / (w + tau) over the cells; draws come within 5 percent
    full = _gaussian_family(spark, sf)
    d = full.panel.withColumn("one", F.lit(1.0))
    model = latent.PanelModel(d, full.edges, "y", [], "one", {"interaction": 0.25}, full.years)
    spec = models.ModelSpec("type_one", interaction="I", area=False, year=False)
    got = latent.criteria(model.fit(spec, draws=400))
    # the intercept is one degree of freedom that the cells share
    closed = F.col("n") / 1.25
    return got.select("n", F.round(closed, 6).alias("p_d"), (F.abs(F.col("p_d") - closed) < 0.05 * closed + 1).alias("near"))


_LL_SQL = "ll AS (SELECT row AS obs, draw, -0.5 * value * value - 0.9189385332046727 AS loglik, value FROM draws)"


def _loglik(spark, sf):
    v = F.col("value")
    return fx.draws_long(spark, sf).select(F.col("row").alias("obs"), "draw", (-0.5 * v * v - 0.9189385332046727).alias("loglik"), "value")


@query(
    "md7_information_criteria",
    with_ctes(
        "effect",
        f"""WITH {_LL_SQL}, pt AS (SELECT obs, ln(avg(exp(loglik))) AS lppd, var_samp(loglik) AS pw, 1 / avg(exp(-loglik)) AS cpo, avg(value) AS m FROM ll GROUP BY 1),
        t AS (SELECT sum(lppd) AS lppd, sum(pw) AS p_waic, sum(ln(cpo)) AS log_cpo, sum(-0.5 * m * m - 0.9189385332046727) AS hat FROM pt),
        b AS (SELECT -2 * sum(loglik) / count(DISTINCT draw) AS d_bar FROM ll)
        SELECT {rnd('-2 * (lppd - p_waic)')} AS waic, {rnd('p_waic')} AS p_waic, {rnd('d_bar')} AS d_bar, {rnd('d_bar + 2 * hat')} AS p_d,
               {rnd('2 * d_bar + 2 * hat')} AS dic, {rnd('log_cpo')} AS log_cpo FROM t, b""",
    ),
)
def md7(spark, sf):
    d = _loglik(spark, sf)
    m = F.avg("value")
    at_mean = d.groupBy("obs").agg((-0.5 * m * m - 0.9189385332046727).alias("loglik_at_mean"))
    return rounded(models.information_criteria(d.drop("value"), at_mean))


@query(
    "md7_pointwise_criteria",
    with_ctes("effect", f"WITH {_LL_SQL} SELECT obs, {rnd('ln(avg(exp(loglik)))')} AS lppd, {rnd('var_samp(loglik)')} AS p_waic, {rnd('1 / avg(exp(-loglik))')} AS cpo FROM ll GROUP BY 1"),
)
def md7_points(spark, sf):
    return rounded(models.pointwise_criteria(_loglik(spark, sf).drop("value")))


# ---------------------------------------------------------------------- posterior


@query("ps7_fitted_exceedance")
def ps7_fitted(spark, sf):
    """Mean, band and probability of a negative effect for every area of the fit of md3."""
    edges, _, _ = tract_graph(spark, sf)
    edges = reliable_checkpoint(edges)
    d = _scaled_panel(spark, sf).groupBy("area").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("b"))
    systems = reliable_checkpoint(d.select("area", F.array("w").alias("w"), F.array("b").alias("b")))
    graph = blocks.dealt(edges, systems.select("area"))
    mean = blocks.solve(systems, graph, [[0.5]]).values.select("area", F.get("x", F.lit(0)).alias("mean"))
    spread = blocks.marginal_variances(systems, edges, graph, [[0.5]]).select("area", F.get("x", F.lit(0)).alias("variance"))
    return rounded(latent.exceedance(mean, spread))


def _unstacked(spark, sf, layout="block"):
    n = fx.n_effect_areas(spark, sf)
    d = posterior.unstack(fx.effects(spark, sf), "row", n, fx.N_YEARS, layout)
    mean = F.aggregate("draws", F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size("draws")
    return d.withColumn("mean", mean), n


_MEAN_SQL = "em AS (SELECT row, block, year_index, area_index, avg(value) AS mean FROM draws GROUP BY 1, 2, 3, 4)"
_COMB_SQL = f"{_MEAN_SQL}, comb AS (SELECT area_index, year_index, sum(mean) AS mean FROM em GROUP BY 1, 2)"


@query(
    "ps1_unstack_effects",
    with_ctes("effect", """SELECT e.row, block, year_index, area_index, CAST((e.row // n) % 2 AS INTEGER) AS block_interleaved, CAST(e.row // n // 2 AS INTEGER) AS year_interleaved FROM effect e, na"""),
)
def ps1(spark, sf):
    a, _ = _unstacked(spark, sf)
    b, _ = _unstacked(spark, sf, "interleaved")
    b = b.select("row", F.col("block").alias("block_interleaved"), F.col("year_index").alias("year_interleaved"))
    return a.select("row", "block", "year_index", "area_index").join(b, "row")


@query("ps2_combined_blocks", with_ctes("effect", f"WITH {_COMB_SQL} SELECT area_index, year_index, {rnd('mean', 9)} AS mean FROM comb"))
def ps2(spark, sf):
    return rounded(posterior.combine_blocks(_unstacked(spark, sf)[0], "mean"), 9)


@query(
    "ps3_add_fixed_effect",
    with_ctes("effect panel", f"WITH {_COMB_SQL} SELECT area_index, year_index, {rnd('mean + (SELECT regr_slope(mortrate, income) FROM panel)', 4)} AS mean FROM comb"),
)
def ps3(spark, sf):
    p = fx.panel(spark, sf)
    fixed = models.linear_regression(p, "mortrate", ["income"]).table(p)
    return rounded(posterior.add_fixed(posterior.combine_blocks(_unstacked(spark, sf)[0], "mean"), "mean", fixed, "income"), 4)


@query(
    "ps4_linear_combinations",
    with_ctes(
        "effect",
        f"WITH {_MEAN_SQL} SELECT b.year_index * n + b.area_index AS i, {rnd('a.mean + b.mean', 9)} AS mean FROM em a JOIN em b ON a.block = 0 AND a.year_index = 0 AND b.block = 1 AND a.area_index = b.area_index, na",
    ),
)
def ps4(spark, sf):
    # the area slope is the first year of block 0, the interaction is block 1
    d, n = _unstacked(spark, sf)
    slope = d.where("block = 0 AND year_index = 0").select(F.lit("slope").alias("effect"), F.col("area_index").alias("j"), "mean")
    inter = d.where("block = 1").select(F.lit("interaction").alias("effect"), (F.col("year_index") * n + F.col("area_index")).alias("j"), "mean")
    sel = structure.area_selectors(spark, n, fx.N_YEARS, "slope", "interaction")
    return rounded(posterior.apply_combinations(sel, slope.unionByName(inter)), 9)


@query(
    "ps5_select_and_expand",
    with_ctes("effect", f"WITH {_COMB_SQL} SELECT area_index, {rnd('mean', 9)} AS mean, CAST(y AS INTEGER) AS year FROM comb, range(2001, 2015) t(y) WHERE year_index = 4"),
)
def ps5(spark, sf):
    d, n = _unstacked(spark, sf)
    one = posterior.select_effect(posterior.combine_blocks(d, "mean"), n, year=4).drop("year_index")
    return rounded(posterior.expand_years(one, 2001, 2014), 9)


def _effect_areas(spark, sf):
    return fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("area_index"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("geoid"))


@query(
    "ps6_map_table",
    with_ctes("effect", f"WITH {_COMB_SQL} SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS geoid, year_index + 1995 AS year, {rnd('mean', 9)} AS mean FROM comb JOIN supplier ON s_suppkey = area_index"),
)
def ps6(spark, sf):
    return rounded(posterior.map_table(posterior.combine_blocks(_unstacked(spark, sf)[0], "mean"), _effect_areas(spark, sf), 1995), 9)


@query(
    "ps7_exceedance_from_draws",
    with_ctes("effect", f"SELECT row, {rnd('avg(CASE WHEN value < 0 THEN 1.0 ELSE 0.0 END)')} AS p_below, {rnd('1 - avg(CASE WHEN value < 0 THEN 1.0 ELSE 0.0 END)')} AS p_above FROM draws GROUP BY 1"),
)
def ps7(spark, sf):
    e = fx.effects(spark, sf)
    return rounded(
        e.select("row", posterior.exceedance_from_draws("draws").alias("p_below"), posterior.exceedance_from_draws("draws", upper=True).alias("p_above"))
    )


def _density_points(spark, sf):
    """A curve per effect: ordinate x from the draw number, density from the draw."""
    return fx.draws_long(spark, sf).select("row", ((F.col("draw") - 20) / 10.0 + F.col("row") % 7 * 0.03).alias("x"), F.abs("value").alias("density"))


@query(
    "ps7_exceedance_from_density",
    with_ctes(
        "effect",
        f"""SELECT row, {rnd('sum(CASE WHEN x1 <= 0 THEN w WHEN x0 >= 0 THEN 0 ELSE -x0 * (f0 + f0 - x0 * (f1 - f0) / (x1 - x0)) / 2 END) / sum(w)')} AS p
        FROM (SELECT *, (x1 - x0) * (f0 + f1) / 2 AS w FROM (
          SELECT row, x AS x0, f AS f0, lead(x) OVER (PARTITION BY row ORDER BY x) AS x1, lead(f) OVER (PARTITION BY row ORDER BY x) AS f1
          FROM (SELECT row, (draw - 20) / CAST(10 AS DOUBLE) + row % 7 * CAST(0.03 AS DOUBLE) AS x, abs(value) AS f FROM draws) a) b WHERE x1 IS NOT NULL) c GROUP BY 1""",
    ),
)
def ps7_density(spark, sf):
    return rounded(posterior.exceedance_from_density(_density_points(spark, sf), ["row"]))


@query(
    "ps8_probability_classes",
    with_ctes(
        "effect",
        """SELECT row, CASE WHEN p < 0.05 THEN 0 WHEN p < 0.2 THEN 1 WHEN p < 0.5 THEN 2 WHEN p < 0.8 THEN 3 WHEN p < 0.95 THEN 4 ELSE 5 END AS class_7,
        CASE WHEN p < 0.2 THEN 0 WHEN p < 0.5 THEN 1 WHEN p < 0.8 THEN 2 ELSE 3 END AS class_5,
        CASE WHEN m < -0.02 THEN 0 WHEN m < -0.01 THEN 1 WHEN m < 0 THEN 2 WHEN m < 0.01 THEN 3 WHEN m < 0.02 THEN 4 ELSE 5 END AS class_mean
        FROM (SELECT row, avg(CASE WHEN value < 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS p, avg(value) AS m FROM draws GROUP BY 1) q""",
    ),
)
def ps8(spark, sf):
    d, _ = _unstacked(spark, sf)
    ends = d.agg(F.struct(F.min("mean").alias("lo"), F.max("mean").alias("hi"))).scalar()
    d = d.select("row", "mean", posterior.exceedance_from_draws("draws").alias("p"), ends.alias("e"))
    inner = [F.lit(v) for v in (-0.02, -0.01, 0.0, 0.01, 0.02)]
    return d.select(
        "row",
        posterior.classify("p", posterior.PROBABILITY_BREAKS_7).alias("class_7"),
        posterior.classify("p", posterior.PROBABILITY_BREAKS_5).alias("class_5"),
        posterior.classify("mean", [F.col("e.lo"), *inner, F.col("e.hi")]).alias("class_mean"),
    )


@query(
    "ps9_effect_bands",
    with_ctes("effect", f"SELECT block, year_index, {rnd('avg(value)')} AS mean, {rnd('quantile_cont(value, 0.025)')} AS q_low, {rnd('quantile_cont(value, 0.975)')} AS q_high FROM draws GROUP BY 1, 2"),
)
def ps9(spark, sf):
    d, _ = _unstacked(spark, sf)
    long = d.select("block", "year_index", F.explode("draws").alias("value")).withColumn("value", F.col("value").cast("double"))
    return rounded(posterior.effect_bands(long, "value", ["block", "year_index"]))


@query(
    "ps10_residuals",
    with_ctes("panel", f"SELECT tract, year, disease, {rnd('mortrate', 9)} AS mortrate, {rnd('f', 9)} AS fitted, {rnd('mortrate - f', 9)} AS residual FROM panel JOIN (SELECT disease AS d, year AS y, avg(mortrate) AS f FROM panel GROUP BY 1, 2) q ON d = disease AND y = year"),
)
def ps10(spark, sf):
    p = fx.panel(spark, sf)
    fitted = p.join(p.groupBy("year", "disease").agg(F.avg("mortrate").alias("fitted")), ["year", "disease"]).select(*_KEY, "fitted")
    return rounded(posterior.residuals(p.select(*_KEY, "mortrate"), fitted, _KEY, "mortrate"), 9)


@query(
    "ps11_prediction_accuracy",
    with_ctes(
        "panel",
        f"""SELECT disease, {rnd('avg(100 * abs((n_rec - pr) / nullif(n_rec, 0)))')} AS mape, {rnd('avg((n_rec - pr) * (n_rec - pr))')} AS mse,
        {rnd('sqrt(avg((n_rec - pr) * (n_rec - pr)))')} AS rmse, {rnd('avg(abs(n_rec - pr))')} AS mae FROM (SELECT *, pop * CAST(0.004 AS DOUBLE) AS pr FROM panel) p GROUP BY 1""",
    ),
)
def ps11(spark, sf):
    d = fx.panel(spark, sf).withColumn("rate", F.lit(0.004))
    return rounded(posterior.accuracy(d, "n_rec", "rate", "pop", by=["disease"]))


@query(
    "ps12_panel_map_tables",
    with_ctes(
        "effect panel",
        f"""WITH {_COMB_SQL}, mt AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS g, year_index + 1995 AS y, mean FROM comb JOIN supplier ON s_suppkey = area_index)
        SELECT g AS geoid, y AS year, {rnd('mean', 9)} AS mean, {rnd('ue')} AS ue, {rnd('mortrate', 9)} AS mortrate FROM mt LEFT JOIN panel ON geoid = g AND year = y AND disease = 'Mentalhealth' WHERE ue IS NOT NULL""",
    ),
)
def ps12(spark, sf):
    m = posterior.map_table(posterior.combine_blocks(_unstacked(spark, sf)[0], "mean"), _effect_areas(spark, sf), 1995)
    p = fx.panel(spark, sf).where(F.col("disease").rlike("^Mental")).select("geoid", "year", "ue", "mortrate")
    return m.join(p, ["geoid", "year"], "left").where(F.col("ue").isNotNull()).select(
        "geoid", "year", F.round("mean", 9).alias("mean"), F.round("ue", 6).alias("ue"), F.round("mortrate", 9).alias("mortrate")
    )


# -------------------------------------------------------------------- diagnostics


@query(
    "dg1_variance_inflation",
    with_ctes("panel", f"SELECT unnest(['elder', 'income']) AS term, {rnd('1 / (1 - r * r)')} AS vif FROM (SELECT corr(elder, income) AS r FROM panel) q"),
)
def dg1(spark, sf):
    return rounded(diagnostics.vif(fx.panel(spark, sf), ["elder", "income"]))


@query("dg2_poisson_variance_inflation")
def dg2(spark, sf):
    return rounded(models.poisson_vif(_poisson_panel(spark, sf), "n_rec", ["elder", "income"], "log_pop"))


@query(
    "dg2_variance_inflation_by_cause",
    with_ctes(
        "panel",
        f"""WITH {_CAUSES_SQL}, w AS (SELECT CAST(disease = 'Allcauses' AS INTEGER) AS a, CAST(disease = 'Mentalhealth' AS INTEGER) AS b, sum(n_rec) AS mu FROM panel GROUP BY disease),
        c AS (SELECT sum(mu * a * b) / sum(mu) - sum(mu * a) / sum(mu) * (sum(mu * b) / sum(mu)) AS ab,
                     sum(mu * a) / sum(mu) * (1 - sum(mu * a) / sum(mu)) AS aa, sum(mu * b) / sum(mu) * (1 - sum(mu * b) / sum(mu)) AS bb FROM w)
        SELECT unnest(['every', 'mental']) AS term, {rnd('1 / (1 - ab * ab / aa / bb)')} AS vif FROM c""",
    ),
)
def dg2_causes(spark, sf):
    # with a factor alone the fitted means of a level sum to its count
    return rounded(models.poisson_vif(_cause_panel(spark, sf), "n_rec", CAUSE_MARKS, "log_pop"))


_CORR = ["ue", "elder", "income", "mortrate"]


@query(
    "dg3_correlation_matrix",
    with_ctes("panel", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {rnd(f'corr({a}, {b})', 3)} AS r FROM panel WHERE ue IS NOT NULL" for a in _CORR for b in _CORR)),
)
def dg3(spark, sf):
    return diagnostics.correlations(fx.panel(spark, sf), _CORR)


def _cdf_sql(z: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2)))"
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    erf = f"(1 - {poly} * exp(-({z}) * ({z}) / 2))"
    return f"(0.5 * (1 + CASE WHEN {z} < 0 THEN -{erf} ELSE {erf} END))"


def _ks_sql(by: str, digits: int | None = 6) -> str:
    gap = "max(greatest(hi / n - F, F - lo / n))"
    gap = gap if digits is None else rnd(gap, digits)
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}CAST(max(n) AS BIGINT) AS n, {gap} AS d FROM (
      SELECT {keys}n, CAST(rank() OVER ({part} ORDER BY v) - 1 AS DOUBLE) AS lo, CAST(count(*) OVER ({part} ORDER BY v) AS DOUBLE) AS hi, {_cdf_sql('((v - m) / s)')} AS F
      FROM (SELECT {keys}mortrate AS v, avg(mortrate) OVER ({part}) AS m, stddev_samp(mortrate) OVER ({part}) AS s, CAST(count(*) OVER ({part}) AS DOUBLE) AS n FROM panel) a) b
      {f'GROUP BY {by}' if by else ''}"""


@query("dg4_ks_normality", with_ctes("panel", _ks_sql("")))
def dg4(spark, sf):
    return rounded(diagnostics.ks_normal(fx.panel(spark, sf), "mortrate").select("n", "d"))


@query("dg5_ks_normality_by_year", with_ctes("panel", _ks_sql("year")))
def dg5(spark, sf):
    return rounded(diagnostics.ks_normal(fx.panel(spark, sf), "mortrate", ["year"]).select("year", "n", "d"))


@query(
    "wn7_grouped_ks_p_value",
    with_ctes(
        "panel",
        f"""SELECT year, {rnd('greatest(0, least(1, sum(CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * n * d * d))))')} AS p_value
        FROM ({_ks_sql('year', None)}) q, range(1, 101) t(k) GROUP BY year""",
    ),
)
def wn7(spark, sf):
    return rounded(diagnostics.ks_normal(fx.panel(spark, sf), "mortrate", ["year"]).select("year", "p_value"))


_MOMENTS = "(SELECT avg((v - m) ^ 2) AS m2, avg((v - m) ^ 3) AS m3, avg((v - m) ^ 4) AS m4, CAST(count(*) AS DOUBLE) AS n FROM (SELECT {v} AS v, avg({v}) OVER () AS m FROM panel) a) q"


@query(
    "dg6_jarque_bera",
    with_ctes(
        "panel",
        f"SELECT {rnd('jb', 4)} AS jb, {rnd('exp(-jb / 2)')} AS p_value FROM (SELECT n / 6 * ((m3 / m2 ^ 1.5) ^ 2 + (m4 / m2 ^ 2 - 3) ^ 2 / 4) AS jb FROM {_MOMENTS.format(v='mortrate')}) r",
    ),
)
def dg6(spark, sf):
    d = diagnostics.jarque_bera(fx.panel(spark, sf), "mortrate")
    return d.select(F.round("jb", 4).alias("jb"), F.round("p_value", 6).alias("p_value"))


@query("dg7_log_skewness", with_ctes("panel", f"SELECT {rnd('m3 / m2 ^ 1.5 * ((n - 1) / n) ^ 1.5')} AS skewness FROM {_MOMENTS.format(v='ln(mortrate)')}"))
def dg7(spark, sf):
    return rounded(diagnostics.sample_skewness(fx.panel(spark, sf).withColumn("v", F.log("mortrate")), "v"))


@query(
    "dg8_histogram_by_year",
    with_ctes(
        "panel",
        f"""WITH r AS (SELECT min(mortrate) AS lo, (max(mortrate) - min(mortrate)) / 30 AS w FROM panel)
        SELECT y.year, b.bin, (SELECT count(*) FROM panel p, r WHERE p.year = y.year AND least(CAST(floor((mortrate - lo) / w) AS BIGINT), 29) = b.bin) AS n,
               {rnd('lo + bin * w')} AS "left", {rnd('lo + (bin + 1) * w')} AS "right"
        FROM (SELECT DISTINCT year FROM panel) y, (SELECT unnest(range(30)) AS bin) b, r""",
    ),
)
def dg8(spark, sf):
    return rounded(diagnostics.histogram(fx.panel(spark, sf), "mortrate", 30, ["year"]))


@query(
    "dg9_kernel_density",
    with_ctes(
        "panel",
        f"""WITH l AS (SELECT 'income' AS name, income AS v FROM panel UNION ALL SELECT 'elder', elder FROM panel),
        s AS (SELECT name, min(v) AS lo, max(v) AS hi, CAST(count(*) AS DOUBLE) AS n, 0.9 * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34) * pow(count(*), -0.2) AS h FROM l GROUP BY 1),
        b AS (SELECT l.name, least(CAST(floor((v - lo) / ((hi - lo) / 256)) AS BIGINT), 255) AS bin, count(*) AS c FROM l JOIN s ON l.name = s.name GROUP BY 1, 2),
        k AS (SELECT s.name, g AS grid, lo - 3 * h + g * (hi - lo + 6 * h) / 31 AS x, lo + (bin + 0.5) * (hi - lo) / 256 AS c0, c, h, n
              FROM b JOIN s ON b.name = s.name, range(0, 32) t(g))
        SELECT name, CAST(grid AS INTEGER) AS grid, {rnd('max(x)')} AS x, {rnd('sum(c * exp(-(pow((x - c0) / h, 2)) / 2) / sqrt(2 * pi())) / max(n * h)')} AS density
        FROM k GROUP BY name, grid""",
    ),
)
def dg9(spark, sf):
    long = reshape.to_long(fx.panel(spark, sf), [], ["income", "elder"])
    return rounded(diagnostics.density(long, "value", ["name"], bins=256, grid=32))
