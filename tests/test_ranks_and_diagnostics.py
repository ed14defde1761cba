"""Exact distributed order statistics against numpy, with ties and hot groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.operators import diagnostics, models, panel, posterior, ranks


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    hot = [("hot", float(v)) for v in np.r_[np.zeros(400), rng.normal(size=600)]]
    rest = [(f"g{i % 5}", float(v)) for i, v in enumerate(rng.exponential(size=500))]
    return hot + rest + [("g0", None), ("empty", None), (None, 1.5), (None, 2.5)]


def test_quantiles(spark, skewed):
    d = spark.createDataFrame(skewed, "g string, x double")
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in ranks.exact_quantiles(d, "x", {"a": 0.025, "b": 0.5, "c": 0.975}, ["g"]).collect()}
    assert "empty" not in got
    for g in {k for k, _ in skewed} - {"empty"}:
        v = [x for k, x in skewed if k == g and x is not None]
        assert np.allclose(got[g], np.quantile(v, [0.025, 0.5, 0.975]))


def test_dense_index(spark):
    d = spark.createDataFrame([(k,) for k in "dbcabdd"], "k string")
    assert sorted(map(tuple, ranks.dense_index(d, "k", "i").collect())) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]


def test_group_totals_keep_null_groups(spark, skewed):
    d = spark.createDataFrame(skewed, "g string, x double")
    out = ranks.with_group_totals(d, ["g"], {"n": F.count(F.lit(1))})
    assert out.count() == len(skewed)
    assert out.where("g IS NULL").first()["n"] == 2


def test_ks_distance(spark, skewed):
    d = spark.createDataFrame(skewed, "g string, x double")
    got = {r["g"]: r["d"] for r in diagnostics.ks_normal(d, "x", ["g"]).collect()}
    from math import erf, sqrt

    v = np.sort([x for k, x in skewed if k == "hot"])
    f = np.array([0.5 * (1 + erf((x - v.mean()) / v.std(ddof=1) / sqrt(2))) for x in v])
    i = np.arange(1, len(v) + 1)
    assert abs(got["hot"] - max((i / len(v) - f).max(), (f - (i - 1) / len(v)).max())) < 1e-6


def test_vif_matches_inverse_correlation(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    x[:, 2] += x[:, 0]
    d = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = [r["vif"] for r in diagnostics.vif(d, ["a", "b", "c"]).collect()]
    assert np.allclose(got, np.diag(np.linalg.inv(np.corrcoef(x.T))))


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(float(v),) for v in rng.normal(size=500)], "x double")
    rows = sorted((r["x"], r["density"]) for r in diagnostics.density(d, "x").collect())
    x, f = map(np.array, zip(*rows))
    assert abs(np.sum((f[1:] + f[:-1]) / 2 * np.diff(x)) - 1) < 0.01


def test_median_imputation_and_constant_column(spark):
    d = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, 5.0), (10.0, None)], "a double, b double")
    got = panel.impute_median(d, ["a", "b"]).collect()
    assert sorted(r["a"] for r in got) == [1.0, 3.0, 3.0, 10.0]
    z = panel.zscore(d, ["a", "b"]).collect()
    assert all(r["b"] is None for r in z)


def test_index_variance_is_the_eigenvalue(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1.0]])
    d = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    pc = models.principal_components(d, ["a", "b", "c"])
    var = d.select(pc.score().alias("s")).agg(F.var_pop("s")).first()[0]
    assert abs(var - pc.eigenvalues[0]) < 1e-9
    assert abs(pc.eigenvalues.sum() - 3) < 1e-9
    assert pc.vectors[np.argmax(np.abs(pc.vectors[:, 0])), 0] > 0


def test_poisson_score_equations(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    pop = rng.integers(50, 500, size=400)
    y = rng.poisson(pop * np.exp(-3 + 0.4 * x))
    d = spark.createDataFrame([(float(a), float(b), float(np.log(p))) for a, b, p in zip(x, y, pop)], "x double, y double, o double")
    fit = models.poisson_regression(d, "y", ["x"], "o")
    mu = F.exp(fit.linear_predictor() + F.col("o"))
    s = d.agg(F.sum(F.col("y") - mu), F.sum((F.col("y") - mu) * F.col("x"))).first()
    assert max(abs(s[0]), abs(s[1])) < 1e-3


def test_exceedance(spark):
    d = spark.createDataFrame([(1, -1.0, 1.0), (1, 1.0, 1.0), (2, 1.0, 1.0), (2, 2.0, 3.0)], "e int, x double, density double")
    got = {r["e"]: r["p"] for r in posterior.exceedance_from_density(d, ["e"]).collect()}
    assert got == {1: 0.5, 2: 0.0}


def test_temporal_effect_is_refused(spark):
    d = spark.createDataFrame([(0, 0, 1.0)], "area_index int, year_index int, mean double")
    with pytest.raises(ValueError):
        posterior.select_effect(d, 5)


def test_repeat_is_capped():
    out = models.repeat_until(lambda s, i: s + 1, 0, lambda s: False, max_iter=3)
    assert (out.result, out.iterations, out.converged) == (3, 3, False)


def test_exact_kolmogorov_distribution():
    from arealis.operators.diagnostics import kolmogorov_cdf

    # values published with the method, and critical values of printed tables
    assert kolmogorov_cdf(10, 0.274) == pytest.approx(0.6284796154565, abs=1e-12)
    assert kolmogorov_cdf(2000, 0.04) == pytest.approx(0.99676943191714, abs=1e-10)
    for n, d in ((1, 0.975), (2, 0.84189), (5, 0.56328), (10, 0.40925), (20, 0.29408), (40, 0.21012)):
        assert kolmogorov_cdf(n, d) == pytest.approx(0.95, abs=2e-5)
    assert kolmogorov_cdf(7, 0.01) == 0 and kolmogorov_cdf(7, 1.0) == 1


def test_ks_method_depends_on_size_and_ties(spark):
    from arealis.operators.diagnostics import kolmogorov_cdf, ks_normal

    rows = [("few", float(v * v)) for v in range(12)] + [("ties", float(v // 2)) for v in range(12)] + [("many", float(v % 151)) for v in range(151)]
    got = {r["g"]: r for r in ks_normal(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    assert {g: r["method"] for g, r in got.items()} == {"few": "exact", "ties": "asymptotic", "many": "asymptotic"}
    assert got["few"]["p_value"] == pytest.approx(1 - kolmogorov_cdf(12, got["few"]["d"]))


def test_size_estimates_do_not_grow_in_a_loop(spark):
    # an estimate of three times the digits in every round filled the driver's memory
    d = spark.range(12).select((F.col("id") % 4).alias("a"), F.col("id").alias("c"))
    for _ in range(8):
        to = d.select("c", F.col("a").alias("to"))
        d = ranks.reliable_checkpoint(d.join(to, "c").join(to.select("c"), "c").select(F.col("to").alias("a"), "c"))
        text = d._jdf.queryExecution().optimizedPlan().stats().simpleString()
        assert "E+" not in text
    assert sorted((r["a"], r["c"]) for r in d.collect()) == sorted((k % 4, k) for k in range(12))
    again = d.join(d.select(F.col("c").alias("a"), F.col("a").alias("x")), "a").where("c > 7")
    assert sorted((r["c"], r["x"]) for r in again.collect()) == [(8, 0), (9, 1), (10, 2), (11, 3)]
