"""NULL rules, recodes, code flags and shares."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arealis.functions import codes, numeric, recode
from arealis.operators import rates, reshape


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_division_by_zero_is_null(spark):
    assert one(spark, numeric.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, numeric.clamp_zero(F.lit(None).cast("double"))) is None
    assert one(spark, numeric.clamp_zero(F.lit(-2.0))) == 0.0


def test_sums_and_nulls(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("c", 2.0)], "g string, x double")
    got = {r["g"]: (r["z"], r["s"]) for r in d.groupBy("g").agg(numeric.zero_sum("x").alias("z"), numeric.strict_sum("x").alias("s")).collect()}
    assert got == {"a": (1.0, None), "b": (0.0, None), "c": (2.0, 2.0)}


def test_normal_cdf(spark):
    from math import erf, sqrt

    for z in (-3.0, -0.5, 0.0, 1.2, 4.0):
        assert abs(one(spark, numeric.normal_cdf(F.lit(z))) - 0.5 * (1 + erf(z / sqrt(2)))) < 2e-7


def test_ages(spark):
    cases = [((1, 45), 45), ((2, 30), 2), ((4, 400), 1), ((5, 3), 0), ((6, 3), 0), ((9, 3), 9999), ((1, 999), 9999), ((None, 3), 9999), ((1, None), 9999)]
    d = spark.createDataFrame([(i, u, n) for i, ((u, n), _) in enumerate(cases)], "i int, u int, n int")
    got = [r["a"] for r in d.orderBy("i").select(recode.age_years("u", "n").alias("a")).collect()]
    assert got == [a for _, a in cases]


def test_age_bands(spark):
    got = [one(spark, recode.age_band(F.lit(a))) for a in (0, 9, 10, 79, 80, 120, 9999)]
    assert got == ["00_10", "00_10", "10_20", "70_80", "80_Inf", "80_Inf", None]
    assert one(spark, recode.age_band(F.lit(9999), unknown=None)) == "80_Inf"
    assert one(spark, recode.age_band(F.lit(None).cast("int"))) is None


def test_recode_passes_unlisted_through(spark):
    assert one(spark, recode.recode(F.lit("x"), {"a": "b"})) == "x"
    assert one(spark, recode.leading_year(F.lit("ABCD1"))) is None


code = st.one_of(st.none(), st.text("FGA0123456789", min_size=1, max_size=5))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(*[code] * 4), min_size=1, max_size=20))
def test_any_code_equals_column_by_column(spark, rows):
    cols = [f"c{i}" for i in range(4)]
    patterns = [p for _, p in codes.CAUSE_FLAGS.values()] + ["F.1", "^F0", "0$", "[^F]1"]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c0 string, c1 string, c2 string, c3 string")
    got = d.orderBy("i").select(*[codes.any_code(cols, p).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    for row, r in zip(got, rows):
        for k, p in enumerate(patterns):
            assert row[f"p{k}"] == int(any(c is not None and re.search(p, c) is not None for c in r)), (p, r)


def test_variable_code(spark):
    assert one(spark, codes.variable_code(F.lit("B01001A_001E"))) == "B01001A_001"
    assert one(spark, codes.variable_code(F.lit("nothing"))) is None


def test_share_with_missing_term_is_null(spark):
    d = spark.createDataFrame([(1.0, 2.0, 4.0), (1.0, None, 4.0), (1.0, 1.0, 0.0)], "a double, b double, n double")
    assert [r["v"] for r in d.select(reshape.share(["a", "b"], ["n"]).alias("v")).collect()] == [75.0, None, None]


def test_standard_weights_sum_to_one(spark):
    w = rates.standard_weights(rates.regroup_bands(rates.standard_population(spark)))
    s = w.agg(F.sum("n_all"), F.sum("n_male"), F.sum("n_female")).first()
    assert all(abs(v - 1) < 1e-12 for v in s)
    assert w.count() == 9


def test_uniform_rate_is_returned(spark):
    w = rates.standard_weights(rates.regroup_bands(rates.standard_population(spark)))
    d = w.select("agegroup", "n_all", F.lit(1).alias("area"), F.lit(12.5).alias("r"))
    assert abs(rates.standardised_rates(d, ["area"], ["r"]).first()["r"] - 12.5) < 1e-12


def test_unknown_age_is_not_in_a_band_but_counts(spark):
    d = spark.createDataFrame([(1, 30, 1), (1, None, 1), (1, 50, 0)], "g int, age int, f int")
    r = rates.flag_summary(d, ["g"], "age", {"f": "mean_age"}, {"f": "n"}).first()
    assert (r["n"], r["mean_age"]) == (2, 15.0)
