"""Queries for joins, aggregates, group-wise values, sorting and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from ..functions.numeric import strict_sum, strict_weighted_mean, zero_sum
from ..functions.recode import age_band
from ..operators import harmonise, panel as panel_ops, rates, reshape
from ..operators.ranks import dense_index
from ..sources.files import read_table, write_table
from . import fixtures as fx
from .files import shared_folder
from .fixtures import with_ctes
from .records import flag_sql, flagged
from .registry import query, rnd, rounded

# ----------------------------------------------------------------------------- joins


@query("jn1_left_join_dimension", with_ctes("panel prices", f"SELECT tract, p.year, disease, {rnd('income')} AS income, cpi FROM panel p LEFT JOIN prices c ON p.year = c.year AND c.year > 1996"))
def jn1(spark, sf):
    cpi = fx.prices(spark, sf).where(F.col("year") > 1996)
    return rounded(fx.panel(spark, sf).join(cpi, "year", "left").select("tract", "year", "disease", "income", "cpi"))


@query(
    "jn2_left_join_composite",
    with_ctes("panel", f"SELECT a.tract, a.year, a.n_rec, {rnd('b.elder')} AS elder FROM panel a LEFT JOIN panel b ON a.tract = b.tract AND a.year = b.year AND b.disease = 'Allcauses' WHERE a.disease = 'Mentalhealth'"),
)
def jn2(spark, sf):
    p = fx.panel(spark, sf)
    a = p.where(F.col("disease") == "Mentalhealth").select("tract", "year", "n_rec")
    b = p.where(F.col("disease") == "Allcauses").select("tract", "year", "elder")
    return rounded(a.join(b, ["tract", "year"], "left"))


@query(
    "jn3_full_join",
    "SELECT coalesce(a.k, b.k) AS k, n_customers, n_urgent FROM (SELECT c_custkey AS k, count(*) AS n_customers FROM customer WHERE c_acctbal > 0 GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) b ON a.k = b.k",
)
def jn3(spark, sf):
    a = fx.table(spark, sf, "customer").where(F.col("c_acctbal") > 0).groupBy(F.col("c_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n_customers"))
    b = fx.table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n_urgent"))
    return a.join(b, "k", "full")


def _state_outcomes(spark, sf):
    """Tract outcomes of two states: 41 counts returned items, 53 accepted ones."""
    p = fx.panel(spark, sf).withColumn("geoid", F.concat(F.when(F.col("tract") % 2 == 0, "41").otherwise("53"), "geoid"))
    own = {"41": "Mentalhealth", "53": "Allcauses"}
    out = {s: p.where(F.col("disease") == d).select("geoid", "year", F.col("n_rec").alias("n_outcome")) for s, d in own.items()}
    cov = p.where(F.col("disease") == "Neoplasms").select("geoid", "year", "income", "elder")
    areas = fx.tracts(spark, sf).select(
        F.concat(F.when(F.col("geom") % 2 == 0, "41").otherwise("53"), F.lpad(F.col("geom").cast("string"), 6, "0")).alias("geoid"), "county"
    )
    return areas, cov, out


_STATE_SQL = f"""st AS (SELECT concat(CASE WHEN tract % 2 = 0 THEN '41' ELSE '53' END, geoid) AS geoid, tract, year, disease, n_rec, income, elder FROM panel),
asm AS (SELECT c.geoid, c.year, t.county, {rnd('c.income')} AS income, {rnd('c.elder')} AS elder, o.n_rec AS n_outcome
  FROM (SELECT * FROM st WHERE disease = 'Neoplasms') c LEFT JOIN tracts t ON c.tract = t.geom
  LEFT JOIN st o ON o.geoid = c.geoid AND o.year = c.year
    AND o.disease = CASE WHEN c.geoid LIKE '41%' THEN 'Mentalhealth' ELSE 'Allcauses' END)"""


@query("jn4_right_join_by_state", with_ctes("panel tracts", f"WITH {_STATE_SQL} SELECT * FROM asm"))
def jn4(spark, sf):
    return rounded(panel_ops.assemble_by_state(*_state_outcomes(spark, sf)).select("geoid", "year", "county", "income", "elder", "n_outcome"))


@query(
    "jn5_chained_left_joins",
    with_ctes(
        "panel prices tracts",
        f"SELECT tract, p.year, disease, {rnd('mortrate', 9)} AS mortrate, cpi, county, s_acctbal FROM panel p LEFT JOIN prices c ON p.year = c.year LEFT JOIN tracts t ON p.tract = t.geom LEFT JOIN supplier s ON p.tract = s.s_suppkey",
    ),
)
def jn5(spark, sf):
    t = fx.tracts(spark, sf).select(F.col("geom").alias("tract"), "county")
    s = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("tract"), "s_acctbal")
    out = panel_ops.add_covariates(fx.panel(spark, sf), [(fx.prices(spark, sf), ["year"]), (t, ["tract"]), (s, ["tract"])])
    return rounded(out.select("tract", "year", "disease", "mortrate", "cpi", "county", "s_acctbal"), 9)


# Every year from the first to the last of the records.
_YEARS_SQL = "(SELECT unnest(range(min(y), max(y) + 1)) AS y FROM (SELECT CAST(year(l_shipdate) AS BIGINT) AS y FROM lineitem) r)"


def _record_years(spark, sf):
    return panel_ops.year_range(fx.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year")))


@query("jn6_area_by_year", f"SELECT s_suppkey AS geom, CAST(y AS INTEGER) AS year FROM supplier, {_YEARS_SQL} q")
def jn6(spark, sf):
    return panel_ops.area_years(fx.tracts(spark, sf).select("geom"), *_record_years(spark, sf))


@query(
    "jn8_keyed_bind",
    with_ctes("panel", f"SELECT tract, year, disease, n_rec, {rnd('m')} AS mean_income FROM panel JOIN (SELECT tract AS t, year AS y, avg(income) AS m FROM panel GROUP BY 1, 2) e ON tract = t AND year = y"),
)
def jn8(spark, sf):
    p = fx.panel(spark, sf)
    effect = p.groupBy("tract", "year").agg(F.avg("income").alias("mean_income"))
    return rounded(p.select("tract", "year", "disease", "n_rec").join(effect, ["tract", "year"]))


# ------------------------------------------------------------------------ aggregates

_FLAG_COUNT_SQL = ", ".join(f"sum({f}) AS {n}" for f, n in codes.COUNTED_FLAGS.items())
_FLAGGED_SQL = (
    f"fl AS (SELECT tract, year, {fx.AGE_SQL} AS age, "
    + ", ".join(f"{flag_sql(f)} AS {f}" for f in codes.COUNTED_FLAGS)
    + " FROM rec)"
)
MEAN_AGES = {
    "nonsubstance2": "n_meanage_nonsubstance2",
    "dementia_vascular": "n_meanage_dementia_vas",
    "dementia_unspecified": "n_meanage_dementia_uns",
}
BAND_OF_AGE_SQL = """CASE WHEN age >= 80 THEN '80_Inf' WHEN age >= 0 THEN concat(lpad(CAST(age // 10 * 10 AS VARCHAR), 2, '0'), '_', CAST(age // 10 * 10 + 10 AS VARCHAR)) END"""


def banded(spark, sf):
    return flagged(spark, sf).withColumn("agegroup", age_band("age"))


@query("ag1_flag_sums_by_band", with_ctes("rec", f"WITH {_FLAGGED_SQL} SELECT tract, year, {BAND_OF_AGE_SQL} AS agegroup, {_FLAG_COUNT_SQL} FROM fl GROUP BY 1, 2, 3"))
def ag1(spark, sf):
    return rates.flag_counts(banded(spark, sf), ["tract", "year", "agegroup"])


@query(
    "ag2_flag_sums_and_mean_ages",
    with_ctes(
        "rec",
        f"WITH {_FLAGGED_SQL} SELECT tract, year, {_FLAG_COUNT_SQL}, "
        + ", ".join(f"{rnd(f'coalesce(sum(age * {f}), 0) / nullif(CAST(sum({f}) AS DOUBLE), 0)')} AS {n}" for f, n in MEAN_AGES.items())
        + " FROM fl GROUP BY 1, 2",
    ),
)
def ag2(spark, sf):
    return rounded(rates.flag_summary(flagged(spark, sf), ["tract", "year"], "age", MEAN_AGES))


@query(
    "ag3_count_and_strict_sum",
    with_ctes("panel", f"SELECT tract, count(*) AS n, {rnd('CASE WHEN count(ue) = count(*) THEN sum(ue) END')} AS ue_sum, {rnd('sum(ue)')} AS ue_known FROM panel GROUP BY tract"),
)
def ag3(spark, sf):
    return rounded(
        fx.panel(spark, sf).groupBy("tract").agg(F.count(F.lit(1)).alias("n"), strict_sum("ue").alias("ue_sum"), F.sum("ue").alias("ue_known"))
    )


@query("ag4_same_function_over_columns", with_ctes("panel", f"SELECT year, disease, {', '.join(f'{rnd(f"sum({c})")} AS {c}' for c in ('n_rec', 'pop', 'elder', 'income'))} FROM panel GROUP BY 1, 2"))
def ag4(spark, sf):
    return rounded(rates.summarise(fx.panel(spark, sf), ["year", "disease"], ["n_rec", "pop", "elder", "income"], zero_sum))


@query("ag5_small_to_large_areas", with_ctes("panel", "SELECT substr(geoid, 1, 5) AS county, year, sum(pop) AS pop, sum(n_rec) AS n_rec FROM panel GROUP BY 1, 2"))
def ag5(spark, sf):
    return fx.panel(spark, sf).groupBy(codes.key_slice("geoid", 1, 5).alias("county"), "year").agg(F.sum("pop").alias("pop"), F.sum("n_rec").alias("n_rec"))


@query(
    "ag6_weighted_mean",
    with_ctes("panel", f"SELECT year, {rnd('sum(income * pop) / sum(pop)')} AS income, {rnd('CASE WHEN count(ue) = count(*) THEN sum(ue * pop) / sum(pop) END')} AS ue, tract % 11 AS grp FROM panel GROUP BY year, tract % 11"),
)
def ag6(spark, sf):
    return rounded(
        fx.panel(spark, sf)
        .groupBy("year", (F.col("tract") % 11).alias("grp"))
        .agg(strict_weighted_mean("income", "pop").alias("income"), strict_weighted_mean("ue", "pop").alias("ue"))
    )


@query("ag7_distinct_counts", with_ctes("panel", "SELECT count(DISTINCT geoid) AS n_areas, count(DISTINCT year) AS n_years, count(DISTINCT disease) AS n_causes FROM panel"))
def ag7(spark, sf):
    return fx.panel(spark, sf).agg(
        F.count_distinct("geoid").alias("n_areas"), F.count_distinct("year").alias("n_years"), F.count_distinct("disease").alias("n_causes")
    )


@query("ag8_min_max", with_ctes("panel", f"SELECT {rnd('min(mortrate)', 9)} AS lo, {rnd('max(mortrate)', 9)} AS hi FROM panel"))
def ag8(spark, sf):
    return rounded(fx.panel(spark, sf).agg(F.min("mortrate").alias("lo"), F.max("mortrate").alias("hi")), 9)


@query("ag9_yearly_mean", with_ctes("panel", f"SELECT year, {rnd('avg(mortrate)')} AS mortrate, {rnd('avg(n_rec)')} AS n_rec FROM panel GROUP BY year"))
def ag9(spark, sf):
    return rounded(fx.panel(spark, sf).groupBy("year").agg(F.avg("mortrate").alias("mortrate"), F.avg("n_rec").alias("n_rec")))


# ------------------------------------------------------------------ group-wise values


@query("wn1_share_of_group", with_ctes("panel", f"SELECT tract, year, disease, {rnd('pop / CAST(sum(pop) OVER (PARTITION BY year, disease) AS DOUBLE)', 9)} AS pop_share FROM panel"))
def wn1(spark, sf):
    return rounded(rates.share_of_group(fx.panel(spark, sf), ["year", "disease"], {"pop": "pop_share"}).select("tract", "year", "disease", "pop_share"), 9)


@query(
    "wn2_expected_counts",
    with_ctes(
        "panel",
        f"SELECT tract, year, disease, {rnd('pop * r')} AS expected, {rnd('n_rec * r')} AS expected_as_outcome FROM (SELECT *, sum(n_rec) OVER (PARTITION BY year) / CAST(sum(pop) OVER (PARTITION BY year) AS DOUBLE) AS r FROM panel) p",
    ),
)
def wn2(spark, sf):
    d = rates.expected_counts(fx.panel(spark, sf), "n_rec", "pop", ["year"])
    d = rates.expected_counts(d, "n_rec", "pop", ["year"], base="outcome", name="expected_as_outcome")
    return rounded(d.select("tract", "year", "disease", "expected", "expected_as_outcome"))


@query("wn3_relative_to_base_year", with_ctes("prices", f"SELECT year, {rnd('(SELECT cpi FROM prices WHERE year = 1998) / cpi')} AS cpi_rel FROM prices"))
def wn3(spark, sf):
    return rounded(harmonise.price_index(fx.prices(spark, sf), 1998, value="cpi", name="cpi_rel"))


@query(
    "wn4_first_known_fill",
    with_ctes(
        "panel",
        f"SELECT tract, year, disease, {rnd('coalesce(ue, f)')} AS ue FROM panel p LEFT JOIN (SELECT tract AS t, disease AS d, arg_min(ue, year) AS f FROM panel WHERE ue IS NOT NULL GROUP BY 1, 2) k ON tract = t AND disease = d",
    ),
)
def wn4(spark, sf):
    d = fx.panel(spark, sf).select("tract", "year", "disease", "ue")
    return rounded(harmonise.fill_first_known(d, ["tract", "disease"], "year", "ue"))


@query(
    "wn5_area_index",
    with_ctes(
        "panel",
        """SELECT geoid, i AS area_index, j AS first_seen FROM (SELECT geoid, row_number() OVER (ORDER BY geoid) AS i FROM (SELECT DISTINCT geoid FROM panel) a)
        JOIN (SELECT geoid AS g, row_number() OVER (ORDER BY y, geoid) AS j FROM (SELECT geoid, min(year) AS y FROM panel GROUP BY 1) b) ON geoid = g""",
    ),
)
def wn5(spark, sf):
    p = fx.panel(spark, sf)
    return panel_ops.area_index(p, "geoid").join(panel_ops.area_index(p, "geoid", "first_seen", "first_seen", "year"), "geoid")


@query(
    "wn6_year_index_and_keys",
    with_ctes(
        "panel",
        """WITH ix AS (SELECT geoid AS g, row_number() OVER (ORDER BY geoid) AS area_index FROM (SELECT DISTINCT geoid FROM panel) a)
        SELECT geoid, disease, area_index, year - 1994 AS year_index, concat(area_index, '_', year - 1994) AS area_year,
               (year - 1995) * (SELECT count(*) FROM ix) + area_index AS row_ordinal FROM panel JOIN ix ON geoid = g""",
    ),
)
def wn6(spark, sf):
    p = fx.panel(spark, sf)
    ix = dense_index(p, "geoid", "area_index")
    return panel_ops.panel_keys(p, ix, "geoid", "year", 1994, ix.count()).select("geoid", "disease", "area_index", "year_index", "area_year", "row_ordinal")


@query("or1_multi_key_sort", with_ctes("panel", f"SELECT disease, year, geoid, {rnd('mortrate', 9)} AS mortrate FROM panel ORDER BY disease, year, geoid"))
def or1(spark, sf):
    return rounded(fx.panel(spark, sf).select("disease", "year", "geoid", "mortrate"), 9).orderBy("disease", "year", "geoid")


@query(
    "st1_union_by_name",
    "SELECT c_custkey AS k, c_acctbal AS balance, CAST(NULL AS DOUBLE) AS price FROM customer UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders",
)
def st1(spark, sf):
    a = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    b = fx.table(spark, sf, "orders").select(F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("k"))
    return a.unionByName(b, allowMissingColumns=True)


# --------------------------------------------------------------------------- reshape


def _pivot_sql(value: str, suffix: str = "") -> str:
    return ", ".join(f'max(CASE WHEN variable = \'{c}E\' THEN {value} END) AS "{c}{suffix}"' for c in fx.TRACT_CODES)


def _tract_long(spark, sf):
    return fx.census(spark, sf).withColumn("variable", codes.variable_code("variable"))


@query("rs1_pivot_by_code", with_ctes("census", f"SELECT tract, year, {_pivot_sql('estimate')} FROM census GROUP BY 1, 2"))
def rs1(spark, sf):
    return reshape.pivot_codes(_tract_long(spark, sf), ["tract", "year"], fx.TRACT_CODES)


@query(
    "rs2_unpivot",
    with_ctes("panel", " UNION ALL ".join(f"SELECT tract, year, disease, '{c}' AS name, {rnd(f'CAST({c} AS DOUBLE)', 9)} AS value FROM panel" for c in ("mortrate", "ue", "elder", "income"))),
)
def rs2(spark, sf):
    return rounded(reshape.to_long(fx.panel(spark, sf), ["tract", "year", "disease"], ["mortrate", "ue", "elder", "income"]), 9)


@query(
    "rs3_long_normalise_wide",
    with_ctes("panel", f"SELECT tract, year, disease, {', '.join(f'{rnd(f"{c} / CAST(sum({c}) OVER (PARTITION BY disease) AS DOUBLE)", 9)} AS {c}' for c in ('n_rec', 'pop'))} FROM panel"),
)
def rs3(spark, sf):
    long = reshape.to_long(fx.panel(spark, sf), ["tract", "year", "disease"], ["n_rec", "pop"])
    shares = rates.share_of_group(long, ["disease", "name"], {"value": "share"})
    return rounded(reshape.pivot_codes(shares, ["tract", "year", "disease"], ["n_rec", "pop"], "name", "share"), 9)


OLD_CODES, NEW_CODES = list(fx.TRACT_CODES[:4]), list(fx.TRACT_CODES[2:])


@query(
    "rs4_code_list_by_year",
    with_ctes(
        "census",
        f"""SELECT tract, year, substr(variable, 1, length(variable) - 1) AS variable, estimate FROM census
        WHERE CASE WHEN year <= 1998 THEN variable IN ({", ".join(f"'{c}E'" for c in OLD_CODES)}) ELSE variable IN ({", ".join(f"'{c}E'" for c in NEW_CODES)}) END""",
    ),
)
def rs4(spark, sf):
    return reshape.codes_for_year(_tract_long(spark, sf), OLD_CODES, NEW_CODES, 1998).select("tract", "year", "variable", "estimate")


@query("rs5_estimates_and_margins", with_ctes("census", f"SELECT tract, year, {_pivot_sql('estimate')}, {_pivot_sql('moe', '_moe')} FROM census GROUP BY 1, 2"))
def rs5(spark, sf):
    est, moe = reshape.estimates_and_margins(_tract_long(spark, sf), ["tract", "year"], fx.TRACT_CODES)
    return est.join(moe, ["tract", "year"])


# --------------------------------------------------------------- rates and harmonising


@query("rt1_regroup_standard_population", with_ctes("std rec", "SELECT b.newgroup AS agegroup, n_all, n_male, n_female, n_records FROM (SELECT newgroup, sum(n_all) AS n_all, sum(n_male) AS n_male, sum(n_female) AS n_female FROM std5 GROUP BY 1) b LEFT JOIN (SELECT " + BAND_OF_AGE_SQL + f" AS g, count(*) AS n_records FROM (SELECT {fx.AGE_SQL} AS age FROM rec) r GROUP BY 1) k ON newgroup = g"))
def rt1(spark, sf):
    n = banded(spark, sf).groupBy("agegroup").agg(F.count(F.lit(1)).alias("n_records"))
    return rates.regroup_bands(rates.standard_population(spark)).join(n, "agegroup", "left")


@query("rt2_standard_weights", with_ctes("std pop", f"SELECT county, agegroup, tpop, {rnd('n_all', 9)} AS n_all, {rnd('n_male', 9)} AS n_male, {rnd('n_female', 9)} AS n_female FROM pop LEFT JOIN std USING (agegroup)"))
def rt2(spark, sf):
    w = rates.standard_weights(rates.regroup_bands(rates.standard_population(spark)))
    return rounded(fx.population(spark, sf).join(w, "agegroup", "left"), 9)


RATE_COUNTS = ("n_mental1", "n_mental3", "n_mentaln")
ALL_COUNTS = tuple(codes.COUNTED_FLAGS.values())


def _band_rates(spark, sf, columns=ALL_COUNTS):
    """Population cells by county, year and band with counts, rates and weights."""
    flags = {f: n for f, n in codes.COUNTED_FLAGS.items() if n in columns}
    county = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("tract"), F.col("s_nationkey").alias("county"))
    # counted by tract first, so the county join moves sums, not records
    by_tract = rates.flag_counts(banded(spark, sf), ["tract", "year", "agegroup"], flags)
    counts = rates.summarise(by_tract.join(county, "tract"), ["county", "year", "agegroup"], list(flags.values()), F.sum)
    pop = panel_ops.area_years(fx.population(spark, sf), *_record_years(spark, sf))
    w = rates.standard_weights(rates.regroup_bands(rates.standard_population(spark)))
    return rates.age_specific_rates(pop, counts, w, ["county", "year", "agegroup"], list(flags.values()))


_BAND_RATES_SQL = f"""{_FLAGGED_SQL},
cnt AS (SELECT s_nationkey AS county, year, {BAND_OF_AGE_SQL} AS agegroup, {_FLAG_COUNT_SQL} FROM fl JOIN supplier ON tract = s_suppkey GROUP BY 1, 2, 3),
br AS (SELECT p.county, CAST(y AS INTEGER) AS year, p.agegroup, tpop, w.n_all, w.n_male, w.n_female,
  {", ".join(f"coalesce(c.{n}, 0) AS {n}" for n in ALL_COUNTS)},
  {", ".join(f"1e5 * coalesce(c.{n}, 0) / tpop AS r_{n[2:]}" for n in ALL_COUNTS)}
  FROM pop p CROSS JOIN {_YEARS_SQL} t LEFT JOIN cnt c ON c.county = p.county AND c.year = y AND c.agegroup = p.agegroup
  LEFT JOIN std w ON w.agegroup = p.agegroup)"""


@query("rt3_age_specific_rates", with_ctes("rec pop std", f"WITH {_BAND_RATES_SQL} SELECT county, year, agegroup, tpop, {', '.join(f'{n}, {rnd(f"r_{n[2:]}")} AS r_{n[2:]}' for n in ALL_COUNTS)} FROM br"))
def rt3(spark, sf):
    return rounded(_band_rates(spark, sf).select("county", "year", "agegroup", "tpop", *[c for n in ALL_COUNTS for c in (n, "r_" + n[2:])]))


@query("rt4_direct_standardised_rate", with_ctes("rec pop std", f"WITH {_BAND_RATES_SQL} SELECT county, year, {', '.join(f'{rnd(f"coalesce(sum(r_{n[2:]} * n_all), 0)")} AS r_{n[2:]}' for n in RATE_COUNTS)} FROM br GROUP BY 1, 2"))
def rt4(spark, sf):
    base = _band_rates(spark, sf, RATE_COUNTS)
    return rounded(rates.standardised_rates(base, ["county", "year"], ["r_" + n[2:] for n in RATE_COUNTS]))


@query("rt5_all_age_counts", with_ctes("rec pop std", f"WITH {_BAND_RATES_SQL} SELECT county, year, {', '.join(f'sum({n}) AS {n}' for n in ALL_COUNTS)} FROM br GROUP BY 1, 2"))
def rt5(spark, sf):
    return rates.total_counts(_band_rates(spark, sf), ["county", "year"], ALL_COUNTS)


def _band_pop_sql() -> str:
    out = []
    for band, cells in rates.age_cells(10).items():
        total = " + ".join(f"max(CASE WHEN variable = '{c}' THEN estimate END)" for c in cells)
        out.append(f"SELECT county, '{band}' AS agegroup, {total} AS tpop FROM age_census GROUP BY county")
    return " UNION ALL ".join(out)


@query("rt6_population_by_band", with_ctes("age_census", _band_pop_sql()))
def rt6(spark, sf):
    return rates.band_population(fx.age_census(spark, sf), ["county"])


@query(
    "rt7_crosswalk_means",
    with_ctes(
        "panel cw",
        f"""SELECT geoid10, year, disease, {rnd('CASE WHEN count(income) = count(*) THEN sum(income * w) / sum(w) END')} AS income, {rnd('CASE WHEN count(ue) = count(*) THEN sum(ue * w) / sum(w) END')} AS ue
        FROM (SELECT geoid10, k.year, k.disease, income, ue, CAST(pop00 * poppct00 / 100 AS DOUBLE) AS w FROM cw CROSS JOIN (SELECT DISTINCT year, disease FROM panel) k
              LEFT JOIN panel p ON tract = geoid00 AND p.year = k.year AND p.disease = k.disease) j
        GROUP BY 1, 2, 3""",
    ),
)
def rt7(spark, sf):
    d = fx.panel(spark, sf).select(F.col("tract").alias("geoid00"), "year", "disease", "income", "ue")
    return rounded(harmonise.crosswalk(d, fx.crosswalk_table(spark, sf), ["income", "ue"], by=["year", "disease"]))


@query(
    "rt8_crosswalk_counts",
    with_ctes(
        "panel cw",
        """SELECT geoid10, year, CAST(floor(sum(n_rec * w) / sum(w)) AS BIGINT) AS n_rec, CAST(floor(sum(pop * w) / sum(w)) AS BIGINT) AS pop
        FROM (SELECT geoid10, year, n_rec, pop, CAST(pop00 * poppct00 / 100 AS DOUBLE) AS w FROM cw JOIN (SELECT tract, year, sum(n_rec) AS n_rec, sum(pop) AS pop FROM panel GROUP BY 1, 2) p ON tract = geoid00) j
        GROUP BY 1, 2""",
    ),
)
def rt8(spark, sf):
    d = fx.panel(spark, sf).groupBy(F.col("tract").alias("geoid00"), "year").agg(F.sum("n_rec").alias("n_rec"), F.sum("pop").alias("pop"))
    return harmonise.crosswalk(d, fx.crosswalk_table(spark, sf), ["n_rec", "pop"], whole=True, by=["year"])


@query(
    "rt9_year_backfill",
    with_ctes("panel", f"SELECT tract, disease, CAST(y AS INTEGER) AS year, {rnd('income')} AS income FROM panel JOIN range(1992, 1998) t(y) ON year = 1997 UNION ALL SELECT tract, disease, year, {rnd('income')} FROM panel WHERE year > 1997"),
)
def rt9(spark, sf):
    d = fx.panel(spark, sf).select("tract", "disease", "year", "income")
    return rounded(harmonise.backfill_years(d, 1997, [1992, 1993, 1994, 1995, 1996]))


@query(
    "rt10_real_income",
    with_ctes("panel prices", f"SELECT tract, p.year, disease, {rnd('income * ((SELECT cpi FROM prices WHERE year = 1998) / cpi)', 9)} AS income_adj FROM panel p LEFT JOIN prices c ON p.year = c.year"),
)
def rt10(spark, sf):
    index = harmonise.price_index(fx.prices(spark, sf), 1998, value="cpi", name="cpi10")
    return rounded(fx.panel(spark, sf).join(index, "year", "left").select("tract", "year", "disease", (F.col("income") * F.col("cpi10")).alias("income_adj")), 9)


@query(
    "rt11_deflate_by_era",
    with_ctes("panel", f"SELECT tract, year, disease, {rnd('CASE WHEN yc = 1990 THEN income / 76.90 * 100 WHEN yc = 2010 THEN income / 125.96 * 100 ELSE income END')} AS income FROM (SELECT *, CASE WHEN year <= 1996 THEN 1990 WHEN year <= 1999 THEN 2000 ELSE 2010 END AS yc FROM panel) p"),
)
def rt11(spark, sf):
    covariate_year = F.when(F.col("year") <= 1996, 1990).when(F.col("year") <= 1999, 2000).otherwise(2010)
    return rounded(
        fx.panel(spark, sf).select("tract", "year", "disease", harmonise.deflate("income", covariate_year, harmonise.PRICE_LEVEL).alias("income"))
    )


@query(
    "rt12_stack_yearly_tables",
    with_ctes("panel", f"SELECT tract, year, disease, n_rec, CASE WHEN year <> (SELECT min(year) FROM panel) THEN pop END AS pop FROM panel"),
)
def rt12(spark, sf):
    # the yearly tables are files of their own; the first one lacks a column
    path = shared_folder(spark, "yearly")
    write_table(fx.panel(spark, sf).select("tract", "disease", "n_rec", "pop", "year"), path, ["year"])
    years = sorted(r["year"] for r in spark.read.parquet(path).select("year").distinct().collect())
    frames = {y: read_table(spark, f"{path}/year={y}") for y in years}
    frames[years[0]] = frames[years[0]].drop("pop")
    return harmonise.stack_years(frames).select("tract", "year", "disease", "n_rec", "pop")


@query(
    "io9_index_to_base_year",
    with_ctes("panel", f"SELECT tract, year, total, {rnd('total / b')} AS total_r98 FROM (SELECT tract, year, sum(pop) AS total FROM panel GROUP BY 1, 2) s LEFT JOIN (SELECT tract AS t, CAST(sum(pop) AS DOUBLE) AS b FROM panel WHERE year = 1998 GROUP BY 1) k ON tract = t"),
)
def io9(spark, sf):
    d = fx.panel(spark, sf).groupBy("tract", "year").agg(F.sum("pop").alias("total"))
    return rounded(harmonise.relative_to_base(d, ["tract"], 1998, "year", "total", "total_r98"))
