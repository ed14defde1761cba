"""Queries over person records: recodes, flags, scalar expressions, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, recode
from ..functions.numeric import clamp_zero, log_guard, per_unit
from ..operators import panel as panel_ops
from ..operators import reshape
from . import fixtures as fx
from .fixtures import with_ctes
from .registry import query, rnd, rounded

# Recode tables of the registry (fixed values).
PREGNANCY = {1: 1, 2: 2, 3: 3, 4: 4, 7: 7, 8: 8, 9: 9}
MARRIED = {"A": "U", "D": "D", "M": "M", "S": "S", "W": "W", "U": "U"}
ARMED_FORCES = {"1": "Y", "2": "N", "9": "U"}
FACILITY_ERAS = [
    (None, 2003, {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 4, 7: 5, 8: 1, 9: 9}),
    (2004, 2015, {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 4, 7: 5, 9: 9}),
]
MARRIED_ERAS = [
    (None, 2003, {"1": "S", "2": "M", "3": "D", "4": "W", "9": "U"}),
    (2004, 2015, {"1": "S", "2": "M", "3": "D", "4": "W", "5": "M", "6": "M", "9": "U"}),
]
EDUCATION_ERAS = [
    (
        None,
        2003,
        {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 2, 10: 2, 11: 2, 12: 3, 13: 4, 14: 4, 15: 4, 16: 6, 17: 7, 99: 9},
    ),
    (2004, 2015, {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 5, 7: 7, 8: 7, 9: 9}),
]
SMOKING_ERAS = [
    (None, 2003, {"1": "Y", "2": "N", "9": "U"}),
    (2004, 2015, {"1": "Y", "2": "N", "7": "P", "8": "U", "9": "U"}),
]
RESIDENCE_UNITS = {"0": "Y", "1": "Y", "2": "M", "3": "W", "4": "D", "5": "H", "6": "M", "9": "U"}
RACE_GROUPS = {
    "1": "1", "2": "2", "3": "4", "4": "4", "5": "4", "6": "4", "7": "4", "8": "4",
    "A": "4", "B": "4", "C": "3", "D": "4", "E": "4", "F": "4", "G": "4", "H": "4",
}


def _case(col: str, mapping: dict) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {col} " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in mapping.items()) + f" ELSE {col} END"


def _era_case(col: str, eras: list) -> str:
    parts = []
    for lo, hi, mapping in eras:
        cond = f"ry <= {hi}" if lo is None else f"ry BETWEEN {lo} AND {hi}"
        parts.append(f"WHEN {cond} THEN {_case(col, mapping)}")
    return "CASE " + " ".join(parts) + f" ELSE {col} END"


_RY = "TRY_CAST(substr(certno, 1, 4) AS INTEGER) AS ry"


@query("pr1_value_recode", with_ctes("reg", f"SELECT rec_id, {_case('armforce', ARMED_FORCES)} AS armforce FROM reg"))
def pr1(spark, sf):
    return fx.registry(spark, sf).select("rec_id", recode.recode("armforce", ARMED_FORCES).alias("armforce"))


@query(
    "pr2_recode_by_era",
    with_ctes(
        "reg",
        f"""SELECT rec_id, {_era_case('fac_type', FACILITY_ERAS)} AS fac_type, {_era_case('married', MARRIED_ERAS)} AS married,
        {_era_case('educ', EDUCATION_ERAS)} AS educ, {_era_case('smoking', SMOKING_ERAS)} AS smoking
        FROM (SELECT *, {_RY} FROM reg) r""",
    ),
)
def pr2(spark, sf):
    d = fx.registry(spark, sf).withColumn("ry", recode.leading_year("certno"))
    return d.select(
        "rec_id",
        recode.recode_by_era("fac_type", "ry", FACILITY_ERAS).alias("fac_type"),
        recode.recode_by_era("married", "ry", MARRIED_ERAS).alias("married"),
        recode.recode_by_era("educ", "ry", EDUCATION_ERAS).alias("educ"),
        recode.recode_by_era("smoking", "ry", SMOKING_ERAS).alias("smoking"),
    )


def _residence_unit():
    return recode.fill_then_recode("resunit", "res_lena", recode.leading_year("certno"), 2015, RESIDENCE_UNITS)


_RESUNIT_SQL = f"CASE WHEN ry <= 2015 THEN {_case('coalesce(resunit, res_lena)', RESIDENCE_UNITS)} ELSE coalesce(resunit, res_lena) END"


@query("pr3_fill_then_recode_unit", with_ctes("reg", f"SELECT rec_id, {_RESUNIT_SQL} AS resunit FROM (SELECT *, {_RY} FROM reg) r"))
def pr3(spark, sf):
    return fx.registry(spark, sf).select("rec_id", _residence_unit().alias("resunit"))


@query(
    "pr4_age_in_years",
    with_ctes("rec", f"SELECT l_orderkey, l_linenumber, l_partkey, coalesce({fx.AGE_SQL}, 9999) AS age FROM rec"),
)
def pr4(spark, sf):
    return fx.records(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", recode.age_years("ddageunit", "ddagenum").alias("age"))


def _any_sql(cols, value: str) -> str:
    return "(" + " OR ".join(f"coalesce({c} = '{value}', false)" for c in cols) + ")"


@query(
    "pr5_race_class",
    with_ctes(
        "reg",
        f"""SELECT rec_id, CASE WHEN racewh = 'Y' AND {" AND ".join(f"{c} <> 'H'" for c in fx.HISPANIC)} THEN 1
        WHEN racebl = 'Y' THEN 2 WHEN {_any_sql(fx.HISPANIC, "H")} THEN 3
        WHEN {_any_sql([*fx.HISPANIC, "racewh", "racebl", *fx.OTHER_RACES], "U")} THEN 9 ELSE 4 END AS race FROM reg""",
    ),
)
def pr5(spark, sf):
    return fx.registry(spark, sf).select(
        "rec_id", recode.race_class("racewh", "racebl", list(fx.HISPANIC), list(fx.OTHER_RACES)).alias("race")
    )


@query("pr6_collapse_codes", with_ctes("reg", f"SELECT {_case('race', RACE_GROUPS)} AS race, count(*) AS n FROM reg GROUP BY 1"))
def pr6(spark, sf):
    return fx.registry(spark, sf).groupBy(recode.recode("race", RACE_GROUPS).alias("race")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "pr7_duration_days",
    with_ctes(
        "reg",
        f"""SELECT rec_id, CASE WHEN u IN ('H', 'N') THEN 1 WHEN u = 'D' THEN resunum WHEN u = 'W' THEN 7 * resunum
        WHEN u = 'M' THEN 30 * resunum WHEN u = 'Y' THEN 365 * resunum WHEN u = 'U' THEN resunum END AS resdays
        FROM (SELECT *, {_RESUNIT_SQL} AS u FROM (SELECT *, {_RY} FROM reg) r) s""",
    ),
)
def pr7(spark, sf):
    return fx.registry(spark, sf).select("rec_id", recode.duration_days(_residence_unit(), "resunum").alias("resdays"))


@query("pr8_record_year", with_ctes("reg", f"SELECT ry AS record_year, count(*) AS n FROM (SELECT {_RY} FROM reg) r GROUP BY 1"))
def pr8(spark, sf):
    return fx.registry(spark, sf).groupBy(recode.leading_year("certno").alias("record_year")).agg(F.count(F.lit(1)).alias("n"))


MULTI_CAUSE = "^dmca([1-9]|1[0-9]|2[0])$"


def flagged(spark, sf):
    """Records with cause columns renamed, all flags and the age (NULL if unknown)."""
    d = codes.rename_matching(fx.records(spark, sf), MULTI_CAUSE, "dmca", "mltcse")
    d = codes.cause_flags(d)
    age = recode.age_years("ddageunit", "ddagenum")
    return d.withColumn("age", F.when(age != recode.UNKNOWN_AGE, age))


@query(
    "pr9_bulk_rename",
    with_ctes("rec", "SELECT " + ", ".join(f"count(dmca{k}) AS mltcse{k}" for k in range(1, 11)) + ', count("dmcaACME") AS "dmcaACME" FROM rec'),
)
def pr9(spark, sf):
    d = codes.rename_matching(fx.records(spark, sf), MULTI_CAUSE, "dmca", "mltcse")
    cols = [c for c in d.columns if c.startswith(("mltcse", "dmca"))]
    return d.agg(*[F.count(c).alias(c) for c in cols])


@query(
    "pr10_suffix_columns",
    with_ctes(
        "census",
        "SELECT tract, year, "
        + ", ".join(f'min(CASE WHEN variable = \'{c}E\' THEN moe END) AS "{c}_moe"' for c in fx.TRACT_CODES)
        + " FROM census GROUP BY tract, year",
    ),
)
def pr10(spark, sf):
    d = fx.census(spark, sf).withColumn("variable", codes.variable_code("variable"))
    wide = reshape.pivot_codes(d, ["tract", "year"], fx.TRACT_CODES, value="moe")
    return codes.suffix_columns(wide, ["tract", "year"], "_moe")


# Which codes of the records each flag takes, written out: the statements do not
# use the package's patterns. The number is that of the cause columns looked at.
_ALL_F = "F012 F03 F102 F320 F209 F411 F009 F603 F99 F171 F023 F450 F700 XF03"
FLAGGED_CODES = {
    "mental": (1, _ALL_F),
    "mental3": (3, _ALL_F),
    "mental_new": (10, "F012 F03 F102 F320 F209 F411 F009 F171 F023 F450 XF03"),
    "mental_new2": (10, "F012 F03 F102 F320 F209 F411 F009 F603 F171 F023 F450 XF03"),
    "moodanxiety": (10, "F320 F411 F450"),
    "substance": (10, "F102 F171"),
    "nonsubstance": (10, "F320 F209 F411 F450"),
    "nonsubstance2": (10, "F012 F03 F320 F209 F411 F009 F603 F023 F450 XF03"),
    "dementia_vascular": (10, "F012"),
    "dementia_unspecified": (10, "F03 XF03"),
    "mental_any": (10, _ALL_F),
    "parkinson": (3, "A521 F023 G20 G903 G219"),
    "dementia": (3, "F012 F03 F009 F023"),
    "alzheimer": (3, "G309"),
}
UNDERLYING_CODES = {"mental_u": _ALL_F, "parkinson_u": "A521 F023 G20 G903 G219", "dementia_u": "F012 F03 F009 F023", "alzheimer_u": "G309"}


def _listed(column: str, listed: str) -> str:
    return f"coalesce({column} IN ({', '.join(repr(c) for c in listed.split())}), false)"


def flag_sql(name: str, prefix: str = "dmca") -> str:
    k, listed = FLAGGED_CODES[name]
    return f"CASE WHEN {' OR '.join(_listed(f'{prefix}{i}', listed) for i in range(1, k + 1))} THEN 1 ELSE 0 END"


_TEN = [n for n, (k, _) in FLAGGED_CODES.items() if k == 10]
_FEW = [n for n, (k, _) in FLAGGED_CODES.items() if k < 10]


@query(
    "pr11_any_of_ten_flags",
    with_ctes(
        "rec",
        f"SELECT tract, year, {', '.join(f'sum({n}) AS {n}' for n in _TEN)} FROM (SELECT tract, year, "
        + ", ".join(f"{flag_sql(n)} AS {n}" for n in _TEN)
        + " FROM rec) f GROUP BY tract, year",
    ),
)
def pr11(spark, sf):
    d = flagged(spark, sf)
    return d.groupBy("tract", "year").agg(*[F.sum(n).alias(n) for n in _TEN])


@query(
    "pr12_first_three_flags",
    with_ctes(
        "rec",
        "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"{flag_sql(n)} AS {n}" for n in _FEW) + " FROM rec",
    ),
)
def pr12(spark, sf):
    return flagged(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", *_FEW)


@query(
    "pr13_underlying_flags",
    with_ctes(
        "rec",
        "SELECT l_orderkey, l_linenumber, l_partkey, "
        + ", ".join(
            f"CASE WHEN {_listed(chr(34) + 'dmcaACME' + chr(34), listed)} THEN 1 ELSE 0 END AS {n}" for n, listed in UNDERLYING_CODES.items()
        )
        + " FROM rec",
    ),
)
def pr13(spark, sf):
    d = codes.underlying_flags(fx.records(spark, sf), "dmcaACME")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", *UNDERLYING_CODES)


BAND_SQL = """CASE WHEN age >= 80 THEN '80_Inf' WHEN age >= 0 THEN concat(lpad(CAST(age // 10 * 10 AS VARCHAR), 2, '0'), '_', CAST(age // 10 * 10 + 10 AS VARCHAR)) END"""


@query(
    "pr14_age_band",
    with_ctes("rec", f"SELECT {BAND_SQL} AS agegroup, count(*) AS n FROM (SELECT {fx.AGE_SQL} AS age FROM rec) r GROUP BY 1"),
)
def pr14(spark, sf):
    age = recode.age_years("ddageunit", "ddagenum")
    return fx.records(spark, sf).groupBy(recode.age_band(age).alias("agegroup")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "pr15_variable_code",
    with_ctes("census", "SELECT substr(variable, 1, length(variable) - 1) AS variable, count(*) AS n, sum(estimate) AS total FROM census GROUP BY 1"),
)
def pr15(spark, sf):
    return fx.census(spark, sf).groupBy(codes.variable_code("variable").alias("variable")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("estimate").alias("total")
    )


@query(
    "pr16_key_slice",
    with_ctes("panel", "SELECT substr(concat('1400000US', geoid), 10, 5) AS county, count(*) AS n, sum(pop) AS pop FROM panel GROUP BY 1"),
)
def pr16(spark, sf):
    d = fx.panel(spark, sf).withColumn("long_id", F.concat(F.lit("1400000US"), "geoid"))
    return d.groupBy(codes.key_slice("long_id", 10, 14).alias("county")).agg(F.count(F.lit(1)).alias("n"), F.sum("pop").alias("pop"))


def _wide_acs(spark, sf):
    return reshape.pivot_codes(fx.acs(spark, sf), ["county", "year"], fx.ACS_CODES)


def _acs_pivot_sql() -> str:
    return (
        "SELECT county, year, "
        + ", ".join(f"max(CASE WHEN variable = '{c}' THEN estimate END) AS {c}" for c in fx.ACS_CODES)
        + " FROM acs GROUP BY county, year"
    )


def _share_sql(s: reshape.Share) -> str:
    num, den = " + ".join(s.numerators), " + ".join(s.denominators)
    top = f"({den}) - ({num})" if s.complement else num
    return rnd(f"100 * ({top}) / nullif({den}, 0)")


@query(
    "pr17_percentage_shares",
    with_ctes(
        "acs",
        f"SELECT county, year, {', '.join(f'{_share_sql(s)} AS {n}' for n, s in reshape.CENSUS_SHARES.items())} FROM ({_acs_pivot_sql()}) w",
    ),
)
def pr17(spark, sf):
    d = reshape.add_shares(_wide_acs(spark, sf), reshape.CENSUS_SHARES)
    return rounded(d.select("county", "year", *reshape.CENSUS_SHARES))


@query(
    "pr18_share_from_metadata",
    f"""SELECT l_suppkey AS tract, {rnd("100 * (q4 + q5) / nullif(q1 + q2 + q3, 0)")} AS p_unemp
    FROM (SELECT l_suppkey, {", ".join(f"sum(CASE WHEN l_linenumber = {k} THEN l_quantity END) AS q{k}" for k in range(1, 6))}
          FROM lineitem GROUP BY l_suppkey) w""",
)
def pr18(spark, sf):
    s = reshape.share_from_labels(fx.meta(spark, sf), "B23001", "Unemployed$", "In labor force$")
    long = fx.table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("tract"), F.concat(F.lit("B23001_00"), F.col("l_linenumber").cast("string")).alias("variable")
    ).agg(F.sum("l_quantity").alias("estimate"))
    wide = reshape.pivot_codes(long, ["tract"], sorted(set(s.cells())))
    return rounded(reshape.add_shares(wide, {"p_unemp": s}).select("tract", "p_unemp"))


@query(
    "pr19_optional_share",
    with_ctes(
        "census",
        f"""SELECT tract, year, {rnd("100 * b / nullif(a, 0)")} AS p_poverty, CAST(NULL AS DOUBLE) AS p_uninsured
        FROM (SELECT tract, year, max(CASE WHEN variable = 'B17001_001E' THEN estimate END) AS a,
                     max(CASE WHEN variable = 'B17001_002E' THEN estimate END) AS b FROM census GROUP BY tract, year) w""",
    ),
)
def pr19(spark, sf):
    d = fx.census(spark, sf).withColumn("variable", codes.variable_code("variable"))
    wide = reshape.pivot_codes(d, ["tract", "year"], fx.TRACT_CODES)
    two = {k: reshape.CENSUS_SHARES[k] for k in ("p_poverty", "p_uninsured")}
    return rounded(reshape.add_shares(wide, two).select("tract", "year", *two))


@query("pr20_clamp_negative", f"SELECT c_custkey, {rnd('CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END')} AS balance FROM customer")
def pr20(spark, sf):
    return rounded(fx.table(spark, sf, "customer").select("c_custkey", clamp_zero("c_acctbal").alias("balance")))


@query("pr21_zero_fill", with_ctes("panel", f"SELECT tract, year, disease, {rnd('coalesce(ue, 0)')} AS ue, {rnd('elder')} AS elder FROM panel"))
def pr21(spark, sf):
    return rounded(fx.panel(spark, sf).select("tract", "year", "disease", "ue", "elder").fillna(0.0, ["ue"]))


@query(
    "pr22_density",
    with_ctes("panel", f"SELECT tract, year, disease, {rnd('1e4 * n_rec / nullif(pop, 0)')} AS per_10k, {rnd('pop / CAST(1.5 AS DOUBLE)')} AS per_area FROM panel"),
)
def pr22(spark, sf):
    return rounded(
        fx.panel(spark, sf).select(
            "tract", "year", "disease", per_unit("n_rec", "pop", 1e4).alias("per_10k"), per_unit("pop", F.lit(1.5)).alias("per_area")
        )
    )


@query("pr23_columns_by_name", with_ctes("panel", f"SELECT tract, year, disease, n_rec AS outcome, {rnd('income')} AS exposure FROM panel"))
def pr23(spark, sf):
    d = panel_ops.with_exposure(fx.panel(spark, sf), outcome="n_rec", exposure="income", population="pop")
    return rounded(d.select("tract", "year", "disease", "outcome", "exposure"))


@query(
    "pr24_log_guards",
    with_ctes("panel", f"SELECT tract, year, disease, {rnd('ln(ue + exp(-25))')} AS log_ue, {rnd('ln(elder + 0.1)')} AS log_elder, {rnd('ln(pop)')} AS log_pop FROM panel"),
)
def pr24(spark, sf):
    return rounded(
        fx.panel(spark, sf).select(
            "tract",
            "year",
            "disease",
            log_guard("ue", 1.3887943864964021e-11).alias("log_ue"),
            log_guard("elder", 0.1).alias("log_elder"),
            F.log("pop").alias("log_pop"),
        )
    )


@query(
    "pr25_state_label",
    "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'Oregon' ELSE 'Washington' END AS state, CAST(c_nationkey AS VARCHAR) AS code, 1 AS one FROM customer",
)
def pr25(spark, sf):
    fips = F.when(F.col("c_nationkey") % 2 == 0, 41).otherwise(53)
    return fx.table(spark, sf, "customer").select(
        "c_custkey", recode.state_label(fips, {"41": "Oregon"}, "Washington").alias("state"), F.col("c_nationkey").cast("string").alias("code"), F.lit(1).alias("one")
    )


# --------------------------------------------------------------------------- filters


@query("fl1_range_filter", with_ctes("panel", f"SELECT tract, year, {rnd('mortrate', 9)} AS mortrate FROM panel WHERE disease = 'Mentalhealth' AND year > 1996 AND year <= 2000"))
def fl1(spark, sf):
    d = fx.panel(spark, sf)
    return rounded(d.where((F.col("disease") == "Mentalhealth") & (F.col("year") > 1996) & (F.col("year") <= 2000)).select("tract", "year", "mortrate"), 9)


@query(
    "fl2_regex_filter",
    with_ctes(
        "panel",
        """SELECT disease, substr(id, 1, 5) AS county, count(*) AS n FROM (
          SELECT *, concat(CASE tract % 3 WHEN 0 THEN '41' WHEN 1 THEN '53' ELSE '16' END, geoid) AS id FROM panel) p
        WHERE regexp_matches(disease, 'Mental.*') AND regexp_matches(id, '^(41|53)') GROUP BY 1, 2""",
    ),
)
def fl2(spark, sf):
    state = F.when(F.col("tract") % 3 == 0, "41").when(F.col("tract") % 3 == 1, "53").otherwise("16")
    d = fx.panel(spark, sf).withColumn("id", F.concat(state, "geoid"))
    d = d.where(F.col("disease").rlike("Mental.*") & F.col("id").rlike("^(41|53)"))
    return d.groupBy("disease", codes.key_slice("id", 1, 5).alias("county")).agg(F.count(F.lit(1)).alias("n"))


@query("fl3_coordinate_filter", with_ctes("reg", f"SELECT rec_id, {rnd('lon')} AS lon, {rnd('lat')} AS lat FROM reg WHERE lon IS NOT NULL AND lat IS NOT NULL AND lon < 0 AND lat > 40"))
def fl3(spark, sf):
    d = fx.registry(spark, sf).where(F.col("lon").isNotNull() & F.col("lat").isNotNull() & (F.col("lon") < 0) & (F.col("lat") > 40))
    return rounded(d.select("rec_id", "lon", "lat"))


@query(
    "fl4_in_and_not_in",
    with_ctes("parks", "SELECT park_id, manager FROM parks WHERE manager IS NULL OR manager NOT IN ('PRIV')"),
)
def fl4(spark, sf):
    # a NULL manager is not in the list, so it stays
    return fx.parks(spark, sf).where(~F.coalesce(F.col("manager").isin("PRIV"), F.lit(False))).select("park_id", "manager")


@query("fl5_semi_join", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def fl5(spark, sf):
    urgent = fx.table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return fx.table(spark, sf, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_nationkey")


@query("fl6_not_null", with_ctes("panel", f"SELECT tract, year, disease, {rnd('ue')} AS ue FROM panel WHERE ue IS NOT NULL"))
def fl6(spark, sf):
    return rounded(fx.panel(spark, sf).where(F.col("ue").isNotNull()).select("tract", "year", "disease", "ue"))
