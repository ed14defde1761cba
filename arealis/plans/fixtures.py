"""Study inputs derived from the driver tables, for Spark and for SQL.

Every fixture is a function of whole tables, so it grows with them:

* records: one per line item, with ten cause codes and an age (unit, number);
* registry: one per order, with the recoded administrative fields;
* census: long variable tables summed from line items;
* tracts: one unit square per supplier on a grid ten squares wide;
* points: one per customer; parks: one rectangle per part; raster: 16 cells per
  tract and year; draws: the embedding vectors.

``with_ctes`` puts the same definitions, written separately in SQL, before a query.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.recode import age_band
from ..operators.reshape import CENSUS_SHARES
from ..operators.spatial import rectangles_to_vertices


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(index: Column, values: list) -> Column:
    """Value at a 0-based position of a short literal list."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


# ------------------------------------------------------------------ person records

N_CODES = 10

# cause codes that occur in the records; the blank ones become NULL
CODES = [
    "F012", "I219", "G309", "A521", "F03", "F102", "I500", "G20", "F320", "I64",
    "F209", "G903", "F411", "I10", "F009", "A021", "F603", "G458", "F99", "I739",
    "F171", "G219", "F023", "I050", "F450", "A419", "F700", "XF03", "I694", "G311",
]


def _blanks(k: int) -> int:
    return 4 * (k % 11)


def _code(k: int) -> Column:
    h = F.col("l_partkey") * (2 * k + 1) + F.col("l_suppkey") * k + F.col("l_linenumber")
    return pick(h % (len(CODES) + _blanks(k)), [*CODES, *[None] * _blanks(k)])


def _code_sql(k: int) -> str:
    h = f"(l_partkey * {2 * k + 1} + l_suppkey * {k} + l_linenumber)"
    return f"{CODES}[CAST({h} % {len(CODES) + _blanks(k)} + 1 AS INTEGER)]"


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Person records: tract, year, age (unit, number), dmca1..10, dmcaACME."""
    unit = (
        F.when(F.col("l_linenumber") == 6, pick(F.col("l_partkey") % 5, [2, 4, 5, 6, 9]))
        .when((F.col("l_linenumber") == 7) & (F.col("l_partkey") % 10 == 0), F.lit(None).cast("int"))
        .otherwise(F.lit(1))
    )
    number = F.when(F.col("l_partkey") % 53 == 0, F.lit(999)).otherwise((F.col("l_orderkey") + 7 * F.col("l_partkey")) % 112)
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_suppkey").alias("tract"),
        F.year("l_shipdate").alias("year"),
        unit.alias("ddageunit"),
        number.cast("int").alias("ddagenum"),
        *[_code(k).alias(f"dmca{k}") for k in range(1, N_CODES + 1)],
        _code(11).alias("dmcaACME"),
    )


_REC_SQL = f"""
rec AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS tract, CAST(year(l_shipdate) AS INTEGER) AS year,
         CASE WHEN l_linenumber = 6 THEN [2, 4, 5, 6, 9][CAST(l_partkey % 5 + 1 AS INTEGER)]
              WHEN l_linenumber = 7 AND l_partkey % 10 = 0 THEN NULL ELSE 1 END AS ddageunit,
         CAST(CASE WHEN l_partkey % 53 = 0 THEN 999 ELSE (l_orderkey + 7 * l_partkey) % 112 END AS INTEGER) AS ddagenum,
         {", ".join(f"{_code_sql(k)} AS dmca{k}" for k in range(1, N_CODES + 1))},
         {_code_sql(11)} AS "dmcaACME"
  FROM lineitem)"""

# age in years with NULL for unknown, from (unit, number)
AGE_SQL = """CASE WHEN ddagenum IS NULL OR ddagenum = 999 THEN NULL WHEN ddageunit = 1 THEN ddagenum
  WHEN ddageunit = 2 THEN CAST(floor(30 * ddagenum / 365.24) AS INTEGER)
  WHEN ddageunit = 4 THEN CAST(floor(ddagenum / 365.24) AS INTEGER)
  WHEN ddageunit IN (5, 6) THEN 0 END"""


# ----------------------------------------------------------------------- registry

HISPANIC = ("ethnicmex", "ethnicpr", "ethniccuban", "ethnicoth")
OTHER_RACES = ("raceaian", "raceasianind", "racech", "racefi")


def _mark(multiplier: int, marked: str) -> Column:
    m = (F.col("o_orderkey") * multiplier + F.col("o_custkey")) % 9
    return F.when(m == 0, marked).when(m == 1, "U").when(m == 2, F.lit(None)).otherwise("N")


def _mark_sql(multiplier: int, marked: str) -> str:
    m = f"(o_orderkey * {multiplier} + o_custkey) % 9"
    return f"CASE WHEN {m} = 0 THEN '{marked}' WHEN {m} = 1 THEN 'U' WHEN {m} = 2 THEN NULL ELSE 'N' END"


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Administrative records with era-dependent codes."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    marks = [_mark(i + 2, "H").alias(n) for i, n in enumerate(HISPANIC)]
    others = [_mark(i + 11, "Y").alias(n) for i, n in enumerate(OTHER_RACES)]
    return table(spark, sf, "orders").select(
        k.alias("rec_id"),
        F.when(k % 101 == 0, F.concat(F.lit("ABCD"), k.cast("string")))
        .otherwise(F.concat((2000 + k % 20).cast("string"), F.lpad(k.cast("string"), 8, "0")))
        .alias("certno"),
        F.year("o_orderdate").alias("dth_yr"),
        (c % 10).cast("int").alias("fac_type"),
        F.when(c % 8 == 7, "9").otherwise((c % 8).cast("string")).alias("married"),
        F.when(k % 23 == 0, 99).otherwise(k % 18).cast("int").alias("educ"),
        F.when(k % 19 != 0, pick(c % 5, ["1", "2", "7", "8", "9"])).alias("smoking"),
        pick(k % 3, ["1", "2", "9"]).alias("armforce"),
        F.when(k % 4 != 0, pick(c % 8, ["0", "1", "2", "3", "4", "5", "6", "9"])).alias("resunit"),
        F.when(k % 44 != 0, pick(k % 6, ["Y", "M", "W", "D", "H", "U"])).alias("res_lena"),
        (c % 40).cast("int").alias("resunum"),
        F.when(k % 16 < 8, (k % 16 + 1).cast("string")).otherwise(F.chr(65 + k % 16 - 8)).alias("race"),
        F.when(k % 3 == 0, "Y").when(k % 3 == 1, "N").alias("racewh"),
        _mark(5, "Y").alias("racebl"),
        *marks,
        *others,
        F.when(k % 37 != 0, F.when(k % 41 == 0, 110.0).otherwise(-110.0) - (k % 1000) / 100.0).alias("lon"),
        (38 + (c % 800) / 100.0).alias("lat"),
    )


_REG_SQL = f"""
reg AS (
  SELECT o_orderkey AS rec_id,
         CASE WHEN o_orderkey % 101 = 0 THEN concat('ABCD', CAST(o_orderkey AS VARCHAR))
              ELSE concat(CAST(2000 + o_orderkey % 20 AS VARCHAR), lpad(CAST(o_orderkey AS VARCHAR), 8, '0')) END AS certno,
         CAST(year(o_orderdate) AS INTEGER) AS dth_yr,
         CAST(o_custkey % 10 AS INTEGER) AS fac_type,
         CASE WHEN o_custkey % 8 = 7 THEN '9' ELSE CAST(o_custkey % 8 AS VARCHAR) END AS married,
         CAST(CASE WHEN o_orderkey % 23 = 0 THEN 99 ELSE o_orderkey % 18 END AS INTEGER) AS educ,
         CASE WHEN o_orderkey % 19 <> 0 THEN ['1', '2', '7', '8', '9'][CAST(o_custkey % 5 + 1 AS INTEGER)] END AS smoking,
         ['1', '2', '9'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS armforce,
         CASE WHEN o_orderkey % 4 <> 0 THEN ['0', '1', '2', '3', '4', '5', '6', '9'][CAST(o_custkey % 8 + 1 AS INTEGER)] END AS resunit,
         CASE WHEN o_orderkey % 44 <> 0 THEN ['Y', 'M', 'W', 'D', 'H', 'U'][CAST(o_orderkey % 6 + 1 AS INTEGER)] END AS res_lena,
         CAST(o_custkey % 40 AS INTEGER) AS resunum,
         CASE WHEN o_orderkey % 16 < 8 THEN CAST(o_orderkey % 16 + 1 AS VARCHAR) ELSE chr(CAST(57 + o_orderkey % 16 AS INTEGER)) END AS race,
         CASE WHEN o_orderkey % 3 = 0 THEN 'Y' WHEN o_orderkey % 3 = 1 THEN 'N' END AS racewh,
         {_mark_sql(5, "Y")} AS racebl,
         {", ".join(f"{_mark_sql(i + 2, 'H')} AS {n}" for i, n in enumerate(HISPANIC))},
         {", ".join(f"{_mark_sql(i + 11, 'Y')} AS {n}" for i, n in enumerate(OTHER_RACES))},
         CASE WHEN o_orderkey % 37 <> 0 THEN CASE WHEN o_orderkey % 41 = 0 THEN 110.0 ELSE -110.0 END - (o_orderkey % 1000) / CAST(100 AS DOUBLE) END AS lon,
         38 + (o_custkey % 800) / CAST(100 AS DOUBLE) AS lat
  FROM orders)"""


# -------------------------------------------------------------------------- census

# line number -> raw variable code; the trailing letter is what PR15 strips
TRACT_CODES = ("B01001_001", "B01001A_001", "B17001_001", "B17001_002", "B25003_001", "B25003_003", "B25001_001")


def census(spark: SparkSession, sf: str) -> DataFrame:
    """Tract-level long table: tract, year, raw variable, estimate, moe."""
    raw = F.concat(pick(F.col("l_linenumber") - 1, list(TRACT_CODES)), F.lit("E"))
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("tract"), F.year("l_shipdate").alias("year"), raw.alias("variable"))
        .agg(F.sum("l_quantity").alias("estimate"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double").alias("moe"))
    )


_CENSUS_SQL = f"""
census AS (
  SELECT l_suppkey AS tract, CAST(year(l_shipdate) AS INTEGER) AS year,
         concat({list(TRACT_CODES)}[l_linenumber], 'E') AS variable,
         sum(l_quantity) AS estimate, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS moe
  FROM lineitem GROUP BY 1, 2, 3)"""

ACS_CODES = tuple(sorted({c for s in CENSUS_SHARES.values() for c in s.cells()}))


def acs(spark: SparkSession, sf: str) -> DataFrame:
    """County-level long table over every cell the shares use."""
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("county"))
    return (
        table(spark, sf, "lineitem")
        .join(sup, "l_suppkey")
        .groupBy("county", F.year("l_shipdate").alias("year"), pick(F.col("l_partkey") % len(ACS_CODES), list(ACS_CODES)).alias("variable"))
        .agg(F.sum("l_quantity").alias("estimate"))
    )


_ACS_SQL = f"""
acs AS (
  SELECT s_nationkey AS county, CAST(year(l_shipdate) AS INTEGER) AS year,
         {list(ACS_CODES)}[CAST(l_partkey % {len(ACS_CODES)} + 1 AS INTEGER)] AS variable, sum(l_quantity) AS estimate
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"""


def age_census(spark: SparkSession, sf: str) -> DataFrame:
    """Sex-by-age cells 3..25 and 27..49 by county, from customers."""
    n = F.col("c_custkey") % 46
    cell = F.when(n < 23, n + 3).otherwise(n + 4)
    return (
        table(spark, sf, "customer")
        .groupBy(F.col("c_nationkey").alias("county"), F.concat(F.lit("B01001_"), F.lpad(cell.cast("string"), 3, "0")).alias("variable"))
        .agg((F.count(F.lit(1)) * 100).alias("estimate"))
    )


_AGE_CENSUS_SQL = """
age_census AS (
  SELECT c_nationkey AS county,
         concat('B01001_', lpad(CAST(CASE WHEN c_custkey % 46 < 23 THEN c_custkey % 46 + 3 ELSE c_custkey % 46 + 4 END AS VARCHAR), 3, '0')) AS variable,
         count(*) * 100 AS estimate
  FROM customer GROUP BY 1, 2)"""


def population(spark: SparkSession, sf: str) -> DataFrame:
    """Population by county and ten-year band (labels), from customers."""
    return (
        table(spark, sf, "customer")
        .groupBy(F.col("c_nationkey").alias("county"), age_band(F.col("c_custkey") % 100).alias("agegroup"))
        .agg((F.count(F.lit(1)) * 1000).alias("tpop"))
    )


_POP_SQL = """
pop AS (
  SELECT c_nationkey AS county,
         ['00_10', '10_20', '20_30', '30_40', '40_50', '50_60', '60_70', '70_80', '80_Inf'][CAST(least(floor((c_custkey % 100) / 10), 8) AS INTEGER) + 1] AS agegroup,
         count(*) * 1000 AS tpop
  FROM customer GROUP BY 1, 2)"""

_STD_SQL = """
std5(agegroup, n_all, n_male, n_female, newgroup) AS (VALUES
  ('00_05', 20201362, 10319427, 9881935, '00_10'), ('05_10', 20348657, 10389638, 9959019, '00_10'),
  ('10_15', 20677194, 10579862, 10097332, '10_20'), ('15_20', 22040343, 11303666, 10736677, '10_20'),
  ('20_25', 21585999, 11014176, 10571823, '20_30'), ('25_30', 21101849, 10635591, 10466258, '20_30'),
  ('30_35', 19962099, 9996500, 9965599, '30_40'), ('35_40', 20179642, 10042022, 10137620, '30_40'),
  ('40_45', 20890964, 10393977, 10496987, '40_50'), ('45_50', 22708591, 11209085, 11499506, '40_50'),
  ('50_55', 22298125, 10933274, 11364851, '50_60'), ('55_60', 19664805, 9523648, 10141157, '50_60'),
  ('60_65', 16817924, 8077500, 8740424, '60_70'), ('65_70', 12435263, 5852547, 6582716, '60_70'),
  ('70_75', 9278166, 4243972, 5034194, '70_80'), ('75_80', 7317795, 3182388, 4135407, '70_80'),
  ('80_85', 5743327, 2294374, 3448953, '80_Inf'), ('85_Inf', 5493433, 1789679, 3703754, '80_Inf')),
std AS (
  SELECT newgroup AS agegroup, sum(n_all) / sum(sum(n_all)) OVER () AS n_all,
         sum(n_male) / sum(sum(n_male)) OVER () AS n_male, sum(n_female) / sum(sum(n_female)) OVER () AS n_female
  FROM std5 GROUP BY newgroup)"""


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """Price index by year of the line items."""
    return (
        table(spark, sf, "lineitem")
        .select(F.year("l_shipdate").alias("year"))
        .distinct()
        .select("year", (100.0 + 3.0 * (F.col("year") - 1995)).alias("cpi"))
    )


_PRICES_SQL = """
prices AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(100.0 + 3.0 * (year(l_shipdate) - 1995) AS DOUBLE) AS cpi FROM lineitem)"""


def crosswalk_table(spark: SparkSession, sf: str) -> DataFrame:
    """Each old tract goes to itself (60 %) and to the next one (40 %)."""
    sup = table(spark, sf, "supplier")
    n = sup.agg(F.count(F.lit(1))).scalar()
    s = F.col("s_suppkey")
    parts = F.array(
        F.struct(s.alias("geoid10"), F.lit(60.0).alias("poppct00")), F.struct(((s + 1) % n).alias("geoid10"), F.lit(40.0).alias("poppct00"))
    )
    return sup.select(s.alias("geoid00"), (1000 + s * 10).alias("pop00"), F.explode(parts).alias("p")).select(
        "geoid00", "p.geoid10", "pop00", "p.poppct00"
    )


_CW_SQL = """
cw AS (
  SELECT s_suppkey AS geoid00, s_suppkey AS geoid10, 1000 + s_suppkey * 10 AS pop00, 60.0 AS poppct00 FROM supplier
  UNION ALL
  SELECT s_suppkey, (s_suppkey + 1) % (SELECT count(*) FROM supplier), 1000 + s_suppkey * 10, 40.0 FROM supplier)"""


def meta(spark: SparkSession, sf: str) -> DataFrame:
    """Variable metadata (name, label), one row per line number."""
    n = F.col("l_linenumber")
    label = F.when(n <= 3, "Male!!In labor force").when(n <= 5, "Male!!In labor force!!Unemployed").otherwise("Male!!Not in labor force")
    return (
        table(spark, sf, "lineitem")
        .select(F.concat(F.lit("B23001_00"), n.cast("string")).alias("name"), label.alias("label"))
        .distinct()
    )


# --------------------------------------------------------------------------- panel


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Tract-year-cause panel from exact integer sums of the line items."""
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    disease = F.when(F.col("l_returnflag") == "R", "Mentalhealth").when(F.col("l_returnflag") == "A", "Allcauses").otherwise("Neoplasms")
    g = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("tract"), F.year("l_shipdate").alias("year"), disease.alias("disease"))
        .agg(
            F.count(F.lit(1)).alias("n_rec"),
            F.sum("l_quantity").cast("long").alias("qty"),
            cents("l_extendedprice").alias("price"),
            cents("l_discount").alias("disc"),
            cents("l_tax").alias("tax"),
        )
    )
    n, q = F.col("n_rec").cast("double"), F.col("qty").cast("double")
    return g.select(
        F.lpad(F.col("tract").cast("string"), 6, "0").alias("geoid"),
        "tract",
        "year",
        "disease",
        "n_rec",
        (F.col("qty") * 10).alias("pop"),
        (F.col("price") / q / 100).alias("mortrate"),
        F.when((F.col("tract") + F.col("year")) % 11 != 0, F.col("disc") / n).alias("ue"),
        (F.col("tax") / n).alias("elder"),
        (q / n).alias("income"),
    )


_PANEL_SQL = """
panel AS (
  SELECT lpad(CAST(tract AS VARCHAR), 6, '0') AS geoid, tract, year, disease, n_rec, qty * 10 AS pop,
         CAST(price AS DOUBLE) / CAST(qty AS DOUBLE) / 100 AS mortrate,
         CASE WHEN (tract + year) % 11 <> 0 THEN CAST(disc AS DOUBLE) / n_rec END AS ue,
         CAST(tax AS DOUBLE) / n_rec AS elder, CAST(qty AS DOUBLE) / n_rec AS income
  FROM (SELECT l_suppkey AS tract, CAST(year(l_shipdate) AS INTEGER) AS year,
               CASE l_returnflag WHEN 'R' THEN 'Mentalhealth' WHEN 'A' THEN 'Allcauses' ELSE 'Neoplasms' END AS disease,
               count(*) AS n_rec, CAST(sum(l_quantity) AS BIGINT) AS qty,
               sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS price,
               sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc, sum(CAST(round(l_tax * 100) AS BIGINT)) AS tax
        FROM lineitem GROUP BY 1, 2, 3) g)"""


# ------------------------------------------------------------------------ geometry

WIDTH = 10  # tracts per grid row


def tracts(spark: SparkSession, sf: str) -> DataFrame:
    """Tract squares (geom, gx, gy), one per supplier."""
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        s.alias("geom"), (s % WIDTH).alias("gx"), F.floor(s / WIDTH).alias("gy"), F.col("s_nationkey").alias("county")
    )


def tract_vertices(spark: SparkSession, sf: str) -> DataFrame:
    t = tracts(spark, sf)
    return rectangles_to_vertices(
        t.select("geom", F.col("gx").alias("x0"), F.col("gy").alias("y0"), (F.col("gx") + 1).alias("x1"), (F.col("gy") + 1).alias("y1")), "geom"
    )


_TRACTS_SQL = """
tracts AS (SELECT s_suppkey AS geom, s_suppkey % 10 AS gx, CAST(floor(s_suppkey / 10) AS BIGINT) AS gy, s_nationkey AS county FROM supplier)"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Points over the grid and one row beyond it; never on a tract border."""
    n = table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        c.alias("pt_id"),
        ((c * 7919) % 10000 / 1000.0 + 0.0005).alias("x"),
        ((c * 104729) % (n * 100 + 1000) / 1000.0 + 0.0005).alias("y"),
        F.col("c_acctbal"),
        F.col("c_nationkey"),
    )


_POINTS_SQL = """
points AS (
  SELECT c_custkey AS pt_id, (c_custkey * 7919) % 10000 / CAST(1000 AS DOUBLE) + CAST(0.0005 AS DOUBLE) AS x,
         (c_custkey * 104729) % ((SELECT count(*) FROM supplier) * 100 + 1000) / CAST(1000 AS DOUBLE) + CAST(0.0005 AS DOUBLE) AS y,
         c_acctbal, c_nationkey
  FROM customer)"""


def parks(spark: SparkSession, sf: str) -> DataFrame:
    """Park rectangles 0.3 x 0.2, one per part, some private."""
    n = table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    p = F.col("p_partkey")
    x0, y0 = (p * 37) % 950 / 100.0, (p * 53) % (n * 10 - 50) / 100.0
    return table(spark, sf, "part").select(
        p.alias("park_id"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 0.3).alias("x1"),
        (y0 + 0.2).alias("y1"),
        F.when(F.col("p_size") % 5 == 0, "PRIV").when(F.col("p_size") % 5 != 1, "LOCAL").alias("manager"),
    )


_PARKS_SQL = """
parks AS (
  SELECT p_partkey AS park_id, x0, y0, x0 + CAST(0.3 AS DOUBLE) AS x1, y0 + CAST(0.2 AS DOUBLE) AS y1,
         CASE WHEN p_size % 5 = 0 THEN 'PRIV' WHEN p_size % 5 <> 1 THEN 'LOCAL' END AS manager
  FROM (SELECT p_partkey, p_size, (p_partkey * 37) % 950 / CAST(100 AS DOUBLE) AS x0,
               (p_partkey * 53) % ((SELECT count(*) FROM supplier) * 10 - 50) / CAST(100 AS DOUBLE) AS y0
        FROM part) p)"""


def facilities(spark: SparkSession, sf: str) -> DataFrame:
    """Facilities at the customer points: state, status, employees."""
    c = F.col("pt_id")
    return points(spark, sf).select(
        c.alias("facility_id"),
        "x",
        "y",
        pick(c % 3, ["OR", "WA", "ID"]).alias("state"),
        F.when(c % 7 == 0, "T").when(c % 29 != 0, "A").alias("status"),
        F.when(c % 31 != 0, c % 50).alias("employees"),
    )


_FACILITIES_SQL = """
facilities AS (
  SELECT pt_id AS facility_id, x, y, ['OR', 'WA', 'ID'][CAST(pt_id % 3 + 1 AS INTEGER)] AS state,
         CASE WHEN pt_id % 7 = 0 THEN 'T' WHEN pt_id % 29 <> 0 THEN 'A' END AS status,
         CASE WHEN pt_id % 31 <> 0 THEN pt_id % 50 END AS employees
  FROM points)"""


def raster(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly raster, 16 cells of width 0.25 per tract: year, x, y, value."""
    years = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("geom"), F.year("l_shipdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n")
    )
    t = tracts(spark, sf).join(years, "geom")
    k = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k")
    return t.select("gx", "gy", "year", "n", k).select(
        "year",
        (F.col("gx") + (F.col("k") % 4) * 0.25 + 0.125).alias("x"),
        (F.col("gy") + F.floor(F.col("k") / 4) * 0.25 + 0.125).alias("y"),
        ((F.col("n") * 7 + F.col("k") * 3) % 11).cast("double").alias("value"),
    )


_RASTER_SQL = """
raster AS (
  SELECT geom, year, k, CAST((n * 7 + k * 3) % 11 AS DOUBLE) AS value
  FROM (SELECT s_suppkey AS geom, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) c, range(16) r(k))"""


def tract_edges_sql() -> str:
    """Queen neighbours on the grid by arithmetic: squares one step apart."""
    return """
adj AS (
  SELECT a.geom AS i, b.geom AS j FROM tracts a
  JOIN (SELECT geom, gx + dx AS gx, gy + dy AS gy FROM tracts, (VALUES (-1), (0), (1)) x(dx), (VALUES (-1), (0), (1)) y(dy)) b
    ON a.gx = b.gx AND a.gy = b.gy AND a.geom <> b.geom)"""


# ----------------------------------------------------------------- posterior draws

N_YEARS = 10


def effects(spark: SparkSession, sf: str) -> DataFrame:
    """Effect rows (row, draws): the embedding vectors; two blocks of ten years."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").alias("draws"))


def n_effect_areas(spark: SparkSession, sf: str) -> int:
    """Areas in the effect layout: rows / (2 blocks x 10 years)."""
    return table(spark, sf, "embeddings").count() // (2 * N_YEARS)


def draws_long(spark: SparkSession, sf: str) -> DataFrame:
    """One row per effect and draw: row, draw, value."""
    return effects(spark, sf).select("row", F.posexplode("draws").alias("draw", "value")).withColumn("value", F.col("value").cast("double"))


_EFFECT_SQL = """
na AS (SELECT count(*) // 20 AS n FROM embeddings),
effect AS (
  SELECT vec_id AS row, embedding AS draws, CAST(vec_id // (n * 10) AS INTEGER) AS block,
         CAST((vec_id // n) % 10 AS INTEGER) AS year_index, vec_id % n AS area_index
  FROM embeddings, na),
draws AS (
  SELECT row, block, year_index, area_index, CAST(d - 1 AS INTEGER) AS draw, CAST(draws[d] AS DOUBLE) AS value
  FROM (SELECT *, unnest(range(1, len(draws) + 1)) AS d FROM effect) e)"""

_NUMBERED = {
    "rec": _REC_SQL,
    "reg": _REG_SQL,
    "census": _CENSUS_SQL,
    "acs": _ACS_SQL,
    "age_census": _AGE_CENSUS_SQL,
    "pop": _POP_SQL,
    "std": _STD_SQL,
    "prices": _PRICES_SQL,
    "cw": _CW_SQL,
    "panel": _PANEL_SQL,
    "tracts": _TRACTS_SQL,
    "points": _POINTS_SQL,
    "facilities": _FACILITIES_SQL,
    "parks": _PARKS_SQL,
    "raster": _RASTER_SQL,
    "adj": tract_edges_sql(),
    "effect": _EFFECT_SQL,
}


def with_ctes(names: str, body: str) -> str:
    """``WITH`` the named fixtures (blank-separated, in order) around a query."""
    wanted = names.split()
    text = ",".join(_NUMBERED[n] for n in wanted)
    if re.match(r"\s*WITH\s", body, re.I):
        body = "," + re.sub(r"^\s*WITH\s", " ", body, count=1, flags=re.I)
    return f"WITH{text}\n{body.strip()}"
