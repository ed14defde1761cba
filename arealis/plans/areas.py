"""Queries for spatial joins, overlays, area covariates and structure matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.recode import state_label
from ..operators import models, panel as panel_ops, spatial, structure
from . import fixtures as fx
from .fixtures import with_ctes
from .registry import query, rnd, rounded
from .tables import _STATE_SQL, _state_outcomes


@query(
    "jn7_point_in_polygon",
    with_ctes("tracts points", "SELECT pt_id, geom FROM points LEFT JOIN tracts ON gx = floor(x) AND gy = floor(y)"),
)
def jn7(spark, sf):
    return spatial.point_in_polygon(fx.points(spark, sf), fx.tract_vertices(spark, sf)).select("pt_id", "geom")


_POP_REF = "pr AS (SELECT l_suppkey AS geom, CAST(sum(l_quantity) AS BIGINT) AS pop_ref FROM lineitem GROUP BY 1)"


@query(
    "cv1_facility_density",
    with_ctes(
        "tracts points facilities",
        f"""WITH {_POP_REF},
        f AS (SELECT t.geom, count(*) AS n, CASE WHEN count(employees) = count(*) THEN sum(employees) END AS e
              FROM facilities LEFT JOIN tracts t ON gx = floor(x) AND gy = floor(y)
              WHERE state IN ('OR', 'WA') AND status <> 'T' GROUP BY 1)
        SELECT coalesce(f.geom, pr.geom) AS geom, {rnd('1e4 * coalesce(n, 0) / pop_ref')} AS d_facility_10k,
               {rnd('1e4 * CASE WHEN n IS NULL THEN 0 ELSE e END / pop_ref')} AS d_employees_10k
        FROM f FULL JOIN pr ON f.geom = pr.geom""",
    ),
)
def cv1(spark, sf):
    pop = fx.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("geom")).agg(F.sum("l_quantity").cast("long").alias("pop_ref"))
    return rounded(spatial.facility_density(fx.facilities(spark, sf), fx.tract_vertices(spark, sf), pop, ["OR", "WA"]))


def _named_vertices(rects):
    """Rectangles keyed by a text id whose first six characters name the county."""
    return spatial.rectangles_to_vertices(rects, "geoid")


@query(
    "cv2_water_share",
    with_ctes(
        "tracts",
        f"""SELECT lpad(CAST(county AS VARCHAR), 2, '0') AS area_id, {rnd('sum(nw)')} AS area_nonwater, {rnd('sum(ns)')} AS area_nonsea,
        {rnd('greatest(100 * (sum(ns) - sum(nw)) / sum(ns), 0)')} AS p_water
        FROM (SELECT county, 1 - (geom % 10) / CAST(20 AS DOUBLE) AS ns, 1 - (geom % 7) / CAST(10 AS DOUBLE) AS nw FROM tracts) a GROUP BY 1""",
    ),
)
def cv2(spark, sf):
    t = fx.tracts(spark, sf).select(
        F.concat(F.lpad(F.col("county").cast("string"), 2, "0"), F.lpad(F.col("geom").cast("string"), 8, "0")).alias("geoid"), "geom", "gx", "gy"
    )

    def layer(cut):
        return _named_vertices(
            t.select("geoid", F.col("gx").alias("x0"), F.col("gy").alias("y0"), (F.col("gx") + 1).alias("x1"), (F.col("gy") + 1 - cut).alias("y1"))
        )

    return rounded(spatial.water_share(layer((F.col("geom") % 7) / 10.0), layer((F.col("geom") % 10) / 20.0), "geoid", 2))


_OVERLAP_SQL = """ov AS (
  SELECT geom, park_id, manager, (least(x1, gx + 1) - greatest(x0, gx)) * (least(y1, gy + 1) - greatest(y0, gy)) AS area
  FROM (SELECT *, unnest(range(CAST(floor(x0) AS BIGINT), CAST(floor(x1) AS BIGINT) + 1)) AS cx FROM parks) p
  JOIN tracts ON gx = cx AND gy BETWEEN floor(y0) AND floor(y1)
  WHERE least(x1, gx + 1) - greatest(x0, gx) > 1e-9 AND least(y1, gy + 1) - greatest(y0, gy) > 1e-9)"""


def _park_vertices(spark, sf, public: bool):
    p = fx.parks(spark, sf)
    if public:
        p = p.where(~F.coalesce(F.col("manager").isin("PRIV"), F.lit(False)))
    return spatial.rectangles_to_vertices(p.select("park_id", "x0", "y0", "x1", "y1"), "park_id")


@query("sp4_overlay_area", with_ctes("tracts parks", f"WITH {_OVERLAP_SQL} SELECT geom, park_id, {rnd('area')} AS area FROM ov"))
def sp4(spark, sf):
    return rounded(
        spatial.overlay_area(fx.tract_vertices(spark, sf), _park_vertices(spark, sf, False), "geom", "park_id")
    )


@query(
    "cv3_park_share",
    with_ctes(
        "tracts parks",
        f"""WITH {_OVERLAP_SQL} SELECT t.geom, coalesce(n, 0) AS n_parks, {rnd('coalesce(a, 0)')} AS park_area,
        CAST(coalesce(n, 0) AS DOUBLE) AS d_parks, {rnd('100 * coalesce(a, 0)')} AS p_park
        FROM tracts t LEFT JOIN (SELECT geom, count(*) AS n, sum(area) AS a FROM ov WHERE manager IS NULL OR manager <> 'PRIV' GROUP BY 1) o ON o.geom = t.geom""",
    ),
)
def cv3(spark, sf):
    return rounded(spatial.park_share(fx.tract_vertices(spark, sf), _park_vertices(spark, sf, True)))


@query(
    "cv4_raster_zonal_mean",
    with_ctes(
        "tracts raster",
        f"""SELECT t.geom, k.year, {rnd('avg(value)')} AS value FROM tracts t CROSS JOIN (SELECT DISTINCT year FROM raster) k
        LEFT JOIN raster r ON r.geom = t.geom AND r.year = k.year AND t.geom % 7 <> 3 GROUP BY 1, 2""",
    ),
)
def cv4(spark, sf):
    # some tracts lie outside the raster
    tract = F.floor("x") + 10 * F.floor("y")
    return rounded(spatial.zonal_statistic(fx.raster(spark, sf).where(tract % 7 != 3), fx.tract_vertices(spark, sf), 0.25, by=["year"]))


@query(
    "cv4_whole_raster_zonal_mean",
    with_ctes(
        "tracts raster",
        f"""SELECT t.geom, k.year, {rnd('avg(value)')} AS value FROM tracts t CROSS JOIN (SELECT DISTINCT year FROM raster) k
        LEFT JOIN raster r ON r.geom = t.geom AND r.year = k.year GROUP BY 1, 2""",
    ),
)
def cv4_whole(spark, sf):
    return rounded(spatial.zonal_statistic(fx.raster(spark, sf), fx.tract_vertices(spark, sf), 0.25, by=["year"]))


def _triangles(df, geom, corner_x, corner_y, leg):
    """Right triangles with legs along the axes, in metres of a national grid."""
    corner = lambda s, dx, dy: F.struct(F.lit(s).alias("seq"), (F.col("_x") + dx).alias("x"), (F.col("_y") + dy).alias("y"))
    ring = F.array(corner(0, 0.0, 0.0), corner(1, leg, 0.0), corner(2, 0.0, leg), corner(3, 0.0, 0.0))
    placed = df.select(geom, (corner_x - 2_000_000).cast("double").alias("_x"), (corner_y + 2_500_000).cast("double").alias("_y"))
    return placed.select(geom, F.lit(0).alias("part"), F.lit(0).alias("ring"), F.explode(ring).alias("v")).select(geom, "part", "ring", "v.seq", "v.x", "v.y")


@query(
    "sp4_overlay_of_triangles",
    """WITH a AS (SELECT s_suppkey AS zone, s_suppkey % 10 * 3000 AS x, s_suppkey // 10 * 3000 AS y, 4000 AS leg FROM supplier),
    b AS (SELECT p_partkey AS plot, p_partkey * 37 % 300 * 100 AS x, p_partkey * 53 % 100 * 300 AS y, 1000 AS leg FROM part),
    o AS (SELECT zone, plot, least(a.x + a.y + a.leg, b.x + b.y + b.leg) - greatest(a.x, b.x) - greatest(a.y, b.y) AS side FROM a, b)
    SELECT zone, plot, round(side * side / 2.0, 3) AS area FROM o WHERE side > 0""",
)
def sp4_triangles(spark, sf):
    # boxes of many pairs overlap although the triangles are apart
    z, q = F.col("zone"), F.col("plot")
    zones = _triangles(fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("zone")), "zone", z % 10 * 3000, F.floor(z / 10) * 3000, 4000.0)
    plots = _triangles(fx.table(spark, sf, "part").select(F.col("p_partkey").alias("plot")), "plot", q * 37 % 300 * 100, q * 53 % 100 * 300, 1000.0)
    return rounded(spatial.overlay_area(zones, plots, "zone", "plot"), 3)


INDEX_COLUMNS = ["income", "elder", "ue", "mortrate"]


@query("cv5_composite_index")
def cv5(spark, sf):
    d = fx.panel(spark, sf)
    pc = models.principal_components(d, INDEX_COLUMNS)
    return rounded(d.select("tract", "year", "disease", pc.score().alias("SES")))


@query("cv6_recomputed_index")
def cv6(spark, sf):
    d = fx.panel(spark, sf).withColumn("SES_old", F.lit(0.0))
    return rounded(models.composite_index(d, ["income", "elder", "ue"]).select("tract", "year", "disease", "SES"))


@query("cv7_loadings_and_eigenvalues")
def cv7(spark, sf):
    d = fx.panel(spark, sf)
    pc = models.principal_components(d, INDEX_COLUMNS)
    return rounded(pc.loadings(d).join(pc.eigen_table(d), "component"))


def _pair_sql(a: str, b: str) -> str:
    """Two columns: components (1, 1) and (1, -1) over the root of two, with the
    eigenvalues 1 + r and 1 - r. Missing values take the column's mean."""
    return f"""f AS (SELECT tract, year, disease, coalesce({a}, (SELECT avg({a}) FROM panel)) AS a, coalesce({b}, (SELECT avg({b}) FROM panel)) AS b FROM panel),
    st AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS r FROM f)"""


_PAIR_SCORE = "((a - ma) / sa + CASE WHEN r >= 0 THEN 1 ELSE -1 END * (b - mb) / sb) / sqrt(2)"


@query("cv5_index_of_two_columns", with_ctes("panel", f"WITH {_pair_sql('income', 'ue')} SELECT tract, year, disease, {rnd(_PAIR_SCORE)} AS \"SES\" FROM f, st"))
def cv5_two(spark, sf):
    d = fx.panel(spark, sf)
    return rounded(d.select("tract", "year", "disease", models.principal_components(d, ["income", "ue"]).score().alias("SES")))


@query("cv6_recomputed_index_of_two_columns", with_ctes("panel", f"WITH {_pair_sql('ue', 'elder')} SELECT tract, year, disease, {rnd(_PAIR_SCORE)} AS \"SES\" FROM f, st"))
def cv6_two(spark, sf):
    d = fx.panel(spark, sf).withColumn("SES_old", F.lit(0.0))
    return rounded(models.composite_index(d, ["ue", "elder"]).select("tract", "year", "disease", "SES"))


@query(
    "cv7_loadings_of_two_columns",
    with_ctes(
        "panel",
        f"""WITH {_pair_sql('income', 'ue')}, e AS (SELECT 1 AS component, 1 + abs(r) AS v FROM st UNION ALL SELECT 2, 1 - abs(r) FROM st)
        SELECT component, variable, {rnd("sqrt(v / 2) * CASE WHEN variable = 'ue' AND (component = 1) <> (r >= 0) THEN -1 ELSE 1 END")} AS loading,
               {rnd('v')} AS eigenvalue, {rnd('50 * v')} AS percent, {rnd('CASE component WHEN 1 THEN 50 * v ELSE 100 END')} AS cumulative
        FROM e, st, (SELECT unnest(['income', 'ue']) AS variable) n""",
    ),
)
def cv7_two(spark, sf):
    d = fx.panel(spark, sf)
    pc = models.principal_components(d, ["income", "ue"])
    return rounded(pc.loadings(d).join(pc.eigen_table(d), "component"))


@query(
    "cv5_supplementary_columns",
    with_ctes(
        "panel",
        f"""WITH {_pair_sql('income', 'ue')}, s AS (SELECT {_PAIR_SCORE} AS one, ((a - ma) / sa - CASE WHEN r >= 0 THEN 1 ELSE -1 END * (b - mb) / sb) / sqrt(2) AS two, elder, disease
          FROM f JOIN panel USING (tract, year, disease), st)
        SELECT 'elder' AS variable, NULL AS level, 1 AS component, {rnd('corr(elder, one)')} AS value, count(elder) AS n FROM s
        UNION ALL SELECT 'elder', NULL, 2, {rnd('corr(elder, two)')}, count(elder) FROM s
        UNION ALL SELECT 'disease', disease, 1, {rnd('avg(one)')}, count(*) FROM s GROUP BY disease
        UNION ALL SELECT 'disease', disease, 2, {rnd('avg(two)')}, count(*) FROM s GROUP BY disease""",
    ),
)
def cv5_supplementary(spark, sf):
    """A further column and the causes of death on the components of two columns."""
    d = fx.panel(spark, sf)
    pc = models.principal_components(d, ["income", "ue"])
    return rounded(models.supplementary(d, pc, ["elder"], ["disease"]))


@query(
    "cv5_eigen_equations",
    f"SELECT variable, component, CAST(0 AS DOUBLE) AS left_over FROM (SELECT unnest(['{"', '".join(INDEX_COLUMNS)}']) AS variable), (SELECT unnest([1, 2, 3, 4]) AS component)",
)
def cv5_equations(spark, sf):
    """C v - lambda v of each component, with correlations from an aggregate of its own."""
    d = fx.panel(spark, sf)
    pc = models.principal_components(d, INDEX_COLUMNS)
    known = d.select(*[F.coalesce(F.col(c).cast("double"), d.agg(F.avg(c)).scalar()).alias(c) for c in INDEX_COLUMNS])
    cells = []
    for i, a in enumerate(INDEX_COLUMNS):
        for k in range(len(INDEX_COLUMNS)):
            pulled = sum((F.corr(a, b) * float(pc.vectors[j, k]) for j, b in enumerate(INDEX_COLUMNS)), F.lit(0.0))
            rest = pulled - float(pc.eigenvalues[k] * pc.vectors[i, k])
            cells.append(F.struct(F.lit(a).alias("variable"), F.lit(k + 1).alias("component"), (F.round(rest, 9) + 0.0).alias("left_over")))
    return known.agg(F.array(*cells).alias("c")).select(F.inline("c"))


_STUDY_SQL = f"""{_STATE_SQL},
study AS (SELECT geoid, year, county, income, elder, n_outcome, CASE WHEN geoid LIKE '41%' THEN 'Oregon' ELSE 'Washington' END AS state
  FROM asm WHERE year IN (1996, 1997, 1998, 1999, 2000))"""


def _study_panel(spark, sf):
    d = panel_ops.assemble_by_state(*_state_outcomes(spark, sf)).where(F.col("year").isin(list(range(1996, 2001))))
    return d.withColumn("state", state_label(F.substring("geoid", 1, 2), {"41": "Oregon"}, "Washington"))


@query("cv8_panel_for_window", with_ctes("panel tracts", f"WITH {_STUDY_SQL} SELECT * FROM study ORDER BY year, geoid"))
def cv8(spark, sf):
    d = _study_panel(spark, sf).select("geoid", "year", "county", "income", "elder", "n_outcome", "state")
    return rounded(d).orderBy("year", "geoid")


@query(
    "cv9_final_covariate_join",
    with_ctes(
        "panel tracts parks raster",
        f"""WITH {_STUDY_SQL}, {_OVERLAP_SQL},
        pk AS (SELECT geom, count(*) AS n, sum(area) AS a FROM ov WHERE manager IS NULL OR manager <> 'PRIV' GROUP BY 1),
        pm AS (SELECT geom, year, avg(value) AS v FROM raster GROUP BY 1, 2)
        SELECT geoid, s.year, s.state, n_outcome, coalesce(n, 0) AS n_parks, {rnd('100 * coalesce(a, 0)')} AS p_park, {rnd('v')} AS pm25_mean
        FROM study s JOIN tracts t ON CAST(substr(geoid, 3) AS BIGINT) = t.geom LEFT JOIN pk ON pk.geom = t.geom
        LEFT JOIN pm ON pm.geom = t.geom AND pm.year = s.year""",
    ),
)
def cv9(spark, sf):
    v = spatial.stored_edges(fx.tract_vertices(spark, sf))
    parks = spatial.park_share(v, _park_vertices(spark, sf, True))
    pm25 = spatial.zonal_statistic(fx.raster(spark, sf), v, 0.25, by=["year"]).withColumnRenamed("value", "pm25_mean")
    study = _study_panel(spark, sf).withColumn("geom", F.substring("geoid", 3, 10).cast("long"))
    out = panel_ops.add_covariates(study, [(parks, ["geom"]), (pm25, ["geom", "year"])])
    return rounded(out.select("geoid", "year", "state", "n_outcome", "n_parks", "p_park", "pm25_mean"))


# ------------------------------------------------------------------------- geometry


@query("sp1_contiguity", with_ctes("tracts adj", "SELECT i, j FROM adj"))
def sp1(spark, sf):
    return spatial.contiguity(fx.tract_vertices(spark, sf), snap=0.005)


@query("sp2_neighbour_counts", with_ctes("tracts adj", "SELECT i, count(*) AS n_neighbours FROM adj GROUP BY 1"))
def sp2(spark, sf):
    return spatial.neighbour_counts(spatial.contiguity(fx.tract_vertices(spark, sf)), fx.tracts(spark, sf))


@query("sp3_polygon_area", with_ctes("tracts parks", "SELECT park_id, round(CAST(0.06 AS DOUBLE), 6) AS area FROM parks"))
def sp3(spark, sf):
    return rounded(spatial.polygon_area(_park_vertices(spark, sf, False), "park_id"))


def _projected_registry(spark, sf):
    """Every third record's coordinates given in the projected system."""
    d = fx.registry(spark, sf).where(F.col("lon") < 0).withColumnsRenamed({"lon": "_lon", "lat": "_lat"})
    x, y = spatial.lonlat_to_lambert(F.col("_lon"), F.col("_lat"))
    third = F.col("rec_id") % 3 == 0
    return d.select(
        "rec_id", F.when(third, x).otherwise(F.col("_lon")).alias("lon"), F.when(third, y).otherwise(F.col("_lat")).alias("lat")
    )


@query(
    "sp5_fix_projected_coordinates",
    with_ctes("reg", f"SELECT rec_id, {rnd('lon', 7)} AS lon, {rnd('lat', 7)} AS lat FROM reg WHERE lon < 0 AND lat >= 40 AND lon < -80"),
)
def sp5(spark, sf):
    # records whose projected easting is below 180 units cannot be told apart;
    # the longitudes of the data keep all eastings far above that
    return rounded(spatial.fix_coordinates(_projected_registry(spark, sf), "lon", "lat"), 7)



@query(
    "sp6_reproject_layers",
    with_ctes(
        "reg",
        f"""SELECT rec_id, {rnd('radians(lon) * 6378137.0', 3)} AS merc_x, {rnd('ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0', 3)} AS merc_y
        FROM reg WHERE lon IS NOT NULL""",
    ),
)
def sp6(spark, sf):
    d = fx.registry(spark, sf).where(F.col("lon").isNotNull())
    x, y = spatial.lonlat_to_mercator(F.col("lon"), F.col("lat"))
    return rounded(d.select("rec_id", x.alias("merc_x"), y.alias("merc_y")), 3)


_ALBERS_SQL = """k AS (SELECT 0.006694380022903416 AS e2, sqrt(0.006694380022903416) AS e),
lat AS (SELECT unnest([29.5, 45.5, 23.0]) AS d, unnest(['1', '2', '0']) AS n),
par AS (SELECT n, cos(radians(d)) / sqrt(1 - e2 * sin(radians(d)) ^ 2) AS m,
  (1 - e2) * (sin(radians(d)) / (1 - e2 * sin(radians(d)) ^ 2) - ln((1 - e * sin(radians(d))) / (1 + e * sin(radians(d)))) / (2 * e)) AS q FROM lat, k),
three AS (SELECT max(m) FILTER (n = '1') AS m1, max(m) FILTER (n = '2') AS m2, max(q) FILTER (n = '1') AS q1, max(q) FILTER (n = '2') AS q2, max(q) FILTER (n = '0') AS q0 FROM par),
cone AS (SELECT (m1 ^ 2 - m2 ^ 2) / (q2 - q1) AS n, m1 ^ 2 + (m1 ^ 2 - m2 ^ 2) / (q2 - q1) * q1 AS c, q0 FROM three),
pts AS (SELECT rec_id, n, 6378137.0 * sqrt(c - n * q0) / n AS rho0, n * radians(lon + 96) AS theta,
  6378137.0 * sqrt(c - n * (1 - e2) * (sin(radians(lat)) / (1 - e2 * sin(radians(lat)) ^ 2) - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e))) / n AS rho
  FROM reg, cone, k WHERE lon IS NOT NULL)"""


@query(
    "sp6_reproject_equal_area",
    with_ctes("reg", f"WITH {_ALBERS_SQL} SELECT rec_id, {rnd('rho * sin(theta)', 3)} AS albers_x, {rnd('rho0 - rho * cos(theta)', 3)} AS albers_y FROM pts"),
)
def sp6_albers(spark, sf):
    d = fx.registry(spark, sf).where(F.col("lon").isNotNull())
    x, y = spatial.lonlat_to_albers(F.col("lon"), F.col("lat"))
    return rounded(d.select("rec_id", x.alias("albers_x"), y.alias("albers_y")), 3)


# ------------------------------------------------------------------------ structure


def tract_graph(spark, sf):
    """Queen neighbours, and the number of tracts and years, of the study area."""
    edges = spatial.contiguity(fx.tract_vertices(spark, sf))
    n = fx.table(spark, sf, "supplier").count()
    years = fx.prices(spark, sf).count()
    return edges, n, years


_L_SQL = "lap AS (SELECT i, j, -1.0 AS v FROM adj UNION ALL SELECT i, i, CAST(count(*) AS DOUBLE) FROM adj GROUP BY i)"
_RT_SQL = """nt AS (SELECT count(*) AS t FROM prices), nn AS (SELECT count(*) AS n FROM supplier),
rt AS (SELECT a.k AS k, b.k AS l, CASE WHEN a.k <> b.k THEN -1.0 WHEN a.k IN (0, t - 1) THEN 1.0 ELSE 2.0 END AS r
  FROM nt, range(0, (SELECT t FROM nt)) a(k) JOIN range(0, (SELECT t FROM nt)) b(k) ON abs(a.k - b.k) <= 1)"""


@query("sp7_graph_laplacian", with_ctes("tracts adj", f"WITH {_L_SQL} SELECT i, j, CAST(v AS DOUBLE) AS v FROM lap"))
def sp7(spark, sf):
    edges, _, _ = tract_graph(spark, sf)
    return structure.laplacian(edges, fx.tracts(spark, sf))


@query(
    "sp8_random_walk_quadratic",
    with_ctes(
        "panel",
        f"""SELECT tract, disease, {rnd('sum((b - a) * (b - a))')} AS roughness FROM (
        SELECT tract, disease, income AS a, lead(income) OVER (PARTITION BY tract, disease ORDER BY year) AS b FROM panel) s GROUP BY 1, 2""",
    ),
)
def sp8(spark, sf):
    # x' R x over the years of every tract and cause, with R from the operator
    first, _ = panel_ops.year_range(fx.prices(spark, sf))
    p = fx.panel(spark, sf).select("tract", "disease", (F.col("year") - first).alias("k"), "income")
    r = structure.rw1(spark, fx.prices(spark, sf).count())
    left = p.join(r.withColumnRenamed("i", "k"), "k").select("tract", "disease", "j", (F.col("income") * F.col("v")).alias("a"))
    right = p.select("tract", "disease", F.col("k").alias("j"), F.col("income").alias("b"))
    return rounded(left.join(right, ["tract", "disease", "j"]).groupBy("tract", "disease").agg(F.sum(F.col("a") * F.col("b")).alias("roughness")))


@query(
    "sp9_kronecker_product",
    with_ctes(
        "tracts adj prices",
        f"WITH {_L_SQL}, {_RT_SQL} SELECT k * n + i AS i, l * n + j AS j, CAST(r * v AS DOUBLE) AS v FROM rt, lap, nn",
    ),
)
def sp9(spark, sf):
    edges, n, t = tract_graph(spark, sf)
    return structure.kron(structure.rw1(spark, t), structure.laplacian(edges), n, n)


_TYPE_SQL = {
    "I": "SELECT e AS i, e AS j, CAST(1 AS DOUBLE) AS v FROM range(0, (SELECT t * n FROM nt, nn)) x(e)",
    "II": "SELECT k * n + a AS i, l * n + a AS j, CAST(r AS DOUBLE) AS v FROM rt, nn, range(0, (SELECT n FROM nn)) x(a)",
    "III": "SELECT k * n + i AS i, k * n + j AS j, CAST(v AS DOUBLE) AS v FROM lap, nn, range(0, (SELECT t FROM nt)) x(k)",
    "IV": "SELECT k * n + i AS i, l * n + j AS j, CAST(r * v AS DOUBLE) AS v FROM rt, lap, nn",
}


@query(
    "sp10_space_time_precision",
    with_ctes(
        "tracts adj prices",
        f"WITH {_L_SQL}, {_RT_SQL} " + " UNION ALL ".join(
            f"SELECT '{k}' AS kind, i, j, v, {d} AS rank_deficiency FROM ({s}) q{k}, nt, nn"
            for (k, s), d in zip(_TYPE_SQL.items(), ("0", "n", "t", "n + t - 1"))
        ),
    ),
)
def sp10(spark, sf):
    edges, n, t = tract_graph(spark, sf)
    lap = structure.laplacian(edges)
    out = None
    for kind in structure.INTERACTION_TYPES:
        m, deficiency = structure.interaction(kind, lap, n, t)
        part = m.select(F.lit(kind).alias("kind"), "i", "j", "v", F.lit(deficiency).alias("rank_deficiency"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "sp11_sum_to_zero_constraints",
    with_ctes(
        "prices",
        """WITH nt AS (SELECT count(*) AS t FROM prices), nn AS (SELECT count(*) AS n FROM supplier),
        c AS (SELECT e AS j, e % n AS a, e // n AS k, n FROM nn, range(0, (SELECT t * n FROM nt, nn)) x(e))
        SELECT 'I' AS kind, 0 AS i, j, CAST(1 AS DOUBLE) AS v FROM c UNION ALL SELECT 'II', a, j, 1 FROM c UNION ALL SELECT 'III', k, j, 1 FROM c
        UNION ALL SELECT 'IV', a - 1, j, 1 FROM c WHERE a > 0 UNION ALL SELECT 'IV', k + n - 1, j, 1 FROM c""",
    ),
)
def sp11(spark, sf):
    n, t = fx.table(spark, sf, "supplier").count(), fx.prices(spark, sf).count()
    out = None
    for kind in structure.INTERACTION_TYPES:
        part = structure.constraints(spark, kind, n, t).select(F.lit(kind).alias("kind"), "i", "j", "v")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "sp12_linear_combination_selectors",
    with_ctes(
        "prices",
        """WITH nt AS (SELECT count(*) AS t FROM prices), nn AS (SELECT count(*) AS n FROM supplier),
        c AS (SELECT e AS i, e % n AS a, e // n AS k FROM nn, range(0, (SELECT t * n FROM nt, nn)) x(e))
        SELECT 'slope' AS effect, i, a AS j, CAST(1 AS DOUBLE) AS v FROM c UNION ALL SELECT 'interaction', i, i, 1 FROM c UNION ALL SELECT 'year', i, k, 1 FROM c""",
    ),
)
def sp12(spark, sf):
    n, t = fx.table(spark, sf, "supplier").count(), fx.prices(spark, sf).count()
    return structure.area_selectors(spark, n, t, "slope", "interaction", "year")
