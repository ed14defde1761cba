"""Queries that write derived tables in a study's file formats and read them back.

The files go to the shared checkpoint folder of the session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import spatial
from ..operators.ranks import ensure_checkpoint_dir
from ..sources import files
from . import fixtures as fx
from .fixtures import with_ctes
from .registry import query, rnd, rounded


def shared_folder(spark, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("io1_csv_with_header", f"SELECT o_orderkey, o_custkey, {rnd('o_totalprice')} AS o_totalprice FROM orders")
def io1(spark, sf):
    path = shared_folder(spark, "csv")
    files.write_csv(fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path)
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"
    return rounded(files.read_csv(spark, path, schema, ["o_orderkey", "o_custkey", "o_totalprice"]))


def _index_files(spark, sf):
    """One file set per year, named like the downloads, with two header lines.

    Tracts and counties together, over all causes.
    """
    p = fx.panel(spark, sf)
    county = fx.tracts(spark, sf).select(F.col("geom").alias("tract"), F.lpad(F.col("county").cast("string"), 5, "0").alias("county"))
    kinds = F.explode(
        F.array(
            F.struct(F.concat(F.lit("1400000US"), "geoid").alias("geo_id"), F.lit("Tract").alias("name")),
            F.struct(F.concat(F.lit("0500000US"), "county").alias("geo_id"), F.lit("County").alias("name")),
        )
    ).alias("k")
    mean = F.sum(F.round(F.col("ue") * 1e9).cast("long")) / F.count("ue") / 1e9
    name = F.concat(F.lit("ACSDT5Y"), F.col("year").cast("string"), F.lit(".B19083_data.csv")).alias("file")
    means = p.join(county, "tract").select("year", "ue", kinds).groupBy("year", "k").agg(mean.alias("ue"))
    rows = means.select(
        F.coalesce(F.col("ue").cast("string"), F.lit("-")).alias("value"), F.lit("0.1").alias("margin"), "k.geo_id", "k.name", name
    )
    heads = F.explode(F.array(F.lit("GEO_ID"), F.lit("id"))).alias("geo_id")
    header = p.select("year").distinct().select(F.lit("B19083_001E").alias("value"), F.lit("B19083_001M").alias("margin"), heads, F.lit("NAME").alias("name"), name)
    path = shared_folder(spark, "index")
    rows.unionByName(header).write.partitionBy("file").csv(path)
    return files.read_inequality_files(spark, f"{path}/file=*.B19083_data*", glob="*.csv")


_INDEX_SQL = """ix AS (SELECT geoid, year, sum(CAST(round(ue * 1e9) AS BIGINT)) / count(ue) / 1e9 AS v
  FROM (SELECT geoid, year, ue FROM panel UNION ALL SELECT lpad(CAST(county AS VARCHAR), 5, '0'), year, ue FROM panel JOIN tracts ON tract = geom) a GROUP BY 1, 2)"""


@query("io2_yearly_index_files", with_ctes("panel tracts", f"WITH {_INDEX_SQL} SELECT geoid, year, {rnd('v')} AS i_gini FROM ix"))
def io2(spark, sf):
    return rounded(_index_files(spark, sf))


@query(
    "rt13_inequality_index_join",
    with_ctes("panel tracts", f"WITH {_INDEX_SQL} SELECT p.geoid, p.year, p.disease, p.n_rec, {rnd('v')} AS i_gini FROM panel p LEFT JOIN ix ON ix.geoid = p.geoid AND ix.year = p.year"),
)
def rt13(spark, sf):
    p = fx.panel(spark, sf).select("geoid", "year", "disease", "n_rec")
    return rounded(p.join(_index_files(spark, sf), ["geoid", "year"], "left"))


@query("io3_saved_table", f"SELECT c_custkey, c_nationkey, {rnd('c_acctbal')} AS c_acctbal FROM customer")
def io3(spark, sf):
    return rounded(files.read_table(spark, f"{sf}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal"))


@query(
    "io4_polygon_layers",
    with_ctes("parks", f"SELECT park_id, seq, {rnd('CASE WHEN seq IN (1, 2) THEN x1 ELSE x0 END')} AS x, {rnd('CASE WHEN seq IN (2, 3) THEN y1 ELSE y0 END')} AS y FROM parks, range(0, 5) r(seq)"),
)
def io4(spark, sf):
    from .areas import _park_vertices

    path = shared_folder(spark, "layers")
    both = _park_vertices(spark, sf, False).withColumnRenamed("park_id", "geom")
    layers = both.withColumn("layer", F.lit("parks")).unionByName(fx.tract_vertices(spark, sf).withColumn("layer", F.lit("tracts")))
    files.write_table(layers, path, ["layer"])
    v = files.read_polygons(spark, path, "parks")
    return rounded(v.select(F.col("geom").alias("park_id"), F.col("seq").cast("long").alias("seq"), "x", "y"))


def _courtyards(spark, sf):
    """The parks with a hole of half their width and height in the middle."""
    from .areas import _park_vertices

    shell = _park_vertices(spark, sf, False)
    p = fx.parks(spark, sf)
    mid = lambda a, b, w: (F.col(a) * (1 - w) + F.col(b) * w).alias(a)
    inner = p.select("park_id", mid("x0", "x1", 0.25), mid("y0", "y1", 0.25), mid("x1", "x0", 0.25), mid("y1", "y0", 0.25))
    return shell.unionByName(spatial.rectangles_to_vertices(inner, "park_id").withColumn("ring", F.lit(1)))


_YARDS_SQL = f"""SELECT park_id, CAST(0 AS BIGINT) AS part, g.ring, r.seq,
    {rnd('x0 + (x1 - x0) * CASE WHEN g.ring = 0 THEN b ELSE 0.25 + 0.5 * b END')} AS x, {rnd('y0 + (y1 - y0) * CASE WHEN g.ring = 0 THEN c ELSE 0.25 + 0.5 * c END')} AS y
    FROM parks, range(0, 2) g(ring), (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) r(seq, b, c)"""


def _vertex_rows(v):
    return rounded(v.select("park_id", *[F.col(c).cast("long").alias(c) for c in ("part", "ring", "seq")], "x", "y"))


@query("io4_geojson_polygons", with_ctes("parks", _YARDS_SQL))
def io4_geojson(spark, sf):
    """A layer with holes, written as a feature per line and read back."""
    path = shared_folder(spark, "shapes")
    files.polygon_shapes(_courtyards(spark, sf), "park_id").select(F.col("geojson").alias("value")).write.text(path)
    return _vertex_rows(files.read_geojson_polygons(spark, path, "park_id", "long", lines=True))


@query("io4_wkt_polygons", with_ctes("parks", _YARDS_SQL))
def io4_wkt(spark, sf):
    """The same layer from a table of well-known text."""
    path = shared_folder(spark, "wkt")
    files.write_table(files.polygon_shapes(_courtyards(spark, sf), "park_id").select("park_id", "wkt"), path)
    return _vertex_rows(files.read_wkt_polygons(files.read_table(spark, path), "wkt", "park_id"))


@query("io5_geojson_points", with_ctes("points facilities", f"SELECT facility_id, state, status, employees, {rnd('x')} AS x, {rnd('y')} AS y FROM facilities"))
def io5(spark, sf):
    """A folder of files with one feature per line."""
    path = shared_folder(spark, "points")
    fx.facilities(spark, sf).repartition(4, "facility_id").select(F.to_json(_feature()).alias("value")).write.text(path)
    return rounded(files.read_geojson_points(spark, path, FACILITY, lines=True))


FACILITY = "facility_id long, state string, status string, employees long"


def _feature():
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct("facility_id", "state", "status", "employees").alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"),
    )


@query("io5_geojson_collections", with_ctes("points facilities", f"SELECT facility_id, state, status, employees, {rnd('x')} AS x, {rnd('y')} AS y FROM facilities"))
def io5_collections(spark, sf):
    """A folder of feature collections, one for every 500 facilities."""
    path = shared_folder(spark, "collections")
    grouped = fx.facilities(spark, sf).groupBy(F.floor(F.col("facility_id") / 500).alias("name")).agg(F.collect_list(_feature()).alias("features"))
    body = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features"))
    pretty = F.replace(body, F.lit('},{"type":"Feature"'), F.lit('},\n{"type":"Feature"'))
    grouped.select("name", pretty.alias("value")).repartition("name").write.partitionBy("name").text(path)
    return rounded(files.read_geojson_points(spark, f"{path}/name=*", FACILITY))


TILE_ROWS = 100  # grid lines of one tile file


@query(
    "io6_ascii_grids",
    with_ctes(
        "raster",
        f"""SELECT geom % 10 + (k % 4) * CAST(0.25 AS DOUBLE) + CAST(0.125 AS DOUBLE) AS x, geom // 10 + (k // 4) * CAST(0.25 AS DOUBLE) + CAST(0.125 AS DOUBLE) AS y, year, {rnd('value')} AS value FROM raster""",
    ),
)
def io6(spark, sf):
    """Tiles of at most 100 lines by 40 columns, one file each."""
    r = fx.raster(spark, sf).select(
        "year", F.floor(F.col("x") / 0.25).alias("c"), F.floor(F.col("y") / 0.25).alias("line"), "value"
    )
    lines = r.groupBy("year", "line").agg(F.map_from_entries(F.collect_list(F.struct("c", "value"))).alias("m"))
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long")), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(-9999.0)).cast("string")))
    tile = F.floor(F.col("line") / TILE_ROWS)
    tiles = lines.groupBy("year", tile.alias("tile")).agg(
        F.sort_array(F.collect_list(F.struct(-F.col("line"), text.alias("t")))).alias("rows"), F.max("line").alias("top"), F.min("line").alias("low")
    )
    # a tract row without any record leaves a gap, so every line is written
    by_line = F.map_from_entries(F.transform("rows", lambda s: F.struct(-s["col1"], s["t"])))
    blank = F.lit(" ".join(["-9999.0"] * 40))
    body = F.array_join(F.transform(F.sequence("top", "low", F.lit(-1).cast("long")), lambda q: F.coalesce(F.try_element_at("_m", q), blank)), "\n")
    head = F.concat(
        F.lit("ncols 40\nnrows "), (F.col("top") - F.col("low") + 1).cast("string"), F.lit("\nxllcorner 0.0\nyllcorner "),
        (F.col("low") * 0.25).cast("string"), F.lit("\ncellsize 0.25\nNODATA_value -9999\n"),
    )
    path = shared_folder(spark, "grids")
    out = tiles.withColumn("_m", by_line).select(F.concat(head, body).alias("value"), F.concat_ws("_", "year", "tile").alias("name"))
    out.repartition("name").write.partitionBy("name").option("lineSep", "\n").text(path)
    cells = files.read_ascii_grids(spark, path, glob="*.txt")
    year = F.regexp_extract("file", r"name=(\d{4})_", 1).cast("int")
    return rounded(cells.where(F.col("value").isNotNull()).select("x", "y", year.alias("year"), "value"))


@query("io7_partitioned_table", with_ctes("panel", f"SELECT tract, disease, n_rec, {rnd('elder')} AS elder, year FROM panel WHERE year = 1999"))
def io7(spark, sf):
    path = shared_folder(spark, "panel")
    files.write_table(fx.panel(spark, sf).select("tract", "disease", "n_rec", "elder", "year"), path, ["year"])
    return rounded(files.read_table(spark, path).where(F.col("year") == 1999))


@query("io8_csv_export", with_ctes("panel", f"SELECT year, disease, count(*) AS n, {rnd('avg(elder)')} AS elder FROM panel GROUP BY 1, 2"))
def io8(spark, sf):
    path = shared_folder(spark, "export")
    small = fx.panel(spark, sf).groupBy("year", "disease").agg(F.count(F.lit(1)).alias("n"), F.avg("elder").alias("elder"))
    files.write_csv(small, path)
    return rounded(files.read_csv(spark, path, "year int, disease string, n long, elder double"))
