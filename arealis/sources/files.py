"""Readers and writers for the formats a study brings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import reliable_checkpoint


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header, typed by the given schema, columns picked by name."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*columns) if columns else df


# Ids of any geography: a seven-digit summary level and part, then the code.
AREA_ID = r"^\d{7}US(.*)$"


def read_inequality_files(spark: SparkSession, folder: str, glob: str = "*.B19083_data*.csv") -> DataFrame:
    """Yearly index files of any geography to (geoid, year, value).

    The files have two header lines, no usable names and the year in the file
    name (``...5Y2010...``). Header lines are those without an area id.
    """
    raw = (
        spark.read.schema("value string, margin string, geo_id string, name string")
        .option("pathGlobFilter", glob)
        .option("header", False)
        .csv(folder)
    )
    year = F.regexp_extract("_metadata.file_path", r"5Y(\d{4})", 1)
    return raw.where(F.col("geo_id").rlike(AREA_ID)).select(
        F.regexp_extract("geo_id", AREA_ID, 1).alias("geoid"),
        year.try_cast("int").alias("year"),
        F.col("value").try_cast("double").alias("i_gini"),
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A saved table."""
    return spark.read.parquet(path)


def read_polygons(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """Polygon layer as a vertex table (geom, part, ring, seq, x, y).

    Several layers may share a folder when written with ``partitionBy('layer')``;
    naming one prunes the others.
    """
    df = spark.read.parquet(path)
    if layer is not None:
        df = df.where(F.col("layer") == layer).drop("layer")
    return df


# JSON text without what its strings hold, and the seam of two documents.
JSON_STRING = r'"(?:[^"\\]|\\.)*+"'
JSON_SEAM = r"\}\s*\{"


def _geojson_features(spark: SparkSession, path: str, properties: str, coordinates: str, lines: bool) -> DataFrame:
    """Features ``f`` of documents with their properties and geometry; what isn't a
    document of the stated kind raises instead of losing features."""
    feature = f"properties:struct<{_as_struct(properties)}>,geometry:struct<type:string,coordinates:{coordinates}>"
    schema = f"type string, {feature.replace('properties:', 'properties ').replace(',geometry:', ', geometry ')}, features array<struct<{feature}>>"
    text = spark.read.text(path, wholetext=not lines).where(F.trim("value") != "")
    doc = text.select("value", F.from_json("value", schema).alias("d"))
    sound = F.col("d.type").isNotNull()
    if not lines:
        sound = sound & ~F.regexp_replace("value", JSON_STRING, "").rlike(JSON_SEAM)
    wrong = F.concat(F.lit(f"not one GeoJSON document in a {'line' if lines else 'file'}: "), F.substring("value", 1, 60))
    doc = doc.select(F.when(sound, F.col("d")).otherwise(F.raise_error(wrong)).alias("d")).select("d.*")
    one = F.array(F.struct("properties", "geometry"))
    return doc.select(F.explode(F.when(F.col("features").isNotNull(), F.col("features")).otherwise(one)).alias("f"))


def read_geojson_points(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """Point features with the listed properties (a DDL string) and x, y.

    ``path`` is a file or a folder of files. By default a file is one document, a
    feature collection or a single feature. With ``lines`` every line is one; Spark
    then splits files, so it is the form to use for large layers. A file of the
    other kind, or text that isn't JSON, raises instead of losing features.
    """
    return _geojson_features(spark, path, properties, "array<double>", lines).select(
        "f.properties.*",
        F.try_element_at("f.geometry.coordinates", F.lit(1)).alias("x"),
        F.try_element_at("f.geometry.coordinates", F.lit(2)).alias("y"),
    )


def read_geojson_polygons(spark: SparkSession, path: str, geom: str = "geom", kind: str = "string", lines: bool = False) -> DataFrame:
    """Polygon and multipolygon features as a vertex table (geom, part, ring, seq, x, y).

    ``geom`` is the property that names a polygon. Documents are as for points. A
    feature without geometry has no vertices; one of another kind raises.
    """
    f = _geojson_features(spark, path, f"{geom} {kind}", "string", lines)
    return _vertices(f.select(F.col(f"f.properties.{geom}").alias(geom), F.col("f.geometry.type").alias("_t"), F.col("f.geometry.coordinates").alias("_c")), geom)


def read_wkt_polygons(df: DataFrame, wkt: str, geom: str = "geom") -> DataFrame:
    """The same vertex table from a column of well-known text (POLYGON, MULTIPOLYGON).

    Further ordinates of a point are left out; EMPTY and null have no vertices.
    """
    number = r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"
    text = F.trim(wkt)
    body = F.regexp_extract(text, r"(?s)^\w+\s*(?:Z|M|ZM)?\s*(\(.*\))$", 1)
    points = F.regexp_replace(body, rf"({number})\s+({number})(?:\s+{number})*", "[$1,$2]")
    coordinates = F.when(F.upper(text).endswith("EMPTY"), F.lit(None)).otherwise(F.translate(points, "()", "[]"))
    named = F.upper(F.regexp_extract(text, r"^(\w+)", 1))
    name = F.when(named == "POLYGON", "Polygon").when(named == "MULTIPOLYGON", "MultiPolygon").otherwise(named)
    return _vertices(df.select(geom, name.alias("_t"), coordinates.alias("_c")), geom)


def _vertices(shapes: DataFrame, geom: str) -> DataFrame:
    """Vertices of shapes (geom, _t type, _c coordinates as JSON text)."""
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    parts = (
        F.when(F.col("_c").isNull(), F.lit(None).cast(many))
        .when(F.col("_t") == "Polygon", F.array(F.from_json("_c", one)))
        .when(F.col("_t") == "MultiPolygon", F.from_json("_c", many))
        .otherwise(F.raise_error(F.concat(F.lit("not a polygon: "), F.coalesce("_t", F.lit("NULL")))))
    )
    d = shapes.select(geom, F.posexplode(parts).alias("part", "_rings"))
    d = d.select(geom, "part", F.posexplode("_rings").alias("ring", "_points"))
    d = d.select(geom, "part", "ring", F.posexplode("_points").alias("seq", "_p"))
    return d.select(geom, "part", "ring", "seq", F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"))


def polygon_shapes(vertices: DataFrame, geom: str = "geom") -> DataFrame:
    """(geom, wkt, geojson): every polygon as multipolygon text and as one feature, so a
    layer can be written line by line with Spark's text writer."""
    rings = vertices.groupBy(geom, "part", "ring").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))).alias("p")
    )
    parts = rings.groupBy(geom, "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", "p"))), lambda r: r["p"]).alias("rings"))
    whole = parts.groupBy(geom).agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "rings"))), lambda r: r["rings"]).alias("c"))
    joined = lambda a: F.concat(F.lit("("), F.array_join(a, ", "), F.lit(")"))
    point = lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string"))
    wkt = joined(F.transform("c", lambda part: joined(F.transform(part, lambda ring: joined(F.transform(ring, point))))))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col(geom)).alias("properties"),
        F.struct(F.lit("MultiPolygon").alias("type"), F.col("c").alias("coordinates")).alias("geometry"),
    )
    return whole.select(geom, F.concat(F.lit("MULTIPOLYGON "), wkt).alias("wkt"), F.to_json(feature).alias("geojson"))


def _as_struct(ddl: str) -> str:
    return ", ".join(":".join(p.strip().split(None, 1)) for p in ddl.split(","))


def read_ascii_grids(spark: SparkSession, folder: str, skip_last: bool = False, glob: str = "*.asc") -> DataFrame:
    """ASCII-grid rasters of a folder as (file, row, col, x, y, value).

    x and y are cell centres; the no-data value becomes NULL. The format has no
    row numbers: a file is split by Spark into blocks of lines, lines are numbered
    inside their block, and a small table says how many lines of the file come
    before it. The numbered lines are stored, so that a lost executor cannot number
    them otherwise. Header lines begin with a letter; blank lines may only follow
    the last row.
    """
    lines = (
        spark.read.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .text(folder)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("id"),
            F.trim(F.regexp_replace("value", r"\r$", "")).alias("text"),
        )
    )
    if skip_last:
        last = lines.agg(F.max("file")).scalar()
        lines = lines.where(F.col("file") < last)
    lines = reliable_checkpoint(lines)
    is_head = F.col("text").rlike("^[A-Za-z]")

    def header(key: str):
        found = F.max(F.when(F.lower("text").startswith(key), F.col("text")))
        return F.get(F.split(found, r"\s+"), F.lit(1)).try_cast("double").alias(key)

    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    heads = lines.where(is_head).groupBy("file").agg(
        *[header(k) for k in ("xllcorner", "yllcorner", "cellsize", "nrows", "nodata")], F.count(F.lit(1)).alias("heads")
    )
    grid = (
        lines.where(~is_head & (F.col("text") != ""))
        .join(blocks, ["file", "block"])
        .join(heads, "file")
        .select(
            "file", F.col("xllcorner").alias("x0"), F.col("yllcorner").alias("y0"), F.col("cellsize").alias("size"), "nrows", "nodata",
            (F.col("id") + F.col("shift") - F.col("heads")).cast("int").alias("row"), "text",
        )
    )
    cells = grid.select("*", F.posexplode(F.split("text", r"\s+")).alias("col", "v"))
    value = F.col("v").try_cast("double")
    return cells.select(
        "file",
        "row",
        "col",
        (F.col("x0") + (F.col("col") + 0.5) * F.col("size")).alias("x"),
        (F.col("y0") + (F.col("nrows") - F.col("row") - 0.5) * F.col("size")).alias("y"),
        F.when(value != F.col("nodata"), value).when(F.col("nodata").isNull(), value).alias("value"),
    )


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), compression: str = "zstd") -> None:
    """Compressed columnar table, optionally split by year (or layer)."""
    df.write.mode("overwrite").option("compression", compression).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Small result tables as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
