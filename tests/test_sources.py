"""Readers on files that are not as tidy as the fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from arealis.sources import files

PROPS = "id long, name string"


def feature(i, name="n"):
    return {"type": "Feature", "properties": {"id": i, "name": name}, "geometry": {"type": "Point", "coordinates": [i, -i]}}


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_folder_of_line_files_keeps_every_feature(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}.json").write_text("\n".join(json.dumps(feature(10 * k + i, "} {")) for i in range(5)) + "\n\n")
    got = files.read_geojson_points(spark, str(tmp_path), PROPS, lines=True)
    assert ids(got) == [10 * k + i for k in range(3) for i in range(5)]
    with pytest.raises(Exception, match="not one GeoJSON document in a file"):
        files.read_geojson_points(spark, str(tmp_path), PROPS).collect()


def test_folder_of_collections(spark, tmp_path):
    for k in range(2):
        doc = {"type": "FeatureCollection", "features": [feature(10 * k + i, "a } { b \\\"") for i in range(4)]}
        (tmp_path / f"{k}.geojson").write_text(json.dumps(doc, indent=1))
    (tmp_path / "one.geojson").write_text(json.dumps(feature(99), indent=2))
    got = files.read_geojson_points(spark, str(tmp_path), PROPS)
    assert ids(got) == [0, 1, 2, 3, 10, 11, 12, 13, 99]
    assert got.where("id = 13").first()["y"] == -13.0
    with pytest.raises(Exception, match="not one GeoJSON document in a line"):
        files.read_geojson_points(spark, str(tmp_path), PROPS, lines=True).collect()


def test_index_files_of_any_geography(spark, tmp_path):
    rows = ["B19083_001E,B19083_001M,GEO_ID,NAME", "Estimate,Margin,id,Geography", "0.4,0.1,1400000US41001000100,Tract", "0.5,0.1,0500000US41001,County", "-,0.1,0400000US41,State"]
    (tmp_path / "ACSDT5Y2012.B19083_data.csv").write_text("\n".join(rows))
    got = {(r["geoid"], r["year"], r["i_gini"]) for r in files.read_inequality_files(spark, str(tmp_path)).collect()}
    assert got == {("41001000100", 2012, 0.4), ("41001", 2012, 0.5), ("41", 2012, None)}


def test_one_grid_is_read_by_several_tasks(spark, tmp_path):
    head = "ncols 3\nnrows 400\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -1\n"
    body = "\r\n".join(f"{r} {r + 0.5} {-1 if r % 2 else r}" for r in range(400))
    for year in (2001, 2002, 2003):
        (tmp_path / f"g{year}.asc").write_text(head + body + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        cells = files.read_ascii_grids(spark, str(tmp_path), skip_last=True).withColumn("row_task", F.spark_partition_id()).collect()
        raw = spark.read.text(str(tmp_path / "g2001.asc"))
        assert raw.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(cells) == 2 * 400 * 3
    for c in cells:
        value = [c["row"], c["row"] + 0.5, None if c["row"] % 2 else c["row"]][c["col"]]
        assert c["value"] == value and c["x"] == 10 + 2 * (c["col"] + 0.5) and c["y"] == 20 + 2 * (400 - c["row"] - 0.5)


SHAPES = [
    ("a", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 1 1))"),
    ("b", "multipolygon(((0 0,1 0,1 1,0 0)),((5.5 -1e1,6 0,6 1,5.5 -1e1),(5.6 -1, 5.7 0, 5.8 0, 5.6 -1)))"),
    ("c", "POLYGON Z ((0 0 7, 1 0 7, 1 1 7, 0 0 7))"),
    ("d", "POLYGON EMPTY"),
    ("e", None),
]


def test_polygons_from_text_and_features(spark, tmp_path):
    df = spark.createDataFrame(SHAPES, "geom string, shape string")
    v = files.read_wkt_polygons(df.where("geom != 'e'"), "shape")
    got = sorted(tuple(r) for r in v.collect())
    assert [r[:4] for r in got if r[0] == "a"] == [("a", 0, 0, k) for k in range(5)] + [("a", 0, 1, k) for k in range(4)]
    assert ("b", 1, 0, 0, 5.5, -10.0) in got and ("b", 1, 1, 2, 5.8, 0.0) in got and ("c", 0, 0, 1, 1.0, 0.0) in got
    assert not [r for r in got if r[0] == "d"]
    shapes = files.polygon_shapes(v)
    again = files.read_wkt_polygons(shapes.select("geom", "wkt"), "wkt")
    assert sorted(tuple(r) for r in again.collect()) == got
    shapes.select("geojson").withColumnRenamed("geojson", "value").write.text(str(tmp_path / "lines"))
    lines = files.read_geojson_polygons(spark, str(tmp_path / "lines"), lines=True)
    assert sorted(tuple(r) for r in lines.collect()) == got
    features = ",\n".join(r["geojson"] for r in shapes.collect())
    single = '{"type":"Feature","properties":{"geom":"p"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}'
    none = '{"type":"Feature","properties":{"geom":"q"},"geometry":null}'
    (tmp_path / "all.json").write_text('{"type":"FeatureCollection","features":[' + f"{features},{single},{none}]}}")
    whole = files.read_geojson_polygons(spark, str(tmp_path / "all.json"))
    assert sorted(tuple(r) for r in whole.where("geom != 'p'").collect()) == got
    assert whole.where("geom = 'p'").count() == 4


def test_other_shapes_raise(spark):
    with pytest.raises(Exception, match="not a polygon"):
        files.read_wkt_polygons(spark.createDataFrame([("x", "LINESTRING (0 0, 1 1)")], "geom string, shape string"), "shape").collect()
