"""Geometry against brute force, structure matrices against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.operators import models, spatial, structure

SHAPES = {
    "concave": [[(0, 0), (4, 0), (4, 4), (2, 1.5), (0, 4)]],
    "clockwise": [[(5, 0), (5, 3), (9, 3), (7, 0.5)]],
    "holed": [[(0, 5), (6, 5), (6, 10), (0, 10)], [(1, 6), (3, 6), (3, 8), (1, 8)]],
    "sliver": [[(7, 4), (9.7, 9.9), (7.1, 9.5)]],
    "left": [[(-4, -4), (0, -4), (-1, 0), (-4, 0)]],
    "right": [[(0, -4), (3, -4), (3, 0), (-1, 0)]],
}


def vertex_table(spark, shapes):
    rows = []
    for g, rings in shapes.items():
        for r, ring in enumerate(rings):
            rows += [(g, 0, r, i, float(x), float(y)) for i, (x, y) in enumerate([*ring, ring[0]])]
    return spark.createDataFrame(rows, "geom string, part int, ring int, seq int, x double, y double")


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


@pytest.mark.parametrize("cell", [None, 0.37, 1.0, 25.0])
def test_points_against_brute_force(spark, cell):
    rng = np.random.default_rng(8)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-5, 11, size=(600, 2)))]
    d = spark.createDataFrame(pts, "id int, x double, y double")
    got = {(r["id"], r["geom"]) for r in spatial.point_in_polygon(d, vertex_table(spark, SHAPES), cell=cell).collect()}
    want = set()
    for i, x, y in pts:
        hits = [g for g, rings in SHAPES.items() if inside(rings, x, y)]
        want |= {(i, g) for g in hits} or {(i, None)}
    assert got == want


def test_border_points_fall_in_one_polygon(spark):
    # grid points on borders and corners of a 3x3 grid of squares
    squares = {f"s{a}{b}": [[(a, b), (a + 1, b), (a + 1, b + 1), (a, b + 1)]] for a in range(3) for b in range(3)}
    pts = [(i, x / 4, y / 4) for i, (x, y) in enumerate((x, y) for x in range(12) for y in range(12))]
    d = spark.createDataFrame(pts, "id int, x double, y double")
    for cell in (None, 0.3):
        got = {r["id"]: r["geom"] for r in spatial.point_in_polygon(d, vertex_table(spark, squares), cell=cell).collect()}
        assert got == {i: f"s{int(x)}{int(y)}" for i, x, y in pts}


def test_halving_stops_on_crowded_cells(spark):
    a = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    ring = [(float(np.cos(t)), float(np.sin(t))) for t in a]
    cells, size = spatial.polygon_cells(vertex_table(spark, {"disc": [ring]}), cell=4.0, max_edges=20)
    assert size < 4.0
    assert cells.agg(F.max(F.size("edges"))).first()[0] <= 20


def test_area_with_hole(spark):
    got = {r["geom"]: r["area"] for r in spatial.polygon_area(vertex_table(spark, SHAPES)).collect()}
    assert got["holed"] == 26.0 and got["clockwise"] == pytest.approx(8.0)


def test_overlay_against_monte_carlo_grid(spark):
    # the overlap with many narrow rectangles that tile the plane is the area itself,
    # and each single overlap matches a fine grid count
    v = vertex_table(spark, SHAPES)
    rects = spark.createDataFrame([(f"{a},{b}", a, b, a + 2.0, b + 2.0) for a in np.arange(-5.0, 11, 2).tolist() for b in np.arange(-5.0, 11, 2).tolist()], "r string, x0 double, y0 double, x1 double, y1 double")
    got = spatial.overlay_area(v, spatial.rectangles_to_vertices(rects, "r"), "geom", "r", cell=0.7).collect()
    total = {}
    for row in got:
        total[row["geom"]] = total.get(row["geom"], 0) + row["area"]
        a, b = map(float, row["r"].split(","))
        g = (np.arange(200) + 0.5) / 100
        n = sum(inside(SHAPES[row["geom"]], a + x, b + y) for x in g[::4] for y in g[::4])
        assert abs(row["area"] - n * 0.0016) < 0.05
    area = {r["geom"]: r["area"] for r in spatial.polygon_area(v).collect()}
    assert all(total[g] == pytest.approx(area[g], abs=1e-9) for g in SHAPES)


def test_zonal_mean_uses_partial_cells(spark):
    v = vertex_table(spark, {"z": [[(0.5, 0), (2, 0), (2, 1), (0.5, 1)]]})
    cells = spark.createDataFrame([(0.5, 0.5, 10.0), (1.5, 0.5, 40.0)], "x double, y double, value double")
    get = lambda s: spatial.zonal_statistic(cells, v, 1.0, stat=s).first()["value"]
    assert get("mean") == pytest.approx(30.0) and get("sum") == pytest.approx(45.0) and get("max") == 40.0


def grid_graph(spark, side=5):
    squares = {f"{b * side + a:02d}": [[(a, b), (a + 1, b), (a + 1, b + 1), (a, b + 1)]] for a in range(side) for b in range(side)}
    e = spatial.contiguity(vertex_table(spark, squares), snap=0.005)
    return e.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


def dense(df, n, m=None):
    out = np.zeros((n, m or n))
    for r in df.collect():
        out[r["i"], r["j"]] += r["v"]
    return out


def test_interaction_matrices(spark):
    edges = grid_graph(spark)
    assert edges.count() == 144
    lap = structure.laplacian(edges)
    n, t = 25, 7
    L = dense(lap, n)
    R = models.rw1_matrix(t)
    assert np.array_equal(dense(structure.rw1(spark, t), t), R)
    assert np.allclose(L.sum(axis=1), 0)
    want = {"I": np.eye(n * t), "II": np.kron(R, np.eye(n)), "III": np.kron(np.eye(t), L), "IV": np.kron(R, L)}
    for kind, nnz, rank_loss in (("I", 175, 0), ("II", 475, 25), ("III", 1183, 7), ("IV", 3211, 31)):
        m, deficiency = structure.interaction(kind, lap, n, t)
        assert (m.count(), deficiency) == (nnz, rank_loss)
        assert np.array_equal(dense(m, n * t), want[kind])
    assert np.array_equal(dense(structure.kron(structure.rw1(spark, t), lap, n, n), n * t), want["IV"])
    a = dense(structure.constraints(spark, "IV", n, t), n - 1 + t, n * t)
    assert np.allclose(a @ want["IV"], 0) and np.linalg.matrix_rank(a) == n - 1 + t


def test_smoothers_match_dense_solutions(spark):
    rng = np.random.default_rng(11)
    side, t = 3, 3
    n = side * side
    edges = grid_graph(spark, side)
    L, R = dense(structure.laplacian(edges), n), models.rw1_matrix(t)
    y, w = rng.normal(size=(t, n)), rng.uniform(0.5, 2, size=(t, n))
    rows = [(k, i, float(y[k, i]), float(w[k, i]), 1.0) for k in range(t) for i in range(n)]
    d = spark.createDataFrame(rows, "year int, area long, y double, w double, one double")
    s = models.smooth_areas(d, edges, "w", "y", 3.0)
    want = np.linalg.solve(np.diag(w.sum(axis=0)) + 3.0 * L, (w * y).sum(axis=0))
    assert s.residual < 1e-8
    assert np.allclose([r["x0"] for r in s.values.orderBy("area").collect()], want, atol=1e-6)

    big = {"I": np.eye(n * t), "II": np.kron(R, np.eye(n)), "III": np.kron(np.eye(t), L), "IV": np.kron(R, L)}
    for kind, weight in (("I", "w"), ("II", "w"), ("III", "w"), ("IV", "one"), ("IV", "w")):
        ww = w if weight == "w" else np.ones_like(w)
        s = models.smooth_interaction(d, edges, kind, weight, "y", 1.0, range(t))
        want = np.linalg.solve(np.diag(ww.ravel()) + big[kind], (ww * y).ravel()).reshape(t, n)
        got = np.array([[r[f"x{k}"] for k in range(t)] for r in s.values.orderBy("area").collect()]).T
        assert np.allclose(got, want, atol=1e-6), kind


def test_projection_round_trip(spark):
    pts = [(-123.9, 46.1), (-120.5, 41.75), (-117.1, 42.0)]
    d = spark.createDataFrame(pts, "lon double, lat double")
    x, y = spatial.lonlat_to_lambert(F.col("lon"), F.col("lat"))
    there = d.select("lon", "lat", x.alias("x"), y.alias("y"))
    lo, la = spatial.lambert_to_lonlat(F.col("x"), F.col("y"))
    for r in there.select("*", lo.alias("lo"), la.alias("la")).collect():
        assert abs(r["lo"] - r["lon"]) < 1e-9 and abs(r["la"] - r["lat"]) < 1e-9
        if r["lat"] == 41.75:  # the origin has the false easting (400 km) and no northing
            assert abs(r["x"] * 0.3048 - 400000) < 1e-4 and abs(r["y"]) < 1e-3


def test_albers_keeps_area(spark):
    # a small square in degrees: projected area equals the ellipsoidal area
    c = [(-120.0, 44.0), (-119.99, 44.0), (-119.99, 44.01), (-120.0, 44.01)]
    d = spark.createDataFrame(c, "lon double, lat double")
    x, y = spatial.lonlat_to_albers(F.col("lon"), F.col("lat"))
    p = [(r["x"], r["y"]) for r in d.select(x.alias("x"), y.alias("y")).collect()]
    shoelace = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2
    q = lambda s: spatial._q_const(np.radians(s))
    true = spatial.GRS80_A**2 / 2 * np.radians(0.01) * (q(44.01) - q(44.0))
    assert shoelace == pytest.approx(true, rel=1e-6)


def disc(n, radius=1.0):
    a = np.linspace(0, 2 * np.pi, n, endpoint=False)
    return [(float(radius * np.cos(t)), float(radius * np.sin(t))) for t in a]


def test_cells_grow_with_the_edges(spark):
    n = [spatial.polygon_cells(vertex_table(spark, {"d": [disc(k)]}))[0].count() for k in (500, 1000, 2000, 4000)]
    assert all(b <= 2.3 * a for a, b in zip(n, n[1:])) and n[-1] < 4 * 4000


def test_points_in_detailed_polygons(spark):
    rng = np.random.default_rng(9)
    shapes = {"d": [disc(700)], "wavy": [[((3 + (1 + 0.2 * np.sin(31 * t)) * np.cos(t)), (1 + 0.2 * np.sin(31 * t)) * np.sin(t)) for t in np.linspace(0, 2 * np.pi, 900, endpoint=False)]]}
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform((-1.3, -1.3), (4.4, 1.3), size=(500, 2)))]
    d = spark.createDataFrame(pts, "id int, x double, y double")
    got = {(r["id"], r["geom"]) for r in spatial.point_in_polygon(d, vertex_table(spark, shapes)).collect()}
    want = set()
    for i, x, y in pts:
        hits = [g for g, rings in shapes.items() if inside(rings, x, y)]
        want |= {(i, g) for g in hits} or {(i, None)}
    assert got == want


@pytest.mark.parametrize("scale,shift", [(1.0, (-2e6, 2.5e6)), (1e-5, (-120.0, 44.0))])
def test_triangles_that_only_share_a_box_do_not_overlap(spark, scale, shift):
    def triangle(x, y, leg):
        return [[(shift[0] + scale * a, shift[1] + scale * b) for a, b in ((x, y), (x + leg, y), (x, y + leg))]]

    rng = np.random.default_rng(4)
    left = {f"l{i}": (int(x), int(y), 3000) for i, (x, y) in enumerate(rng.integers(0, 60, (60, 2)) * 500)}
    right = {f"r{i}": (int(x), int(y), 1500) for i, (x, y) in enumerate(rng.integers(0, 60, (60, 2)) * 500)}
    tables = [vertex_table(spark, {k: triangle(*v) for k, v in t.items()}) for t in (left, right)]
    got = {(r["a"], r["b"]): r["area"] for r in spatial.overlay_area(tables[0].withColumnRenamed("geom", "a"), tables[1].withColumnRenamed("geom", "b"), "a", "b").collect()}
    want = {}
    for a, (x1, y1, l1) in left.items():
        for b, (x2, y2, l2) in right.items():
            side = min(x1 + y1 + l1, x2 + y2 + l2) - max(x1, x2) - max(y1, y2)
            if side > 0:
                want[a, b] = side * side / 2 * scale * scale
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, rel=1e-6) for k, v in want.items())


@pytest.mark.parametrize("seqs", [[0, 10, 20, 30, 40], [0, 1, 1, 2, 3], [0, 1, 2, 3]])
def test_unsound_rings_raise(spark, seqs):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    rows = [("s", 0, 0, q, x, y) for q, (x, y) in zip(seqs, square)]
    v = spark.createDataFrame(rows, "geom string, part int, ring int, seq int, x double, y double")
    with pytest.raises(Exception, match="ring with gaps or without end"):
        spatial.polygon_area(v).collect()


def test_zonal_rows_for_polygons_without_cells(spark):
    v = vertex_table(spark, {"a": [[(0, 0), (1, 0), (1, 1), (0, 1)]], "b": [[(5, 5), (6, 5), (6, 6), (5, 6)]]})
    cells = spark.createDataFrame([(0.5, 0.5, y, float(y)) for y in (2000, 2001)], "x double, y double, year int, value double")
    got = {(r["geom"], r["year"]): r["value"] for r in spatial.zonal_statistic(cells, v, 1.0, by=["year"]).collect()}
    assert got == {("a", 2000): 2000.0, ("a", 2001): 2001.0, ("b", 2000): None, ("b", 2001): None}


def test_solver_says_when_it_stops_early(spark):
    edges = grid_graph(spark, 5)
    d = spark.createDataFrame([(i, float(i % 7), 1.0) for i in range(25)], "area long, y double, w double")
    with pytest.raises(RuntimeError, match="not converged"):
        models.smooth_areas(d, edges, "w", "y", 50.0, tol=1e-12, max_iter=2)
    done = models.smooth_areas(d, edges, "w", "y", 50.0).reported().first()
    assert done["converged"] and done["residual"] <= 1e-8 and done["iterations"] > 2
    late = spark.createDataFrame([(0, 2000, 1.0, 1.0), (0, 2005, 1.0, 1.0)], "area long, year int, y double, w double")
    with pytest.raises(Exception, match="a year that is not listed"):
        models.smooth_interaction(late, edges, "I", "w", "y", 1.0, [2000, 2001]).values.collect()


def test_year_walk_keeps_gaps(spark):
    d = spark.createDataFrame([(2000, 1.0, 1.0), (2001, 2.0, 1.0), (2004, 8.0, 1.0)], "year int, y double, w double")
    x = models.smooth_years(d, "w", "y", 0.5)
    w = np.array([1.0, 1, 0, 0, 1])
    want = np.linalg.solve(np.diag(w) + 0.5 * models.rw1_matrix(5), w * np.array([1.0, 2, 0, 0, 8]))
    assert list(x) == list(range(2000, 2005)) and np.allclose(list(x.values()), want)


def test_family_of_models_nests(spark):
    rng = np.random.default_rng(6)
    edges = grid_graph(spark, 3)
    rows = [(i, y, float(rng.normal() + i + y - 2000), float(rng.normal())) for i in range(9) for y in (2000, 2001, 2002)]
    panel = spark.createDataFrame(rows, "area long, year int, y double, x double")
    family = [models.ModelSpec("base"), models.ModelSpec("slope", area_slope=True), models.ModelSpec("all", True, True, "I")]
    fits = models.FamilyFit(panel, edges, "y", "x", ["x"], dict.fromkeys(("area", "year", "area_slope", "year_slope", "interaction"), 0.5), [2000, 2001, 2002])
    got = {r["model"]: r for r in models.compare_models(fits, family).collect()}
    assert all(r["n"] == 27 and r["rmse"] == pytest.approx((r["rss"] / 27) ** 0.5) for r in got.values())
    assert got["base"]["rss"] > got["slope"]["rss"] > got["all"]["rss"]


def test_index_of_rows_with_missing_values(spark):
    rows = [(1.0, 5.0), (2.0, None), (3.0, 9.0), (None, 7.0), (7.0, 1.0)]
    d = spark.createDataFrame(rows, "a double, b double")
    x = np.array([[np.nan if v is None else v for v in r] for r in rows])
    x = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    z = (x - x.mean(0)) / x.std(0)
    r = (z[:, 0] * z[:, 1]).mean()
    want = (z[:, 0] + np.sign(r) * z[:, 1]) / np.sqrt(2)
    got = [row["SES"] for row in models.composite_index(d, ["a", "b"]).collect()]
    assert np.allclose(got, want)
    dropped = models.principal_components(d, ["a", "b"], missing="drop")
    assert dropped.mean == pytest.approx([11 / 3, 5.0])


def test_disc_over_squares_meets_few_edges(spark):
    """Pairs of edges grow with border cells, not with edges times squares."""
    turn = 2 * np.pi * np.arange(10_001) / 10_000
    ring = [(10 + 8.3 * np.cos(t), 10 + 8.3 * np.sin(t)) for t in turn[:-1]]
    disc = vertex_table(spark, {"d": [ring + ring[:1]]}).withColumnRenamed("geom", "a")
    side = spark.range(1000).select(F.col("id").alias("b"), (F.col("id") % 32 * 0.625).alias("x0"), (F.floor(F.col("id") / 32) * 0.625).alias("y0"))
    squares = spatial.rectangles_to_vertices(side.select("b", "x0", "y0", (F.col("x0") + 0.625).alias("x1"), (F.col("y0") + 0.625).alias("y1")), "b")
    got = {r["b"]: r["area"] for r in spatial.overlay_area(disc, squares, "a", "b").collect()}
    x, y = (np.array([v[k] for v in ring]) for k in (0, 1))
    whole = abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2
    inside = [b for b in range(1000) if all((b % 32 * 0.625 + i - 10) ** 2 + (b // 32 * 0.625 + j - 10) ** 2 < 8.29**2 for i in (0, 0.625) for j in (0, 0.625))]
    assert len(inside) > 400 and all(got[b] == pytest.approx(0.625**2, rel=1e-12) for b in inside)
    assert sum(got.values()) == pytest.approx(whole, rel=1e-10)
    cells = spatial.covered_cells(spatial.stored_edges(disc, "a"), 0.625, "a")
    border, pieces = cells.where("pieces IS NOT NULL").agg(F.count(F.lit(1)), F.sum("n")).first()
    assert border < 130 and pieces < 10_000 + 4 * border


def test_edges_are_neither_sent_whole_nor_sorted_by_ring(spark, tmp_path):
    # a file of a few bytes stands for many vertices: its size doesn't tell
    spark.range(2000).write.parquet(str(tmp_path / "part"))
    k = F.col("id")
    rects = spark.read.parquet(str(tmp_path / "part")).select(k.alias("geom"), k.alias("x0"), k.alias("y0"), (k + 2).alias("x1"), (k + 3).alias("y1"))
    edges = spatial.polygon_edges(spatial.rectangles_to_vertices(rects, "geom"))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortAggregate" not in plan
    assert spatial.polygon_area(spatial.rectangles_to_vertices(rects, "geom")).where("area = 6").count() == 2000
