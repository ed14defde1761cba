"""Polygons, points and rasters as plain tables.

A polygon layer is a vertex table ``(geom, part, ring, seq, x, y)`` of closed
rings; ring 0 of a part is its shell, further rings are holes. All spatial work
is equi-joins on grid keys:

* ``point_in_polygon`` cuts every boundary into grid cells once. A cell then
  knows the few edges that run through it and, for each polygon, whether its
  lower edge line is inside. A point meets only the rows of its own cell, so
  points are never paired with whole polygons.
* ``overlay_area`` meets two layers in the cells of one grid: a cell inside a polygon
  counts whole, and only in cells where both have a border do edges meet, in closed form. It
  is exact for any simple polygons, with holes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import clamp_zero, per_unit, ratio, strict_sum
from .ranks import reliable_checkpoint

RING = ("part", "ring")


def polygon_edges(vertices: DataFrame, geom: str = "geom") -> DataFrame:
    """One row per directed edge ``(geom, part, ring, x1, y1, x2, y2)``.

    The successor of a vertex is found by a join on ``seq + 1``, so a ring with a
    third of all vertices is spread over all tasks. A ring whose numbers have gaps
    or repeat, or that does not end where it begins, raises. A table of edges is
    returned as it is, so every operator takes a layer either way.
    """
    if "x1" in vertices.columns:
        return vertices
    v = vertices.select(geom, *RING, "seq", F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"))
    nxt = v.select(
        geom, *RING, (F.col("seq") - 1).alias("seq"), F.col("x1").alias("x2"), F.col("y1").alias("y2")
    )
    # vertices made in a query are many more bytes than the file they come from: not to be sent whole
    edges = v.join(nxt.hint("merge"), [geom, *RING, "seq"]).select(geom, *RING, "x1", "y1", "x2", "y2")
    return edges.unionByName(_unsound_rings(vertices, geom))


def stored_edges(vertices: DataFrame, geom: str = "geom") -> DataFrame:
    """The edges of a layer, built and checked once for all operators that need them."""
    return vertices if "x1" in vertices.columns else reliable_checkpoint(polygon_edges(vertices, geom))


def _unsound_rings(vertices: DataFrame, geom: str) -> DataFrame:
    """No rows, or an error: one aggregate over the vertices of every ring."""
    # x and y by themselves, so that rings are hashed rather than sorted
    rings = vertices.groupBy(geom, *RING).agg(
        F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_a"), F.max("seq").alias("_b"),
        *[f(c, "seq").alias(f"_{c}{k}") for c in ("x", "y") for k, f in enumerate((F.min_by, F.max_by))],
    )
    closed = F.col("_x0").eqNullSafe(F.col("_x1")) & F.col("_y0").eqNullSafe(F.col("_y1"))
    sound = (F.col("_n") == F.col("_b") - F.col("_a") + 1) & (F.col("_n") > 1) & closed
    message = F.concat(F.lit("ring with gaps or without end: "), F.to_json(F.struct(geom, *RING)))
    bad = F.when(sound, F.lit(None)).otherwise(F.raise_error(message)).cast("double")
    return rings.select(geom, *RING, *[bad.alias(c) for c in ("x1", "y1", "x2", "y2")]).where(F.col("x1").isNotNull())


def ring_areas(edges: DataFrame, geom: str = "geom") -> DataFrame:
    """Signed shoelace area per ring, positive when counter-clockwise."""
    return edges.groupBy(geom, *RING).agg(
        (F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("signed_area")
    )


def polygon_area(vertices: DataFrame, geom: str = "geom", unit: float = 1.0, name: str = "area") -> DataFrame:
    """Area per polygon: shells minus holes, divided by ``unit``."""
    size = F.abs("signed_area")
    return (
        ring_areas(polygon_edges(vertices, geom), geom)
        .groupBy(geom)
        .agg((F.sum(F.when(F.col("ring") == 0, size).otherwise(-size)) / F.lit(float(unit))).alias(name))
    )


# ---------------------------------------------------------------- point in polygon


def _upright(edges: DataFrame, geom: str) -> DataFrame:
    """Edges ordered left to right (upward if vertical).

    Both polygons along a shared border then compute with the same numbers, so a
    point next to it cannot fall in both or in neither.
    """
    swap = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return edges.select(
        geom, pick("x1", "x2").alias("xl"), pick("y1", "y2").alias("yl"), pick("x2", "x1").alias("xr"), pick("y2", "y1").alias("yr")
    )


def _side(e: Column, x: Column, y: Column) -> Column:
    return (e["xr"] - e["xl"]) * (y - e["yl"]) - (e["yr"] - e["yl"]) * (x - e["xl"])


def _edge_above(e: Column, x: Column, y: Column) -> Column:
    """The edge passes above a spot just right of and above (x, y)."""
    s = _side(e, x, y)
    return (s < 0) | ((s == 0) & (e["yr"] > e["yl"]))


def _edge_right(e: Column, x: Column, y: Column) -> Column:
    """The edge passes right of a spot just right of and above (x, y)."""
    s = _side(e, x, y)
    return (
        F.when(e["xl"] == e["xr"], x < e["xl"]).when(e["yr"] > e["yl"], s > 0).otherwise(s < 0)
    )


def grid_size(edges: DataFrame, geom: str = "geom") -> float:
    """Cell size of a layer: the mean edge length, or the side of the square that
    an edge has to itself where that is more. The cells that cover the layer are
    then at most about as many as its edges, whatever the detail of its borders.
    """
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    area = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
    rings = edges.groupBy(geom, *RING).agg(area.alias("_a"), F.sum(length).alias("_l"), F.count(F.lit(1)).alias("_n"))
    a, l, n = rings.agg(F.sum(F.abs("_a")), F.sum("_l"), F.sum("_n")).first()
    return max(l / n, math.sqrt(a / n)) or 1.0 if n else 1.0


def polygon_cells(vertices: DataFrame, cell: float | None = None, geom: str = "geom", max_edges: int = 4096) -> tuple[DataFrame, float]:
    """Grid cells of every polygon: ``(geom, cx, cy, inside, edges)``.

    ``inside`` is the parity of the cell's lower line right of the cell, the
    ``edges`` array holds the edges that run through the cell (empty for cells in
    the interior). The cell size is that of ``grid_size`` unless given, and is
    halved while some cell of one polygon holds more than ``max_edges`` edges; if
    that does not end (edges on top of each other), it raises.
    """
    edges = stored_edges(vertices, geom)
    size = float(cell) if cell else grid_size(edges, geom)
    pieces = _edge_cells(edges, size, geom)
    for _ in range(16):
        most = pieces.groupBy(geom, "cx", "cy").count().agg(F.max("count")).first()[0]
        if most is None or most <= max_edges:
            break
        size /= 2
        pieces = _edge_cells(edges, size, geom)
    else:
        raise ValueError(f"over {max_edges} edges of one polygon cross in one place")

    border = pieces.groupBy(geom, "cx", "cy").agg(
        F.collect_list(F.struct("xl", "yl", "xr", "yr", "crosses")).alias("edges"),
        F.sum(F.col("crosses").cast("int")).alias("_n"),
    )
    # A window over the border cells of one grid row of one polygon: crossings to
    # the right give the parity, the gap to the next border cell is the interior.
    row = W.partitionBy(geom, "cy").orderBy("cx")
    rest = row.rowsBetween(1, W.unboundedFollowing)
    border = border.withColumn("inside", F.coalesce(F.sum("_n").over(rest), F.lit(0)) % 2).withColumn(
        "_next", F.lead("cx").over(row)
    )
    # the gap after a cell lies inside when the line right of the cell does
    gap = F.when(
        (F.col("inside") == 1) & (F.col("_next") > F.col("cx") + 1), F.sequence(F.col("cx") + 1, F.col("_next") - 1)
    )
    none = F.array().cast("array<struct<xl:double,yl:double,xr:double,yr:double,crosses:boolean>>")
    cells = F.concat(
        F.array(F.struct(F.col("cx"), F.lit(True).alias("border"))),
        F.coalesce(
            F.transform(gap, lambda c: F.struct(c.alias("cx"), F.lit(False).alias("border"))),
            F.array().cast("array<struct<cx:bigint,border:boolean>>"),
        ),
    )
    out = border.select(geom, "cy", "inside", "edges", F.explode(cells).alias("c")).select(
        geom,
        F.col("c.cx").alias("cx"),
        "cy",
        F.when(F.col("c.border"), F.col("inside")).otherwise(F.lit(1)).alias("inside"),
        F.when(F.col("c.border"), F.col("edges")).otherwise(none).alias("edges"),
    )
    return out, size


def _edge_cells(edges: DataFrame, size: float, geom: str) -> DataFrame:
    """Edges cut into the cells they run through, with a flag on the cell that
    holds the crossing with the lower line of the grid row."""
    h = F.lit(size)
    e = _upright(edges, geom)
    low, high = F.least("yl", "yr"), F.greatest("yl", "yr")
    rows = e.select(
        "*",
        F.explode(F.sequence(F.floor(low / h), F.floor(high / h))).alias("cy"),
    )
    y0, y1 = F.col("cy") * h, (F.col("cy") + 1) * h
    at = lambda y: F.when(  # noqa: E731  x of the edge at height y
        F.col("yl") != F.col("yr"),
        F.col("xl") + (F.col("xr") - F.col("xl")) * (y - F.col("yl")) / F.nullif(F.col("yr") - F.col("yl"), F.lit(0.0)),
    )
    a, b = F.greatest(low, F.least(y0, high)), F.least(high, F.greatest(y1, low))
    xa, xb = F.coalesce(at(a), F.col("xl")), F.coalesce(at(b), F.col("xr"))
    inside = lambda x: F.greatest(F.col("xl"), F.least(F.col("xr"), x))
    crossing = F.when((low <= y0) & (y0 < high), F.floor(inside(at(y0)) / h))
    # the small margin absorbs rounding at cell borders
    first = F.floor(inside(F.least(xa, xb)) / h - F.lit(1e-9))
    last = F.floor(inside(F.greatest(xa, xb)) / h + F.lit(1e-9))
    return rows.select("*", crossing.alias("_cross"), F.explode(F.sequence(first, last)).alias("cx")).select(
        geom, "xl", "yl", "xr", "yr", "cx", "cy", F.coalesce(F.col("_cross") == F.col("cx"), F.lit(False)).alias("crosses")
    )


def point_in_polygon(
    points: DataFrame,
    vertices: DataFrame,
    x: str = "x",
    y: str = "y",
    geom: str = "geom",
    cell: float | None = None,
    how: str = "left",
) -> DataFrame:
    """Points with the polygon that contains them; unmatched points stay (NULL).

    A point on a border belongs to the polygon on its upper/right side. The
    points are moved at most once (by cell); the cells side is broadcast by Spark
    only when its measured size allows, and a hot cell is split by the adaptive
    skew join because the points are the streamed side.
    """
    cells, size = polygon_cells(vertices, cell, geom)
    h = F.lit(size)
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    cells = cells.withColumnsRenamed({"cx": "_cx", "cy": "_cy", "inside": "_inside", "edges": "_edges"})
    y0 = F.col("_cy") * h

    def passed(e: Column) -> Column:
        to_right = e["crosses"] & _edge_right(e, px, y0)
        upward = (
            (e["xl"] <= px) & (px < e["xr"]) & _edge_above(e, px, y0) & ~_edge_above(e, px, py)
        )
        return to_right.cast("int") + upward.cast("int")

    parity = F.aggregate("_edges", F.col("_inside").cast("int"), lambda acc, e: acc + passed(e)) % 2
    on = (F.floor(px / h) == F.col("_cx")) & (F.floor(py / h) == F.col("_cy")) & (parity == 1)
    return points.join(cells, on, how).drop("_cx", "_cy", "_inside", "_edges")


# ----------------------------------------------------------------------- overlay


def bounding_boxes(vertices: DataFrame, geom: str = "geom") -> DataFrame:
    return vertices.groupBy(geom).agg(
        F.min(F.col("x").cast("double")).alias("x0"),
        F.min(F.col("y").cast("double")).alias("y0"),
        F.max(F.col("x").cast("double")).alias("x1"),
        F.max(F.col("y").cast("double")).alias("y1"),
    )


def rectangles_to_vertices(rects: DataFrame, geom: str) -> DataFrame:
    """Vertex table of axis-aligned rectangles ``(geom, x0, y0, x1, y1)``."""
    corner = lambda s, cx, cy: F.struct(
        F.lit(s).alias("seq"), F.col(cx).cast("double").alias("x"), F.col(cy).cast("double").alias("y")
    )
    ring = F.array(
        corner(0, "x0", "y0"), corner(1, "x1", "y0"), corner(2, "x1", "y1"), corner(3, "x0", "y1"), corner(4, "x0", "y0")
    )
    return rects.select(geom, F.lit(0).alias("part"), F.lit(0).alias("ring"), F.explode(ring).alias("v")).select(
        geom, "part", "ring", "v.seq", "v.x", "v.y"
    )


_PIECES = "array<struct<w:double,a:double,b:double,fa:double,fb:double>>"


def covered_cells(edges: DataFrame, size: float, geom: str = "geom", x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """What every polygon covers of the cells of a grid: ``(geom, cx, cy, n, cover, pieces)``.

    Cell (cx, cy) begins at ``(x0 + cx * size, y0 + cy * size)``. A cell in the interior
    has no ``pieces`` and is covered whole. In a border cell the polygon is a sum of
    pieces: ``w`` times the part of the cell above a line from ``fa`` under the top at
    x = a to ``fb`` at x = b. There is one for each edge in the cell, one left of each
    crossing with the lower line, and one for the state of that line at the right end.
    ``cover`` is the area, ``n`` the number of pieces.
    """
    h = F.lit(float(size))
    turn = ring_areas(edges, geom).select(
        F.col(geom).alias("_g"), F.col("part").alias("_p"), F.col("ring").alias("_r"),
        (F.signum("signed_area") * F.when(F.col("ring") == 0, 1).otherwise(-1)).alias("_turn"),
    )
    e = edges.join(turn, (edges[geom] == F.col("_g")) & (F.col("part") == F.col("_p")) & (F.col("ring") == F.col("_r")))
    e = e.select(geom, "_turn", *[(F.col(c) - F.lit(float(o))).alias(c) for c, o in (("x1", x0), ("y1", y0), ("x2", x0), ("y2", y0))])
    swap = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    # u is 1 where the polygon lies left of the edge as it goes right (or up)
    e = e.select(
        geom, pick("x1", "x2").alias("xl"), pick("y1", "y2").alias("yl"), pick("x2", "x1").alias("xr"), pick("y2", "y1").alias("yr"),
        (F.col("_turn") * F.when(swap, -1).otherwise(1)).alias("u"),
    )
    low, high = F.least("yl", "yr"), F.greatest("yl", "yr")
    rows = e.select("*", F.explode(F.sequence(F.floor(low / h), F.floor(high / h))).alias("cy"))
    bottom, top = F.col("cy") * h, (F.col("cy") + 1) * h
    within = lambda x: F.greatest(F.col("xl"), F.least(F.col("xr"), x))
    x_at = lambda y: within(F.when(F.col("yl") != F.col("yr"), F.col("xl") + (F.col("xr") - F.col("xl")) * (y - F.col("yl")) / F.nullif(F.col("yr") - F.col("yl"), F.lit(0.0))))
    a, b = F.greatest(low, F.least(bottom, high)), F.least(high, F.greatest(top, low))
    flat = F.col("yl") == F.col("yr")
    xa, xb = F.when(flat, F.col("xl")).otherwise(x_at(a)), F.when(flat, F.col("xr")).otherwise(x_at(b))
    crossing = F.when((low <= bottom) & (bottom < high), x_at(bottom))
    rows = rows.select(
        "*", F.least(xa, xb).alias("_from"), F.greatest(xa, xb).alias("_to"), crossing.alias("_x"),
    ).withColumn("_c", F.floor(F.col("_x") / h))
    # the small margin absorbs rounding at cell borders
    cut = rows.select("*", F.explode(F.sequence(F.floor(F.col("_from") / h - F.lit(1e-9)), F.floor(F.col("_to") / h + F.lit(1e-9)))).alias("cx"))
    left, right = F.col("cx") * h, (F.col("cx") + 1) * h
    pa, pb = F.greatest("_from", left), F.least("_to", right)
    slope = (F.col("yr") - F.col("yl")) / F.nullif(F.col("xr") - F.col("xl"), F.lit(0.0))
    under = lambda x: F.greatest(F.lit(0.0), F.least(h, top - (F.col("yl") + slope * (x - F.col("xl")))))
    # an edge along the lower line is below the state just above it
    line = F.when((pb > pa) & ~(flat & (F.col("yl") == bottom)), F.struct(F.col("u").alias("w"), pa.alias("a"), pb.alias("b"), under(pa).alias("fa"), under(pb).alias("fb")))
    here = F.col("_c") == F.col("cx")
    step = F.when(here, F.when(F.col("yr") > F.col("yl"), F.col("u")).otherwise(-F.col("u")))
    below = F.when(here & (F.col("_x") > left), F.struct(step.alias("w"), left.alias("a"), F.col("_x").alias("b"), h.alias("fa"), h.alias("fb")))
    border = (
        cut.select(geom, "cx", "cy", line.alias("line"), below.alias("below"), F.coalesce(step, F.lit(0)).alias("step"))
        .groupBy(geom, "cx", "cy")
        .agg(F.concat(F.collect_list("line"), F.collect_list("below")).cast(_PIECES).alias("pieces"), F.sum("step").alias("step"))
    )
    # A window over the border cells of one grid row of one polygon: the crossings to
    # the right give the state, the gap to the next border cell is the interior.
    row = W.partitionBy(geom, "cy").orderBy("cx")
    state = F.coalesce(F.sum("step").over(row.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    border = border.select("*", F.round(state).cast("int").alias("state"), F.lead("cx").over(row).alias("next"))
    base = F.array(F.struct(F.lit(1.0).alias("w"), left.alias("a"), right.alias("b"), h.alias("fa"), h.alias("fb"))).cast(_PIECES)
    none = F.array().cast(_PIECES)
    border = border.withColumn("pieces", F.concat("pieces", F.when(F.col("state") == 1, base).otherwise(none)))
    area = F.aggregate("pieces", F.lit(0.0), lambda acc, p: acc + p["w"] * (p["b"] - p["a"]) * (p["fa"] + p["fb"]) / 2)
    gap = border.where((F.col("state") == 1) & (F.col("next") > F.col("cx") + 1)).select(
        geom, F.explode(F.sequence(F.col("cx") + 1, F.col("next") - 1)).alias("cx"), "cy", F.lit(1).alias("n"), (h * h).alias("cover"), F.lit(None).cast(_PIECES).alias("pieces")
    )
    found = border.select(geom, "cx", "cy", F.size("pieces").alias("n"), area.alias("cover"), "pieces").where("n > 0")
    return found.unionByName(gap)


def _shared(p: Column, q: Column) -> Column:
    """Area that two pieces of one cell share."""
    a, b = F.greatest(p["a"], q["a"]), F.least(p["b"], q["b"])
    at = lambda t, x: t["fa"] + (t["fb"] - t["fa"]) * ((x - t["a"]) / (t["b"] - t["a"]))
    pa, pb, qa, qb = at(p, a), at(p, b), at(q, a), at(q, b)
    da, db = F.abs(pa - qa), F.abs(pb - qb)
    crossed = (pa - qa) * (pb - qb) < 0
    gap = F.when(crossed, (da * da + db * db) / F.nullif(2 * (da + db), F.lit(0.0))).otherwise((da + db) / 2)
    return F.when(b > a, p["w"] * q["w"] * (b - a) * ((pa + pb + qa + qb) / 4 - gap / 2)).otherwise(F.lit(0.0))


def overlay_area(
    left: DataFrame,
    right: DataFrame,
    lgeom: str = "left_geom",
    rgeom: str = "right_geom",
    cell: float | None = None,
    name: str = "area",
    noise: float = 1e-12,
    crowd: int = 1 << 20,
) -> DataFrame:
    """One row per intersecting pair of polygons with the area they share.

    Polygons of both layers meet in the cells of one grid. A cell inside one of them
    adds what the other covers of it; only where both have a border in a cell do their
    edges meet. The cell size is the larger one of ``grid_size``, so that the coarser layer has
    few edges in a cell and pairs are linear in the edges of the other; it is halved while a
    pair of polygons has over ``crowd`` pairs of edges in one cell. Pairs that only touch, or are
    apart, are left out: their sum is rounding, at most ``noise`` times their shared cells.
    """
    # edges of both layers are built once
    left, right = stored_edges(left, lgeom), stored_edges(right, rgeom)
    box = lambda e: e.agg(F.min("x1"), F.min("y1")).first()
    x0, y0 = (float(v) if v is not None else 0.0 for v in box(left))
    h = float(cell) if cell else max(grid_size(left, lgeom), grid_size(right, rgeom))
    for _ in range(16):
        a = covered_cells(left, h, lgeom, x0, y0).withColumnsRenamed({"n": "_n", "cover": "_u", "pieces": "_p"})
        b = covered_cells(right, h, rgeom, x0, y0).withColumnsRenamed({"n": "_m", "cover": "_v", "pieces": "_q"})
        most = [(c.where(f"{p} IS NOT NULL").agg(F.max(n)).first()[0] or 0) for c, p, n in ((a, "_p", "_n"), (b, "_q", "_m"))]
        if most[0] * most[1] <= crowd:
            break
        h /= 2
    else:
        raise ValueError(f"over {crowd} pairs of edges of two polygons meet in one place")
    both = F.aggregate("_p", F.lit(0.0), lambda s, p: s + F.aggregate("_q", F.lit(0.0), lambda t, q: t + _shared(p, q)))
    shared = F.when(F.col("_p").isNull(), F.col("_v")).when(F.col("_q").isNull(), F.col("_u")).otherwise(both)
    found = a.join(b, ["cx", "cy"]).groupBy(lgeom, rgeom).agg(F.sum(shared).alias(name), F.count(F.lit(1)).alias("_cells"))
    return found.where(F.col(name) > F.lit(noise * h * h) * F.col("_cells")).drop("_cells")


# ------------------------------------------------------------------- covariates


def zonal_statistic(cells: DataFrame, vertices: DataFrame, cell: float, geom: str = "geom", by: Sequence[str] = (), stat: str = "mean") -> DataFrame:
    """Raster value per polygon, weighted by the covered part of each cell.

    ``cells`` has (x, y, value) at cell centres and the ``by`` columns (year).
    ``mean`` and ``sum`` weight by coverage; ``min`` and ``max`` take every cell
    that is touched. The coverage is exact and computed once per grid position,
    not once per layer; cells inside a polygon count whole. Every polygon has a row under each of the ``by`` keys that
    occur; without a known cell its value is NULL.
    """
    # the raster is the grid: its cells need no edges
    first = cells.agg(F.min("x"), F.min("y")).first()
    x0, y0 = (0.0 if v is None else float(v) - cell / 2 for v in first)
    place = lambda c, o: F.floor((F.col(c) - F.lit(o)) / F.lit(cell))
    cover = covered_cells(stored_edges(vertices, geom), cell, geom, x0, y0).where(F.col("cover") > F.lit(1e-12 * cell * cell))
    values = cells.withColumns({"cx": place("x", x0), "cy": place("y", y0)})
    v = cover.select(geom, "cx", "cy", F.col("cover").alias("_cover")).join(values, ["cx", "cy"])
    weight = F.col("_cover") / F.lit(cell * cell)
    known = F.when(F.col("value").isNotNull(), weight)
    agg = {
        "mean": ratio(F.sum(F.col("value") * weight), F.sum(known)),
        "sum": F.sum(F.col("value") * weight),
        "min": F.min("value"),
        "max": F.max("value"),
    }[stat]
    found = v.groupBy(geom, *by).agg(agg.alias("value"))
    everywhere = vertices.select(geom).distinct()
    if by:
        keys = cells.agg(F.collect_set(F.struct(*by))).scalar()
        everywhere = everywhere.withColumn("_k", F.explode(keys)).select(geom, *[F.col("_k")[k].alias(k) for k in by])
    return everywhere.join(found, [geom, *by], "left")


def facility_density(
    facilities: DataFrame,
    vertices: DataFrame,
    population: DataFrame,
    states: Sequence[str],
    geom: str = "geom",
    cell: float | None = None,
) -> DataFrame:
    """Open facilities and their employees per 10,000 people by area.

    An area without facilities has 0; an unknown employee number makes the
    area's employee density NULL rather than too small.
    """
    open_ = facilities.where(F.col("state").isin(list(states)) & (F.col("status") != "T"))
    by_area = (
        point_in_polygon(open_, vertices, geom=geom, cell=cell)
        .groupBy(geom)
        .agg(
            F.count(F.lit(1)).alias("n_facility"),
            strict_sum("employees").alias("n_employees"),
            F.lit(True).alias("_seen"),
        )
    )
    n = F.coalesce("n_facility", F.lit(0))
    emp = F.when(F.col("_seen"), F.col("n_employees")).otherwise(F.lit(0))
    return by_area.join(population, geom, "full").select(
        geom, per_unit(n, "pop_ref", 1e4).alias("d_facility_10k"), per_unit(emp, "pop_ref", 1e4).alias("d_employees_10k")
    )


def water_share(non_water: DataFrame, non_sea: DataFrame, geom: str, digits: int) -> DataFrame:
    """Freshwater percentage by larger area from two polygon layers.

    The larger area is the first ``digits`` characters of the polygon id.
    """
    def total(v: DataFrame, name: str) -> DataFrame:
        key = F.substring(F.col(geom), 1, digits).alias("area_id")
        return polygon_area(v, geom, name="_a").groupBy(key).agg(F.sum("_a").alias(name))

    joined = total(non_water, "area_nonwater").join(total(non_sea, "area_nonsea"), "area_id", "left")
    pct = ratio(F.lit(100.0) * (F.col("area_nonsea") - F.col("area_nonwater")), "area_nonsea")
    return joined.select("area_id", "area_nonwater", "area_nonsea", clamp_zero(pct).alias("p_water"))


def park_share(areas: DataFrame, parks: DataFrame, geom: str = "geom", park: str = "park_id", unit: float = 1.0, cell: float | None = None) -> DataFrame:
    """Park number, area, density and percentage for every area (0 without parks)."""
    areas = stored_edges(areas, geom)
    overlap = overlay_area(areas, parks, geom, park, cell=cell, name="_a")
    by_area = overlap.groupBy(geom).agg(F.count(F.lit(1)).alias("n_parks"), (F.sum("_a") / F.lit(unit)).alias("park_area"))
    size = polygon_area(areas, geom, unit, "_size")
    n, a = F.coalesce("n_parks", F.lit(0)), F.coalesce("park_area", F.lit(0.0))
    return size.join(by_area, geom, "left").select(
        geom,
        n.alias("n_parks"),
        a.alias("park_area"),
        ratio(n, "_size").alias("d_parks"),
        ratio(100 * a, "_size").alias("p_park"),
    )


def contiguity(vertices: DataFrame, snap: float = 0.0, geom: str = "geom") -> DataFrame:
    """Directed edges (i, j) of areas that share a boundary point.

    With ``snap`` two vertices count as one when their distance is at most
    ``snap``: vertices go to a grid of that width and meet the 3x3 cells around.
    """
    v = vertices.select(F.col(geom), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    if snap <= 0:
        a, b = v.withColumnRenamed(geom, "i"), v.withColumnRenamed(geom, "j")
        return a.join(b, ["x", "y"]).where(F.col("i") != F.col("j")).select("i", "j").distinct()
    h = F.lit(float(snap))
    cell = v.select(geom, "x", "y", F.floor(F.col("x") / h).alias("cx"), F.floor(F.col("y") / h).alias("cy"))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = (
        cell.withColumn("_dx", F.explode(steps))
        .withColumn("_dy", F.explode(steps))
        .select(
            F.col(geom).alias("i"),
            F.col("x").alias("_x"),
            F.col("y").alias("_y"),
            (F.col("cx") + F.col("_dx")).alias("cx"),
            (F.col("cy") + F.col("_dy")).alias("cy"),
        )
    )
    d2 = F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)
    return (
        near.join(cell.withColumnRenamed(geom, "j"), ["cx", "cy"])
        .where((F.col("i") != F.col("j")) & (d2 <= F.lit(float(snap) ** 2)))
        .select("i", "j")
        .distinct()
    )


def neighbour_counts(edges: DataFrame, areas: DataFrame | None = None, area: str = "geom") -> DataFrame:
    """Number of neighbours per area; with ``areas`` isolated areas show as 0."""
    counts = edges.groupBy("i").agg(F.count(F.lit(1)).alias("n_neighbours"))
    if areas is None:
        return counts
    return areas.select(F.col(area).alias("i")).join(counts, "i", "left").fillna(0, ["n_neighbours"])


# -------------------------------------------------------------------- projections

# GRS80 ellipsoid (fixed values).
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
_E2 = 2 * GRS80_F - GRS80_F**2
_E = math.sqrt(_E2)

# Oregon statewide Lambert conic in international feet (fixed values).
OREGON_LAMBERT = {
    "lat_1": 43.0,
    "lat_2": 45.5,
    "lat_0": 41.75,
    "lon_0": -120.5,
    "false_easting_m": 400000.0,
    "metres_per_unit": 0.3048,
}
# Contiguous-US Albers equal-area in metres (fixed values).
US_ALBERS = {"lat_1": 29.5, "lat_2": 45.5, "lat_0": 23.0, "lon_0": -96.0}


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - _E2 * math.sin(lat) ** 2)


def _t(lat: float) -> float:
    s = math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - _E * s) / (1 + _E * s)) ** (_E / 2)


def _lambert_constants(p: dict) -> tuple[float, float, float]:
    lat1, lat2, lat0 = (math.radians(p[k]) for k in ("lat_1", "lat_2", "lat_0"))
    n = (math.log(_m(lat1)) - math.log(_m(lat2))) / (math.log(_t(lat1)) - math.log(_t(lat2)))
    f = _m(lat1) / (n * _t(lat1) ** n)
    return n, f, GRS80_A * f * _t(lat0) ** n


def lambert_to_lonlat(x: Column, y: Column, p: dict = OREGON_LAMBERT) -> tuple[Column, Column]:
    """Inverse two-parallel Lambert conformal conic as column expressions."""
    n, f, rho0 = _lambert_constants(p)
    xm = x * F.lit(p["metres_per_unit"]) - F.lit(p["false_easting_m"])
    ym = F.lit(rho0) - y * F.lit(p["metres_per_unit"])
    rho = F.sqrt(xm * xm + ym * ym)
    t = F.pow(rho / F.lit(GRS80_A * f), F.lit(1 / n))
    chi = F.lit(math.pi / 2) - 2 * F.atan(t)
    # series for the latitude from the conformal latitude (published to e^8)
    e2, e4, e6, e8 = _E2, _E2**2, _E2**3, _E2**4
    lat = (
        chi
        + F.sin(2 * chi) * F.lit(e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360)
        + F.sin(4 * chi) * F.lit(7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520)
        + F.sin(6 * chi) * F.lit(7 * e6 / 120 + 81 * e8 / 1120)
        + F.sin(8 * chi) * F.lit(4279 * e8 / 161280)
    )
    lon = F.atan2(xm, ym) / F.lit(n) + F.lit(math.radians(p["lon_0"]))
    return F.degrees(lon), F.degrees(lat)


def lonlat_to_lambert(lon: Column, lat: Column, p: dict = OREGON_LAMBERT) -> tuple[Column, Column]:
    """Forward two-parallel Lambert conformal conic."""
    n, f, rho0 = _lambert_constants(p)
    phi = F.radians(lat)
    es = F.lit(_E) * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(_E / 2))
    rho = F.lit(GRS80_A * f) * F.pow(t, F.lit(n))
    theta = F.lit(n) * (F.radians(lon) - F.lit(math.radians(p["lon_0"])))
    unit = F.lit(p["metres_per_unit"])
    return (rho * F.sin(theta) + F.lit(p["false_easting_m"])) / unit, (F.lit(rho0) - rho * F.cos(theta)) / unit


def _q_const(lat: float) -> float:
    s = math.sin(lat)
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def lonlat_to_albers(lon: Column, lat: Column, p: dict = US_ALBERS) -> tuple[Column, Column]:
    """Forward Albers equal-area conic, metres."""
    lat1, lat2, lat0 = (math.radians(p[k]) for k in ("lat_1", "lat_2", "lat_0"))
    n = (_m(lat1) ** 2 - _m(lat2) ** 2) / (_q_const(lat2) - _q_const(lat1))
    c = _m(lat1) ** 2 + n * _q_const(lat1)
    rho0 = GRS80_A * math.sqrt(c - n * _q_const(lat0)) / n
    s = F.sin(F.radians(lat))
    q = (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E)) * F.lit(1 - _E2)
    rho = F.sqrt(F.lit(c) - F.lit(n) * q) * F.lit(GRS80_A / n)
    theta = F.lit(n) * (F.radians(lon) - F.lit(math.radians(p["lon_0"])))
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def lonlat_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical web Mercator, metres."""
    return (
        F.radians(lon) * F.lit(GRS80_A),
        F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * F.lit(GRS80_A),
    )


def fix_coordinates(df: DataFrame, lon: str, lat: str, projection: dict = OREGON_LAMBERT) -> DataFrame:
    """Projected coordinates (first axis 180 or more) brought to lon/lat, then the
    sanity filter: latitude from 40 and longitude below -80."""
    lo, la = lambert_to_lonlat(F.col(lon), F.col(lat), projection)
    projected = F.col(lon) >= 180
    fixed = df.select(
        *[
            F.when(projected, lo).otherwise(F.col(lon)).alias(c)
            if c == lon
            else F.when(projected, la).otherwise(F.col(lat)).alias(c)
            if c == lat
            else F.col(c)
            for c in df.columns
        ]
    )
    return fixed.where((F.col(lat) >= 40) & (F.col(lon) < -80))
