"""Polygon operators on ring-edge tables (poly, x1, y1, x2, y2); x is longitude or easting.

Containment is even-odd, so holes need no special case.  A polygon is rasterised once into grid cells:
cells wholly inside carry no geometry, cells on the boundary carry only the edges that pass through them.
A point then compares itself with the few edges of its own cell, however large the polygon is.  Where an outline is dense, cells
are split one by one until few edges are left in each (`polygon_leaves`).
"""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.nulls import num
from .spark_support import stored

# The reference point of a cell sits off its centre so that it does not meet vertices on round coordinates.
OFFSET = 0.4871236
PAD = 1e-9


def _cross_x(y: Column) -> Column:
    """x at which an edge meets the horizontal line at y."""
    return F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))


def _cross_y(x: Column) -> Column:
    return F.col("y1") + (x - F.col("x1")) * (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))


def _spans_y(y: Column) -> Column:
    return (F.col("y1") > y) != (F.col("y2") > y)


def _spans_x(x: Column) -> Column:
    return (F.col("x1") > x) != (F.col("x2") > x)


def _reference(index: Column, cell: float | Column) -> Column:
    return (index + num(OFFSET)) * (cell if isinstance(cell, Column) else num(cell))


def _flips(px: Column, py: Column, ref_x: Column, ref_y: Column) -> Column:
    """How often a row's edge is met on the way from a point to its cell's reference; an inside cell's own row counts once."""
    across = _spans_y(py) & ((_cross_x(py) > px) != (_cross_x(py) > ref_x))
    along = _spans_x(ref_x) & ((_cross_y(ref_x) > py) != (_cross_y(ref_x) > ref_y))
    flips = F.coalesce(across, F.lit(False)).cast("int") + F.coalesce(along, F.lit(False)).cast("int")
    return F.when(F.col("x1").isNull(), F.lit(1)).otherwise(flips)


def polygon_cells(edges: DataFrame, cell: float) -> DataFrame:
    """(poly, cy, cx, x1, y1, x2, y2): boundary cells with their edges, inside cells with null edges."""
    lo_y, hi_y = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("cy", F.explode(F.sequence(
        F.floor(lo_y / cell - PAD).cast("bigint"), F.floor(hi_y / cell + PAD).cast("bigint"))))

    # boundary: clip the edge to its row, then visit the columns the clipped part touches
    bottom, top = F.col("cy") * num(cell), (F.col("cy") + 1) * num(cell)
    flat = F.col("y1") == F.col("y2")
    at = lambda y: F.when(flat, F.col("x1")).otherwise(_cross_x(F.least(F.greatest(y, lo_y), hi_y)))
    xa, xb = at(bottom), F.when(flat, F.col("x2")).otherwise(at(top))
    boundary = rows.withColumn("cx", F.explode(F.sequence(
        F.floor(F.least(xa, xb) / cell - PAD).cast("bigint"),
        F.floor(F.greatest(xa, xb) / cell + PAD).cast("bigint"))))
    boundary = boundary.select("poly", "cy", "cx", "x1", "y1", "x2", "y2")

    # inside: along each row's reference line, columns between an odd and the next even crossing
    line = _reference(F.col("cy"), cell)
    crossing = rows.where(_spans_y(line)).select(
        "poly", "cy", (F.ceil(_cross_x(line) / cell - num(OFFSET)) - 1).cast("bigint").alias("k"),
        _cross_x(line).alias("x"))
    order = W.partitionBy("poly", "cy").orderBy(F.desc("x"), F.desc("k"))
    runs = crossing.withColumns({"pos": F.row_number().over(order), "next_k": F.lead("k").over(order)})
    runs = runs.where((F.col("pos") % 2 == 1) & (F.col("next_k") < F.col("k")))
    inside = runs.select("poly", "cy", F.explode(F.sequence(F.col("next_k") + 1, F.col("k"))).alias("cx"))
    empty = [F.lit(None).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    return boundary.unionByName(inside.select("poly", "cy", "cx", *empty))


def polygon_leaves(edges: DataFrame, cell: float, most: int = 64, deepest: int = 16) -> tuple[DataFrame, int]:
    """(poly, level, cy, cx, x1, y1, x2, y2) and the deepest level in use: cells of side cell / 2**level with at most `most` edges.

    A cell with more edges becomes four; only `deepest` ends this, where more edges than that meet in one spot.  A level is
    one written table, so that lost executors repeat one level.  No edges give no cells.
    """
    at, done, level = ["poly", "cy", "cx"], [], 0
    cells = stored(polygon_cells(edges, cell), "cells")
    while True:
        full = cells.groupBy(*at).agg(F.count("x1").alias("n")).where(F.col("n") > most).select(*at)
        full = stored(full, "full") if level < deepest else None
        last = full is None or full.isEmpty()
        done.append((cells if last else cells.join(full, at, "left_anti")).withColumn("level", F.lit(level)))
        if last:
            return reduce(DataFrame.unionByName, done), level
        cells = stored(_quarters(cells.join(full, at, "left_semi"), cell / 2 ** level), "cells")
        level += 1


def _quarters(cells: DataFrame, cell: float) -> DataFrame:
    """Each cell as four: an edge goes to those that its padded box and line touch, inside ones get a row without an edge."""
    half = cell / 2
    four = cells.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(3)))) \
        .withColumns({"qy": F.col("cy") * 2 + F.floor(F.col("_q") / 2), "qx": F.col("cx") * 2 + F.col("_q") % 2})
    mid_x, mid_y, reach = (F.col("qx") + 0.5) * num(half), (F.col("qy") + 0.5) * num(half), num(half * (0.5 + PAD))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    near = lambda a, b, mid: (F.least(a, b) <= mid + reach) & (F.greatest(a, b) >= mid - reach)
    line = F.abs(dx * (mid_y - F.col("y1")) - dy * (mid_x - F.col("x1"))) <= (F.abs(dx) + F.abs(dy)) * reach * (1 + PAD)
    own = ["poly", F.col("qy").alias("cy"), F.col("qx").alias("cx")]
    edges = four.where(near("x1", "x2", mid_x) & near("y1", "y2", mid_y) & line).select(*own, "x1", "y1", "x2", "y2")
    met = _flips(_reference(F.col("qx"), half), _reference(F.col("qy"), half), _reference(F.col("cx"), cell), _reference(F.col("cy"), cell))
    inside = four.withColumn("_hit", met).groupBy(*own).agg(F.sum("_hit").alias("n")).where("n % 2 = 1")
    empty = [F.lit(None).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    return edges.unionByName(inside.select("poly", "cy", "cx", *empty))


def polygons_at(points: DataFrame, leaves: DataFrame, levels: int, cell: float, point_id: str,
                x: str = "lon", y: str = "lat") -> DataFrame:
    """(point_id, poly) for every polygon that contains the point, by the leaves of `polygon_leaves`. A point without a place has none."""
    side = num(cell) / F.pow(F.lit(2.0), F.col("level"))
    p = points.select(point_id, F.col(x).alias("px"), F.col(y).alias("py")).where("px is not null and py is not null") \
        .withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))) \
        .withColumns({"cy": F.floor(F.col("py") / side).cast("bigint"), "cx": F.floor(F.col("px") / side).cast("bigint")})
    hit = _flips(F.col("px"), F.col("py"), _reference(F.col("cx"), side), _reference(F.col("cy"), side))
    joined = p.join(leaves, ["level", "cy", "cx"]).select(point_id, "poly", hit.alias("hit")).where("hit > 0")
    parity = joined.groupBy(point_id, "poly").agg(F.sum("hit").alias("hits"))
    return parity.where(F.col("hits") % 2 == 1).select(point_id, "poly")


def unwrapped(edges: DataFrame) -> DataFrame:
    """Polygons that cross the 180th meridian, in longitudes from 0 to 360; others as they are. Such a polygon has an edge of more than
    180 degrees; one that holds a pole has to be closed along it beforehand."""
    crossing = edges.where(F.abs(F.col("x1") - F.col("x2")) > 180).select("poly", F.lit(True).alias("_over")).distinct()
    east = lambda c: F.when(F.col("_over") & (F.col(c) < 0), F.col(c) + 360).otherwise(F.col(c)).alias(c)
    return edges.join(crossing, "poly", "left").select(*[east(c) if c in ("x1", "x2") else F.col(c) for c in edges.columns])


def polygons_around(points: DataFrame, edges: DataFrame, cell: float, point_id: str, x: str = "lon", y: str = "lat",
                    most: int = 64) -> DataFrame:
    """(point_id, poly) on the globe: polygons of any number of edges, also across the 180th meridian."""
    leaves, levels = polygon_leaves(unwrapped(edges), cell, most)
    turned = points.select(point_id, y, F.explode(F.when(
        F.col(x) < 0, F.array(F.col(x), F.col(x) + 360)).otherwise(F.array(x))).alias(x))
    return polygons_at(turned, leaves, levels, cell, point_id, x, y)


def with_cell(points: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    return points.withColumns({"cy": F.floor(F.col(y) / cell).cast("bigint"),
                               "cx": F.floor(F.col(x) / cell).cast("bigint")})


def containing_polygons(points: DataFrame, cells: DataFrame, cell: float, point_id: str,
                        x: str = "lon", y: str = "lat") -> DataFrame:
    """(point_id, poly) for every polygon that contains the point."""
    p = with_cell(points.select(point_id, F.col(x).alias("px"), F.col(y).alias("py")), "px", "py", cell)
    ref_x, ref_y = _reference(F.col("cx"), cell), _reference(F.col("cy"), cell)
    hit = _flips(F.col("px"), F.col("py"), ref_x, ref_y)
    joined = p.join(cells, ["cy", "cx"]).select(point_id, "poly", hit.alias("hit")).where("hit > 0")
    parity = joined.groupBy(point_id, "poly").agg(F.sum("hit").alias("hits"))
    return parity.where(F.col("hits") % 2 == 1).select(point_id, "poly")


def attach_polygon(points: DataFrame, edges: DataFrame, cell: float, point_id: str,
                   x: str = "lon", y: str = "lat") -> DataFrame:
    """Left join keeping the smallest containing polygon of each point."""
    found = polygons_at(points, *polygon_leaves(edges, cell), cell, point_id, x, y)
    first = found.groupBy(point_id).agg(F.min("poly").alias("poly"))
    return points.join(first, point_id, "left")


def keep_inside(points: DataFrame, edges: DataFrame, cell: float, point_id: str,
                x: str = "lon", y: str = "lat") -> DataFrame:
    found = polygons_at(points, *polygon_leaves(edges, cell), cell, point_id, x, y)
    return points.join(found.select(point_id).distinct(), point_id, "left_semi")


def ring_area(edges: DataFrame) -> DataFrame:
    """Shoelace area per polygon from its rings; a hole (role inner) is subtracted."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    rings = edges.groupBy("poly", "ring", "role").agg((F.abs(F.sum(cross)) / 2).alias("area"))
    signed = F.when(F.col("role") == "inner", -F.col("area")).otherwise(F.col("area"))
    return rings.groupBy("poly").agg(F.sum(signed).alias("area"))


def ring_edges(rings: DataFrame) -> DataFrame:
    """(poly, ring, role, coords array<struct<x,y>>) -> edges; a ring left open is closed."""
    pts = F.col("coords")
    closed = F.when(F.element_at(pts, 1) == F.element_at(pts, -1), pts) \
        .otherwise(F.concat(pts, F.slice(pts, 1, 1)))
    pairs = rings.withColumn("_c", closed).where(F.size("_c") >= 4) \
        .withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_c") - 1)))
    a, b = F.element_at("_c", F.col("_i")), F.element_at("_c", F.col("_i") + 1)
    return pairs.select("poly", "ring", "role", a["x"].alias("x1"), a["y"].alias("y1"),
                        b["x"].alias("x2"), b["y"].alias("y2"))


def centroids(edges: DataFrame) -> DataFrame:
    """Area-weighted centroid of each polygon from its ring edges; holes are taken out, however they wind."""
    ringed = edges if "ring" in edges.columns else edges.withColumns({"ring": F.lit(0), "role": F.lit("outer")})
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    rings = ringed.groupBy("poly", "ring", "role").agg(
        F.sum(cross).alias("a"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"),
        F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"))
    sign = F.signum("a") * F.when(F.col("role") == "inner", -1).otherwise(1)
    sums = rings.groupBy("poly").agg(*[F.sum(sign * F.col(c)).alias(c) for c in ("a", "sx", "sy")])
    return sums.select("poly", (F.col("sx") / (3 * F.col("a"))).alias("cx"), (F.col("sy") / (3 * F.col("a"))).alias("cy"))
