"""Sites from footprints: polygons closer than a gap belong to one site."""
from pyspark.sql import DataFrame, functions as F

from ..functions.geo import segment_distance2
from ..functions.nulls import num
from .nearest import split_segments
from .spark_support import cut, growing


def close_pairs(edges: DataFrame, gap: float) -> DataFrame:
    """(a, b), a < b: polygon pairs whose edges come within `gap`.

    Edges are cut into pieces no longer than the gap and placed in cells of 2 x gap by midpoint; pieces
    within the gap have midpoints within 2 x gap, so they share a cell or touch neighbouring cells.
    Pieces that coincide (copies of a polygon, shared borders) are one geometry: its polygons are linked to
    the smallest of them, and only distinct geometries are compared.
    """
    ends = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    a, b = F.least(*ends), F.greatest(*ends)
    forward = edges.select("poly", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    every = split_segments(forward, gap)
    geometry = ["x1", "y1", "x2", "y2"]
    pieces = every.groupBy(*geometry).agg(F.min("poly").alias("poly"))
    copies = every.join(pieces.withColumnRenamed("poly", "first"), geometry).where("first < poly") \
        .select(F.col("first").alias("a"), F.col("poly").alias("b")).distinct()
    side = num(2 * gap)
    cell = pieces.withColumns({"i": F.floor((F.col("x1") + F.col("x2")) / 2 / side).cast("bigint"),
                               "j": F.floor((F.col("y1") + F.col("y2")) / 2 / side).cast("bigint")})
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    # a cell with one polygon only cannot give a pair: drop it before pieces meet
    spread = cell.select("poly", "i", "j", around.alias("o")).select(
        "poly", (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"))
    shared = spread.groupBy("i", "j").agg(F.min("poly").alias("lo"), F.max("poly").alias("hi")).where("lo < hi").select("i", "j")
    left = cell.join(shared, ["i", "j"], "left_semi")
    right = cell.select(F.col("poly").alias("poly_b"), "i", "j", *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    right = right.withColumn("o", around).withColumns({"i": F.col("i") + F.col("o.a"), "j": F.col("j") + F.col("o.b")}).drop("o")
    met = left.join(right, ["i", "j"]).where("poly < poly_b")
    ax, ay, bx, by = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    cx, cy, dx, dy = (F.col(f"b_{c}") for c in ("x1", "y1", "x2", "y2"))
    d2 = F.least(segment_distance2(ax, ay, cx, cy, dx, dy), segment_distance2(bx, by, cx, cy, dx, dy),
                 segment_distance2(cx, cy, ax, ay, bx, by), segment_distance2(dx, dy, ax, ay, bx, by))
    side_of = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    crossing = (side_of(ax, ay, bx, by, cx, cy) * side_of(ax, ay, bx, by, dx, dy) < 0) & \
        (side_of(cx, cy, dx, dy, ax, ay) * side_of(cx, cy, dx, dy, bx, by) < 0)
    close = met.where(crossing | (d2 <= num(gap * gap))).select(F.col("poly").alias("a"), F.col("poly_b").alias("b"))
    return close.unionByName(copies).distinct()


def smallest_reachable(pairs: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(poly, site): the smallest node that pairs (a, b) lead to, for every node that is not the smallest itself.

    Alternates large-star and small-star rounds, which halve the distance to the smallest node; every
    grouping is a minimum (combined map-side), and each round is cut with a reliable checkpoint.
    """
    def downward(links: DataFrame) -> DataFrame:
        return links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))

    def settled(links: DataFrame) -> bool:
        """Every node has one smaller neighbour at most, which has none itself: all edges lead to a smallest node."""
        end = lambda name, down: links.select(F.col(name).alias("node"), F.lit(down).alias("down"), F.lit(1 - down).alias("up"))
        ends = end("u", 1).unionByName(end("v", 0)).groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        return not ends.where("down + up > 1").agg(F.count("*")).first()[0]

    def star(links: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
        lowest = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = links.join(growing(lowest), "u")
        moved = joined.where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved, lowest

    edges = cut(downward(pairs).distinct())
    for _ in range(max_rounds):
        if settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = star(both, F.col("v") > F.col("u"))
        small, lowest = star(downward(large), F.lit(True))
        small = small.unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = cut(downward(small).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("poly"), F.col("v").alias("site"))


def connected_components(nodes: DataFrame, pairs: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(poly, site): the smallest node of each connected component."""
    return nodes.join(smallest_reachable(pairs, max_rounds), "poly", "left").select("poly", F.coalesce("site", "poly").alias("site"))


def dissolve_sites(footprints: DataFrame, gap: float, min_area: float) -> DataFrame:
    """(poly, site, site_area) of sites at least `min_area`; area is the sum of the parts."""
    from .polygons import ring_area
    areas = ring_area(footprints)
    nodes = areas.select("poly")
    parts = connected_components(nodes, close_pairs(footprints, gap)).join(areas, "poly")
    totals = parts.groupBy("site").agg(F.sum("area").alias("site_area")).where(F.col("site_area") >= min_area)
    return parts.join(totals, "site").select("poly", "site", "site_area")


def intersecting_constituents(sites: DataFrame, raw: DataFrame, cell: float) -> DataFrame:
    """(site, poly): raw polygons that touch a site polygon, by crossing edges or a vertex inside either."""
    from .polygons import containing_polygons, polygon_cells
    site_cells, raw_cells = polygon_cells(sites, cell), polygon_cells(raw, cell)
    vertex = lambda df: df.select("poly", F.concat_ws(":", "poly", "x1", "y1").alias("vid"), F.col("x1").alias("x"), F.col("y1").alias("y")).distinct()
    rv, sv = vertex(raw), vertex(sites)
    raw_in_site = containing_polygons(rv, site_cells, cell, "vid", "x", "y").withColumnRenamed("poly", "site") \
        .join(rv.select("vid", "poly"), "vid").select("site", "poly")
    site_in_raw = containing_polygons(sv, raw_cells, cell, "vid", "x", "y") \
        .join(sv.select("vid", F.col("poly").alias("site")), "vid").select("site", "poly")
    s = site_cells.where("x1 is not null").select(F.col("poly").alias("site"), "cy", "cx", *[F.col(c).alias(f"s_{c}") for c in ("x1", "y1", "x2", "y2")])
    met = raw_cells.where("x1 is not null").join(s, ["cy", "cx"])
    side_of = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    a, b = (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))
    c, d = (F.col("s_x1"), F.col("s_y1")), (F.col("s_x2"), F.col("s_y2"))
    # on one line both products are 0: such segments meet only if their extents do
    extent = lambda p, q, i: (F.least(p[i], q[i]), F.greatest(p[i], q[i]))
    overlap = lambda i: (extent(a, b, i)[0] <= extent(c, d, i)[1]) & (extent(c, d, i)[0] <= extent(a, b, i)[1])
    crossing = (side_of(a, b, c) * side_of(a, b, d) <= 0) & (side_of(c, d, a) * side_of(c, d, b) <= 0) & overlap(0) & overlap(1)
    crossed = met.where(crossing).select("site", "poly")
    return raw_in_site.unionByName(site_in_raw).unionByName(crossed).distinct()


def site_metadata(joined: DataFrame) -> DataFrame:
    """Name and date of each site: plant-kind parts first, then the lowest index with a value; and the part count.

    joined: site, kind, name, start_date, idx.  Other parts supply values only where a site has no plant part.
    """
    plant = F.max(F.col("kind") == "plant")
    is_plant = F.col("kind") == "plant"
    out = joined.groupBy("site").agg(
        plant.alias("_has"), F.count("*").alias("n_parts"),
        *[F.min_by(c, F.when(is_plant & (F.col(c) != ""), F.col("idx"))).alias(f"_{c}_plant") for c in ("name", "start_date")],
        *[F.min_by(c, F.when(F.col(c) != "", F.col("idx"))).alias(f"_{c}_any") for c in ("name", "start_date")])
    choose = lambda c: F.coalesce(F.when(F.col("_has"), F.col(f"_{c}_plant")).otherwise(F.col(f"_{c}_any")), F.lit(""))
    return out.select("site", "n_parts", choose("name").alias("name"), choose("start_date").alias("start_date"))
