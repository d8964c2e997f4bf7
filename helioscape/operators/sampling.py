"""Reproducible sampling of labelled points.

Randomness is a hash of an id and the seed, never rand(): a retried task draws the same points.
"""
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import constants as K
from ..functions.geo import block_id, destination, merc_x, merc_y, segment_distance2
from ..functions.nulls import num
from .nearest import nearest_on_sphere, nearest_segment, split_segments
from .ordered import ordinal, top_n
from .polygons import attach_polygon, containing_polygons, polygon_cells, ring_area
from .spark_support import hash_fold, stored, uniform


def weighted_top(df: DataFrame, group: list[str], id_col: str, weight: Column, n: int) -> DataFrame:
    """Weighted sample without replacement: the n smallest of -ln(u)/w per group."""
    keyed = df.withColumn("_key", -F.log(uniform(F.col(id_col))) / weight)
    return top_n(keyed, group, ["_key", id_col], n, spread=id_col).drop("_key")


def first_n(df: DataFrame, id_col: str, n: int, salt: str) -> DataFrame:
    """n rows in hash order (a distributed top-n)."""
    return df.withColumn("_key", uniform(F.col(id_col), salt)).orderBy("_key", id_col).limit(n).drop("_key")


def far_from_plants(points: DataFrame, plants: DataFrame, point_id: str) -> DataFrame:
    """Points farther from the nearest plant than 1 km plus that plant's radius; all points where there is no plant.

    A point without coordinates is near nothing and stays. plants: plant_id, plat, plon, area_m2.
    """
    hit = nearest_on_sphere(points, plants, point_id, ["plant_id", "area_m2"], tlat="plat", tlon="plon")
    near = hit.where(F.col("km") <= num(1) + F.sqrt(F.col("area_m2") / num(math.pi)) / num(1000))
    return points.join(near.select(point_id), point_id, "left_anti")


def background_candidates(ids: DataFrame, id_col: str, south: float, north: float, west: float, east: float) -> DataFrame:
    """One area-uniform point per id inside a latitude band and longitude range."""
    s0, s1 = math.sin(math.radians(south)), math.sin(math.radians(north))
    lat = F.degrees(F.asin(num(s0) + uniform(F.col(id_col), "lat") * num(s1 - s0)))
    lon = num(west) + uniform(F.col(id_col), "lon") * num(east - west)
    return ids.select(id_col, F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


def _annulus_point(key: str) -> list[Column]:
    """lat, lon of a point 5-100 km from the row's (lat, lon), uniform over the annulus."""
    lo, hi = K.HARD_KM
    km = F.sqrt(num(lo ** 2) + uniform(F.col(key), "km") * num(hi ** 2 - lo ** 2))
    lat, lon = destination(F.col("lat"), F.col("lon"), uniform(F.col(key), "bearing") * 360, km)
    return [F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon")]


def hard_candidates(positives: DataFrame, id_col: str, per_point: int) -> DataFrame:
    """`per_point` points in the annulus around each positive."""
    tries = positives.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(per_point - 1)))) \
        .withColumn("cand_id", F.concat_ws("-", F.col(id_col).cast("string"), F.col("_k").cast("string")))
    return tries.select("cand_id", *_annulus_point("cand_id"))


def hard_draws(draws: DataFrame, id_col: str, positives: DataFrame, count: int) -> DataFrame:
    """One point per draw, in the annulus around a positive that each draw picks with equal chance.

    positives: pos (1 to count), lat, lon.
    """
    pos = (F.floor(uniform(F.col(id_col), "source") * count) + 1).cast("bigint")
    return draws.select(id_col, pos.alias("pos")).join(positives.select("pos", "lat", "lon"), "pos").select(id_col, *_annulus_point(id_col))


def numbered(points: DataFrame, id_col: str) -> tuple[DataFrame, int]:
    """Points with a position `pos` from 1 in the order of a unique numeric id, and how many there are."""
    placed = stored(ordinal(points, [], id_col, "pos"), "numbered")
    return placed, placed.count()


def _nth_smallest(ids: DataFrame, id_col: str, n: int, end: int, buckets: int = 1024) -> int:
    """The n-th smallest of unique ids in 0..end-1, by counts over ever narrower ranges; nothing is sorted."""
    low, width = 0, end
    while width > 1:
        step = -(-width // buckets)
        within = ids.where((F.col(id_col) >= low) & (F.col(id_col) < low + width))
        counts = within.groupBy(F.floor((F.col(id_col) - low) / step).alias("b")).count().collect()  # at most `buckets` rows
        for b, count in sorted((r["b"], r["count"]) for r in counts):
            if n <= count:
                break
            n -= count
        low, width = low + b * step, step
    return low


def sample_exact(spark: SparkSession, draw: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], wanted: int,
                 id_col: str = "draw", most: int = 10_000) -> DataFrame:
    """Rejection sampling to an exact count: the first `wanted` accepted draws in the order of their numbers.

    draw(ids) makes a candidate of every number in `id_col`, keep(candidates) leaves the accepted ones. A candidate depends
    on its number alone, so neither the sizes of the rounds nor retried tasks change the sample. Every round draws what is
    short times the inverse of the rate seen so far and is written once. wanted <= 0 gives no rows; where fewer than one of
    `most` draws is accepted, as on an empty land, ValueError instead of a short sample.
    """
    if wanted <= 0:
        return keep(draw(spark.range(0).withColumnRenamed("id", id_col)))
    parts, tried, have = [], 0, 0
    while have < wanted:
        if tried >= most * (have + 1):
            raise ValueError(f"{have} of {tried} draws accepted, {wanted} wanted")
        rate = (have + 1) / (tried + 1)
        batch = min(math.ceil(1.1 * (wanted - have) / rate) + 100, most * (have + 1) - tried)
        ids = spark.range(tried, tried + batch).withColumnRenamed("id", id_col)
        part = stored(keep(draw(ids)), "accepted")
        parts.append(part)
        have, tried = have + part.count(), tried + batch
    found = reduce(DataFrame.unionByName, parts)
    return found.where(F.col(id_col) <= _nth_smallest(found, id_col, wanted, tried))


def assign_region(points: DataFrame, borders: DataFrame, cell: float, point_id: str, piece: float = 50_000.0) -> DataFrame:
    """Adds poly and region: the smallest polygon that contains the point, else that of the nearest outline (Mercator metres).

    borders: poly, region, role, ring and edges in degrees. A point without coordinates, or without any polygon, has nulls.
    """
    placed = stored(attach_polygon(points, borders, cell, point_id), "placed")
    flat = borders.select("poly", merc_x(F.col("x1")).alias("x1"), merc_y(F.col("y1")).alias("y1"), merc_x(F.col("x2")).alias("x2"), merc_y(F.col("y2")).alias("y2"))
    missed = placed.where("poly is null and lat is not null and lon is not null").select(point_id, merc_x(F.col("lon")).alias("x"), merc_y(F.col("lat")).alias("y"))
    near = nearest_segment(missed, split_segments(flat, piece), point_id, ["poly"]).select(point_id, F.col("poly").alias("_near"))
    names = borders.groupBy("poly").agg(F.min("region").alias("region"))
    return placed.join(near, point_id, "left").withColumn("poly", F.coalesce("poly", "_near")).drop("_near").join(names, "poly", "left")


def select_positives(plants: DataFrame, borders: DataFrame, cell: float, most: int = K.MAX_POSITIVES_PER_REGION) -> DataFrame:
    """Plants with lat, lon and the region they lie in: at most `most` a region, large ones favoured (weight: root of the area)."""
    placed = assign_region(plants, borders, cell, "plant_id")
    return weighted_top(placed, ["region"], "plant_id", F.sqrt("area_m2"), most)


def accept(candidates: DataFrame, id_col: str, land: DataFrame, cell: float, plants: DataFrame) -> DataFrame:
    """Candidates on land and far from every plant's surroundings. land: `polygon_cells` of the land, made once for all rounds."""
    inside = containing_polygons(candidates, land, cell, id_col).select(id_col).distinct()
    on_land = stored(candidates.join(inside, id_col, "left_semi"), "on_land")  # read three times below
    return far_from_plants(on_land, plants, id_col)


def interior_points(edges: DataFrame, per_polygon: Column, edge_m: float, tries: int = 12) -> DataFrame:
    """Points inside each polygon, as many as `per_polygon` asks (a column over `area`); (poly, rn, x, y, margin).

    Each wanted point has `tries` candidates. A candidate lies on a random horizontal line, in one of the stretches
    that the polygon covers there, so thin and slanted polygons lose none; candidates are drawn with a chance in
    proportion to what their line covers, which spreads them evenly over the area. Points `edge_m` from all edges
    come first, others fill up. A polygon without any such point has one, its candidate farthest from the edges.
    edges: poly, x1, y1, x2, y2 and, where there are holes, ring and role.
    """
    ringed = edges if "ring" in edges.columns else edges.withColumns({"ring": F.lit(0), "role": F.lit("outer")})
    box = edges.groupBy("poly").agg(F.min("x1").alias("x0"), F.max("x1").alias("xm"), F.min("y1").alias("y0"), F.max("y1").alias("ym"))
    box = box.join(ring_area(ringed), "poly").withColumn("n", per_polygon)
    lines = box.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") * tries)))
    draw = lambda salt, *more: uniform(F.concat_ws("-", F.col("poly").cast("string"), F.col("k").cast("string"), *more), salt)
    lines = lines.select("poly", "k", "n", (F.col("y0") + draw("y") * (F.col("ym") - F.col("y0"))).alias("py"))
    sides = edges.select("poly", "x1", "y1", "x2", "y2")
    at = F.col("x1") + (F.col("py") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    met = lines.join(sides, "poly").where((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))).select("poly", "k", "n", "py", at.alias("x"))
    order = W.partitionBy("poly", "k").orderBy("x")
    runs = met.withColumns({"pos": F.row_number().over(order), "next": F.lead("x").over(order)}).where("pos % 2 = 1 and next > x")
    race = -F.log(draw("run", F.col("pos").cast("string"))) / (F.col("next") - F.col("x"))
    chosen = runs.groupBy("poly", "k", "n", "py").agg(F.min_by(F.struct("x", "next"), race).alias("r"), F.sum(F.col("next") - F.col("x")).alias("cover"))
    cand = chosen.select("poly", "k", "n", "py", (F.col("r.x") + draw("x") * (F.col("r.next") - F.col("r.x"))).alias("px"), (-F.log(draw("rank")) / F.col("cover")).alias("race"))
    d2 = segment_distance2(F.col("px"), F.col("py"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    tested = cand.join(sides, "poly").groupBy("poly", "k", "n", "px", "py", "race").agg(F.sqrt(F.min(d2)).alias("margin"))
    tested = tested.withColumn("shallow", F.col("margin") < num(edge_m))
    ranked = top_n(tested, ["poly"], ["shallow", "race", "k"], K.MAX_POINTS_PER_POLYGON, spread="k", rank="rn").where("rn <= n")
    deep = tested.groupBy("poly").agg(F.min("shallow").alias("narrow"), F.max(F.struct("margin", "px", "py")).alias("m"))
    wide = ranked.join(deep.where("not narrow").select("poly"), "poly", "left_semi").select("poly", "rn", "px", "py", "margin")
    narrow = deep.where("narrow").select("poly", F.lit(1).alias("rn"), "m.px", "m.py", "m.margin")
    drawn = wide.unionByName(narrow)
    missed = box.join(deep.select("poly"), "poly", "left_anti")
    return drawn.unionByName(_representative(edges, missed)).withColumnsRenamed({"px": "x", "py": "y"})


def _representative(edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """A point surely inside each polygon: middle of its widest stretch along a horizontal line."""
    line = F.col("y0") + num(0.4871236) * (F.col("ym") - F.col("y0"))
    met = edges.join(boxes.select("poly", line.alias("py")), "poly").where((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py")))
    at = F.col("x1") + (F.col("py") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    order = W.partitionBy("poly").orderBy("x")
    runs = met.select("poly", "py", at.alias("x")).withColumns({"pos": F.row_number().over(order), "next": F.lead("x").over(order)})
    best = runs.where("pos % 2 = 1").groupBy("poly").agg(
        F.max_by(F.struct("x", "next", "py"), F.col("next") - F.col("x")).alias("b"))
    return best.select("poly", F.lit(1).alias("rn"), ((F.col("b.x") + F.col("b.next")) / 2).alias("px"), F.col("b.py").alias("py"),
                       F.lit(None).cast("double").alias("margin"))


def points_per_area(area: Column, per_ha: float = K.POINTS_PER_HA) -> Column:
    n = F.bround(area / num(10_000) * num(per_ha), 0)
    return F.least(F.greatest(n, F.lit(1)), F.lit(K.MAX_POINTS_PER_POLYGON)).cast("int")


def outside_buffer(points: DataFrame, edges: DataFrame, point_id: str, metres: float, cell: float,
                   x: str = "x", y: str = "y", piece: float = 1000.0) -> DataFrame:
    """Points neither inside a polygon nor within `metres` of an edge."""
    inside = containing_polygons(points, polygon_cells(edges, cell), cell, point_id, x, y)
    near = nearest_segment(points, split_segments(edges.select("poly", "x1", "y1", "x2", "y2"), piece), point_id, ["poly"], x, y)
    return points.join(inside.select(point_id).distinct(), point_id, "left_anti") \
        .join(near.where(F.col("distance") <= num(metres)).select(point_id), point_id, "left_anti")


def stratified_fold(df: DataFrame, group: str, label: str, folds: int = 5) -> DataFrame:
    """Fold per group within its class (`test` is fold 0).  A group never splits."""
    stratum = df.groupBy(group).agg(F.max(label).alias("_y")).withColumn(
        "fold", hash_fold(F.concat_ws("|", F.col("_y").cast("string"), F.col(group).cast("string")), folds))
    return df.join(stratum.select(group, "fold"), group).withColumn("is_test", F.col("fold") == 0)


def group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    return df.withColumn("fold", hash_fold(F.col(group), folds))


def with_blocks(df: DataFrame, step: float = 2.0) -> DataFrame:
    return df.withColumn("group_id", block_id(F.col("lat"), F.col("lon"), step))
