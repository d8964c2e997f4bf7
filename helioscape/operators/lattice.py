"""Regular lattices and interpolation on them."""
import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.nulls import num
from .polygons import containing_polygons, polygon_cells
from .shaping import assign_ids
from .spark_support import growing


def cell_centres(bounds: DataFrame, step: float) -> DataFrame:
    """Centres lo + step/2 ... < hi of each row's box (south, north, west, east), one output row per centre.

    Rows are generated first and spread over tasks, columns after that.
    """
    n_rows = F.ceil((F.col("north") - F.col("south")) / num(step) - num(0.5)).cast("int")
    n_cols = F.ceil((F.col("east") - F.col("west")) / num(step) - num(0.5)).cast("int")
    rows = bounds.where((n_rows > 0) & (n_cols > 0)).withColumn("i", F.explode(F.sequence(F.lit(0), n_rows - 1))) \
        .repartition("i", *[c for c in bounds.columns if c not in ("south", "north", "west", "east")][:1])
    grid = rows.withColumn("j", F.explode(F.sequence(F.lit(0), n_cols - 1)))
    return grid.withColumns({"lat": F.round(F.col("south") + num(step / 2) + F.col("i") * num(step), 4),
                             "lon": F.round(F.col("west") + num(step / 2) + F.col("j") * num(step), 4)}) \
        .drop("south", "north", "west", "east")


def land_cells(borders: DataFrame, step: float, band: tuple[float, float] = K.LATITUDE_BAND) -> DataFrame:
    """(poly, lat, lon, pid): centres of one global lattice that lie in a polygon, numbered by latitude, then longitude.

    The lattice starts at the south of the latitude band and at -180 degrees, whatever the polygons; a centre inside
    several polygons belongs to the smallest poly. borders: edges (poly, x1, y1, x2, y2) in degrees.
    """
    # centres lo + step / 2, lo + 3 step / 2, ... below hi
    n_rows, n_cols = (math.ceil((hi - lo) / step - 0.5 - 1e-9) for lo, hi in (band, (-180, 180)))
    south = band[0]
    first = lambda lo, start: F.greatest(F.ceil((lo - num(start)) / num(step) - num(0.5)), F.lit(0)).cast("int")
    last = lambda hi, start, count: F.least(F.floor((hi - num(start)) / num(step) - num(0.5)), F.lit(count - 1)).cast("int")
    boxes = borders.groupBy("poly").agg(first(F.min("y1"), south).alias("i0"), last(F.max("y1"), south, n_rows).alias("i1"),
                                        first(F.min("x1"), -180).alias("j0"), last(F.max("x1"), -180, n_cols).alias("j1"))
    rows = boxes.where("i0 <= i1 and j0 <= j1").withColumn("i", F.explode(F.sequence("i0", "i1"))).repartition("i")
    cells = rows.select("i", F.explode(F.sequence("j0", "j1")).alias("j")).distinct()
    order = F.col("i").cast("long") * n_cols + F.col("j")
    grid = cells.select(order.alias("cid"), F.round(num(south + step / 2) + F.col("i") * num(step), 4).alias("lat"),
                        F.round(num(-180 + step / 2) + F.col("j") * num(step), 4).alias("lon"))
    found = containing_polygons(grid, polygon_cells(borders, step), step, "cid")
    land = grid.join(found.groupBy("cid").agg(F.min("poly").alias("poly")), "cid")
    return assign_ids(land, "cid", f"C{str(step).replace('.', '')}_").select("poly", "lat", "lon", "pid")


def padded_nodes(bounds: DataFrame, step: float) -> DataFrame:
    """Nodes covering each box with one extra step on every side, aligned to multiples of step."""
    def count(lo, hi):
        start = F.floor(F.col(lo) / num(step)) * num(step) - num(step)
        return F.ceil((F.col(hi) + num(2 * step) - start) / num(step) - num(1e-9)).cast("int"), start
    n_rows, south = count("south", "north")
    n_cols, west = count("west", "east")
    rows = bounds.withColumn("i", F.explode(F.sequence(F.lit(0), n_rows - 1))).repartition("i")
    grid = rows.withColumn("j", F.explode(F.sequence(F.lit(0), n_cols - 1)))
    return grid.withColumns({"lat": F.round(south + F.col("i") * num(step), 2), "lon": F.round(west + F.col("j") * num(step), 2)}) \
        .drop("south", "north", "west", "east", "i", "j")


def corner_cells(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Per lattice cell (r, c) its four corner values, named <v>00, <v>01, <v>10, <v>11 (row, column)."""
    around = nodes.select("r", "c", *values, F.explode(F.array(*[
        F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (0, 1) for dc in (0, 1)])).alias("o"))
    cell = around.select((F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"), "o", *values)
    aggs = [F.max(F.when((F.col("o.dr") == dr) & (F.col("o.dc") == dc), F.col(v))).alias(f"{v}{dr}{dc}")
            for v in values for dr in (0, 1) for dc in (0, 1)]
    return cell.groupBy("r", "c").agg(*aggs)


def bilinear(points: DataFrame, cells: DataFrame, scalars: list[str], arrays: list[str], lat0: float, dlat: float,
             nrows: int, lon0: float, dlon: float, ncols: int) -> DataFrame:
    """Interpolate corner cells at points; outside the lattice the edge interval is extended linearly.

    Points are moved once: the four corners were gathered per cell beforehand.
    """
    fr, fc = (F.col("lat") - num(lat0)) / num(dlat), (F.col("lon") - num(lon0)) / num(dlon)
    clip = lambda x, n: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(n - 2)).cast("int")
    keyed = points.withColumns({"r": clip(fr, nrows), "c": clip(fc, ncols)}) \
        .withColumns({"_wr": fr - F.col("r"), "_wc": fc - F.col("c")})
    met = keyed.join(growing(cells), ["r", "c"], "left")
    wr, wc = F.col("_wr"), F.col("_wc")
    weights = {"00": (1 - wr) * (1 - wc), "01": (1 - wr) * wc, "10": wr * (1 - wc), "11": wr * wc}
    out = [sum((F.col(f"{v}{k}") * w for k, w in weights.items()), num(0)).alias(v) for v in scalars]
    for v in arrays:
        mixed = None
        for k, w in weights.items():
            part = F.transform(F.col(f"{v}{k}"), _times(w))
            mixed = part if mixed is None else F.zip_with(mixed, part, lambda a, b: a + b)
        out.append(mixed.alias(v))
    return met.select(*points.columns, *out)


def _times(w: Column):
    return lambda x: x * w


def source_tiles(df: DataFrame, south: float, north: float, west: float, east: float, nx: int, ny: int,
                 pad: float = 0.0) -> DataFrame:
    """Tile number of each element; extents are closed, so the far edge belongs to the last tile."""
    tx = F.least(F.expr(f"width_bucket(lon, double('{west - pad}'), double('{east + pad}'), {nx})"), F.lit(nx))
    ty = F.least(F.expr(f"width_bucket(lat, double('{south - pad}'), double('{north + pad}'), {ny})"), F.lit(ny))
    inside = F.col("lat").between(south - pad, north + pad) & F.col("lon").between(west - pad, east + pad)
    return df.where(inside).withColumns({"tx": tx.cast("int") - 1, "ty": ty.cast("int") - 1})
