"""Exact nearest neighbour as equi-joins down a packed tree of boxes.

Targets are sorted by Morton code of their place and cut into runs of a fixed number; a run is a leaf, 16 consecutive
nodes are one node of the next level. A leaf therefore holds at most that number of targets and a node at most 16 children,
whether the targets are spread out, lie in a clump or on a ring, or share one midpoint. Leaves are packed, not cells, so
nothing has to be refined. Every distinct query place starts at the few top nodes and goes down level by level, keeping the
nodes whose box is no farther than the best upper bound that the place knows; then it meets the targets of the leaves left.
"""
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geo import chord_km, segment_distance2, unit_xyz
from ..functions.nulls import num
from .spark_support import stored

#: Targets of a leaf, and children of a node as a power of two.
LEAF = 16
FAN_BITS = 4
SLACK = 1e-9


def _morton(dims: list[str], origin: list[float], width: float) -> Column:
    """Interleaved bits of the scaled coordinates: places with a long common prefix lie in one small cell."""
    count = len(dims)
    bits = 62 // count
    code = F.lit(0).cast("bigint")
    for i, (d, o) in enumerate(zip(dims, origin)):
        x = F.floor((F.col(d) - num(o)) * num(((1 << bits) - 1) / width)).cast("bigint")
        block = 1 << (bits - 1).bit_length() - 1
        while block:  # move halves of every block apart
            mask = sum(((1 << block) - 1) << (k * block * count) for k in range(64 // (block * count) + 1)) & (1 << 63) - 1
            x = x.bitwiseOR(F.shiftleft(x, block * (count - 1))).bitwiseAND(F.lit(mask))
            block //= 2
        code = code.bitwiseOR(F.shiftleft(x, i))
    return code


class PackedTree:
    """Targets with the number of their leaf, and the boxes of all nodes by level; both are written once."""

    def __init__(self, targets: DataFrame, dims: list[str], lo: list[str], hi: list[str], leaf: int, extent: tuple[list[float], float]):
        self.dims = dims
        ranged = targets.withColumn("_code", _morton(dims, *extent)).repartitionByRange("_code").sortWithinPartitions("_code")
        kept = stored(ranged.drop("_code").withColumn("_at", F.monotonically_increasing_id()), "nearest-targets")
        kept = kept.withColumn("_part", F.shiftright("_at", 33)).withColumn("_run", F.expr(f"(_at & {(1 << 33) - 1}) div {leaf}"))
        # leaves are numbered through all partitions: one row a partition
        counts = kept.groupBy("_part").agg((F.max("_run") + 1).alias("runs")).orderBy("_part").collect()
        first, offsets = 0, []
        for r in counts:
            offsets += [first] * (r["_part"] + 1 - len(offsets))
            first += r["runs"]
        self.leaves = first
        began = F.element_at(F.lit(offsets or [0]).cast("array<bigint>"), F.col("_part").cast("int") + 1)
        self.targets = kept.withColumn("_leaf", began + F.col("_run")).drop("_at", "_part", "_run")
        self.height = 0
        while first > 1 << FAN_BITS:
            first, self.height = -(-first // (1 << FAN_BITS)), self.height + 1
        self.bounds = [f"{side}{i}" for i in range(len(dims)) for side in "be"]
        low = [F.min(c).alias(f"b{i}") for i, c in enumerate(lo)] + [F.max(c).alias(f"e{i}") for i, c in enumerate(hi)]
        boxes = self.targets.groupBy("_leaf").agg(*low)
        levels = boxes.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(self.height)))) \
            .withColumn("node", F.expr(f"shiftright(_leaf, level * {FAN_BITS})"))
        up = [(F.min if c[0] == "b" else F.max)(c).alias(c) for c in self.bounds]
        self.nodes = stored(levels.groupBy("level", "node").agg(*up), "nearest-nodes")

    def candidates(self, places: DataFrame, tolerance: float) -> DataFrame:
        """(dims, _leaf): the leaves that can hold the nearest target of a place."""
        top = self.nodes.where(F.col("level") == self.height).orderBy("node").collect()  # at most 16
        roots = F.array(*[F.struct(F.lit(r["node"]).alias("node"), *[F.lit(r[c]).alias(c) for c in self.bounds]) for r in top])
        found = places.select(*self.dims, F.explode(roots).alias("_r")).select(*self.dims, "_r.*")
        near = " + ".join(f"pow(greatest(b{i} - `{d}`, `{d}` - e{i}, 0D), 2)" for i, d in enumerate(self.dims))
        # a target touches every face of a box: one is no farther than the far end of the nearer face of any axis
        face = lambda i, d, k: f"pow({'least' if i == k else 'greatest'}(abs(`{d}` - b{i}), abs(e{i} - `{d}`)), 2)"
        ends = [" + ".join(face(i, d, k) for i, d in enumerate(self.dims)) for k in range(len(self.dims))]
        far = f"least({', '.join(ends)})"
        for level in range(self.height, -1, -1):
            if level < self.height:
                children = self.nodes.where(F.col("level") == level).select(F.expr(f"shiftright(node, {FAN_BITS})").alias("_up"), "node", *self.bounds)
                found = found.join(children, F.col("_at") == F.col("_up"))
            met = found.select(*self.dims, F.col("node").alias("_at"), F.expr(f"sqrt({near})").alias("_near"), F.expr(f"sqrt({far})").alias("_far"))
            bound = F.min("_far").over(W.partitionBy(*self.dims))
            found = met.withColumn("_best", bound).where(F.col("_near") <= F.col("_best") * num(1 + SLACK) + num(tolerance)).select(*self.dims, "_at")
        return found.withColumnRenamed("_at", "_leaf")


def nearest(points: DataFrame, targets: DataFrame, dims: list[str], point_id: str, target_cols: list[str],
            distance2: Callable[[Callable[[str], Column]], Column] | None = None, box: tuple[list[str], list[str]] | None = None,
            leaf: int = LEAF, digits: int = 9, extent: tuple[list[float], float] | None = None) -> DataFrame:
    """(point_id, *target_cols, distance) of the nearest target; ties go to the smallest target_cols.

    `points` has point_id and `dims`; `targets` has `dims` and target_cols.  Targets with an extent pass the
    columns of their box and `distance2(t)`, the exact squared distance between point columns and t(name).
    `extent` (origin and width) saves the pass that finds it. Points and targets without a place (null, NaN) are left out;
    repeated points are repeated; without targets nothing is returned.
    """
    lo, hi = box or (dims, dims)
    there = lambda df: df.where(" and ".join(f"`{d}` is not null and not isnan(`{d}`)" for d in dims))
    targets = there(targets)
    if extent is None:
        row = targets.agg(*[F.min(d).alias(f"lo{i}") for i, d in enumerate(dims)], *[F.max(d).alias(f"hi{i}") for i, d in enumerate(dims)]).first()
        origin = [row[f"lo{i}"] or 0.0 for i in range(len(dims))]
        extent = origin, max((row[f"hi{i}"] or 0.0) - o for i, o in enumerate(origin)) or 1.0
    if box is None:
        # of several targets at one place only the smallest can win
        targets = targets.groupBy(*dims).agg(*[F.min(F.struct(*target_cols)).alias("_t")] if target_cols else [F.count("*").alias("_c")]) \
            .select(*dims, *[F.col("_t")[c].alias(c) for c in target_cols])
    tree = PackedTree(targets, dims, lo, hi, leaf, extent)
    asked = there(points.select(point_id, *dims))
    if not tree.leaves:
        kinds = {f.name: f.dataType for f in targets.schema.fields}
        return asked.where("false").select(point_id, *[F.lit(None).cast(kinds[c]).alias(c) for c in target_cols], F.lit(None).cast("double").alias("distance"))
    scale = float(10 ** digits)
    leaves = tree.candidates(asked.select(*dims).distinct(), 2 / scale)
    # a leaf's few targets travel as one row
    lists = tree.targets.groupBy("_leaf").agg(F.collect_list(F.struct(*[c for c in tree.targets.columns if c != "_leaf"])).alias("_list"))

    def hit(t):
        if distance2 is None:
            d2 = num(0)
            for d in dims:
                delta = F.col(d) - t[d]
                d2 = d2 + delta * delta
        else:
            d2 = distance2(lambda name: t[name])
        return F.struct(F.rint(F.sqrt(d2) * num(scale)).alias("d"), *[t[c].alias(c) for c in target_cols])

    met = leaves.join(lists, "_leaf").select(*dims, F.array_min(F.transform("_list", hit)).alias("_hit"))
    best = met.groupBy(*dims).agg(F.min("_hit").alias("_hit"))
    return asked.join(best, dims).select(point_id, *[F.col("_hit")[c].alias(c) for c in target_cols], (F.col("_hit")["d"] / num(scale)).alias("distance"))


def nearest_on_sphere(points: DataFrame, targets: DataFrame, point_id: str, target_cols: list[str],
                      lat: str = "lat", lon: str = "lon", tlat: str = "lat", tlon: str = "lon",
                      leaf: int = LEAF) -> DataFrame:
    """Great-circle nearest target and its distance in km (valid across dateline and poles)."""
    dims = ["ux", "uy", "uz"]
    p = points.select(point_id, *[c.alias(d) for c, d in zip(unit_xyz(F.col(lat), F.col(lon)), dims)])
    t = targets.select(*target_cols, *[c.alias(d) for c, d in zip(unit_xyz(F.col(tlat), F.col(tlon)), dims)])
    hit = nearest(p, t, dims, point_id, target_cols, leaf=leaf, digits=12, extent=([-1.0] * 3, 2.0))
    return hit.withColumn("km", chord_km(F.col("distance"))).drop("distance")


def nearest_segment(points: DataFrame, segments: DataFrame, point_id: str, target_cols: list[str],
                    x: str = "x", y: str = "y", leaf: int = LEAF) -> DataFrame:
    """Planar distance to the nearest segment (x1, y1, x2, y2)."""
    p = points.select(point_id, F.col(x).alias("cx"), F.col(y).alias("cy"))
    # copies of a segment, in either direction, are one target: only the smallest can win
    ends = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    low, high = F.least(*ends), F.greatest(*ends)
    once = segments.groupBy(low["x"].alias("x1"), low["y"].alias("y1"), high["x"].alias("x2"), high["y"].alias("y2")) \
        .agg(F.min(F.struct(*target_cols)).alias("_t")).select("x1", "y1", "x2", "y2", *[F.col("_t")[c].alias(c) for c in target_cols])
    s = once.withColumns({
        "cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2,
        "xa": F.least("x1", "x2"), "xb": F.greatest("x1", "x2"), "ya": F.least("y1", "y2"), "yb": F.greatest("y1", "y2")})
    return nearest(p, s, ["cx", "cy"], point_id, target_cols, box=(["xa", "ya"], ["xb", "yb"]), leaf=leaf, digits=6,
                   distance2=lambda t: segment_distance2(F.col("cx"), F.col("cy"), t("x1"), t("y1"), t("x2"), t("y2")))


def split_segments(segments: DataFrame, step: float) -> DataFrame:
    """Cut segments into equal pieces no longer than `step`, so the boxes of their cells stay tight."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    pieces = F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy) / num(step))).cast("int")
    cut = segments.withColumn("_n", pieces).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    a, b = F.col("_i") / F.col("_n"), (F.col("_i") + 1) / F.col("_n")
    return cut.select(*[c for c in segments.columns if c not in ("x1", "y1", "x2", "y2")],
                      (F.col("x1") + a * dx).alias("x1"), (F.col("y1") + a * dy).alias("y1"),
                      (F.col("x1") + b * dx).alias("x2"), (F.col("y1") + b * dy).alias("y2"))


def distance_index(points: DataFrame, layers: dict[str, DataFrame], point_id: str) -> DataFrame:
    """Kilometres from each point to the nearest vertex of each layer (x, y in metres), one column per layer.

    The layers' indexes are independent, so their jobs are submitted together.
    """
    def one(item):
        name, vertices = item
        hit = nearest(points, vertices.select("x", "y"), ["x", "y"], point_id, [], digits=6)
        return hit.select(point_id, (F.col("distance") / 1000).alias(name))

    with ThreadPoolExecutor(max_workers=len(layers)) as pool:
        hits = list(pool.map(one, layers.items()))
    out = points.select(point_id)
    for hit in hits:
        out = out.join(hit, point_id, "left")
    return out
