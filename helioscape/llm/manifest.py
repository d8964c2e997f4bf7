"""Merkle manifest of a table: a tree of digests per key, a tree over their roots, and a proof for every row.

Rows become leaves; the leaves of one key stand in order, and every 8 consecutive nodes become one until a single node, the
key's root, is left. The keys' roots form one more tree. All nodes go to an append log in the order in which they are
complete (postorder): a builder holds an aligned run of 4,096 leaves, so what it completes is one contiguous segment of the
log, and the place of any node follows from the sizes of the subtrees before it. Proofs read siblings by such places.

A builder's top node is a leaf of the next stage, which works alike, so 4,096 ** k leaves take k stages whatever the skew:
a key that holds all rows has as many builders as any other rows would.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.spark_support import join_same, stored

FAN = 8
#: Levels above the leaves that one builder completes; it holds FAN ** LEVELS leaves.
LEVELS = 4


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """Digest of a row: its fields one after the other."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def height(leaves: int, fan: int = FAN) -> int:
    """Levels above the leaves until one node is left."""
    found = 0
    while leaves > 1:
        leaves, found = -(-leaves // fan), found + 1
    return found


def before(leaves: int, levels: int, fan: int = FAN) -> int:
    """Nodes of the log that are complete before the leaf of this number, which begins a subtree."""
    return sum(leaves // fan**g for g in range(levels + 1))


def position(level: int, index: int, leaves: int, levels: int, fan: int = FAN) -> int:
    """Place in the log of node `index` of a level: what is complete before its first leaf, and its own subtree, which it ends."""
    first = index * fan**level
    width = min(fan**level, leaves - first)
    return before(first, levels, fan) + sum(-(-width // fan**g) for g in range(level + 1)) - 1


def append_log(leaves: list[str], levels: int, fan: int = FAN) -> list[str]:
    """All nodes of a run of leaves in completion order; the last leaf completes what is still open."""
    log: list[str] = []
    open_nodes: list[list[str]] = [[] for _ in range(levels + 1)]
    for i, node in enumerate(leaves):
        log.append(node)
        open_nodes[0].append(node)
        for h in range(1, levels + 1):
            if (i + 1) % fan**h and i + 1 < len(leaves):
                break
            node = digest("".join(open_nodes[h - 1]))
            open_nodes[h - 1].clear()
            log.append(node)
            open_nodes[h].append(node)
    return log


def run_siblings(log: list[str], leaves: int, levels: int, level: int, index: int, fan: int = FAN) -> tuple[str, str]:
    """Digests left and right of a node in its run, each concatenated."""
    run = index // fan * fan
    end = min(run + fan, -(-leaves // fan**level))
    node = lambda j: log[position(level, j, leaves, levels, fan)]
    return "".join(map(node, range(run, index))), "".join(map(node, range(index + 1, end)))


def segment_paths(log: list[str], leaves: int, levels: int) -> list[list[tuple[str, str]]]:
    """For every leaf of a segment its siblings level by level; nodes of one run share what stands above."""
    above: list[list[tuple[str, str]]] = [[]]
    for level in range(levels - 1, -1, -1):
        count = -(-leaves // FAN**level)
        above = [[run_siblings(log, leaves, levels, level, j), *above[j // FAN]] for j in range(count)]
    return above


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The root that follows from a leaf and its siblings."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def numbered(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds place (from 0) and leaves (their number) within each tree, in the given order, nulls first.

    One range shuffle; a tree may cover many partitions, whose sizes (a row per partition and tree) give the offsets.
    """
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged, "manifest-order").withColumn("_part", F.shiftright("_at", 33))
    counts = ranged.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    so_far = Window.partitionBy(tree).orderBy("_part")
    offsets = counts.select(tree, "_part", "_first", F.sum("_rows").over(so_far).alias("_upto"), "_rows",
                            F.sum("_rows").over(Window.partitionBy(tree)).alias("leaves"))
    placed = join_same(ranged, offsets, [tree, "_part"])
    return placed.withColumn("place", F.col("_at") - F.col("_first") + F.col("_upto") - F.col("_rows")) \
        .drop("_at", "_part", "_first", "_upto", "_rows")


_SEGMENT = T.StructType([
    T.StructField("tree", T.StringType()), T.StructField("segment", T.LongType()), T.StructField("leaves", T.LongType()),
    T.StructField("start", T.LongType()), T.StructField("log", T.ArrayType(T.StringType())),
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("claims", T.ArrayType(T.StringType()))])
_SEGMENT_ARROW = pa.schema([("tree", pa.string()), ("segment", pa.int64()), ("leaves", pa.int64()), ("start", pa.int64()),
                            ("log", pa.list_(pa.string())), ("ids", pa.list_(pa.int64())), ("claims", pa.list_(pa.string()))])


def _build(rows: pa.Table, levels: int) -> pa.Table:
    """One builder: an aligned run of leaves -> its segment of the log."""
    rows = rows.sort_by("place")
    leaves, segment = rows.column("leaves")[0].as_py(), rows.column("segment")[0].as_py()
    log = append_log(rows.column("leaf").to_pylist(), min(levels, height(leaves)))
    return pa.Table.from_pylist([{"tree": rows.column("tree")[0].as_py(), "segment": segment, "leaves": leaves, "start": before(segment * FAN**levels, height(leaves)),
                                  "log": log, "ids": rows.column("id").to_pylist(), "claims": rows.column("claim").to_pylist()}], _SEGMENT_ARROW)


def build_log(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Stages of log segments of a table (tree, place, leaves, leaf, id, claim); each stage is stored."""
    stages: list[DataFrame] = []
    while True:
        named = leaves.select("tree", "place", "leaves", "leaf", F.col("id").cast("long").alias("id"), "claim",
                              F.expr(f"place div {FAN**levels}").alias("segment"))
        built = stored(named.groupBy("tree", "segment").applyInArrow(lambda rows: _build(rows, levels), _SEGMENT), f"manifest-log-{len(stages)}")
        stages.append(built)
        open_trees = built.where(F.col("leaves") > FAN**levels)
        if open_trees.isEmpty():
            return stages
        top = F.element_at("log", -1)
        leaves = open_trees.select("tree", F.col("segment").alias("place"), F.ceil(F.col("leaves") / FAN**levels).cast("long").alias("leaves"),
                                   top.alias("leaf"), F.col("segment").alias("id"), top.alias("claim"))


def tree_roots(stages: list[DataFrame], levels: int) -> DataFrame:
    """tree, node: the last node of each tree's last segment."""
    ends = [s.where(F.col("leaves") <= FAN**levels).select("tree", F.element_at("log", -1).alias("node")) for s in stages]
    found = ends[0]
    for e in ends[1:]:
        found = found.unionByName(e)
    return found


_STEP = "array<struct<left:string,right:string>>"
_PATHS = f"tree string, id long, leaf string, claim string, path {_STEP}"


def _extract(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of segments with the path above them (column tail) -> a row per leaf with its whole path."""
    for batch in batches:
        for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            log, count = row["log"], len(row["ids"])
            levels = min(most, height(row["leaves"]))
            tail = [(s["left"], s["right"]) for s in row["tail"] or []]
            paths = segment_paths(log, count, levels)
            steps = [[{"left": a, "right": b} for a, b in p + tail] for p in paths]
            yield pa.RecordBatch.from_pydict({
                "tree": [row["tree"]] * count, "id": row["ids"], "leaf": [log[position(0, j, count, levels)] for j in range(count)],
                "claim": row["claims"], "path": steps}, schema=_path_schema())


def _path_schema() -> pa.Schema:
    step = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    return pa.schema([("tree", pa.string()), ("id", pa.int64()), ("leaf", pa.string()), ("claim", pa.string()), ("path", step)])


def with_tails(stages: list[DataFrame], outer: DataFrame | None, levels: int) -> DataFrame:
    """The first stage's segments with the path from each segment's top to the root; `outer` (tree, tail) goes on from a tree's root."""
    empty = F.array().cast(_STEP)
    upper: DataFrame | None = None
    for number in range(len(stages) - 1, -1, -1):
        segments = stages[number]
        last = segments.where(F.col("leaves") <= FAN**levels)
        last = join_same(last, outer, ["tree"]) if outer is not None else last.withColumn("tail", empty)
        if upper is not None:
            inner = segments.where(F.col("leaves") > FAN**levels)
            tails = upper.select("tree", F.col("id").alias("segment"), F.col("path").alias("tail"))
            last = last.unionByName(join_same(inner, tails, ["tree", "segment"]))
        if number == 0:
            return last
        upper = last.mapInArrow(partial(_extract, most=levels), _PATHS)
    raise AssertionError("a log has a stage")


@dataclass
class Manifest:
    """Log segments of the trees and of the tree over their roots, and (tree, subroot, root, tail) of every tree."""
    stages: list[DataFrame]
    top_stages: list[DataFrame]
    trees: DataFrame
    levels: int

    def proofs(self) -> DataFrame:
        """A row per leaf: id, tree, leaf, subroot, root, siblings (digests, level by level, left to right), folded (root that follows from the claim)."""
        segments = with_tails(self.stages, self.trees.select("tree", "tail"), self.levels)
        roots = self.trees.select("tree", "subroot", "root")
        return join_same(segments, roots, ["tree"]).mapInArrow(
            partial(_prove, most=self.levels), "id long, tree string, leaf string, subroot string, root string, siblings string, folded string")


_PROOF = pa.schema([(n, pa.int64() if n == "id" else pa.string()) for n in ("id", "tree", "leaf", "subroot", "root", "siblings", "folded")])


def _prove(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            log, count = row["log"], len(row["ids"])
            levels = min(most, height(row["leaves"]))
            tail = [(s["left"], s["right"]) for s in row["tail"]]
            over = "".join(a + b for a, b in tail)
            paths = segment_paths(log, count, levels)
            for first in range(0, count, 512):
                part = range(first, min(first + 512, count))
                yield pa.RecordBatch.from_pydict({
                    "id": [row["ids"][j] for j in part], "tree": [row["tree"]] * len(part),
                    "leaf": [log[position(0, j, count, levels)] for j in part],
                    "subroot": [row["subroot"]] * len(part), "root": [row["root"]] * len(part),
                    "siblings": ["".join(a + b for a, b in paths[j]) + over for j in part],
                    "folded": [fold(row["claims"][j], paths[j] + tail) for j in part]}, schema=_PROOF)


def build_manifest(df: DataFrame, id_col: str, tree_col: str, leaf_value: Column, claim_value: Column | None = None,
                   levels: int = LEVELS) -> Manifest:
    """Manifest of all rows of a table.

    Leaves of a tree stand by id, nulls first; rows that share an id (or have none) by their digest, so repeated rows are
    leaves side by side. A null key is a tree of its own and comes first. A claim is the leaf that a holder shows (default: the
    leaf itself) and is folded with the original siblings. `levels` is the height of a builder and never changes a result. An empty table has no tree and gives no row. Other columns are ignored.
    """
    spark: SparkSession = df.sparkSession
    rows = df.select(F.col(tree_col).cast("string").alias("tree"), F.col(id_col).cast("long").alias("id"), leaf_value.alias("leaf"),
                     (leaf_value if claim_value is None else claim_value).alias("claim"))
    stages = build_log(numbered(rows, "tree", ["id", "leaf"]), levels)
    roots = tree_roots(stages, levels)
    named = roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("node").alias("leaf"))
    placed = stored(numbered(named, "tree", ["key"]), "manifest-roots")
    top = build_log(placed.select("tree", "place", "leaves", "leaf", F.col("place").alias("id"), F.col("leaf").alias("claim")), levels)
    paths = with_tails(top, None, levels).mapInArrow(partial(_extract, most=levels), _PATHS).select(F.col("id").alias("place"), F.col("path").alias("tail"))
    over = tree_roots(top, levels).select(F.col("node").alias("root"))
    trees = placed.select(F.col("key").alias("tree"), "place", F.col("leaf").alias("subroot")).join(paths, "place").drop("place")
    known = over.head()
    trees = trees.withColumn("root", F.lit(known["root"] if known else None).cast("string"))
    return Manifest(stages, top, stored(trees, "manifest-trees"), levels)
