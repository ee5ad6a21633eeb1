"""Node maintenance of an R*-tree as set operations: bounding rectangles, subtree choice, split, reinsertion.

Node contents are bounded by the fan-out, so windows over one node hold few rows; many nodes are handled at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions import geometry as G

LOW, HIGH = ("x_min", "y_min"), ("x_max", "y_max")
#: Children of a node at most.
FAN_OUT = 1170
#: Share of a node's entries that a forced reinsertion takes out: one in so many.
EVICTED = 3


def _cols(names) -> list[F.Column]:
    return [F.col(n) for n in names]


def bounding_rectangles(entries: DataFrame, *keys: str) -> DataFrame:
    """keys, n and the bounding rectangle of points (x, y) or rectangles, per group (one row if no key)."""
    low, high = (LOW, HIGH) if "x_min" in entries.columns else (("x", "y"), ("x", "y"))
    sums = [F.count(F.lit(1)).alias("n"), F.min(low[0]).alias("x_min"), F.max(high[0]).alias("x_max"), F.min(low[1]).alias("y_min"), F.max(high[1]).alias("y_max")]
    return entries.groupBy(*keys).agg(*sums)


def sibling_list(nodes: DataFrame) -> DataFrame:
    """One row: ``nodes``, the list of (node_id, corners) of sibling nodes."""
    return nodes.agg(F.collect_list(F.struct("node_id", *LOW, *HIGH)).alias("nodes"))


def choose_subtree(points: DataFrame, nodes: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """id, node_id, enlargement: for each point the sibling node whose area grows least, the first if equal.

    ``nodes`` are the children of one node, at most ``fan_out`` of them (checked): their list is one row beside the points, and each
    point keeps the least growth only.  Points descend all levels of an index by ``PointIndex.choose_leaves``.
    """
    if nodes.count() > fan_out:
        raise ValueError(f"more than {fan_out} siblings: descend an index level by level")

    def growth(n: F.Column) -> F.Column:
        return F.struct(G.enlargement([n[c] for c in LOW], [n[c] for c in HIGH], _cols(("x", "y")), _cols(("x", "y"))).alias("enlargement"), n["node_id"].alias("node_id"))

    best = points.select("id", "x", "y").join(F.broadcast(sibling_list(nodes))).select("id", F.array_min(F.transform("nodes", growth)).alias("b"))  # one row
    return best.filter("b is not null").select("id", F.col("b.node_id").alias("node_id"), F.col("b.enlargement").alias("enlargement"))


def split(entries: DataFrame, least: int) -> DataFrame:
    """The R* split of overfull nodes.

    ``entries``: node_id, id and x_min, x_max, y_min, y_max (points: equal corners), M + 1 rows per node;
    ``least`` is the least number of entries of a half.  Result: node_id, axis, bound, cut (entries in the first
    half), then id and side (1 or 2) of every entry.

    Per axis entries are sorted twice, by their lower and by their upper ends (bound 0 and 1; the other end and the id decide
    between equals); a cut leaves at least ``least`` on both sides.
    The axis of least total margin over both orders wins (x if equal), on it the cut of least overlap, then least total area,
    then the first, by lower ends before upper ones.
    """
    orders = [(axis, bound, c, ends) for axis, c in ((0, "x"), (1, "y")) for bound, ends in ((0, ("min", "max")), (1, ("max", "min")))]
    rows = entries.withColumn("o", F.explode(F.array(*[F.struct(F.lit(axis).alias("axis"), F.lit(bound).alias("bound"), F.col(f"{c}_{ends[0]}").alias("first"), F.col(f"{c}_{ends[1]}").alias("second")) for axis, bound, c, ends in orders])))
    rows = rows.select("node_id", "id", *LOW, *HIGH, "o.axis", "o.bound", "o.first", "o.second")
    each = ("node_id", "axis", "bound")
    ordered = Window.partitionBy(*each).orderBy("first", "second", "id")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    # what follows, as what precedes in the opposite order: running minima, not one scan per row
    beyond = Window.partitionBy(*each).orderBy(F.desc("first"), F.desc("second"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    first = [F.min(c).over(upto).alias(f"a_{c}") for c in LOW] + [F.max(c).over(upto).alias(f"a_{c}") for c in HIGH]
    second = [F.min(c).over(beyond).alias(f"b_{c}") for c in LOW] + [F.max(c).over(beyond).alias(f"b_{c}") for c in HIGH]
    total = F.count(F.lit(1)).over(Window.partitionBy(*each)).alias("total")
    cuts = rows.select(*each, "id", F.row_number().over(ordered).alias("rank"), total, *first, *second)
    a, b = [_cols([f"{s}_{c}" for c in LOW]) for s in "ab"], [_cols([f"{s}_{c}" for c in HIGH]) for s in "ab"]
    scored = cuts.filter((F.col("rank") >= least) & (F.col("rank") <= F.col("total") - least)).select(
        *each, F.col("rank").alias("cut"), (G.margin(a[0], b[0]) + G.margin(a[1], b[1])).alias("margin"),
        G.overlap(a[0], b[0], a[1], b[1]).alias("overlap"), (G.area(a[0], b[0]) + G.area(a[1], b[1])).alias("area"),
    )
    axis = scored.groupBy("node_id", "axis").agg(F.sum("margin").alias("margin")).groupBy("node_id").agg(F.min(F.struct("margin", "axis")).alias("w")).select("node_id", F.col("w.axis").alias("axis"))
    cut = scored.join(axis, ["node_id", "axis"]).groupBy("node_id", "axis").agg(F.min(F.struct("overlap", "area", "bound", "cut")).alias("w")).select("node_id", "axis", F.col("w.bound").alias("bound"), F.col("w.cut").alias("cut"))
    sides = cuts.select(*each, "id", "rank").join(cut, list(each))
    return sides.select(*each, "cut", "id", F.when(F.col("rank") <= F.col("cut"), 1).otherwise(2).alias("side"))


def forced_reinsert(entries: DataFrame, share: int = EVICTED) -> DataFrame:
    """node_id, id, dist of the entries to take out: a third of each node, farthest from its rectangle's centre first."""
    whole = Window.partitionBy("node_id")
    mid = [(F.min(a).over(whole) + F.max(b).over(whole)) / 2 for a, b in zip(LOW, HIGH)]
    own = G.centre(_cols(LOW), _cols(HIGH))
    dist = F.sqrt((own[0] - F.col("mx")) * (own[0] - F.col("mx")) + (own[1] - F.col("my")) * (own[1] - F.col("my")))
    rows = entries.select("*", mid[0].alias("mx"), mid[1].alias("my"), F.count(F.lit(1)).over(whole).alias("n")).withColumn("dist", dist)
    rank = F.row_number().over(whole.orderBy(F.desc("dist"), "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= F.floor(F.col("n") / share)).select("node_id", "id", "dist")


def underfull(nodes: DataFrame, least: int) -> DataFrame:
    """Nodes (but the root) with fewer than ``least`` entries: what a deletion must dissolve."""
    return nodes.filter((F.col("n") < least) & F.col("parent_id").isNotNull())
