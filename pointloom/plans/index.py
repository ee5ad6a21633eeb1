"""The Z-ordered packed index: bulk load, persistence and pruned queries.

``layout`` holds the points with z and leaf_id, written in Z-order so that row groups are compact
rectangles; ``nodes`` holds every node's rectangle per level (0 = leaves); ``meta`` is one row.  Queries are right
without the index; it only narrows what is read.

Changes go to a delta: ``added`` points stand beside the layout, ``gone`` holds the ids and coordinates of points taken out
of it, and queries read all three.  Once the changes pass ``DELTA_SHARE`` of the points the index is packed anew by one sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.functions import geometry as G
from pointloom.functions.zorder import scaled_z
from pointloom.operators import search
from pointloom.operators.changes import delete as delete_points
from pointloom.operators.maintenance import bounding_rectangles
from pointloom.operators.skyline import skyline_2d
from pointloom.plans.storage import materialise, number_rows

#: Entries per node at most, their least share, and the share filled by bulk loading.
MOST, LEAST_SHARE, FILL = 1170, 0.4, 0.85
#: Node rows looked at on one machine (the bound of collected and windowed node tables).
NODE_BOUND = 20_000
#: Leaf ranges pushed into the scan at most; beyond, leaves are joined.
RANGE_BOUND = 500
#: Changes, as a share of the packed points, from which on the index is packed anew.
DELTA_SHARE = 0.05
#: Rows of a delta that are broadcast at most.
DELTA_BROADCAST = 200_000
LOW, HIGH = ("x_min", "y_min"), ("x_max", "y_max")
POINT, KEY = ("id", "name", "x", "y"), ("id", "x", "y")
NODE_SCHEMA = "level int, node_id long, parent_id long, n long, points long, x_min double, x_max double, y_min double, y_max double"


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in names]


def capacity(most: int = MOST, fill: float = FILL) -> int:
    """Entries a bulk-loaded node gets, rounded up."""
    return -int(-most * fill // 1)


def with_z(points: DataFrame) -> DataFrame:
    """``points`` with z, scaled to their own extent (one row, joined without a key)."""
    extent = bounding_rectangles(points).select(*LOW, *HIGH)
    return points.join(F.broadcast(extent)).withColumn("z", scaled_z(_cols(("x", "y")), _cols(LOW), _cols(HIGH))).drop(*LOW, *HIGH)  # one row


def leaf_of(rank: Column, count: int, most: int, cap: int, least: int) -> Column:
    """Leaf number of the rank-th point (from 0) of ``count``.

    Leaves take ``cap`` points in turn; if that leaves an underfull last one, all points are spread evenly over as
    many leaves instead (the first ones get one more), which keeps every leaf between least and most.
    """
    if count > cap and 0 < count % cap < least:
        leaves = -(-count // cap)
        small, larger = divmod(count, leaves)
        head = larger * (small + 1)
        return F.when(rank < head, F.floor(rank / (small + 1))).otherwise(larger + F.floor((rank - head) / small)).cast("long")
    return F.floor(rank / cap).cast("long")


def pack(points: DataFrame, most: int = MOST, fill: float = FILL) -> DataFrame:
    """The layout: points with z and leaf_id, in order of (z, id)."""
    fixed = number_rows(with_z(points), ["z", "id"], "__rank")
    leaf = leaf_of(F.col("__rank"), fixed.count(), most, capacity(most, fill), int(most * LEAST_SHARE))
    return fixed.withColumn("leaf_id", leaf).drop("__rank")


def levels(layout: DataFrame, cap: int) -> DataFrame:
    """All nodes, leaves to root; one small aggregation per level."""
    spark = layout.sparkSession
    now = materialise(bounding_rectangles(layout, "leaf_id").withColumnRenamed("leaf_id", "node_id").withColumn("points", F.col("n")), "nodes")
    count, level, out = now.count(), 0, spark.createDataFrame([], NODE_SCHEMA)
    while count:
        parent = F.floor(F.col("node_id") / cap).cast("long") if count > 1 else F.lit(None).cast("long")
        named = now.select(F.lit(level).alias("level"), "node_id", parent.alias("parent_id"), "n", "points", "x_min", "x_max", "y_min", "y_max")
        out = out.unionByName(named)
        if count == 1:
            break
        up = bounding_rectangles(named, "parent_id").join(named.groupBy("parent_id").agg(F.sum("points").alias("points")), "parent_id")
        now = materialise(up.withColumnRenamed("parent_id", "node_id"), "nodes")
        count, level = -(-count // cap), level + 1
    return materialise(out, "all-nodes")


@dataclass
class PointIndex:
    layout: DataFrame
    nodes: DataFrame
    most: int
    fill: float
    points: int
    height: int
    added: DataFrame | None = None
    gone: DataFrame | None = None
    n_added: int = 0
    n_gone: int = 0

    # ---- building and storing ----

    @classmethod
    def build(cls, points: DataFrame, most: int = MOST, fill: float = FILL) -> PointIndex:
        """Bulk load."""
        layout = materialise(pack(points, most, fill), "layout")
        nodes = levels(layout, capacity(most, fill))
        top = nodes.agg(F.max("level")).first()[0]
        return cls(layout, nodes, most, fill, layout.count(), 0 if top is None else top + 1)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Store layout, nodes and meta; an index with a delta is packed first."""
        if self.n_added or self.n_gone:
            return self.compact().save(path, mode)
        spark = self.layout.sparkSession
        self.layout.write.mode(mode).parquet(f"{path}/layout")
        self.nodes.write.mode(mode).parquet(f"{path}/nodes")
        meta = [(self.most, self.fill, self.points, self.height)]
        spark.createDataFrame(meta, "most int, fill double, points long, height int").coalesce(1).write.mode(mode).parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PointIndex:
        m = spark.read.parquet(f"{path}/meta").first()
        return cls(spark.read.parquet(f"{path}/layout"), spark.read.parquet(f"{path}/nodes"), m["most"], m["fill"], m["points"], m["height"])

    # ---- catalogue ----

    @property
    def cap(self) -> int:
        return capacity(self.most, self.fill)

    def rows(self) -> DataFrame:
        """All points (id, name, x, y), delta included."""
        return self._with_added(self._live(self.layout))

    def count(self) -> int:
        return self.points + self.n_added - self.n_gone

    def meta(self) -> DataFrame:
        """One row, of the packed part: points, most, least, fill, height, num_leaves, num_blocks and the root rectangle."""
        root = bounding_rectangles(self.nodes.filter("level = 0")).drop("n")
        counts = self.nodes.agg(F.count(F.when(F.col("level") == 0, 1)).alias("num_leaves"), F.count(F.lit(1)).alias("num_blocks"))
        fixed = [F.lit(self.points).cast("long").alias("points"), F.lit(self.most).alias("most"), F.lit(int(self.most * LEAST_SHARE)).alias("least"), F.lit(self.fill).alias("fill"), F.lit(self.height).alias("height")]
        return counts.crossJoin(root).select(*fixed, "*")  # one row each

    def level_statistics(self) -> DataFrame:
        """Per level of the packed part: nodes, entries, least and most entries, mean share of a node's capacity used."""
        stats = self.nodes.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("entries"), F.min("n").alias("fewest"), F.max("n").alias("largest"))
        return stats.withColumn("fullness", F.col("entries") / (F.col("nodes") * self.most))

    def node(self, level: int, node_id: int) -> DataFrame:
        return self.nodes.filter((F.col("level") == level) & (F.col("node_id") == node_id))

    # ---- pruned queries ----

    def _top_level(self) -> int:
        """The lowest level with at most ``NODE_BOUND`` nodes."""
        count, level = -(-self.points // max(1, self.cap)), 0
        while count > NODE_BOUND:
            count, level = -(-count // self.cap), level + 1
        return min(level, max(0, self.height - 1))

    def _within(self, kept: list[int], level: int) -> DataFrame:
        """Layout rows under the kept nodes: as leaf ranges pushed into the scan, or a join if there are many."""
        size = self.cap**level
        ranges: list[list[int]] = []
        for node in sorted(kept):
            if ranges and ranges[-1][1] == node * size - 1:
                ranges[-1][1] = (node + 1) * size - 1
            else:
                ranges.append([node * size, (node + 1) * size - 1])
        if not ranges:
            return self.layout.limit(0)
        if len(ranges) <= RANGE_BOUND:
            test = F.lit(False)
            for a, b in ranges:
                test = test | F.col("leaf_id").between(a, b)
            return self.layout.filter(test)
        ids = self.layout.sparkSession.createDataFrame([(k,) for k in kept], "__node long")
        return self.layout.join(ids, F.floor(F.col("leaf_id") / size) == F.col("__node"), "left_semi")

    def range_query(self, area: Sequence[Sequence[float]]) -> DataFrame:
        """As ``search.range_query``, reading only what lies under intersecting nodes."""
        level, (low, high) = self._top_level(), zip(*area)
        hit = self.nodes.filter(F.col("level") == level).filter(G.intersects(_cols(LOW), _cols(HIGH), low, high))
        kept = [r["node_id"] for r in hit.select("node_id").collect()]  # at most NODE_BOUND
        return self._with_added(self._live(search.range_query(self._within(kept, level), area)), lambda rows: search.range_query(rows, area))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Layout rows (id, name, x, y) that were not taken out."""
        rows = rows.select(*POINT)
        if not self.n_gone:
            return rows
        return rows.join(F.broadcast(self.gone) if self.n_gone <= DELTA_BROADCAST else self.gone, list(KEY), "left_anti").select(*POINT)

    def _with_added(self, rows: DataFrame, narrowed=lambda rows: rows) -> DataFrame:
        return rows.unionByName(narrowed(self.added)) if self.n_added else rows

    def knn(self, at: Sequence[float], k: int) -> DataFrame:
        """As ``search.knn``: nodes farther than a bound on the k-th distance are left out.

        The bound is the least farthest distance such that nodes up to it hold k points (and as many more as were taken out);
        ties survive since equal distances are kept.
        """
        if k <= 0:
            return search.knn(self.layout.select(*POINT), at, 0)
        level = self._top_level()
        rows = self.nodes.filter(F.col("level") == level).select("node_id", F.col("points").alias("n"), G.mindist(_cols(LOW), _cols(HIGH), at).alias("near"), G.maxdist(_cols(LOW), _cols(HIGH), at).alias("far")).collect()
        bound, seen = float("inf"), 0
        for r in sorted(rows, key=lambda r: r["far"]):
            seen += r["n"]
            if seen >= k + self.n_gone:
                bound = r["far"]
                break
        # a rounding of the last place must not drop a node
        kept = [r["node_id"] for r in rows if r["near"] <= bound * (1 + 1e-12)]
        return search.knn(self._with_added(self._live(self._within(kept, level))), at, k)

    def skyline(self) -> DataFrame:
        """id, x, y of the skyline; leaves whose lower corner another leaf's upper corner dominates are not read.

        Once points were taken out an upper corner promises none, so all leaves are read.
        """
        if self.n_gone:
            return skyline_2d(self.rows())
        level = self._top_level()
        rows = self.nodes.filter(F.col("level") == level).select("node_id", *LOW, *HIGH).collect()
        kept, best = [], float("inf")
        # by x of the upper corner: the least upper y among corners left of a node's lower corner
        corners = sorted((r["x_max"], r["y_max"]) for r in rows)
        at = 0
        for r in sorted(rows, key=lambda r: r["x_min"]):
            while at < len(corners) and corners[at][0] < r["x_min"]:
                best = min(best, corners[at][1])
                at += 1
            if not best < r["y_min"]:
                kept.append(r["node_id"])
        return skyline_2d(self._with_added(self._within(kept, level).select(*POINT)))

    def knn_join(self, queries: DataFrame, k: int) -> DataFrame:
        """qid, id, name, x, y, dist, rank: the k nearest points of each query (qid, qx, qy).

        Queries descend the levels together: at each, a query keeps the nodes whose near distance is within its bound
        on the k-th distance, and joins their children by parent; then points join by leaf.
        """
        q = queries.select("qid", "qx", "qy")
        at = _cols(("qx", "qy"))
        if self.n_added:
            return self.compact().knn_join(queries, k)
        level = self.height - 1
        if level < 0:
            return q.join(self.layout.select("leaf_id", "id", "name", "x", "y"), F.lit(False)).select("qid", "id", "name", "x", "y", F.lit(0.0).alias("dist"), F.lit(1).alias("rank"))
        now = q.crossJoin(F.broadcast(self.nodes.filter(F.col("level") == level)))  # the root: one row
        while True:
            scored = now.select("qid", "qx", "qy", "node_id", F.col("points").alias("n"), G.mindist(_cols(LOW), _cols(HIGH), at).alias("near"), G.maxdist(_cols(LOW), _cols(HIGH), at).alias("far"))
            running = F.sum("n").over(Window.partitionBy("qid").orderBy("far", "node_id"))
            whole = Window.partitionBy("qid")
            bound = F.coalesce(F.min(F.when(F.col("seen") >= k + self.n_gone, F.col("far"))).over(whole), F.lit(float("inf")))
            kept = scored.withColumn("seen", running).withColumn("bound", bound * (1 + 1e-12)).filter("near <= bound").select("qid", "qx", "qy", F.col("node_id").alias("__up"))
            if level == 0:
                break
            level -= 1
            below = self.nodes.filter(F.col("level") == level)
            now = kept.join(below, F.col("__up") == F.col("parent_id"))
        points = self.layout.select("leaf_id", *POINT)
        if self.n_gone:
            points = points.join(self.gone, list(KEY), "left_anti")
        pairs = kept.join(points, F.col("__up") == F.col("leaf_id")).withColumn("dist", G.distance(_cols(("x", "y")), at))
        return search.nearest_per_query(pairs, k).select("qid", "id", "name", "x", "y", "dist", "rank")

    def intersecting_leaves(self) -> DataFrame:
        """a, b: pairs of leaves (a < b) whose rectangles share a point, through a common grid (no cross join)."""
        leaves = self.nodes.filter("level = 0")
        areas = leaves.select(F.col("node_id").alias("area_id"), *LOW, *HIGH)
        return rectangle_join(areas, areas).filter("a < b")

    def choose_leaves(self, points: DataFrame) -> DataFrame:
        """id, node_id, enlargement: the leaf each point (id, x, y) would be put in.

        Points descend all levels together: at each they take, of their node's children, the one whose rectangle grows least (the
        first if equal); children are joined by parent, so a point meets at most a fan-out of nodes a level.
        """
        level = self.height - 1
        now = points.select("id", "x", "y").withColumn("__up", F.lit(0).cast("long"))
        growth = G.enlargement(_cols(LOW), _cols(HIGH), _cols(("x", "y")), _cols(("x", "y")))
        out = now.select("id", F.col("__up").alias("node_id"), F.lit(None).cast("double").alias("enlargement")).limit(0)
        while level >= 0:
            below = self.nodes.filter(F.col("level") == level).select(F.coalesce("parent_id", F.lit(0).cast("long")).alias("__up"), "node_id", *LOW, *HIGH)
            best = now.join(below, "__up").groupBy("id", "x", "y").agg(F.min(F.struct(growth.alias("enlargement"), "node_id")).alias("b"))
            out = best.select("id", F.col("b.node_id").alias("node_id"), F.col("b.enlargement").alias("enlargement"))
            now = best.select("id", "x", "y", F.col("b.node_id").alias("__up"))
            level -= 1
        return out

    # ---- changes ----

    def compact(self) -> PointIndex:
        """The index packed anew, its delta merged (one sort)."""
        return PointIndex.build(self.rows(), self.most, self.fill) if self.n_added or self.n_gone else self

    def _changed(self, new: PointIndex) -> PointIndex:
        return new.compact() if new.n_added + new.n_gone > DELTA_SHARE * new.points else new

    def insert(self, new: DataFrame) -> PointIndex:
        """The index with further points: in the delta, or packed anew if that grows too large."""
        added = self._with_added(new.select(*POINT).limit(0)).unionByName(new.select(*POINT))
        added = materialise(added, "added")
        return self._changed(replace(self, added=added, n_added=added.count()))

    def delete(self, keys: DataFrame) -> tuple[PointIndex, int]:
        """(the index without the points of these ids and coordinates, how many went)."""
        keys = materialise(keys.select(*KEY).distinct(), "deleted-keys")
        hit = materialise(self._live(self.layout).join(keys, list(KEY), "left_semi").select(*KEY), "deleted")
        n = hit.count()
        gone = materialise(self.gone.unionByName(hit) if self.n_gone else hit, "gone") if n else self.gone
        left, n_left = self.added, 0
        if self.n_added:
            left = materialise(delete_points(self.added, keys), "added")
            n_left = left.count()
        went = n + self.n_added - n_left
        return self._changed(replace(self, added=left, gone=gone, n_added=n_left, n_gone=self.n_gone + n)), went


def rectangle_join(left: DataFrame, right: DataFrame, grid: int = search.GRID) -> DataFrame:
    """a, b: ids of intersecting rectangles (area_id, corners), each pair once: in the cell of its lower common corner.

    Cells are bordered by quantiles of the left rectangles' lower corners.
    """
    inner = dict(zip(LOW, search.borders(left, _cols(LOW), grid)))

    def dealt(df: DataFrame, side: str) -> DataFrame:
        named = df.select(*[F.col(c).alias(f"{side}_{c}") for c in ("area_id", *LOW, *HIGH)])
        for low, high in zip(LOW, HIGH):
            named = named.select("*", F.explode(F.sequence(search.cell(F.col(f"{side}_{low}"), inner[low]), search.cell(F.col(f"{side}_{high}"), inner[low]))).alias(f"c_{low}"))
        return named

    pairs = dealt(left, "l").join(dealt(right, "r"), [f"c_{c}" for c in LOW])
    home = reduce(lambda a, b: a & b, [search.cell(F.greatest(F.col(f"l_{c}"), F.col(f"r_{c}")), inner[c]) == F.col(f"c_{c}") for c in LOW])
    meet = G.intersects(_cols([f"l_{c}" for c in LOW]), _cols([f"l_{c}" for c in HIGH]), _cols([f"r_{c}" for c in LOW]), _cols([f"r_{c}" for c in HIGH]))
    return pairs.filter(meet & home).select(F.col("l_area_id").alias("a"), F.col("r_area_id").alias("b"))
