"""Registered point-engine queries with their oracle SQL.

Point views: ``part`` points (x = retail price, y = size) and ``orders`` points (x, y spread over the
globe by the order key).  The index of the orders points is built once per session and folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import geometry as G
from pointloom.functions import zorder
from pointloom.operators import changes, maintenance, search, skyline
from pointloom.plans.index import PointIndex, leaf_of, rectangle_join
from pointloom.plans.storage import number_rows, shared_dir
from pointloom.sources import osm
from pointloom.sources import points as P
from pointloom.streaming import ingest

AREA = ((-30.0, 20.0), (0.0, 60.0))
AT = (10.0, 20.0)
K = 25
EXACT = (908.8, 20.0)
#: Small node size of the registered index, so that the test tables give several levels.
MOST, FILL = 100, 0.85
CAP, LEAST = 85, 40
#: Order priorities whose points the registered deletions name.
GONE = ("1-URGENT", "2-HIGH", "3-MEDIUM")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.points(_read(spark, sf_dir, "part"), "p_partkey", "p_retailprice", F.col("p_size"), "p_name")


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("long")
    lat = (key * 7919 % 1800001).cast("double") / F.lit(10000.0) - F.lit(90.0)
    lon = (key * 104729 % 3600001).cast("double") / F.lit(10000.0) - F.lit(180.0)
    return P.points(_read(spark, sf_dir, "orders"), key, lat, lon, "o_orderpriority")


_BUILT: dict[tuple[str, str], PointIndex] = {}


def order_index(spark: SparkSession, sf_dir: str) -> PointIndex:
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _BUILT:
        _BUILT[at] = PointIndex.build(order_points(spark, sf_dir), MOST, FILL)
    return _BUILT[at]


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query points: every supplier, spread over the globe by its key."""
    key = F.col("s_suppkey").cast("long")
    x = (key * 7919 % 1801).cast("double") / F.lit(10.0) - F.lit(90.0)
    y = (key * 104729 % 3601).cast("double") / F.lit(10.0) - F.lit(180.0)
    return _read(spark, sf_dir, "supplier").select(key.alias("qid"), x.alias("qx"), y.alias("qy"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle around every query point."""
    q = supplier_points(spark, sf_dir)
    x, y = F.col("qx"), F.col("qy")
    return q.select(F.col("qid").alias("area_id"), (x - 4).alias("x_min"), (x + 4).alias("x_max"), (y - 7).alias("y_min"), (y + 7).alias("y_max"))


def entries_of_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overfull leaves for the split: the customers of each nation."""
    c = _read(spark, sf_dir, "customer")
    x, y = F.col("c_acctbal").cast("double"), (F.col("c_custkey") * 37 % 1000).cast("double")
    rows = c.select(F.col("c_nationkey").cast("long").alias("node_id"), F.col("c_custkey").cast("long").alias("id"), x.alias("x"), y.alias("y"))
    return rows.select("node_id", "id", F.col("x").alias("x_min"), F.col("x").alias("x_max"), F.col("y").alias("y_min"), F.col("y").alias("y_max"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of ``part`` inside a closed rectangle."""
    return search.range_query(part_points(spark, sf_dir), ((900, 910), (1, 25)))


def range_query(spark, sf_dir):
    return search.range_query(order_points(spark, sf_dir), AREA)


def range_query_part(spark, sf_dir):
    return search.range_query(part_points(spark, sf_dir), ((910, 960), (5, 30)))


def range_query_indexed(spark, sf_dir):
    return order_index(spark, sf_dir).range_query(AREA)


def range_join(spark, sf_dir):
    return search.range_join(order_points(spark, sf_dir), areas(spark, sf_dir))


def point_lookup(spark, sf_dir):
    return search.lookup(part_points(spark, sf_dir), 77)


def exact_match(spark, sf_dir):
    return search.exact_match(part_points(spark, sf_dir), EXACT)


def knn(spark, sf_dir):
    return search.knn(order_points(spark, sf_dir), AT, K)


def knn_ties(spark, sf_dir):
    return search.knn(part_points(spark, sf_dir), (910.0, 20.0), 40)


def knn_indexed(spark, sf_dir):
    return order_index(spark, sf_dir).knn(AT, K)


def knn_join(spark, sf_dir):
    return order_index(spark, sf_dir).knn_join(supplier_points(spark, sf_dir), 7)


def skyline_2d(spark, sf_dir):
    return skyline.skyline_2d(part_points(spark, sf_dir))


def skyline_indexed(spark, sf_dir):
    return order_index(spark, sf_dir).skyline()


def skyline_3d(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount")])
    return skyline.skyline(rows, ("l_quantity", "l_extendedprice", "l_discount"))


def skyline_per_group(spark, sf_dir):
    return skyline.skyline_2d(order_points(spark, sf_dir), by=("name",))


def skyline_3d_per_group(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount")])
    return skyline.skyline(rows, ("l_quantity", "l_extendedprice", "l_discount"), by=("l_returnflag",))


def knn_vectors(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = search.knn_vectors(vectors, "embedding", [0.05 * (i % 7) - 0.1 for i in range(64)], 12)
    return near.select("id", F.round("dist", 6).alias("dist"))


def underfull_leaves(spark, sf_dir):
    """Leaves that a large deletion leaves underfull: what a rebuild has to dissolve."""
    index = order_index(spark, sf_dir)
    rest = changes.delete(index.layout.select("id", "x", "y", "leaf_id"), index.layout.filter(F.col("name").isin(*GONE)))
    leaves = maintenance.bounding_rectangles(rest, "leaf_id").withColumnRenamed("leaf_id", "node_id")
    return maintenance.underfull(leaves.withColumn("parent_id", F.floor(F.col("node_id") / CAP)), LEAST).select("node_id", "n")


def rebuilt_after_delete(spark, sf_dir):
    """Leaves of the index packed anew after a deletion."""
    index = order_index(spark, sf_dir)
    new, _ = index.delete(index.layout.filter(F.col("name").isin(*GONE)))
    return new.compact().nodes.filter("level = 0").select("node_id", "n", "x_min", "x_max", "y_min", "y_max")


def dominated_points(spark, sf_dir):
    some = part_points(spark, sf_dir)
    return skyline.dominated_by_any(some, some.select("id", (F.col("x") + 20).alias("x"), (F.col("y") + 5).alias("y"))).select("id", "x", "y")


def mindist_origin(spark, sf_dir):
    return search.mindist_to_origin(_nation_rectangles(spark, sf_dir)).select("node_id", "mindist")


def _nation_rectangles(spark, sf_dir):
    """Rectangles around the customers of each nation; balances are moved to be positive, so that the origin lies outside."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("node_id"), (F.col("c_acctbal").cast("double") + 1000).alias("x"), (F.col("c_custkey") % 1000).cast("double").alias("y"))
    return maintenance.bounding_rectangles(c, "node_id")


def node_rectangles(spark, sf_dir):
    return _nation_rectangles(spark, sf_dir)


def root_rectangle(spark, sf_dir):
    return order_index(spark, sf_dir).meta().select("points", "num_leaves", "height", "x_min", "x_max", "y_min", "y_max")


def page_layout(spark, sf_dir):
    return P.page_layout(part_points(spark, sf_dir)).select("id", "block_id", "record_id")


def page_fetch(spark, sf_dir):
    paged = P.page_layout(part_points(spark, sf_dir), 50)
    wanted = spark.createDataFrame([(0, 7), (1, 0), (2, 49), (3, 50)], "block_id long, record_id long")
    return P.fetch(paged, wanted).select("block_id", "record_id", "id", "name", "x", "y")


def page_statistics(spark, sf_dir):
    return P.page_statistics(P.page_layout(part_points(spark, sf_dir), 150), 150)


def z_value(spark, sf_dir):
    p = part_points(spark, sf_dir).select("id", (F.col("x") / 10).alias("x"), F.col("y"))
    return p.select("id", zorder.raw_z([F.col("x"), F.col("y")]).alias("z"))


def z_scaled(spark, sf_dir):
    return order_index(spark, sf_dir).layout.select("id", "z")


def leaf_layout(spark, sf_dir):
    return order_index(spark, sf_dir).layout.select("id", "leaf_id")


def leaf_rectangles(spark, sf_dir):
    return order_index(spark, sf_dir).nodes.filter("level = 0").select("node_id", "n", "x_min", "x_max", "y_min", "y_max")


def upper_rectangles(spark, sf_dir):
    """All nodes above the leaves."""
    return order_index(spark, sf_dir).nodes.filter("level > 0").select("level", "node_id", "n", "points", "x_min", "x_max", "y_min", "y_max")


def level_statistics(spark, sf_dir):
    return order_index(spark, sf_dir).level_statistics()


def tail_rebalance(spark, sf_dir):
    rows = number_rows(part_points(spark, sf_dir), ["id"], "rank")
    leaf = leaf_of(F.col("rank"), rows.count(), 166, 141, 66)
    return rows.groupBy(leaf.alias("leaf_id")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def node_intersections(spark, sf_dir):
    r = _nation_rectangles(spark, sf_dir).withColumnRenamed("node_id", "area_id")
    return rectangle_join(r, r).filter("a < b")


def choose_subtree(spark, sf_dir):
    new = part_points(spark, sf_dir).select("id", (F.col("x") * 9 - 8000).alias("x"), (F.col("y") * 20).alias("y"))
    return maintenance.choose_subtree(new, _nation_rectangles(spark, sf_dir))


def split_choice(spark, sf_dir):
    return maintenance.split(entries_of_node(spark, sf_dir), 4).select("node_id", "axis", "cut").distinct()


def split_rectangles(spark, sf_dir):
    """The split of overfull inner nodes: entries with extent, which their lower and upper ends order differently."""
    key = F.col("p_partkey").cast("long")
    x, y = (key * 7919 % 1000).cast("double"), (key * 104729 % 997).cast("double")
    corners = [x.alias("x_min"), (x + F.col("p_size") * 9).cast("double").alias("x_max"), y.alias("y_min"), (y + key * 37 % 400).cast("double").alias("y_max")]
    entries = _read(spark, sf_dir, "part").select((key % 20).alias("node_id"), key.alias("id"), *corners)
    return maintenance.split(entries, 4).select("node_id", "axis", "bound", "cut", "id", "side")


def choose_leaves(spark, sf_dir):
    """The leaf of the index that each supplier's point would be put in."""
    new = supplier_points(spark, sf_dir).select(F.col("qid").alias("id"), F.col("qx").alias("x"), F.col("qy").alias("y"))
    return order_index(spark, sf_dir).choose_leaves(new).select("id", "node_id")


def split_sides(spark, sf_dir):
    return maintenance.split(entries_of_node(spark, sf_dir), 4).select("node_id", "id", "side")


def forced_reinsert(spark, sf_dir):
    return maintenance.forced_reinsert(entries_of_node(spark, sf_dir)).select("node_id", "id", "dist")


def insert_points(spark, sf_dir):
    return changes.insert(part_points(spark, sf_dir), order_points(spark, sf_dir))


def _deletion(spark, sf_dir):
    """All points, and keys with every id: the coordinates are right for urgent and high orders only."""
    p = order_points(spark, sf_dir)
    right = F.col("name").isin(*GONE)
    return p, p.select("id", "x", F.when(right, F.col("y")).otherwise(F.col("y") + 1).alias("y"))


def delete_points(spark, sf_dir):
    return changes.delete(*_deletion(spark, sf_dir))


def deleted_points(spark, sf_dir):
    return changes.deleted(*_deletion(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_deleted"))


def name_labels(spark, sf_dir):
    return part_points(spark, sf_dir).select("id", P.label_of(F.col("id")).alias("name"))


def stored_names(spark, sf_dir):
    return part_points(spark, sf_dir).select("id", P.stored_name(F.concat("name", F.lit(" with a longer tail"))).alias("name"))


def rectangle_measures(spark, sf_dir):
    r = _nation_rectangles(spark, sf_dir)
    low, high = [F.col("x_min"), F.col("y_min")], [F.col("x_max"), F.col("y_max")]
    mid = G.centre(low, high)
    return r.select("node_id", G.area(low, high).alias("area"), G.margin(low, high).alias("margin"), G.overlap(low, high, (0, 0), (5000, 500)).alias("overlap"), mid[0].alias("centre_x"), mid[1].alias("centre_y"), G.maxdist(low, high, (0, 0)).alias("maxdist"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pointloom/{name}-{uuid.uuid4().hex}"


def osm_nodes(spark, sf_dir):
    """Nodes written as OpenStreetMap XML, a document for every 5,000, and read as points."""
    path, p = _folder(spark, "osm"), order_points(spark, sf_dir)
    values = [F.lit('<node id="'), F.col("id").cast("string"), F.lit('" lat="'), F.col("x").cast("string"), F.lit('" lon="'), F.col("y").cast("string"), F.lit('"><tag k="source" v="made"/></node>')]
    document = F.concat(F.lit('<osm version="0.6">\n'), F.concat_ws("\n", F.collect_list("line")), F.lit("\n</osm>"))
    p.select(F.floor(F.col("id") / 5000).alias("part"), F.concat(*values).alias("line")).groupBy("part").agg(document.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return osm.read(spark, path)


def osm_stored(spark, sf_dir):
    """The same nodes, stored as a point table and read back."""
    path = _folder(spark, "osm-points")
    P.write(osm_nodes(spark, sf_dir), path)
    return P.read(spark, path)


def data_file(spark, sf_dir):
    """A point table written, more points appended, and read back."""
    path = _folder(spark, "points")
    P.write(part_points(spark, sf_dir), path)
    P.write(order_points(spark, sf_dir), path, "append")
    return P.read(spark, path)


def stream_append(spark, sf_dir):
    """Points that arrive as files, appended to a table by a stream."""
    arriving, path = _folder(spark, "arriving"), _folder(spark, "streamed")
    P.write(part_points(spark, sf_dir), arriving)
    ingest.append(ingest.watch(spark, arriving), path, _folder(spark, "stream-log"), once=True).awaitTermination()
    return P.read(spark, path)


def _stored_index(spark, sf_dir) -> PointIndex:
    path = _folder(spark, "index")
    order_index(spark, sf_dir).save(path)
    return PointIndex.load(spark, path)


def stored_index(spark, sf_dir):
    """A range query on an index saved and loaded."""
    return _stored_index(spark, sf_dir).range_query(AREA)


def stored_nodes(spark, sf_dir):
    """Leaf entries of a loaded index: node rectangles as saved."""
    return _stored_index(spark, sf_dir).nodes.filter("level = 0").select("node_id", "n", "x_min", "x_max", "y_min", "y_max")


def stored_catalogue(spark, sf_dir):
    """The catalogue of a loaded index."""
    return _stored_index(spark, sf_dir).meta().select("points", "most", "least", "fill", "height", "num_leaves", "num_blocks")


def node_by_id(spark, sf_dir):
    return order_index(spark, sf_dir).node(0, 3).select("node_id", "n", "x_min", "x_max", "y_min", "y_max")


def leaves_by_mindist(spark, sf_dir):
    """Leaves in order of their distance to a point."""
    return search.by_mindist(order_index(spark, sf_dir).nodes.filter("level = 0"), AT).select("place", "node_id", "mindist")


def _changed_index(spark, sf_dir) -> PointIndex:
    """The index with the suppliers' points added and the first points taken out, both in its delta."""
    index = order_index(spark, sf_dir)
    new = supplier_points(spark, sf_dir).select((-F.col("qid") - 1).alias("id"), F.lit("new").alias("name"), F.col("qx").alias("x"), F.col("qy").alias("y"))
    return index.delete(order_points(spark, sf_dir).filter("id % 50 = 7"))[0].insert(new)


def range_after_changes(spark, sf_dir):
    return _changed_index(spark, sf_dir).range_query(AREA)


def knn_after_changes(spark, sf_dir):
    return _changed_index(spark, sf_dir).knn(AT, K)


def skyline_after_changes(spark, sf_dir):
    return _changed_index(spark, sf_dir).skyline()


QUERIES = {
    f.__name__: f
    for f in (
        range_query, range_query_part, range_query_indexed, range_join, point_lookup, exact_match, knn, knn_ties, knn_indexed, knn_join, skyline_2d, skyline_indexed,
        skyline_3d, skyline_per_group, skyline_3d_per_group, knn_vectors, underfull_leaves, rebuilt_after_delete, dominated_points, mindist_origin, node_rectangles, root_rectangle, page_layout, page_fetch, page_statistics, z_value, z_scaled, leaf_layout,
        leaf_rectangles, upper_rectangles, level_statistics, tail_rebalance, node_intersections, choose_subtree, split_choice, split_sides, forced_reinsert,
        insert_points, delete_points, deleted_points, name_labels, stored_names, rectangle_measures, osm_nodes, osm_stored, data_file, stream_append,
        stored_index, stored_nodes, stored_catalogue, node_by_id, leaves_by_mindist, split_rectangles, choose_leaves, range_after_changes, knn_after_changes, skyline_after_changes,
    )
}

# ---- oracle SQL --------------------------------------------------------------------------------

_Q = """Q AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name, CAST(p_retailprice AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y FROM part)"""
_P = """P AS (SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderpriority AS name,
  CAST((CAST(o_orderkey AS BIGINT) * 7919) % 1800001 AS DOUBLE) / CAST(10000 AS DOUBLE) - CAST(90 AS DOUBLE) AS x,
  CAST((CAST(o_orderkey AS BIGINT) * 104729) % 3600001 AS DOUBLE) / CAST(10000 AS DOUBLE) - CAST(180 AS DOUBLE) AS y FROM orders)"""
_DIST = "sqrt((x - CAST({0} AS DOUBLE)) * (x - CAST({0} AS DOUBLE)) + (y - CAST({1} AS DOUBLE)) * (y - CAST({1} AS DOUBLE)))"


def _morton(a: str, b: str) -> str:
    """Bits of a at even places, of b at odd ones, spelled out."""
    even = " | ".join(f"((({a} >> {i}) & 1) << {2 * i})" for i in range(31))
    odd = " | ".join(f"((({b} >> {i}) & 1) << {2 * i + 1})" for i in range(31))
    return f"({even} | {odd})"


_Z = f"""{_P}, E AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM P),
I AS (SELECT id, name, x, y, CAST(trunc((x - x0) / (x1 - x0) * CAST(2147483647 AS DOUBLE)) AS BIGINT) AS a, CAST(trunc((y - y0) / (y1 - y0) * CAST(2147483647 AS DOUBLE)) AS BIGINT) AS b FROM P, E),
Z AS (SELECT id, name, x, y, {_morton("a", "b")} AS z FROM I),
R AS (SELECT *, row_number() OVER (ORDER BY z, id) - 1 AS rank, count(*) OVER () AS total FROM Z),
H AS (SELECT *, CASE WHEN total > {CAP} AND total % {CAP} > 0 AND total % {CAP} < {LEAST} THEN (total + {CAP} - 1) // {CAP} ELSE 0 END AS leaves FROM R),
L AS (SELECT *, CAST(CASE WHEN leaves = 0 THEN rank // {CAP}
  WHEN rank < (total % leaves) * (total // leaves + 1) THEN rank // (total // leaves + 1)
  ELSE (total % leaves) + (rank - (total % leaves) * (total // leaves + 1)) // (total // leaves) END AS BIGINT) AS leaf_id FROM H),
N AS (SELECT leaf_id AS node_id, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM L GROUP BY leaf_id)"""
_SUPPLIERS = """S AS (SELECT CAST(s_suppkey AS BIGINT) AS qid, CAST((CAST(s_suppkey AS BIGINT) * 7919) % 1801 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(90 AS DOUBLE) AS qx,
  CAST((CAST(s_suppkey AS BIGINT) * 104729) % 3601 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(180 AS DOUBLE) AS qy FROM supplier)"""
_AREAS = f"{_SUPPLIERS}, A AS (SELECT qid AS area_id, qx - 4 AS x_min, qx + 4 AS x_max, qy - 7 AS y_min, qy + 7 AS y_max FROM S)"
_GONE = "('1-URGENT', '2-HIGH', '3-MEDIUM')"
_NATION = """C AS (SELECT CAST(c_nationkey AS BIGINT) AS node_id, CAST(c_acctbal AS DOUBLE) + 1000 AS x, CAST(c_custkey % 1000 AS DOUBLE) AS y FROM customer),
B AS (SELECT node_id, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM C GROUP BY node_id)"""
_SPLIT = """D AS (SELECT CAST(c_nationkey AS BIGINT) AS node_id, CAST(c_custkey AS BIGINT) AS id, CAST(c_acctbal AS DOUBLE) AS x, CAST((CAST(c_custkey AS BIGINT) * 37) % 1000 AS DOUBLE) AS y FROM customer),
T AS (SELECT node_id, id, x, y, 0 AS axis, x AS lo FROM D UNION ALL SELECT node_id, id, x, y, 1 AS axis, y AS lo FROM D),
U AS (SELECT node_id, axis, id, row_number() OVER (PARTITION BY node_id, axis ORDER BY lo, id) AS rank, count(*) OVER (PARTITION BY node_id, axis) AS total,
  min(x) OVER a AS ax0, max(x) OVER a AS ax1, min(y) OVER a AS ay0, max(y) OVER a AS ay1, min(x) OVER b AS bx0, max(x) OVER b AS bx1, min(y) OVER b AS by0, max(y) OVER b AS by1
  FROM T WINDOW a AS (PARTITION BY node_id, axis ORDER BY lo, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY node_id, axis ORDER BY lo, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
V AS (SELECT node_id, axis, rank AS cut, (ax1 - ax0) + (ay1 - ay0) + ((bx1 - bx0) + (by1 - by0)) AS margin,
  greatest(least(ax1, bx1) - greatest(ax0, bx0), 0) * greatest(least(ay1, by1) - greatest(ay0, by0), 0) AS overlap,
  (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) AS area FROM U WHERE rank >= 4 AND rank <= total - 4),
X AS (SELECT node_id, axis, sum(margin) AS margin FROM V GROUP BY node_id, axis),
Y AS (SELECT node_id, axis FROM (SELECT node_id, axis, row_number() OVER (PARTITION BY node_id ORDER BY margin, axis) AS r FROM X) WHERE r = 1),
W AS (SELECT node_id, axis, cut FROM (SELECT V.*, row_number() OVER (PARTITION BY V.node_id ORDER BY overlap, area, cut) AS r FROM V JOIN Y ON V.node_id = Y.node_id AND V.axis = Y.axis) WHERE r = 1)"""


def _box(p: str, area) -> str:
    (a, b), (c, d) = area
    return f"{p}x BETWEEN {a} AND {b} AND {p}y BETWEEN {c} AND {d}"


#: Nodes above the leaves: a leaf's ancestor on level k has its number divided by the capacity k times.
_UPPER = f"""{_Z}, M AS (SELECT count(*) AS m FROM N), LV AS (SELECT unnest(range(1, 8)) AS level), NU AS (
  SELECT CAST(level AS INTEGER) AS level, CAST(node_id // CAST(pow({CAP}, level) AS BIGINT) AS BIGINT) AS node_id, count(DISTINCT node_id // CAST(pow({CAP}, level - 1) AS BIGINT)) AS n,
  CAST(sum(N.n) AS BIGINT) AS points, min(x_min) AS x_min, max(x_max) AS x_max, min(y_min) AS y_min, max(y_max) AS y_max
  FROM N, LV, M WHERE m - 1 >= CAST(pow({CAP}, level - 1) AS BIGINT) GROUP BY 1, 2)"""
_RECTANGLES = """D AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(CAST(p_partkey AS BIGINT) * 7919 % 1000 AS DOUBLE) AS x, CAST(CAST(p_partkey AS BIGINT) * 104729 % 997 AS DOUBLE) AS y, p_size FROM part),
R AS (SELECT id % 20 AS node_id, id, x AS x_min, x + p_size * 9 AS x_max, y AS y_min, y + id * 37 % 400 AS y_max FROM D),
T AS (SELECT *, 0 AS axis, 0 AS bound, x_min AS k1, x_max AS k2 FROM R UNION ALL SELECT *, 0, 1, x_max, x_min FROM R UNION ALL SELECT *, 1, 0, y_min, y_max FROM R UNION ALL SELECT *, 1, 1, y_max, y_min FROM R),
U AS (SELECT node_id, axis, bound, id, row_number() OVER (PARTITION BY node_id, axis, bound ORDER BY k1, k2, id) AS rank, count(*) OVER (PARTITION BY node_id, axis, bound) AS total,
  min(x_min) OVER a AS ax0, max(x_max) OVER a AS ax1, min(y_min) OVER a AS ay0, max(y_max) OVER a AS ay1, min(x_min) OVER b AS bx0, max(x_max) OVER b AS bx1, min(y_min) OVER b AS by0, max(y_max) OVER b AS by1
  FROM T WINDOW a AS (PARTITION BY node_id, axis, bound ORDER BY k1, k2, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY node_id, axis, bound ORDER BY k1, k2, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
V AS (SELECT node_id, axis, bound, rank AS cut, (ax1 - ax0) + (ay1 - ay0) + ((bx1 - bx0) + (by1 - by0)) AS margin,
  greatest(least(ax1, bx1) - greatest(ax0, bx0), 0) * greatest(least(ay1, by1) - greatest(ay0, by0), 0) AS overlap,
  (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) AS area FROM U WHERE rank >= 4 AND rank <= total - 4),
X AS (SELECT node_id, axis, sum(margin) AS margin FROM V GROUP BY node_id, axis),
Y AS (SELECT node_id, axis FROM (SELECT node_id, axis, row_number() OVER (PARTITION BY node_id ORDER BY margin, axis) AS r FROM X) WHERE r = 1),
W AS (SELECT node_id, axis, bound, cut FROM (SELECT V.*, row_number() OVER (PARTITION BY V.node_id ORDER BY overlap, area, bound, cut) AS r FROM V JOIN Y ON V.node_id = Y.node_id AND V.axis = Y.axis) WHERE r = 1)"""
_CHANGED = f"""{_P}, {_SUPPLIERS}, CH AS (SELECT id, name, x, y FROM P WHERE id % 50 <> 7 UNION ALL SELECT -qid - 1, 'new', qx, qy FROM S)"""
_KEYS = f"K AS (SELECT id, x, CASE WHEN name IN {_GONE} THEN y ELSE y + 1 END AS y FROM P)"
_3D = "l_quantity, l_extendedprice, l_discount"

ORACLES = {
    "range_query": f"WITH {_P} SELECT id, name, x, y FROM P WHERE {_box('', AREA)}",
    "range_query_part": f"WITH {_Q} SELECT id, name, x, y FROM Q WHERE x BETWEEN 910 AND 960 AND y BETWEEN 5 AND 30",
    "range_query_indexed": f"WITH {_P} SELECT id, name, x, y FROM P WHERE {_box('', AREA)}",
    "range_join": f"WITH {_P}, {_AREAS} SELECT CAST(area_id AS BIGINT) AS area_id, id, name, x, y FROM P JOIN A ON x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max",
    "point_lookup": f"WITH {_Q} SELECT id, name, x, y FROM Q WHERE id = 77",
    "exact_match": f"WITH {_Q} SELECT id, name, x, y FROM Q WHERE x = CAST(908.8 AS DOUBLE) AND y = 20",
    "knn": f"WITH {_P} SELECT id, name, x, y, {_DIST.format(*AT)} AS dist FROM P ORDER BY dist, id LIMIT {K}",
    "knn_ties": f"WITH {_Q} SELECT id, name, x, y, {_DIST.format(910, 20)} AS dist FROM Q ORDER BY dist, id LIMIT 40",
    "knn_indexed": f"WITH {_P} SELECT id, name, x, y, {_DIST.format(*AT)} AS dist FROM P ORDER BY dist, id LIMIT {K}",
    "knn_join": f"WITH {_P}, {_SUPPLIERS}, G AS (SELECT CAST(qid AS BIGINT) AS qid, id, name, x, y, {_DIST.format('qx', 'qy')} AS dist FROM P, S), O AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rank FROM G) SELECT * FROM O WHERE rank <= 7",
    "skyline_2d": f"WITH {_Q}, M AS (SELECT x, y, min(id) AS id FROM Q GROUP BY x, y) SELECT id, x, y FROM M a WHERE NOT EXISTS (SELECT 1 FROM M b WHERE b.x <= a.x AND b.y <= a.y AND (b.x < a.x OR b.y < a.y))",
    "skyline_indexed": f"WITH {_P}, M AS (SELECT x, y, min(id) AS id FROM P GROUP BY x, y), F AS (SELECT id, x, y, min(y) OVER (ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM M) SELECT id, x, y FROM F WHERE m IS NULL OR y < m",
    "skyline_3d": f"WITH M AS (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_discount AS DOUBLE) AS l_discount, min(CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) AS id FROM lineitem GROUP BY {_3D}) SELECT CAST(id AS BIGINT) AS id, {_3D} FROM M a WHERE NOT EXISTS (SELECT 1 FROM M b WHERE b.l_quantity <= a.l_quantity AND b.l_extendedprice <= a.l_extendedprice AND b.l_discount <= a.l_discount AND (b.l_quantity < a.l_quantity OR b.l_extendedprice < a.l_extendedprice OR b.l_discount < a.l_discount))",
    "skyline_3d_per_group": f"WITH M AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_discount AS DOUBLE) AS l_discount, min(CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) AS id FROM lineitem GROUP BY l_returnflag, {_3D}) SELECT l_returnflag, CAST(id AS BIGINT) AS id, {_3D} FROM M a WHERE NOT EXISTS (SELECT 1 FROM M b WHERE a.l_returnflag = b.l_returnflag AND b.l_quantity <= a.l_quantity AND b.l_extendedprice <= a.l_extendedprice AND b.l_discount <= a.l_discount AND (b.l_quantity < a.l_quantity OR b.l_extendedprice < a.l_extendedprice OR b.l_discount < a.l_discount))",
    "skyline_per_group": f"WITH {_P}, M AS (SELECT name, x, y, min(id) AS id FROM P GROUP BY name, x, y), F AS (SELECT name, id, x, y, min(y) OVER (PARTITION BY name ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM M) SELECT name, id, x, y FROM F WHERE m IS NULL OR y < m",
    "knn_vectors": "WITH U AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(64)) AS i FROM embeddings), D AS (SELECT id, sqrt(sum((v - (0.05 * (i % 7) - 0.1)) * (v - (0.05 * (i % 7) - 0.1)))) AS dist FROM U GROUP BY id) SELECT id, round(CAST(dist AS DOUBLE), 6) AS dist FROM (SELECT * FROM D ORDER BY dist, id LIMIT 12)",
    "underfull_leaves": f"WITH {_Z}, U AS (SELECT leaf_id AS node_id, count(*) AS n FROM L WHERE name NOT IN {_GONE} GROUP BY leaf_id) SELECT node_id, n FROM U WHERE n < {LEAST}",
    "rebuilt_after_delete": f"WITH {_Z.replace('FROM orders)', 'FROM orders WHERE o_orderpriority NOT IN ' + _GONE + ')')} SELECT * FROM N",
    "dominated_points": f"WITH {_Q} SELECT id, x, y FROM Q a WHERE EXISTS (SELECT 1 FROM Q b WHERE b.x + 20 <= a.x AND b.y + 5 <= a.y AND (b.x + 20 < a.x OR b.y + 5 < a.y))",
    "mindist_origin": f"WITH {_NATION} SELECT node_id, sqrt(greatest(x_min, -x_max, 0) * greatest(x_min, -x_max, 0) + greatest(y_min, -y_max, 0) * greatest(y_min, -y_max, 0)) AS mindist FROM B",
    "node_rectangles": f"WITH {_NATION} SELECT * FROM B",
    "root_rectangle": f"WITH RECURSIVE {_Z}, T(h, m) AS (SELECT CAST(1 AS INTEGER), count(*) FROM N UNION ALL SELECT h + 1, (m + {CAP} - 1) // {CAP} FROM T WHERE m > 1) SELECT CAST((SELECT count(*) FROM P) AS BIGINT) AS points, count(*) AS num_leaves, (SELECT CAST(max(h) AS INTEGER) FROM T) AS height, min(x_min) AS x_min, max(x_max) AS x_max, min(y_min) AS y_min, max(y_max) AS y_max FROM N",
    "page_layout": f"WITH {_Q}, R AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM Q) SELECT id, CAST(n // 564 AS BIGINT) AS block_id, CAST(n % 564 AS BIGINT) AS record_id FROM R",
    "page_fetch": f"WITH {_Q}, R AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS n FROM Q) SELECT CAST(n // 50 AS BIGINT) AS block_id, CAST(n % 50 AS BIGINT) AS record_id, id, name, x, y FROM R WHERE n IN (7, 50, 149)",
    "page_statistics": f"WITH {_Q}, R AS (SELECT (row_number() OVER (ORDER BY id) - 1) // 150 AS b FROM Q), G AS (SELECT b, count(*) AS n FROM R GROUP BY b) SELECT count(*) AS pages, CAST(sum(n) AS BIGINT) AS points, max(n) AS fullest, min(n) AS emptiest, CAST(count(*) * 150 - sum(n) AS BIGINT) AS free, (SELECT max(id) + 1 FROM Q) AS next_id, CAST((SELECT count(*) // 150 FROM Q) AS BIGINT) AS next_block_id, CAST((SELECT count(*) % 150 FROM Q) AS BIGINT) AS next_record_id FROM G",
    "z_value": f"WITH {_Q}, I AS (SELECT id, CAST(trunc(x / 10 * CAST(10000000 AS DOUBLE)) AS BIGINT) AS a, CAST(trunc(y * CAST(10000000 AS DOUBLE)) AS BIGINT) AS b FROM Q) SELECT id, {_morton('a', 'b')} AS z FROM I",
    "z_scaled": f"WITH {_Z} SELECT id, z FROM L",
    "leaf_layout": f"WITH {_Z} SELECT id, leaf_id FROM L",
    "leaf_rectangles": f"WITH {_Z} SELECT * FROM N",
    "upper_rectangles": f"WITH {_UPPER} SELECT * FROM NU",
    "level_statistics": f"WITH {_UPPER}, AL AS (SELECT CAST(0 AS INTEGER) AS level, n FROM N UNION ALL SELECT level, n FROM NU) SELECT level, count(*) AS nodes, CAST(sum(n) AS BIGINT) AS entries, min(n) AS fewest, max(n) AS largest, CAST(sum(n) AS DOUBLE) / CAST(count(*) * {MOST} AS DOUBLE) AS fullness FROM AL GROUP BY level",
    "tail_rebalance": f"WITH {_Q}, R AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank, count(*) OVER () AS total FROM Q), H AS (SELECT *, CASE WHEN total > 141 AND total % 141 > 0 AND total % 141 < 66 THEN ntile((SELECT (count(*) + 140) // 141 FROM Q)) OVER (ORDER BY id) - 1 ELSE rank // 141 END AS leaf FROM R) SELECT CAST(leaf AS BIGINT) AS leaf_id, count(*) AS n, min(id) AS first_id FROM H GROUP BY leaf",
    "node_intersections": f"WITH {_NATION} SELECT a.node_id AS a, b.node_id AS b FROM B a JOIN B b ON a.node_id < b.node_id AND a.x_min <= b.x_max AND b.x_min <= a.x_max AND a.y_min <= b.y_max AND b.y_min <= a.y_max",
    "choose_subtree": f"WITH {_Q}, {_NATION}, N AS (SELECT id, x * 9 - 8000 AS x, y * 20 AS y FROM Q), G AS (SELECT id, node_id, (greatest(x_max, x) - least(x_min, x)) * (greatest(y_max, y) - least(y_min, y)) - (x_max - x_min) * (y_max - y_min) AS enlargement FROM N, B), O AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY enlargement, node_id) AS r FROM G) SELECT id, node_id, enlargement FROM O WHERE r = 1",
    "split_choice": f"WITH {_SPLIT} SELECT node_id, CAST(axis AS INTEGER) AS axis, CAST(cut AS INTEGER) AS cut FROM W",
    "split_sides": f"WITH {_SPLIT} SELECT U.node_id AS node_id, U.id AS id, CAST(CASE WHEN U.rank <= W.cut THEN 1 ELSE 2 END AS INTEGER) AS side FROM U JOIN W ON U.node_id = W.node_id AND U.axis = W.axis",
    "forced_reinsert": "WITH D AS (SELECT CAST(c_nationkey AS BIGINT) AS node_id, CAST(c_custkey AS BIGINT) AS id, CAST(c_acctbal AS DOUBLE) AS x, CAST((CAST(c_custkey AS BIGINT) * 37) % 1000 AS DOUBLE) AS y FROM customer), M AS (SELECT *, (min(x) OVER w + max(x) OVER w) / 2 AS mx, (min(y) OVER w + max(y) OVER w) / 2 AS my, count(*) OVER w AS n FROM D WINDOW w AS (PARTITION BY node_id)), F AS (SELECT *, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS dist FROM M), O AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY dist DESC, id) AS r FROM F) SELECT node_id, id, dist FROM O WHERE r <= n // 3",
    "insert_points": f"WITH {_Q}, {_P} SELECT id, name, x, y FROM Q UNION ALL SELECT id, name, x, y FROM P",
    "delete_points": f"WITH {_P}, {_KEYS} SELECT id, name, x, y FROM P WHERE NOT EXISTS (SELECT 1 FROM K WHERE K.id = P.id AND K.x = P.x AND K.y = P.y)",
    "deleted_points": f"WITH {_P}, {_KEYS} SELECT count(*) AS n_deleted FROM P WHERE EXISTS (SELECT 1 FROM K WHERE K.id = P.id AND K.x = P.x AND K.y = P.y)",
    "name_labels": f"WITH {_Q} SELECT id, concat('name ', CAST(1 + id % 8 AS VARCHAR)) AS name FROM Q",
    "stored_names": f"WITH {_Q} SELECT id, substr(concat(name, ' with a longer tail'), 1, 30) AS name FROM Q",
    "rectangle_measures": f"WITH {_NATION} SELECT node_id, (x_max - x_min) * (y_max - y_min) AS area, (x_max - x_min) + (y_max - y_min) AS margin, greatest(least(x_max, 5000) - greatest(x_min, 0), 0) * greatest(least(y_max, 500) - greatest(y_min, 0), 0) AS overlap, (x_min + x_max) / 2 AS centre_x, (y_min + y_max) / 2 AS centre_y, sqrt(greatest(abs(x_min), abs(x_max)) * greatest(abs(x_min), abs(x_max)) + greatest(abs(y_min), abs(y_max)) * greatest(abs(y_min), abs(y_max))) AS maxdist FROM B",
    "osm_nodes": f"WITH {_P} SELECT id, concat('name ', CAST(1 + id % 8 AS VARCHAR)) AS name, x, y FROM P",
    "osm_stored": f"WITH {_P} SELECT id, concat('name ', CAST(1 + id % 8 AS VARCHAR)) AS name, x, y FROM P",
    "data_file": f"WITH {_Q}, {_P} SELECT id, name, x, y FROM Q UNION ALL SELECT id, name, x, y FROM P",
    "stream_append": f"WITH {_Q} SELECT id, name, x, y FROM Q",
    "stored_index": f"WITH {_P} SELECT id, name, x, y FROM P WHERE {_box('', AREA)}",
    "stored_nodes": f"WITH {_Z} SELECT * FROM N",
    "stored_catalogue": f"WITH {_UPPER} SELECT (SELECT count(*) FROM P) AS points, CAST({MOST} AS INTEGER) AS most, CAST({LEAST} AS INTEGER) AS least, CAST({FILL} AS DOUBLE) AS fill, CAST((SELECT coalesce(max(level), 0) + 1 FROM NU) AS INTEGER) AS height, m AS num_leaves, m + (SELECT count(*) FROM NU) AS num_blocks FROM M",
    "node_by_id": f"WITH {_Z} SELECT * FROM N WHERE node_id = 3",
    "leaves_by_mindist": f"WITH {_Z}, O AS (SELECT node_id, sqrt(greatest(x_min - {AT[0]}, {AT[0]} - x_max, 0) * greatest(x_min - {AT[0]}, {AT[0]} - x_max, 0) + greatest(y_min - {AT[1]}, {AT[1]} - y_max, 0) * greatest(y_min - {AT[1]}, {AT[1]} - y_max, 0)) AS mindist FROM N) SELECT row_number() OVER (ORDER BY mindist, node_id) - 1 AS place, node_id, mindist FROM O",
    "split_rectangles": f"WITH {_RECTANGLES} SELECT U.node_id AS node_id, CAST(U.axis AS INTEGER) AS axis, CAST(U.bound AS INTEGER) AS bound, CAST(W.cut AS INTEGER) AS cut, U.id AS id, CAST(CASE WHEN U.rank <= W.cut THEN 1 ELSE 2 END AS INTEGER) AS side FROM U JOIN W ON U.node_id = W.node_id AND U.axis = W.axis AND U.bound = W.bound",
    "range_after_changes": f"WITH {_CHANGED} SELECT id, name, x, y FROM CH WHERE {_box('', AREA)}",
    "knn_after_changes": f"WITH {_CHANGED} SELECT id, name, x, y, {_DIST.format(*AT)} AS dist FROM CH ORDER BY dist, id LIMIT {K}",
    "skyline_after_changes": f"WITH {_CHANGED}, MM AS (SELECT x, y, min(id) AS id FROM CH GROUP BY x, y), FF AS (SELECT id, x, y, min(y) OVER (ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM MM) SELECT id, x, y FROM FF WHERE m IS NULL OR y < m",
}


def _descent(levels: int = 4) -> str:
    """Choice of the least growing child on every level, from the one below the root down to the leaves."""
    growth = "(greatest(x_max, qx) - least(x_min, qx)) * (greatest(y_max, qy) - least(y_min, qy)) - (x_max - x_min) * (y_max - y_min)"
    nodes = f"AN AS (SELECT 0 AS level, node_id, x_min, x_max, y_min, y_max FROM N UNION ALL SELECT level, node_id, x_min, x_max, y_min, y_max FROM NU), TP AS (SELECT max(level) AS top FROM AN)"
    steps, last = [], "SELECT qid, qx, qy, CAST(0 AS BIGINT) AS node_id FROM S"
    for k in range(levels, -1, -1):
        # levels above the root leave a point where it is
        steps.append(f"""D{k} AS (SELECT qid, qx, qy, node_id FROM (SELECT u.qid, u.qx, u.qy, CASE WHEN {k} >= top THEN CAST(0 AS BIGINT) ELSE a.node_id END AS node_id,
          row_number() OVER (PARTITION BY u.qid ORDER BY {growth}, a.node_id) AS r FROM ({last}) u, TP, AN a WHERE a.level = least({k}, top) AND ({k} >= top OR a.node_id // {CAP} = u.node_id)) WHERE r = 1)""")
        last = f"SELECT * FROM D{k}"
    return f"WITH {_UPPER}, {_SUPPLIERS}, {nodes}, {', '.join(steps)} SELECT qid AS id, node_id FROM D0"


ORACLES["choose_leaves"] = _descent()
