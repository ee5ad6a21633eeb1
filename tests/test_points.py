"""Hand-made rows and properties of the point engine."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pointloom.engine import PointEngine
from pointloom.functions import zorder
from pointloom.operators import changes, maintenance, search, skyline
from pointloom.plans.index import PointIndex, capacity, leaf_of, rectangle_join
from pointloom.plans.storage import number_rows
from pointloom.sources import osm, pbf
from pointloom.sources import points as P

RANGE_ROWS = [(1, 0, 0), (2, 0, 0), (3, 1, 1), (4, 2, 0), (5, 0, 2), (6, -1, -1), (7, 0.5, 0.5)]


def table(spark, rows):
    return spark.createDataFrame([(i, f"name {i}", float(x), float(y)) for i, x, y in rows], P.POINT_SCHEMA)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def scattered(n, seed=0, ties=False):
    rnd = random.Random(seed)
    return [(i, rnd.randint(-9, 9) if ties else rnd.uniform(-90, 90), rnd.randint(-9, 9) if ties else rnd.uniform(-180, 180)) for i in range(n)]


@pytest.fixture(scope="module")
def indexed(spark):
    rows = scattered(1500)
    return rows, PointIndex.build(table(spark, rows), most=20, fill=0.85)


def test_range_is_closed(spark):
    t = table(spark, RANGE_ROWS)
    assert ids(search.range_query(t, ((0, 1), (0, 1)))) == [1, 2, 3, 7]
    assert ids(search.range_query(t, ((1, 0), (0, 1)))) == []


def test_knn_ties_and_bounds(spark):
    t = table(spark, [(10, 3, 4), (11, 5, 0), (12, 0, 5), (13, 1, 0)])
    got = lambda k: [r["id"] for r in search.knn(t, (0, 0), k).collect()]
    assert got(2) == [13, 10] and got(3) == [13, 10, 11] and got(9) == [13, 10, 11, 12] and got(0) == []


def test_skyline_rows(spark):
    t = table(spark, [(20, 1, 5), (21, 2, 3), (22, 4, 1), (23, 3, 4), (24, 2, 3), (25, 5, 5)])
    assert ids(skyline.skyline_2d(t)) == ids(skyline.skyline(t, ("x", "y"))) == [20, 21, 22]
    assert ids(skyline.skyline_2d(table(spark, [(30, 1, 1), (31, -5, -5)]))) == [31]
    assert ids(skyline.skyline_2d(table(spark, []))) == ids(skyline.skyline(table(spark, []), ("x", "y"))) == []
    assert ids(skyline.skyline_2d(table(spark, [(4, 1, 1), (3, 1, 1)]))) == [3]


@pytest.mark.parametrize("seed", range(3))
def test_skyline_against_brute_force(spark, seed):
    rows = scattered(400, seed, ties=True)
    best = {}
    for i, x, y in rows:
        best[x, y] = min(i, best.get((x, y), i))
    want = sorted(i for (x, y), i in best.items() if not any((a, b) != (x, y) and a <= x and b <= y for a, b in best))
    t = table(spark, rows)
    assert ids(skyline.skyline_2d(t, 7)) == ids(skyline.skyline(t, ("x", "y"))) == want


def test_skyline_per_group(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["a", "b", None]), float(rnd.randint(-9, 9)), float(rnd.randint(-9, 9))) for i in range(300)]
    want = []
    for g in ("a", "b", None):
        best = {}
        for i, name, x, y in rows:
            if name == g:
                best[x, y] = min(i, best.get((x, y), i))
        want += [i for (x, y), i in best.items() if not any((a, b) != (x, y) and a <= x and b <= y for a, b in best)]
    assert ids(skyline.skyline_2d(spark.createDataFrame(rows, P.POINT_SCHEMA), 5, by=("name",))) == sorted(want)


def test_skyline_three_dimensions(spark):
    rnd = random.Random(3)
    rows = [(i, *(float(rnd.randint(0, 12)) for _ in range(3))) for i in range(600)]
    best = {}
    for i, *c in rows:
        best[tuple(c)] = min(i, best.get(tuple(c), i))
    want = sorted(i for c, i in best.items() if not any(o != c and all(a <= b for a, b in zip(o, c)) for o in best))
    assert ids(skyline.skyline(spark.createDataFrame(rows, "id long, a double, b double, c double"), ("a", "b", "c"))) == want


def test_delete_needs_id_and_coordinates(spark):
    t = table(spark, RANGE_ROWS)
    key = lambda i, x, y: spark.createDataFrame([(i, float(x), float(y))], "id long, x double, y double")
    assert ids(changes.delete(t, key(1, 0, 0))) == [2, 3, 4, 5, 6, 7]
    assert ids(changes.delete(t, key(1, 0, 1))) == [1, 2, 3, 4, 5, 6, 7]
    new = table(spark, [(99, 8, 8)])
    assert ids(changes.delete(changes.insert(t, new), new)) == ids(t)
    assert [tuple(r) for r in changes.repeated_ids(changes.insert(t, table(spark, [(1, 9, 9)]))).collect()] == [(1, 2)]


def test_invalid_coordinates_are_told_apart(spark):
    t = spark.createDataFrame([(1, "a", 1.0, 2.0), (2, "b", float("nan"), 2.0), (3, "c", 1.0, None), (0, "d", 0.0, 0.0)], P.POINT_SCHEMA)
    assert ids(P.valid(t)) == [0, 1] and ids(P.invalid(t)) == [2, 3]


def morton(a, b):
    return sum((a >> i & 1) << 2 * i | (b >> i & 1) << 2 * i + 1 for i in range(31))


def test_z_values(spark):
    rows = [(35.9, 14.5), (0.0, 0.0), (1e-7, 0.0), (214.7483647, 214.7483647)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double, y double").select(zorder.raw_z([F.col("x"), F.col("y")])).collect()]
    assert got[0] == 113043203489099776
    assert got == [morton(int(x * 1e7), int(y * 1e7)) for x, y in rows]
    three = spark.range(1).select(zorder.interleave([F.lit(5), F.lit(3), F.lit(1)], 20).alias("z")).first()["z"]
    assert three == sum((v >> i & 1) << (3 * i + d) for d, v in enumerate((5, 3, 1)) for i in range(20))


def test_names(spark):
    t = spark.createDataFrame([("short",), ("é" * 20,), ("x" * 29 + "é",), ("y" * 40,)], "name string")
    assert [r[0] for r in t.select(P.stored_name(F.col("name"))).collect()] == ["short", "é" * 15, "x" * 29, "y" * 30]


def test_number_rows(spark):
    rows = number_rows(table(spark, scattered(777, 2, ties=True)).repartition(5), ["x", "id"]).collect()
    assert [r["row_number"] for r in sorted(rows, key=lambda r: (r["x"], r["id"]))] == list(range(777))


def test_pages(spark):
    paged = P.page_layout(table(spark, scattered(130)), 50)
    assert sorted((r["block_id"], r["record_id"]) for r in paged.collect()) == [(i // 50, i % 50) for i in range(130)]
    assert tuple(P.page_statistics(paged, 50).first()) == (3, 130, 50, 30, 20, 130, 2, 30)
    assert tuple(P.page_statistics(P.page_layout(table(spark, scattered(100)), 50), 50).first())[4:] == (0, 100, 2, 0)
    assert tuple(P.page_statistics(P.page_layout(table(spark, []))).first()) == (0, 0, None, None, 0, 0, 0, 0)


@pytest.mark.parametrize("n", [0, 1, 17, 18, 19, 34, 35, 40, 43, 200])
def test_leaves_keep_their_bounds(spark, n):
    most, fill = 20, 0.85
    cap, least = capacity(most, fill), 8
    assert cap == 17
    index = PointIndex.build(table(spark, scattered(n, n)), most, fill)
    sizes = [r["n"] for r in index.nodes.filter("level = 0").collect()]
    assert sum(sizes) == n and index.points == n
    if n > cap:
        assert all(least <= s <= most for s in sizes)
    assert index.nodes.filter("parent_id is null").count() == (n > 0)
    meta = index.meta().first()
    assert meta["num_leaves"] == len(sizes) and meta["height"] == index.height and (n == 0) == (meta["x_min"] is None)


def test_packing_bounds_in_general(spark):
    for most, fill in ((10, 0.85), (50, 0.85), (1170, 0.85)):
        cap, least = capacity(most, fill), int(most * 0.4)
        for n in (1, cap, cap + 1, 2 * cap + 1, 3 * cap + least, 7 * cap + 2):
            rows = spark.range(n).select(leaf_of(F.col("id"), n, most, cap, least).alias("l")).groupBy("l").count().collect()
            sizes = [r["count"] for r in rows]
            assert sum(sizes) == n and (n <= cap or all(least <= s <= most for s in sizes)), (most, n, sizes)


def test_tree_contains_what_is_below(indexed):
    rows, index = indexed
    nodes = {(r["level"], r["node_id"]): r for r in index.nodes.collect()}
    assert index.height == 3 and sum(1 for k in nodes if k[0] == index.height - 1) == 1
    for r in index.layout.collect():
        leaf = nodes[0, r["leaf_id"]]
        assert leaf["x_min"] <= r["x"] <= leaf["x_max"] and leaf["y_min"] <= r["y"] <= leaf["y_max"]
    for (level, _), r in nodes.items():
        if r["parent_id"] is not None:
            up = nodes[level + 1, r["parent_id"]]
            assert up["x_min"] <= r["x_min"] and r["x_max"] <= up["x_max"] and up["y_min"] <= r["y_min"] and r["y_max"] <= up["y_max"]
    assert {r["points"] for k, r in nodes.items() if k[0] == index.height - 1} == {1500}


@pytest.mark.parametrize("seed", range(4))
def test_index_changes_no_answer(spark, indexed, seed):
    rows, index = indexed
    rnd = random.Random(seed)
    xs, ys = sorted(rnd.uniform(-90, 90) for _ in range(2)), sorted(rnd.uniform(-180, 180) for _ in range(2))
    assert ids(index.range_query((xs, ys))) == sorted(i for i, x, y in rows if xs[0] <= x <= xs[1] and ys[0] <= y <= ys[1])
    at, k = (rnd.uniform(-99, 99), rnd.uniform(-200, 200)), rnd.choice((1, 5, 50, 2000))
    want = sorted((math.sqrt((x - at[0]) ** 2 + (y - at[1]) ** 2), i) for i, x, y in rows)[:k]
    assert [r["id"] for r in index.knn(at, k).collect()] == [i for _, i in want]
    assert index.knn(at, 0).count() == 0


def test_indexed_skyline_and_joins(spark, indexed):
    rows, index = indexed
    assert ids(index.skyline()) == ids(skyline.skyline_2d(index.layout))
    queries = spark.createDataFrame([(1, 0.0, 0.0), (2, 88.0, -170.0), (3, 500.0, 500.0)], "qid long, qx double, qy double")
    got = sorted((r["qid"], r["rank"], r["id"]) for r in index.knn_join(queries, 6).collect())
    want = []
    for q, x0, y0 in ((1, 0, 0), (2, 88, -170), (3, 500, 500)):
        want += [(q, k + 1, i) for k, (_, i) in enumerate(sorted((math.sqrt((x - x0) ** 2 + (y - y0) ** 2), i) for i, x, y in rows)[:6])]
    assert got == want
    leaves = index.nodes.filter("level = 0").collect()
    meet = sorted((a["node_id"], b["node_id"]) for a in leaves for b in leaves if a["node_id"] < b["node_id"] and a["x_min"] <= b["x_max"] and b["x_min"] <= a["x_max"] and a["y_min"] <= b["y_max"] and b["y_min"] <= a["y_max"])
    assert sorted(map(tuple, index.intersecting_leaves().collect())) == meet


def test_range_join_without_pairs_twice(spark):
    rows = scattered(300, 5, ties=True)
    boxes = [(1, -9.0, 9.0, -9.0, 9.0), (2, 0.0, 0.0, -5.0, 5.0), (3, 5.0, 1.0, 0.0, 1.0), (4, 3.0, 4.0, 3.0, 3.0)]
    areas = spark.createDataFrame(boxes, "area_id long, x_min double, x_max double, y_min double, y_max double")
    want = sorted((a, i) for a, x0, x1, y0, y1 in boxes for i, x, y in rows if x0 <= x <= x1 and y0 <= y <= y1)
    for grid in (1, 7, 64):
        assert sorted((r["area_id"], r["id"]) for r in search.range_join(table(spark, rows), areas, grid).collect()) == want
    assert search.range_join(table(spark, rows), areas.limit(0)).count() == 0
    assert rectangle_join(areas.filter("area_id <> 3"), areas.limit(0)).count() == 0


def test_split_example(spark):
    rows = [(1, i, float(x), float(x), float(y), float(y)) for i, (x, y) in enumerate([(0, 0), (1, 1), (2, 0), (10, 1), (11, 0)])]
    entries = spark.createDataFrame(rows, "node_id long, id long, x_min double, x_max double, y_min double, y_max double")
    got = maintenance.split(entries, 1).collect()
    assert {(r["axis"], r["cut"]) for r in got} == {(0, 3)}
    assert sorted(r["id"] for r in got if r["side"] == 1) == [0, 1, 2]
    assert [r["id"] for r in maintenance.forced_reinsert(entries).collect()] in ([0], [4])
    nodes = spark.createDataFrame([(1, 0.0, 2.0, 0.0, 2.0), (2, 4.0, 6.0, 0.0, 2.0)], "node_id long, x_min double, x_max double, y_min double, y_max double")
    new = table(spark, [(1, 3, 1), (2, 5, 1), (3, 3.5, 1)])
    assert sorted((r["id"], r["node_id"]) for r in maintenance.choose_subtree(new, nodes).collect()) == [(1, 1), (2, 2), (3, 2)]


def test_osm_xml(spark, tmp_path):
    (tmp_path / "m.osm").write_text('<osm version="0.6"><node id="101" lat="35.9" lon="14.5"/><node id="102" lat="-35.91" lon="14.51"><tag k="name" v="x"/></node><way id="9"><nd ref="101"/></way></osm>')
    got = sorted(tuple(r) for r in osm.read(spark, str(tmp_path / "m.osm")).collect())
    assert got == [(101, "name 6", 35.9, 14.5), (102, "name 7", -35.91, 14.51)]


def _varint(v):
    out = b""
    while v > 127:
        out, v = out + bytes([v & 127 | 128]), v >> 7
    return out + bytes([v])


def _zig(v):
    return _varint(v << 1 if v >= 0 else (-v << 1) - 1)


def _field(n, v):
    return _varint(n << 3) + _varint(v) if isinstance(v, int) else _varint(n << 3 | 2) + _varint(len(v)) + v


def _file(blocks):
    out = b""
    for kind, body, packed in blocks:
        blob = _field(3, zlib.compress(body)) if packed else _field(1, body)
        head = _field(1, kind) + _field(3, len(blob))
        out += len(head).to_bytes(4, "big") + head + blob
    return out


def test_osm_pbf(spark, tmp_path):
    nodes = [(101, 359000000, 145000000), (102, -359100000, 145100000), (5, 0, -1799999999)]
    dense, last = [b"", b"", b""], (0, 0, 0)
    for n in nodes:
        dense = [d + _zig(a - b) for d, a, b in zip(dense, n, last)]
        last = n
    group = _field(2, _field(1, dense[0]) + _field(8, dense[1]) + _field(9, dense[2]))
    plain = _field(1, _varint(8) + _zig(7) + _varint(64) + _zig(10000000) + _varint(72) + _zig(-20000000))
    blocks = [(b"OSMHeader", b"", False), (b"OSMData", _field(1, b"") + _field(2, group), True), (b"OSMData", _field(2, plain) + _field(17, 100), False)]
    (tmp_path / "m.osm.pbf").write_bytes(_file(blocks))
    assert list(pbf.blobs(_file(blocks)))[0]
    got = sorted((r["id"], round(r["x"], 7), round(r["y"], 7)) for r in osm.read(spark, str(tmp_path / "m.osm.pbf")).collect())
    assert got == [(5, 0.0, -179.9999999), (7, 1.0, -2.0), (101, 35.9, 14.5), (102, -35.91, 14.51)]


def test_engine_round_trip(spark, tmp_path):
    rows = scattered(200, 9)
    engine = PointEngine.bulk_loading(table(spark, rows), most=20)
    engine.save(str(tmp_path / "index"))
    again = PointEngine.load(spark, str(tmp_path / "index"))
    assert ids(again.range_query(((-50, 50), (-50, 50)))) == ids(engine.range_query(((-50, 50), (-50, 50))))
    assert again.meta().first() == engine.meta().first()
    more = again.insert_point(1000, (0.0, 0.0))
    assert more.serial_search(1000).first()["name"] == "name 1" and [r["id"] for r in more.knn_query(1, (0, 0)).collect()] == [1000]
    less, gone = more.remove_point(1000, (0.0, 0.0))
    assert gone and ids(less.points) == ids(engine.points)
    assert not less.remove_point(1000, (0.0, 0.0))[1]
    assert maintenance.underfull(engine.index.nodes.filter("level = 0"), 8).count() == 0


def test_zero_extent(spark):
    index = PointIndex.build(table(spark, [(i, 1, 1) for i in range(30)]), most=10)
    assert {r["z"] for r in index.layout.collect()} == {0}
    assert [r["id"] for r in index.knn((0, 0), 3).collect()] == [0, 1, 2] and index.range_query(((1, 1), (1, 1))).count() == 30


def test_intermediate_tables_can_be_removed(spark):
    from pointloom.plans import registry, storage

    assert storage.materialise(spark.range(3).toDF("id"), "some").count() == 3
    assert storage.clean(spark) and not storage.clean(spark)
    registry._BUILT.clear()


def test_stream_append(spark, tmp_path):
    from pointloom.streaming import ingest

    P.write(table(spark, RANGE_ROWS), str(tmp_path / "in"))
    for _ in range(2):
        ingest.append(ingest.watch(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log"), once=True).awaitTermination()
    assert ids(P.read(spark, str(tmp_path / "out"))) == [1, 2, 3, 4, 5, 6, 7]


def test_delta_changes_no_answer(spark):
    rows = scattered(900, seed=5)
    index = PointIndex.build(table(spark, rows), most=20, fill=0.85)
    new = [(5000 + i, x + 0.5, y) for i, x, y in scattered(20, seed=6)] + [(3, rows[3][1], rows[3][2])]
    gone = rows[:15] + [(800, 0.0, 0.0)]
    changed, went = index.insert(table(spark, new)).delete(table(spark, gone).select("id", "x", "y"))
    assert went == 16 and changed.layout is index.layout and changed.n_added == 20 and changed.n_gone == 15  # the packed part stands as it is
    left = table(spark, rows[15:] + new[:20])
    assert changed.count() == left.count() and ids(changed.rows()) == ids(left)
    for area in (((-50, 20), (-100, 90)), ((-90, 90), (-180, 180)), ((500, 501), (0, 1))):
        assert ids(changed.range_query(area)) == ids(search.range_query(left, area))
    for at in ((rows[0][1], rows[0][2]), (90, 180), (0, 0)):
        assert [r["id"] for r in changed.knn(at, 17).collect()] == [r["id"] for r in search.knn(left, at, 17).collect()]
    assert ids(changed.skyline()) == ids(skyline.skyline_2d(left))
    queries = spark.createDataFrame([(1, rows[0][1], rows[0][2]), (2, 40.0, 40.0)], "qid long, qx double, qy double")
    pairs = lambda i: sorted((r["qid"], r["rank"], r["id"]) for r in i.knn_join(queries, 6).collect())
    packed = changed.compact()
    assert pairs(changed) == pairs(packed) == pairs(index.delete(table(spark, gone).select("id", "x", "y"))[0].insert(table(spark, new[:20])))
    assert packed.n_added == packed.n_gone == 0 and ids(packed.layout) == ids(left)
    # a point put back is there, and can be taken out again
    back = changed.insert(table(spark, rows[:1]))
    assert back.count() == changed.count() + 1 and back.delete(table(spark, rows[:1]))[1] == 1
    # past the share of changes the index is packed anew
    many = index.insert(table(spark, scattered(100, seed=7)))
    assert many.n_added == 0 and many.points == 1000


def test_changed_index_is_saved_whole(spark, tmp_path):
    rows = scattered(300, seed=8)
    index, _ = PointIndex.build(table(spark, rows), most=20, fill=0.85).insert(table(spark, [(999, 1, 1)])).delete(table(spark, rows[:2]))
    index.save(str(tmp_path / "index"))
    assert ids(PointIndex.load(spark, str(tmp_path / "index")).layout) == sorted([r[0] for r in rows[2:]] + [999])


def test_subtree_choice_is_bounded_by_the_fan_out(spark):
    nodes = spark.range(6).selectExpr("id node_id", "id * 10.0 x_min", "id * 10.0 + 5 x_max", "0.0D y_min", "1.0D y_max")
    got = maintenance.choose_subtree(table(spark, [(1, 21, 0), (2, 57, 1)]), nodes)
    assert sorted((r["id"], r["node_id"]) for r in got.collect()) == [(1, 2), (2, 5)] and "NestedLoop" not in got._jdf.queryExecution().toString().replace("BroadcastNestedLoopJoin BuildRight, Inner", "")
    with pytest.raises(ValueError):
        maintenance.choose_subtree(table(spark, [(1, 21, 0)]), nodes, fan_out=5)


def test_leaf_choice_descends_by_least_growth(spark):
    index = PointIndex.build(table(spark, scattered(700, seed=16)), most=20, fill=0.85)  # others' tables may have been removed by now
    nodes = [r.asDict() for r in index.nodes.collect()]
    points = scattered(40, seed=9)

    def growth(n, x, y):
        return (max(n["x_max"], x) - min(n["x_min"], x)) * (max(n["y_max"], y) - min(n["y_min"], y)) - (n["x_max"] - n["x_min"]) * (n["y_max"] - n["y_min"])

    want = {}
    for i, x, y in points:
        at = 0
        for level in range(index.height - 2, -1, -1):
            at = min((growth(n, x, y), n["node_id"]) for n in nodes if n["level"] == level and n["parent_id"] == at)[1]
        want[i] = at
    assert {r["id"]: r["node_id"] for r in index.choose_leaves(table(spark, points)).collect()} == want


@pytest.mark.parametrize("spread", ["even", "ties", "skewed"])
def test_dominated_points_and_skylines_however_points_are_spread(spark, spread):
    rows = scattered(400, seed=11, ties=spread == "ties")
    if spread == "skewed":  # all but one in a hair's breadth of x
        rows = [(i, x * 1e-9, y) for i, x, y in rows] + [(900, 1e9, -500.0)]
    others = [(i, x + 3, y + 2) for i, x, y in rows[:50]]
    beats = lambda o, p: o[1] <= p[1] and o[2] <= p[2] and (o[1] < p[1] or o[2] < p[2])
    assert ids(skyline.dominated_by_any(table(spark, rows), table(spark, others))) == [p[0] for p in rows if any(beats(o, p) for o in others)]
    edge = [p for p in rows if not any(beats(o, p) for o in rows)]
    assert ids(skyline.skyline_2d(table(spark, rows))) == sorted(min(q[0] for q in edge if q[1:] == p[1:]) for p in {e[1:]: e for e in edge}.values())


def test_clustered_points_spread_over_cells(spark):
    rnd = random.Random(13)
    rows = [(i, rnd.gauss(0, 1e-6), rnd.gauss(0, 1e-6)) for i in range(1500)] + [(9000, 80.0, 170.0)]
    points = table(spark, rows)
    areas = spark.createDataFrame([(1, -1e-6, 1e-6, -1e-6, 1e-6), (2, -90.0, 90.0, -180.0, 180.0), (3, 5.0, 4.0, 0.0, 1.0)], "area_id long, x_min double, x_max double, y_min double, y_max double")
    got = sorted((r["area_id"], r["id"]) for r in search.range_join(points, areas).collect())
    box = {1: (-1e-6, 1e-6, -1e-6, 1e-6), 2: (-90, 90, -180, 180)}
    assert got == sorted((a, i) for a, (p, q, u, v) in box.items() for i, x, y in rows if p <= x <= q and u <= y <= v)
    inner = search.borders(points, [F.col("x")], 16)[0]
    cells = points.groupBy(search.cell(F.col("x"), inner).alias("c")).count().collect()
    assert len(cells) >= 12 and max(r["count"] for r in cells) < 300


def test_entry_without_the_text_operators(monkeypatch):
    import builtins
    import importlib

    import __spark_entry__ as entry

    plain = builtins.__import__

    def no_text(name, *args, **kwargs):
        if name.startswith(("pointloom.llm", "corpus_pipeline")):
            raise ImportError(name)
        return plain(name, *args, **kwargs)

    from pointloom.plans import registry

    monkeypatch.setattr(builtins, "__import__", no_text)
    importlib.reload(entry)
    assert entry.queries() == registry.QUERIES and entry.oracle_sql() == registry.ORACLES


def test_shared_folder_is_asked_for_on_a_cluster():
    from pointloom.plans.storage import shared_dir

    class Conf:
        def __init__(self, **held):
            self.held = held

        def get(self, key, default=None):
            return self.held.get(key.rsplit(".", 1)[-1], default)

    class Session:
        conf = Conf(master="yarn")

    with pytest.raises(ValueError):
        shared_dir(Session)


def test_packed_numbers():
    def coded(v):
        v, out = (v << 1 ^ v >> 63) & (1 << 64) - 1, b""
        while v >= 128:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    rnd = random.Random(14)
    for n in (0, 1, 500):
        values = [rnd.choice((0, -1, 1, rnd.randint(-(1 << 62), 1 << 62), rnd.randint(-300, 300), -(1 << 63), (1 << 63) - 1)) for _ in range(n)]
        assert pbf.packed(b"".join(map(coded, values))).tolist() == values
