"""Operators on small made-up cases, and properties against brute force."""

import itertools
import math
import random
import re
import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmill.functions import geometry as g
from trailmill.operators import graph, network, polygon, simplify, track
from trailmill.plans import catalogue
from trailmill.sources import gpsfile, gpx, streets, svg
from trailmill.streaming import fixes

COORDS = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=2, max_size=9)


def close(points, kept, epsilon):
    return all((simplify.segment_distances(points[i + 1 : j], points[i], points[j]) <= epsilon).all() for i, j in zip(kept, kept[1:]))


@settings(max_examples=150, deadline=None)
@given(COORDS, st.sampled_from([0.0, 0.5, 1.0, 3.0]))
def test_simplification_is_least(coords, epsilon):
    points = np.array(coords, float)
    kept = simplify.fewest_points(points, epsilon)
    assert kept[0] == 0 and kept[-1] == len(points) - 1 and close(points, kept, epsilon)
    for n in range(len(kept) - 2):
        for inner in itertools.combinations(range(1, len(points) - 1), n):
            assert not close(points, [0, *inner, len(points) - 1], epsilon)


def test_long_polylines_are_split():
    angle = np.linspace(0, 2 * np.pi, 1500)
    ring = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    ring[-1] = ring[0]
    kept = simplify.kept_vertices(ring, 0.001)
    assert 10 < len(kept) < 200 and kept == sorted(set(kept)) and close(ring, kept, 0.001)


def test_simplify_around(spark):
    rows = [(1, i, i * 0.001, 0.0, i in (0, 5, 9)) for i in range(12)]
    kept = simplify.simplify_around(spark.createDataFrame(rows, "track_id int, seq int, lon double, lat double, is_waypoint boolean"))
    assert sorted(r["seq"] for r in kept.collect()) == [0, 5, 9, 10, 11]


def test_grid_cut_keeps_length_and_tiles(spark):
    rng = random.Random(4)
    rows = [(i, 0, *(rng.uniform(-0.01, 0.01) for _ in range(4))) for i in range(100)] + [(100, 0, 0.0, 0.0, 0.004, 0.0), (101, 0, 1.0, 1.0, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "way_id int, seq int, x1 double, y1 double, x2 double, y2 double")
    edges = network.tile_edges(network.cut_on_grid(table)).collect()
    length = {}
    for e in edges:
        assert e["tx"] is not None
        for v, t in (("x1", "tx"), ("x2", "tx"), ("y1", "ty"), ("y2", "ty")):
            assert e[t] * g.SIDE - 2 * g.BORDER <= e[v] <= (e[t] + 1) * g.SIDE + 2 * g.BORDER
        length[e["way_id"]] = length.get(e["way_id"], 0) + math.dist((e["x1"], e["y1"]), (e["x2"], e["y2"]))
    for w, _, x1, y1, x2, y2 in rows[:-1]:
        assert abs(length[w] - math.dist((x1, y1), (x2, y2))) < 1e-12
    assert 101 not in length and sum(e["way_id"] == 100 for e in edges) == 3


def test_merge_covers_the_same_and_is_stable(spark):
    rng = random.Random(5)
    lines = set()
    for _ in range(200):
        x, y, dx, dy = rng.randrange(40), rng.randrange(40), *rng.choice([(1, 0), (0, 1), (1, 1), (2, 1)])
        n = rng.randrange(1, 6)
        ends = [(x, y), (x + n * dx, y + n * dy)]
        rng.shuffle(ends)
        lines.add((0, 0, *ends[0], *ends[1]))
    schema = "tx bigint, ty bigint, cx1 int, cy1 int, cx2 int, cy2 int"
    merged = network.merge_collinear(spark.createDataFrame(sorted(lines), schema))
    got = sorted(tuple(r) for r in merged.collect())

    def cover(rows):
        out = set()
        for _, _, x1, y1, x2, y2 in rows:
            n = math.gcd(x2 - x1, y2 - y1)
            sx, sy = (x2 - x1) // n, (y2 - y1) // n
            if (sx, sy) < (0, 0):
                x1, y1, sx, sy = x2, y2, -sx, -sy
            out |= {(x1 + i * sx, y1 + i * sy, sx, sy) for i in range(n)}
        return out

    assert cover(got) == cover(lines) and len(got) < len(lines)
    assert sorted(tuple(r) for r in network.merge_collinear(spark.createDataFrame(got, schema)).collect()) == got


def test_way_split_of_loops(spark):
    rows = [(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 1), (2, 0, 2), (2, 1, 9), (3, 0, 7)]
    pieces = network.split_ways(spark.createDataFrame(rows, "way_id int, seq int, node_id int"))
    assert sorted((r["way_id"], r["piece"], r["node_id"]) for r in pieces.collect()) == [(1, 0, 1), (1, 0, 2), (1, 1, 1), (1, 1, 2), (1, 1, 3), (2, 0, 2), (2, 0, 9)]


def test_interests(spark):
    tag = lambda *pairs: [{"k": k, "v": v} for k, v in pairs]
    rows = [(1, 0.1, 0.1, tag(("a", "x"), ("b", "y"))), (2, 0.2, 0.2, tag(("c", "z"))), (3, 0.3, 0.3, tag(("b", "y"), ("a", "x"), ("q", "r")))]
    nodes = spark.createDataFrame(rows, "node_id int, lon double, lat double, tags array<struct<k: string, v: string>>")
    found = network.interests(nodes, [("a", "x"), ("b", "y"), ("a", "x")])
    assert sorted((r["lon"], r["type"]) for r in found.collect()) == [(0.1, 2), (0.3, 3)]


def test_corridor_rings(spark):
    rows = [("a", 0, 0.0005, 0.0005), ("a", 1, 0.0305, 0.0105), ("b", 0, 0.0, 0.0), ("b", 1, 0.0001, 0.0001)]
    points = spark.createDataFrame(rows, "track_id string, seq int, lon double, lat double")
    segments = network.segments(points, ("track_id",))
    ring = polygon.corridor_polygon(segments)
    cells = {r["track_id"]: r["n"] for r in polygon.corridor_cells(segments).groupBy("track_id").agg(F.count("*").alias("n")).collect()}
    area = {r["track_id"]: r["area"] for r in polygon.signed_area(ring).collect()}
    assert all(abs(-area[t] / (2 * g.SIDE) ** 2 - cells[t]) < 1e-6 for t in ("a", "b"))


def test_routes_and_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(30), rng.randrange(30), float(rng.randrange(1, 9))) for _ in range(60)]
    best = {0: 0.0}
    for _ in range(30):
        for a, b, n in links:
            if a in best and best[a] + n < best.get(b, math.inf):
                best[b] = best[a] + n
    table = spark.createDataFrame(links, "a int, b int, length double")
    sources = spark.createDataFrame([(0, 0)], "source int, node int")
    assert {r["node"]: r["distance"] for r in graph.routes(table, sources).collect()} == best
    near = {r["node"] for r in graph.routes(table, sources, bound=6.0).collect()}
    assert near == {k for k, v in best.items() if v <= 6}
    of = {x: {x} for a, b, _ in links for x in (a, b)}
    for a, b, _ in links:
        merged = of[a] | of[b]
        for x in merged:
            of[x] = merged
    assert {r["node"]: r["component"] for r in graph.components(table).collect()} == {x: min(s) for x, s in of.items()}


def test_geometry(spark):
    row = spark.range(1).select(
        g.haversine(*map(F.lit, (2.35, 48.85, -0.12, 51.5))).alias("km"), g.bearing(*map(F.lit, (0.0, 0.0, -1.0, -1.0))).alias("back"), g.angle_between(F.lit(0.1), F.lit(6.2)).alias("turn"),
        g.segment_distance(*map(F.lit, (0.0, 1.0, -1.0, 0.0, 1.0, 0.0))).alias("near"), g.segment_distance(*map(F.lit, (3.0, 4.0, 0.0, 0.0, 0.0, 0.0))).alias("point"),
        g.cell(F.lit(-0.0001)).alias("floor"), g.cell(F.lit(-0.0001), toward_zero=True).alias("trunc"), F.size(g.tiles_of(F.lit(0.0), F.lit(0.0))).alias("corner"), F.size(g.tiles_of(F.lit(0.0007), F.lit(0.0007))).alias("middle"),
    ).first()
    assert abs(row["km"] / 1000 - 341.7) < 2 and abs(row["back"] - 5 * math.pi / 4) < 1e-12 and abs(row["turn"] - (2 * math.pi - 6.1)) < 1e-12
    assert (row["near"], row["point"], row["floor"], row["trunc"], row["corner"], row["middle"]) == (1.0, 5.0, -1, 0, 4, 1)


def test_quantising_error(spark):
    rng = random.Random(7)
    table = spark.createDataFrame([(rng.uniform(-9, 9),) for _ in range(300)], "x double")
    tile = F.floor(F.col("x") / g.SIDE)
    back = g.dequantise(g.quantise(F.col("x"), tile), tile)
    assert table.agg(F.max(F.abs(back - F.col("x")))).first()[0] <= g.SIDE / 510 + 1e-12


def test_binary_blocks():
    edges = [(4, 7, 1, 2, 3, 4), (5, 7, 0, 0, 255, 255), (4, 8, 9, 9, 8, 8)]
    points = [(5.7, 45.1, True)] + [(5.7 + i / 100, 45.2, i == 8) for i in range(1, 10)]
    data = gpsfile.interests_block([(4, 7, 2, 10, 20)]) + gpsfile.path_block(points) + gpsfile.heights_block([1.9, -40000.0] + [3.0] * 8) + gpsfile.tiles_block(edges)
    rows = list(gpsfile.blocks(data))
    assert sorted((r[2], r[3], *map(int, r[4:8])) for r in rows if r[0] == "edge") == sorted(edges)
    assert [(r[4], r[5], bool(r[6])) for r in rows if r[0] == "point"] == points
    assert [r[4] for r in rows if r[0] == "height"][:2] == [1.0, -32768.0]
    west = list(gpsfile.blocks(gpsfile.interests_block([(-3, -1, 2, 10, 20)])))
    assert [tuple(r[2:7]) for r in west] == [(-3, -1, 2.0, 10.0, 20.0)]
    assert [tuple(r[2:7]) for r in rows if r[0] == "interest"] == [(4, 7, 2.0, 10.0, 20.0)]
    assert gpsfile.heights_block([1.0, None]) == b"" and gpsfile.interests_block([]) == b""
    with pytest.raises(ValueError):
        list(gpsfile.blocks(b"\x09"))
    assert struct.unpack_from("<BH", gpsfile.path_block(points)) == (gpsfile.PATH, 10)


def test_files_west_and_south_of_zero(spark):
    """Tracks on all sides of 0, with waypoints as interests and streets, come back as they were."""
    points = [(t, i, x + i * 0.0004, y - i * 0.0003, float(100 + i), i in (0, 4)) for t, (x, y) in enumerate([(-3.7, -33.4), (-0.001, 0.001), (18.4, -33.9)]) for i in range(5)]
    marked = spark.createDataFrame(points, "track_id int, seq int, lon double, lat double, ele double, is_waypoint boolean")
    edges = network.quantised(network.tile_edges(network.cut_on_grid(network.segments(marked, ("track_id",)))))
    spots = marked.where("is_waypoint").select(F.lit(0).alias("type"), "lon", "lat")
    names = spark.createDataFrame([(0, "Calle Á", 3, 1), (0, "Calle Á", 4, 0), (2, "Long Street", 0, 0)], "track_id int, name string, tile_no int, local_id int")
    rows = gpsfile.decode(gpsfile.encode(marked, edges, spots, street_edges=names))
    got = rows.collect()
    assert sorted((r["track_id"], r["number"], r["a"], r["b"], r["c"] == 1) for r in got if r["kind"] == "point") == [(t, i, x, y, f) for t, i, x, y, _, f in points]
    assert {(r["tx"], r["ty"]) for r in got if r["kind"] == "interest" and r["track_id"] == 0} == {(math.floor(x / g.SIDE), math.floor(y / g.SIDE)) for t, _, x, y, _, f in points if f and t == 0}
    assert sorted((r["track_id"], r["name"], r["a"], r["b"]) for r in got if r["kind"] == "street") == [(0, "Calle A", 3.0, 1.0), (0, "Calle A", 4.0, 0.0), (2, "Long Street", 0.0, 0.0)]
    lines = {(r["track_id"], r["number"]): r["line"] for r in gpsfile.listing(rows).collect()}
    assert lines[0, 0] == "-3.700000 -33.400000 100 m ***" and lines[0, 1].endswith("101 m")
    bare = gpsfile.decode(gpsfile.encode(track.without_elevation(marked), edges, spots))
    assert bare.where("kind = 'height'").count() == 0


def test_route_to_street(spark):
    places = spark.createDataFrame([(i, float(i % 4), float(i // 4)) for i in range(16)], "node int, x double, y double")
    pairs = [(a, b) for a in range(16) for b in range(16) if abs(a % 4 - b % 4) + abs(a // 4 - b // 4) == 1 and {a, b} != {5, 6}]
    links = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a int, b int, length double")
    street = spark.createDataFrame([("high", 6), ("high", 15), ("far", 99)], "street string, node int")
    requests = spark.createDataFrame([(1, 5, "high"), (2, 6, "high"), (3, 0, "far"), (4, 0, "none")], "request_id int, node int, street string")
    got = {}
    for r in graph.route_to_street(requests, links, places, street).orderBy("step").collect():
        got.setdefault(r["request_id"], []).append(r["node"])
    assert got == {1: [6, 2, 1, 5], 2: [6]}
    goals = spark.createDataFrame([(1, 5, 6), (2, 0, 0)], "request_id int, source int, node int")
    bound = {r["request_id"]: r["distance"] for r in graph.greedy_bound(links, places, goals).collect()}
    assert bound == {1: 3.0, 2: 0.0}


def test_street_dictionary(spark):
    names = [("Rue de l'Église", [(1, 2), (70000, 3)]), ("Avenue É", []), ("Zoé", [(4, 4)]), ("abc", [(5, 5)])]
    back = streets.decode(streets.encode(names))
    assert back == [(streets.strip_accents(n), w) for n, w in sorted(names, key=lambda s: s[0].encode())]
    table = spark.createDataFrame([(1, n, t, k) for n, ways in names for t, k in ways], "map_id int, name string, tile_no int, local_id int")
    (row,) = streets.encoded(table).collect()
    assert [n for n, _ in streets.decode(bytes(row["streets"]))] == ["Rue de l'Eglise", "Zoe", "abc"]


def test_picture(spark):
    points = spark.createDataFrame([(1, 0, 5.7, 45.1), (1, 1, 5.71, 45.11)], "track_id int, seq int, lon double, lat double")
    edges = spark.createDataFrame([(4275, 33825, 0, 0, 255, 255)], "tx bigint, ty bigint, cx1 int, cy1 int, cx2 int, cy2 int")
    assert svg.COLORS[0] == "black" and svg.node_layer(points).count() == 2 and svg.segment_layer(network.segments(points, ("track_id",))).count() == 1
    text = svg.document(svg.draw(points, edges).unionByName(svg.layers(svg.point_layer(points))), (5.7, 45.1, 5.71, 45.11))
    assert text.startswith("<svg") and text.count("<circle") == 2 and "<polyline" in text and "<rect" in text and "<line" in text
    assert gpx.from_area(spark, 0.0, 1.0, 2.0, 3.0).count() == 5


def fix_rows():
    rng = random.Random(8)
    out, place = [], [5.7, 45.1]
    for i in range(60):
        place = [place[0] + rng.choice([0, 1e-5, 2e-4]), place[1] + rng.choice([0, -1e-5, 1e-4])]
        out.append((i % 3, datetime(2024, 1, 1) + timedelta(seconds=i), *place))
    return out + [(0, datetime(2024, 1, 1, 0, 10), 0.0, 0.0), (1, datetime(2024, 1, 1, 0, 10), float("nan"), 1.0)]


FIX = "device_id int, ts timestamp, lon double, lat double"


def test_gate_in_batch_and_stream(spark, tmp_path):
    rows = fix_rows()
    batch = fixes.accepted(spark.createDataFrame(rows, FIX))
    want = sorted(tuple(r)[:4] for r in batch.collect())
    for device in range(3):
        last, kept = None, []
        for d, ts, *place in rows:
            if d == device and place[0] == place[0] and any(place) and (last is None or fixes.metres(last, place) >= 4):
                last = place
                kept.append((ts, *place))
        assert [w[1:] for w in want if w[0] == device] == kept
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    for i, part in enumerate((rows[:25], rows[25:50], rows[50:])):
        spark.createDataFrame(part, FIX).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(FIX + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("part")
    q = fixes.accepted_stream(stream).writeStream.format("memory").queryName("gate").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r)[:4] for r in spark.sql("select * from gate").collect()) == want


def test_stream_drops_late_fixes(spark, tmp_path):
    """What comes later than the delay behind the triggers before is dropped; what is late by less is gated."""
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    parts = [[(1, at(0), 5.0, 45.0), (1, at(20), 5.1, 45.0)], [(1, at(1), 5.2, 45.0), (1, at(19.5), 5.3, 45.0), (2, at(2), 6.0, 45.0)], [(1, at(30), 5.4, 45.0)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, FIX).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(FIX + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("part")
    q = fixes.accepted_stream(stream).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["lon"] for r in spark.sql("select * from late").collect()) == [5.0, 5.1, 5.3, 5.4]


def test_simulated_fixes(spark):
    rows = fixes.simulated(spark, (5.0, 45.0, 6.0, 46.0))
    assert rows.isStreaming and rows.columns == ["device_id", "ts", "lon", "lat"]


def test_viewport_join(spark):
    at = spark.createDataFrame([(1, 5.7001, 45.1001)], "device_id int, lon double, lat double")
    tx, ty = math.floor(5.7001 / g.SIDE), math.floor(45.1001 / g.SIDE)
    edges = spark.createDataFrame([(tx + i, ty + j, i) for i in (-2, -1, 0) for j in (0, 1, 2)], "tx bigint, ty bigint, n int")
    assert fixes.with_viewport(at, edges, g.SIDE).count() == 4


def test_spacing_and_heights(spark):
    rows = [(1, i, t) for i, t in enumerate([0.0, 0.0001, 0.0004, 0.0006, 0.0009])]
    kept = track.spaced(spark.createDataFrame(rows, "track_id int, seq int, travelled double"))
    assert sorted(r["seq"] for r in kept.collect()) == [0, 2, 4]
    points = spark.createDataFrame([(1, 0, 1.0, 1.0, 5.5), (1, 1, 2.0, 2.0, None), (1, 2, 2.0, 2.0, 7.9), (2, 0, 1.0, 1.0, None)], "track_id int, seq int, lon double, lat double, ele double")
    assert sorted((r["track_id"], r["seq"], r["height"]) for r in track.heights(points).collect()) == [(1, 0, 5), (1, 1, 7), (1, 2, 7)]


def test_routes_raise_when_rounds_are_spent(spark):
    links = spark.createDataFrame([(i, i + 1, 1.0) for i in range(4)], "a bigint, b bigint, length double")
    sources = spark.createDataFrame([(0, 0)], "source bigint, node bigint")
    with pytest.raises(RuntimeError):
        graph.routes(links, sources, rounds=2)
    assert {r["node"]: r["distance"] for r in graph.routes(links, sources).collect()} == {i: float(i) for i in range(5)}


def joined_rows(frame):
    """The most rows that a join of the frame's executed plan gave."""
    frame.collect()
    plans, most = [frame._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
        elif plan.nodeName().endswith("QueryStage"):
            plans.append(plan.plan())
        if "Join" in plan.nodeName():
            most = max(most, plan.metrics().apply("numOutputRows").value())
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return most


def test_obvious_counts_exits_without_joining_each_step_with_each(spark):
    rng = random.Random(5)
    here = (5.7, 45.1)
    place = lambda: (5.7 + rng.randrange(-30, 31) / 100000, 45.1 + rng.randrange(-30, 31) / 100000)
    ring = [(here[0] + 0.01 * math.cos(k * math.pi / 10), here[1] + 0.01 * math.sin(k * math.pi / 10)) for k in range(20)]
    exits = list({place() for _ in range(150)} | set(ring))
    few = [((5.8, 45.2), (5.81, 45.2)), ((5.8, 45.2), (5.8, 45.21)), ((5.8, 45.2), (5.79, 45.2))]
    steps = [(1, k, *place(), *here, *place()) for k in range(200)] + [(2, k, *ring[k], *here, *ring[(k + 7) % 20]) for k in range(20)]
    steps += [(3, 0, 5.79, 45.2, 5.8, 45.2, 5.81, 45.2), (3, 1, 5.81, 45.2, 5.8, 45.2, 5.8, 45.21), (4, 0, 5.0, 45.0, 5.1, 45.0, 5.2, 45.0)]
    out = graph.obvious(
        spark.createDataFrame(steps, "track_id long, seq long, px double, py double, x double, y double, qx double, qy double"),
        spark.createDataFrame([(*here, *e) for e in exits] + [(*a, *b) for a, b in few], "x double, y double, ox double, oy double"),
    )

    def bearing(x1, y1, x2, y2):
        angle = math.atan2(y2 - y1, x2 - x1)
        return angle + 2 * math.pi if angle < 0 else angle

    def between(a, b):
        return min(abs(b - a), 2 * math.pi - abs(b - a))

    want = set()
    for track, seq, px, py, x, y, qx, qy in steps:
        own = exits if (x, y) == here else [b for a, b in few if a == (x, y)]
        ahead = bearing(px, py, x, y)
        reach = between(ahead, bearing(x, y, qx, qy)) + math.pi / 10
        aligned = sum(between(ahead, bearing(x, y, *e)) <= reach for e in own)
        want.add((track, seq, len(own), aligned, len(own) <= 2 or aligned == 1))
    assert {(r.track_id, r.seq, r.n_exits, r.n_aligned, r.obvious) for r in out.collect()} == want
    assert joined_rows(out) <= len(steps)


def test_detected_crossroads_hold_one_row_per_step_at_a_hub(spark):
    """A hub with many ways out, crossed by many tracks: the waypoints are those that brute force finds."""
    hub, n = (5.7051, 45.1051), 60
    ends = [(hub[0] + 0.0011 * math.cos(2 * math.pi * k / n + 0.01), hub[1] + 0.0011 * math.sin(2 * math.pi * k / n + 0.01)) for k in range(n)]
    edges = spark.createDataFrame([(k, *hub, *e) for k, e in enumerate(ends)], "edge_id long, x1 double, y1 double, x2 double, y2 double")
    points = [(t, s, *p, 0.0) for t in range(n) for s, p in enumerate((ends[t], hub, ends[(t + 7) % n]))]
    out = graph.detect_crossroads(spark.createDataFrame(points, "track_id long, seq long, lon double, lat double, ele double"), edges)
    # each way out is one of many within the slack, in both directions
    assert sorted(map(tuple, out.collect())) == [(t, 1) for t in range(n)]


def test_cutting_compiles_into_short_methods(spark):
    """The JVM only interprets methods of more than 8000 bytes."""
    rows = spark.range(10).selectExpr("id way_id", "id seq", "5.7 + id / 1000 x1", "45.1 + id / 700 y1", "5.7 + id / 800 x2", "45.1 + id / 900 y2").selectExpr("way_id", "seq", *(f"cast({c} as double) {c}" for c in ("x1", "y1", "x2", "y2")))
    edges = network.quantised(network.tile_edges(network.cut_on_grid(rows)))
    compiled = edges._jdf.queryExecution().debug().codegenToSeq()
    assert compiled.size() > 0
    assert max(compiled.apply(i)._3().maxMethodCodeSize() for i in range(compiled.size())) <= 8000


@pytest.mark.parametrize("limit", [gpsfile.BROADCAST_BYTES if hasattr(gpsfile, "BROADCAST_BYTES") else 1, 0])
def test_interests_meet_tracks_by_tile(spark, monkeypatch, limit):
    """Files hold all interests near their track, none is joined with each track, whether tiles are broadcast or dealt."""
    monkeypatch.setattr(gpsfile, "BROADCAST_BYTES", limit, raising=False)
    rng = random.Random(3)
    points = [(t, i, 5.7 + t * 0.0003 + i * 0.0005, 45.1 + i * 0.0004, None if t == 3 else float(i * 300 - t), i % 3 == 0) for t in range(12) for i in range(2 + t)]
    marked = spark.createDataFrame(points, "track_id int, seq int, lon double, lat double, ele double, is_waypoint boolean")
    spots = [(rng.choice([1, 2, 200]), 5.7 + rng.random() * 0.01, 45.1 + rng.random() * 0.01) for _ in range(900)]
    segments = network.segments(marked, ("track_id",))
    edges = network.quantised(network.tile_edges(network.cut_on_grid(segments)))
    files = gpsfile.encode(marked, edges, spark.createDataFrame(spots, "type int, lon double, lat double"))
    got = gpsfile.decode(files).collect()
    code = lambda v: min(255, max(0, round((v - math.floor(v * 255 / g.SIDE + 0.5) // 255 * g.SIDE) * 255 / g.SIDE)))
    cell = lambda v: math.floor(v * 255 / g.SIDE + 0.5) // 255
    near = {t: {(cell(x) + i, cell(y) + j) for u, _, x, y, *_ in points if u == t for i in (-1, 0, 1) for j in (-1, 0, 1)} for t in range(12)}
    want = sorted((t, cell(x), cell(y), k, code(x), code(y)) for t in near for k, x, y in spots if (cell(x), cell(y)) in near[t])
    found = [(r.track_id, r.tx, r.ty, int(r.a), int(r.b), int(r.c)) for r in got if r.kind == "interest"]
    assert sorted(found) == want and all(r.d is None and r.name is None for r in got if r.kind == "interest")
    # numbers count within a tile, in order of the entries
    order = sorted((r.track_id, r.tx, r.ty, r.number, r.a, r.b, r.c) for r in got if r.kind == "interest")
    assert [(*r[:3], *map(int, r[4:])) for r in order] == want and order[0][3] == 0
    assert sorted((r.track_id, r.number, r.a, r.b, r.c == 1) for r in got if r.kind == "point") == [(t, i, x, y, w) for t, i, x, y, _, w in points]
    assert sorted((r.track_id, r.number, r.a) for r in got if r.kind == "height") == [(t, i, z) for t, i, _, _, z, _ in points if z is not None]
    kept = sorted((r.track_id, r.tx, r.ty, r.cx1, r.cy1, r.cx2, r.cy2) for r in edges.collect())
    assert sorted((r.track_id, r.tx, r.ty, *map(int, (r.a, r.b, r.c, r.d))) for r in got if r.kind == "edge") == kept
    # alone what the tracks' tiles, not their interests, ask for
    assert joined_rows(files) <= sum(map(len, near.values())) < len(want)


def test_rows_that_files_repeat_take_little_room(spark, tmp_path):
    """What the same tile gives to many files lies together, so that a column of it is a few runs."""
    points = [(t, i, 5.7002 + t * 1e-6, 45.1002 + i * 1e-6, 1.0, i == 0) for t in range(100) for i in range(2)]
    marked = spark.createDataFrame(points, "track_id int, seq int, lon double, lat double, ele double, is_waypoint boolean").coalesce(1)
    spots = [(1 + k % 3, 5.7002 + k % 97 * 1e-5, 45.1002 + k % 89 * 1e-5) for k in range(4000)]
    edges = spark.createDataFrame([], "track_id int, tx long, ty long, cx1 int, cy1 int, cx2 int, cy2 int")
    rows = gpsfile.decode(gpsfile.encode(marked, edges, spark.createDataFrame(spots, "type int, lon double, lat double")))
    rows.write.parquet(str(tmp_path / "rows"))
    back = spark.read.parquet(str(tmp_path / "rows"))
    assert back.where("kind = 'interest'").count() == 100 * 4000
    assert back.where("kind = 'interest'").distinct().count() == 100 * 4000
    assert sum(p.stat().st_size for p in (tmp_path / "rows").glob("*.parquet")) < 0.5 * back.count()


def test_roundtrip_deals_points_by_track_alone(spark, sf_dir):
    """What goes by track and place, or by track and tile, is shuffled once, by track."""
    rows = catalogue.queries()["binary_roundtrip"](spark, sf_dir)
    dealt = re.findall(r"Exchange hashpartitioning\((.*), \d+\), ", rows._jdf.queryExecution().executedPlan().toString())
    assert dealt and all(re.fullmatch(r"track_id#\d+L?", by) for by in dealt) and len(dealt) <= 3


def test_marked_where_is_marked(spark):
    rows = [(1, 0, 5.0, 45.0), (1, 1, 5.1, 45.0), (1, 2, 5.0, 45.0), (1, 3, None, 45.0), (1, 4, 0.0, 45.0), (1, 5, -0.0, 45.0), (2, 0, 5.1, 45.0), (2, 1, 5.0, 45.0), (2, 3, None, None)]
    points = spark.createDataFrame(rows, "track_id int, seq int, lon double, lat double")
    for condition in ("seq % 3 = 0", "seq = 5", "lon > 5", "seq < 0", "lon is null"):
        want = track.marked(points, points.where(condition)).select("track_id", "seq", "is_waypoint")
        got = track.marked_where(points, F.expr(condition)).select("track_id", "seq", "is_waypoint")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), condition
