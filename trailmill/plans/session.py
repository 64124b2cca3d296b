"""Whole sessions: from an extract to a tiled map, from a track and a map to a file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions import geometry as g
from trailmill.operators import graph, network, simplify, track
from trailmill.sources import gpsfile, osm


def build_map(nodes: DataFrame, ways: DataFrame, side: float = g.SIDE, merge: bool = True) -> DataFrame:
    """Ways filtered, located, split at shared nodes, simplified, cut on the grid, put in tiles, quantised and, unless
    the edges are for routing, merged. ``tx, ty, cx1, cy1, cx2, cy2``."""
    kept = ways.where(network.local_way_filter(F.col("tags")))
    known = osm.way_nodes(kept).join(nodes.select("node_id"), "node_id", "left_semi").select("way_id", "seq", "node_id")
    points = network.split_ways(known).join(nodes.select("node_id", "lon", "lat"), "node_id").select("way_id", "piece", "seq", "lon", "lat")
    pieces = simplify.simplify(points, ("way_id", "piece"))
    edges = network.tile_edges(network.cut_on_grid(network.segments(pieces, ("way_id", "piece")), side), side)
    edges = network.quantised(edges, side)
    return network.merge_collinear(edges) if merge else edges.select("tx", "ty", "cx1", "cy1", "cx2", "cy2").distinct()


def ski_maps(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """A map per difficulty on the larger grid: ``piste, tx, ty, ...``."""
    graded = ways.withColumn("piste", g.piste(F.col("tags")))
    maps = [build_map(nodes, graded.where(F.col("piste") == k), g.SKI_SIDE).withColumn("piste", F.lit(k)) for k in range(5)]
    out = maps[0]
    for m in maps[1:]:
        out = out.unionByName(m)
    return out


def graph_edges(tile_edges: DataFrame, side: float = g.SIDE) -> DataFrame:
    """Merged tile edges as places in degrees, for the graph operators."""
    ends = [g.dequantise(F.col(f"c{v}{n}"), F.col(f"t{v}"), side).alias(f"{v}{n}") for n in (1, 2) for v in "xy"]
    rows = tile_edges.select(*ends)
    return rows.withColumn("edge_id", F.xxhash64("x1", "y1", "x2", "y2"))


def clean_track(points: DataFrame) -> DataFrame:
    """Spurs out, ends and commented places as waypoints: ``track_id, seq, lon, lat, ele, is_waypoint``."""
    rows = track.without_spurs(points)
    order = Window.partitionBy("track_id").orderBy("seq")
    last = F.lead("seq").over(order).isNull()
    first = F.lag("seq").over(order).isNull()
    return rows.withColumn("is_waypoint", F.col("is_waypoint") | first | last)


def with_waypoints(interests: DataFrame, marked: DataFrame) -> DataFrame:
    """Waypoints join the interests as type 0."""
    return interests.unionByName(marked.where("is_waypoint").select(F.lit(0).alias("type"), "lon", "lat"))


def session_files(points: DataFrame, nodes: DataFrame, ways: DataFrame, wanted: Sequence[tuple[str, str]] = (), autodetect: bool = True) -> DataFrame:
    """``track_id, content``: a file per track of ``(track_id, seq, lon, lat, ele, is_waypoint)``.

    With autodetection, tracks of two waypoints or fewer get those at doubtful crossroads. Every track is simplified
    between its waypoints; heights stay with the points that are left.
    """
    marked = clean_track(points)
    tiles = build_map(nodes, ways)
    if autodetect:
        few = marked.groupBy("track_id").agg(F.count_if("is_waypoint").alias("n")).where("n <= 2").select("track_id")
        found = graph.detect_crossroads(marked.join(few, "track_id", "left_semi"), graph_edges(tiles)).withColumn("found", F.lit(True))
        marked = marked.join(found, ["track_id", "seq"], "left").withColumn("is_waypoint", F.col("is_waypoint") | F.coalesce("found", F.lit(False))).drop("found")
    kept = simplify.simplify_around(marked).select("track_id", "seq")
    path = marked.join(kept, ["track_id", "seq"], "left_semi")
    interests = network.interests(nodes, wanted) if wanted else nodes.sparkSession.createDataFrame([], "type int, lon double, lat double")
    return gpsfile.encode(path, tiles, with_waypoints(interests, path))
