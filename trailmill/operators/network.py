"""Road-network operators: filters, splitting, grid cuts, tiles, quantising, merging, clipping.

Tables: ``nodes(node_id, lon, lat)``, ``ways(way_id, tags, name)``, ``way_nodes(way_id, seq, node_id)``,
``segments(way_id, seq, x1, y1, x2, y2)``, ``tile_edges(way_id, seq, part, tx, ty, x1, y1, x2, y2)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions import geometry as g
from trailmill.operators.lineage import running_total


def remote_way_filter(tags: Column, ski: bool = False, keep_motorway_link: bool = False) -> Column:
    """Which ways an extract holds. ``keep_motorway_link`` also lets that class through, as older extracts did."""
    if ski:
        return (tags["piste:type"] == "downhill") | tags["aerialway"].isNotNull()
    left_out = ["motorway", "trunk", "trunk_link"] + ["motorway_link"] * (not keep_motorway_link)
    isnt = lambda key, value: F.coalesce(tags[key] != value, F.lit(True))
    return tags["highway"].isNotNull() & ~tags["highway"].isin(left_out) & isnt("footway", "crossing") & isnt("area", "yes")


def local_way_filter(tags: Column) -> Column:
    """Drops raceways and steps, and footways unless bicycles may use them."""
    kind = F.coalesce(tags["highway"], F.lit(""))
    return ~kind.isin("raceway", "steps") & ((kind != "footway") | F.coalesce(tags["bicycle"] == "yes", F.lit(False)))


def located(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Way nodes with coordinates; references to unknown nodes go."""
    return way_nodes.join(nodes, "node_id").select("way_id", "seq", "node_id", "lon", "lat")


def used_nodes(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(way_nodes, "node_id", "left_semi")


def node_degree(way_nodes: DataFrame) -> DataFrame:
    """Occurrences over all ways: a closing loop counts its node twice."""
    return way_nodes.groupBy("node_id").agg(F.count("*").alias("degree"))


def split_ways(way_nodes: DataFrame) -> DataFrame:
    """Ways cut at nodes that occur more than once: ``way_id, piece, seq, node_id``. A cut node ends one piece and
    begins the next; pieces of one point go."""
    rows = way_nodes.join(node_degree(way_nodes), "node_id")
    order = Window.partitionBy("way_id").orderBy("seq")
    is_cut = (F.col("degree") > 1) & (F.row_number().over(order) > 1)
    rows = rows.withColumn("is_cut", is_cut.cast("int"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("piece", F.coalesce(F.sum("is_cut").over(before), F.lit(0)))
    both = F.when(F.col("is_cut") == 1, F.array(F.col("piece"), F.col("piece") + 1)).otherwise(F.array("piece"))
    rows = rows.withColumn("piece", F.explode(both))
    size = F.count("*").over(Window.partitionBy("way_id", "piece"))
    return rows.withColumn("size", size).where("size >= 2").select("way_id", "piece", "seq", "node_id")


def segments(points: DataFrame, key: Sequence[str] = ("way_id",)) -> DataFrame:
    """Consecutive pairs of located points, one row each, under the sequence number of the first."""
    order = Window.partitionBy(*key).orderBy("seq")
    after = lambda c: F.lead(c).over(order)
    rows = points.select(*key, "seq", F.col("lon").alias("x1"), F.col("lat").alias("y1"), after("lon").alias("x2"), after("lat").alias("y2"))
    return rows.where("x2 is not null")


def _own_method(rows: DataFrame) -> DataFrame:
    """The same rows, out of a generator of one constant: Spark compiles what comes after one into a method of its own,
    where a run of projections is a single method, which the JVM only interprets once it is longer than 8000 bytes."""
    return rows.withColumn("own method", F.explode(F.array(F.lit(0)))).drop("own method")


def cut_on_grid(segments: DataFrame, side: float = g.SIDE) -> DataFrame:
    """Segments cut where they cross grid lines, their pieces told apart by ``part``; segments without length go.

    Each end and each crossing is a row of its own and finds where its piece ends by itself: the nearest of what comes
    after it among the end and the lines next to it. So nothing is sorted, and all of it is arithmetic on flat columns.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    first = lambda a, b: F.floor(F.least(a, b) / side) + 1
    last = lambda a, b: F.ceil(F.greatest(a, b) / side) - 1
    # lines strictly between the ends, first to last
    rows = segments.where("x1 <> x2 or y1 <> y2")
    rows = rows.withColumns({"cut fx": first(x1, x2), "cut lx": last(x1, x2), "cut fy": first(y1, y2), "cut ly": last(y1, y2)})
    fx, lx, fy, ly = (F.col(f"cut {c}") for c in ("fx", "lx", "fy", "ly"))
    nx, n = F.greatest(lx - fx + 1, F.lit(0)), F.greatest(lx - fx + 1, F.lit(0)) + F.greatest(ly - fy + 1, F.lit(0))
    part = F.col("part")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), n + 1)))
    at_x, at_y = lambda x: g.y_at_x(x1, y1, x2, y2, x), lambda y: g.x_at_y(x1, y1, x2, y2, y)
    line_x, line_y = (fx + part - 1).cast("double") * side, (fy + part - nx - 1).cast("double") * side
    place = lambda start, on_x, on_y, end: F.when(part == 0, start).when(part <= nx, on_x).when(part <= n, on_y).otherwise(end)
    rows = rows.withColumns({"cut x": place(x1, line_x, at_y(line_y), x2), "cut y": place(y1, at_x(line_x), line_y, y2)})
    x, y = F.col("cut x"), F.col("cut y")
    rows = _own_method(rows).withColumns({"cut d2": g.squared_distance(x1, y1, x, y), "cut k": F.rint(x / side), "cut m": F.rint(y / side)})
    # The line of either kind that is nearest to this place, the next one on the way, and the end. Steps of a few columns
    # each, in methods of their own: the compiler leaves long methods alone.
    spots = {"x0": F.lit(0.0), "x1": F.signum(x2 - x1), "y0": F.lit(0.0), "y1": F.signum(y2 - y1)}
    here = {s: F.col("cut k" if s[0] == "x" else "cut m") + step for s, step in spots.items()}
    on = {s: k * side for s, k in here.items()}
    rows = _own_method(rows).withColumns({f"cut {s} {v}": at if s[0] == v else at_x(at) if s[0] == "x" else at_y(at) for s, at in on.items() for v in "xy"})
    rows = _own_method(rows).withColumns({f"cut {s} d2": g.squared_distance(x1, y1, F.col(f"cut {s} x"), F.col(f"cut {s} y")) for s in spots} | {"cut end d2": g.squared_distance(x1, y1, x2, y2)})
    d2 = F.col("cut d2")
    there = {s: (k >= fx) & (k <= lx) if s[0] == "x" else (k >= fy) & (k <= ly) for s, k in here.items()}
    place_of = {s: (F.col(f"cut {s} d2"), F.col(f"cut {s} x"), F.col(f"cut {s} y")) for s in spots} | {"end": (F.col("cut end d2"), x2, y2)}
    after = lambda far, px, py: (far > d2) | ((far == d2) & ((px > x) | ((px == x) & (py > y))))
    # a crossing of two lines at once is one place
    same = {s: there[s] & (place_of[s][1] == x) & (place_of[s][2] == y) for s in ("x0", "y0")}
    again = ((part > nx) & same["x0"]) | ((part > n) & same["y0"])
    rows = _own_method(_own_method(rows).withColumn("cut again", again))
    rows = rows.withColumns({f"cut {s} to": F.when(~F.col("cut again") & there.get(s, F.lit(True)) & after(*p), p[0]) for s, p in place_of.items()})
    far = {s: F.col(f"cut {s} to") for s in place_of}
    # out of a generator of one row, below which conditions on it aren't pushed, where each would work it out again
    rows = rows.withColumn("cut to", F.explode(F.array(F.least(*far.values())))).where("`cut to` is not null")
    rows = rows.withColumn("cut to x", F.explode(F.array(F.least(*(F.when(far[s] == F.col("cut to"), p[1]) for s, p in place_of.items())))))
    to_y = F.least(*(F.when((far[s] == F.col("cut to")) & (p[1] == F.col("cut to x")), p[2]) for s, p in place_of.items()))
    kept = [c for c in segments.columns if c not in ("x1", "y1", "x2", "y2")]
    return rows.select(*kept, "part", x.alias("x1"), y.alias("y1"), F.col("cut to x").alias("x2"), to_y.alias("y2"))


def in_box(segments: DataFrame, x0: int, y0: int, x1: int, y1: int, side: float = g.SIDE) -> DataFrame:
    """Segments that can have a piece in the tiles from (x0, y0) to (x1, y1): to filter before cutting."""
    near = lambda a, b, low, high: (F.greatest(a, b) >= (low - 1) * side) & (F.least(a, b) <= (high + 2) * side)
    return segments.where(near("x1", "x2", x0, x1) & near("y1", "y2", y0, y1))


def tile_edges(cut: DataFrame, side: float = g.SIDE) -> DataFrame:
    """Cut segments with the least tile that holds both ends; null where there is none.

    The tile comes out of a generator of one row: conditions on what is computed from it later aren't pushed below,
    where they would each work it out again.
    """
    ends = ("x1", "y1", "x2", "y2")
    rows = cut.withColumns({f"tile {v}": g.cell(F.col(v), side) for v in ends})
    spans = {v: g.cell_span(F.col(v), F.col(f"tile {v}"), side) for v in ends}
    rows = _own_method(rows).withColumns({f"tile {v} {n}": spans[v][n] for v in ends for n in (0, 1)})
    col = lambda v, n: F.col(f"tile {v} {n}")
    least = {v: F.greatest(col(f"{v}1", 0), col(f"{v}2", 0)) for v in "xy"}
    last = {v: F.least(col(f"{v}1", 1), col(f"{v}2", 1)) for v in "xy"}
    rows = _own_method(rows).withColumns({f"tile least {v}": least[v] for v in "xy"} | {"tile shared": (least["x"] <= last["x"]) & (least["y"] <= last["y"])})
    tile = F.when(F.col("tile shared"), F.struct(F.col("tile least x").alias("tx"), F.col("tile least y").alias("ty")))
    rows = rows.withColumn("tile", F.explode(F.array(tile)))
    return rows.select(*[c for c in cut.columns if c not in ends], F.col("tile.tx").alias("tx"), F.col("tile.ty").alias("ty"), *ends)


def edges_per_tile(edges: DataFrame) -> DataFrame:
    return edges.groupBy("tx", "ty").agg(F.count("*").alias("n_edges"))


def quantised(edges: DataFrame, side: float = g.SIDE) -> DataFrame:
    """Ends as bytes inside the tile; edges that shrink to a point go."""
    code = [g.quantise(F.col(f"{v}{n}"), F.col(f"t{v}"), side).alias(f"c{v}{n}") for n in (1, 2) for v in "xy"]
    # out of a generator of one row, as in tile_edges
    rows = edges.withColumn("code", F.explode(F.array(F.struct(*code)))).select(*edges.columns, "code.*")
    return rows.where("cx1 <> cx2 or cy1 <> cy2").drop("x1", "y1", "x2", "y2")


def merge_collinear(edges: DataFrame) -> DataFrame:
    """Edges of a tile on one line that overlap or touch become one: ``tx, ty, cx1, cy1, cx2, cy2``.

    The line's key is exact: quotients of such small whole numbers are equal only if the fractions are.
    """
    first, second = F.struct(F.col("cx1").alias("x"), F.col("cy1").alias("y")), F.struct(F.col("cx2").alias("x"), F.col("cy2").alias("y"))
    rows = edges.select("tx", "ty", F.least(first, second).alias("a"), F.greatest(first, second).alias("b"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    slope = F.when(dx != 0, dy / F.nullif(dx, F.lit(0)))
    height = F.when(dx != 0, (dx * F.col("a.y") - dy * F.col("a.x")) / F.nullif(dx, F.lit(0))).otherwise(F.col("a.x").cast("double"))
    rows = rows.select("tx", "ty", slope.alias("slope"), height.alias("height"), (F.col("a.x") * 256 + F.col("a.y")).alias("begin"), (F.col("b.x") * 256 + F.col("b.y")).alias("end")).distinct()
    line = Window.partitionBy("tx", "ty", "slope", "height").orderBy("begin", "end")
    reached = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.coalesce((F.col("begin") > reached).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("tx", "ty", "slope", "height", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    div = lambda c: F.call_function("div", F.col(c), F.lit(256)).cast("int")
    mod = lambda c: (F.col(c) % 256).cast("int")
    return out.select("tx", "ty", div("begin").alias("cx1"), mod("begin").alias("cy1"), div("end").alias("cx2"), mod("end").alias("cy2"))


def tile_prefix(edges: DataFrame) -> DataFrame:
    """Non-empty tiles in row-major order with their number in the grid's extent and the running end of their edges."""
    tiles = running_total(edges_per_tile(edges), ("ty", "tx"), F.col("n_edges"), "end")
    box = tiles.agg(F.min("tx").alias("x0"), F.max("tx").alias("x1"), F.min("ty").alias("y0"))
    rows = tiles.join(F.broadcast(box))  # one row
    number = (F.col("ty") - F.col("y0")) * (F.col("x1") - F.col("x0") + 1) + F.col("tx") - F.col("x0")
    return rows.select(number.alias("tile_no"), "tx", "ty", "n_edges", "end")


def grid_extent(edges: DataFrame) -> DataFrame:
    """The extent that holds all non-empty tiles."""
    return edges.agg(F.min("tx").alias("x0"), F.min("ty").alias("y0"), (F.max("tx") - F.min("tx") + 1).alias("width"), (F.max("ty") - F.min("ty") + 1).alias("height"))


def map_stats(edges: DataFrame) -> DataFrame:
    tiles = edges_per_tile(edges)
    return tiles.agg((4 * F.sum("n_edges")).alias("n_bytes"), F.count("*").alias("n_tiles"), F.max("n_edges").alias("max_edges"))


def dilated(tiles: DataFrame) -> DataFrame:
    """Tiles and their eight neighbours, once each."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    rows = tiles.select("tx", "ty").distinct().withColumn("step", F.explode(steps))
    return rows.select((F.col("tx") + F.col("step.i")).alias("tx"), (F.col("ty") + F.col("step.j")).alias("ty")).distinct()


def corridor_clip(edges: DataFrame, path_edges: DataFrame) -> DataFrame:
    """Edges in tiles that the path's edges use, or next to them."""
    return edges.join(dilated(path_edges), ["tx", "ty"], "left_semi")


def rect_clip(edges: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    return edges.where(F.col("tx").between(x0, x1) & F.col("ty").between(y0, y1))


def viewport(edges: DataFrame, vx: int, vy: int) -> DataFrame:
    """The 3 by 3 tiles around the view."""
    return rect_clip(edges, vx - 1, vy - 1, vx + 1, vy + 1)


def kept_streets(street_ways: DataFrame, edges: DataFrame) -> DataFrame:
    """Streets with the ways that still have an edge; streets without one go."""
    kept = street_ways.join(edges, "way_id", "left_semi")
    return kept.groupBy("name").agg(F.array_sort(F.collect_set("way_id")).alias("ways"))


def street_tiles(street_ways: DataFrame, edges: DataFrame) -> DataFrame:
    """Per street and tile the edges of its ways there: ``name, tx, ty, edges``, as an array of ends in order."""
    ends = F.struct("x1", "y1", "x2", "y2")
    return street_ways.join(edges, "way_id").groupBy("name", "tx", "ty").agg(F.array_sort(F.collect_set(ends)).alias("edges"))


def interests(node_tags: DataFrame, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """``type, lon, lat`` of nodes ``(node_id, lon, lat, tags: array<struct<k, v>>)`` with a wanted tag: its number in
    the list from 1 (the last, if listed twice), by the node's last matching tag."""
    types = {pair: i for i, pair in enumerate(wanted, 1)}
    asked = node_tags.sparkSession.createDataFrame([(k, v, i) for (k, v), i in types.items()], "k string, v string, type int")
    tags = node_tags.select("node_id", "lon", "lat", F.posexplode("tags").alias("pos", "tag")).select("*", "tag.k", "tag.v")
    found = tags.join(asked, ["k", "v"])
    return found.groupBy("node_id", "lon", "lat").agg(F.max_by("type", "pos").alias("type")).select("type", "lon", "lat")


def interests_tiled(points: DataFrame, side: float = g.SIDE) -> DataFrame:
    """Interests by tile with encoded places and the running end of each tile."""
    rows = points.select("type", "lon", "lat", g.cell(F.col("lon"), side).alias("tx"), g.cell(F.col("lat"), side).alias("ty"))
    place = F.struct("type", g.quantise(F.col("lon"), F.col("tx"), side).alias("cx"), g.quantise(F.col("lat"), F.col("ty"), side).alias("cy"))
    tiles = rows.groupBy("tx", "ty").agg(F.array_sort(F.collect_list(place)).alias("places"))
    return running_total(tiles, ("ty", "tx"), F.size("places").cast("bigint"), "end")


def street_blocks(street_ways: DataFrame) -> DataFrame:
    """Streets in order of their names' bytes, in blocks of about the square root of their number."""
    names = running_total(street_ways.groupBy("name").agg(F.countDistinct("way_id").alias("n_ways")), ("name",), F.lit(1).cast("bigint"), "rank")
    size = names.agg(F.ceil(F.sqrt(F.count("*"))).cast("bigint").alias("size"))
    names = names.join(F.broadcast(size))  # one row
    return names.select("name", "n_ways", F.call_function("div", F.col("rank") - 1, F.greatest("size", F.lit(1))).alias("block"))
