"""Layers as SVG, rows formatted where they lie and joined in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.functions import geometry as g

# The colours of layers in turn.
COLORS = ("black", "red", "green", "blue", "purple", "cyan")


def _y(column: str) -> F.Column:
    """North is up."""
    return -F.col(column)


def point_layer(points: DataFrame, radius: float = 0.00005) -> DataFrame:
    place = F.format_string("<circle cx='%.7f' cy='%.7f' r='%.7f'/>", F.col("lon"), _y("lat"), F.lit(radius))
    return points.select(place.alias("shape"))


def node_layer(nodes: DataFrame) -> DataFrame:
    """Single places ``(lon, lat)`` as filled dots, as wide as a share of the picture."""
    return nodes.select(F.format_string("<circle stroke='none' cx='%.7f' cy='%.7f' r='0.4%%'/>", F.col("lon"), _y("lat")).alias("shape"))


def segment_layer(segments: DataFrame) -> DataFrame:
    """Pieces of polylines ``(x1, y1, x2, y2)`` as thin lines."""
    ends = [F.col("x1"), _y("y1"), F.col("x2"), _y("y2")]
    return segments.select(F.format_string("<line stroke-width='0.1%%' x1='%.7f' y1='%.7f' x2='%.7f' y2='%.7f'/>", *ends).alias("shape"))


def track_layer(points: DataFrame) -> DataFrame:
    """One polyline per track."""
    place = F.format_string("%.7f,%.7f", F.col("lon"), _y("lat"))
    rows = points.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("seq", place.alias("at")))).alias("points"))
    line = F.array_join(F.transform("points", lambda p: p["at"]), " ")
    return rows.select(F.format_string("<polyline fill='none' points='%s'/>", line).alias("shape"))


def edge_layer(edges: DataFrame, side: float = g.SIDE) -> DataFrame:
    """Quantised tile edges as lines."""
    ends = [g.dequantise(F.col(f"c{v}{n}"), F.col(f"t{v}"), side) * (1 if v == "x" else -1) for n in (1, 2) for v in "xy"]
    return edges.select(F.format_string("<line x1='%.7f' y1='%.7f' x2='%.7f' y2='%.7f'/>", *ends).alias("shape"))


def tile_layer(edges: DataFrame, side: float = g.SIDE) -> DataFrame:
    """A rectangle around each non-empty tile."""
    tiles = edges.select("tx", "ty").distinct()
    shape = F.format_string("<rect fill='none' x='%.7f' y='%.7f' width='%.7f' height='%.7f'/>", F.col("tx") * side, -(F.col("ty") + 1) * side, F.lit(side), F.lit(side))
    return tiles.select(shape.alias("shape"))


def layers(*shapes: DataFrame) -> DataFrame:
    """``layer, color, shape``: each layer with its colour."""
    out = None
    for i, rows in enumerate(shapes):
        rows = rows.select(F.lit(i).alias("layer"), F.lit(COLORS[i % len(COLORS)]).alias("color"), "shape")
        out = rows if out is None else out.unionByName(rows)
    return out


def draw(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Tracks over the map: one row per shape, to be written in order of layers. A whole picture is ``document``."""
    return layers(edge_layer(edges), tile_layer(edges), track_layer(points))


def document(shapes: DataFrame, box: tuple[float, float, float, float]) -> str:
    """The text of a picture: for pictures that a viewer can show, so shapes come to the driver."""
    x0, y0, x1, y1 = box
    head = f"<svg xmlns='http://www.w3.org/2000/svg' viewBox='{x0:.6f} {-y1:.6f} {x1 - x0:.6f} {y1 - y0:.6f}' stroke-width='0.2%'>"
    rows = shapes.orderBy("layer", "shape").toLocalIterator()
    return head + "".join(f"<g stroke='{r['color']}'>{r['shape']}</g>" for r in rows) + "</svg>"
