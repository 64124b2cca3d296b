"""Column expressions on degree coordinates and the tile grid. All stay inside the JVM.

A point is a pair of double columns (longitude x, latitude y); a tile is a pair of bigint columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SIDE = 1 / 750  # degrees; a tile's side
SKI_SIDE = 1 / 150
BORDER = 1 / 111200  # degrees; about one metre
SIMPLIFY = 0.00015
SNAP = 0.0001
SPACING = 0.0003
ANGLE_SLACK = math.pi / 10
SHARP_TURN = 80 * math.pi / 180
EARTH_RADIUS = 6371000.0
NOISE_METRES = 4.0


def squared_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(squared_distance(x1, y1, x2, y2))


def haversine(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres along the sphere."""
    half_y, half_x = F.sin(F.radians(y2 - y1) / 2), F.sin(F.radians(x2 - x1) / 2)
    a = half_y * half_y + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * half_x * half_x
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Angle of the second point as seen from the first, in [0, 2 pi)."""
    angle = F.atan2(y2 - y1, x2 - x1)
    return F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)


def angle_between(a: Column, b: Column) -> Column:
    """The smaller turn between two bearings."""
    turn = F.abs(b - a)
    return F.least(turn, 2 * math.pi - turn)


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """From a point to the nearest place of a segment; a segment without length is its point."""
    length2 = squared_distance(x1, y1, x2, y2)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / F.nullif(length2, F.lit(0.0))))
    return F.when(length2 == 0, distance(x, y, x1, y1)).otherwise(distance(x, y, x1 + (x2 - x1) * t, y1 + (y2 - y1) * t))


def same_place(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return distance(x1, y1, x2, y2) <= BORDER


def y_at_x(x1: Column, y1: Column, x2: Column, y2: Column, x: Column) -> Column:
    """On the line through two points; null where it is upright."""
    return y1 + (x - x1) / F.nullif(x2 - x1, F.lit(0.0)) * (y2 - y1)


def x_at_y(x1: Column, y1: Column, x2: Column, y2: Column, y: Column) -> Column:
    """On the line through two points; null where it is level."""
    return x1 + (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) * (x2 - x1)


def grid_lines_between(a: Column, b: Column, side: float = SIDE) -> Column:
    """Array of the multiples of ``side`` strictly between two coordinates."""
    low, high = F.least(a, b) / side, F.greatest(a, b) / side
    cells = F.sequence(F.floor(low), F.ceil(high))
    inside = F.filter(cells, lambda k: (k.cast("double") > low) & (k.cast("double") < high))
    return F.transform(inside, lambda k: k.cast("double") * side)


def nearest_whole(v: Column) -> Column:
    """Rounded, halves away from zero, as bigint. ``round`` on doubles goes through decimals, which costs far more."""
    size = F.abs(v)
    whole = F.floor(size)
    whole = whole + (size - whole >= 0.5).cast("int")
    return F.when(v < 0, -whole).otherwise(whole)


def cell(x: Column, side: float = SIDE, toward_zero: bool = False) -> Column:
    """The tile coordinate of a coordinate rounded to 1/255 of a side: floored, or truncated toward zero."""
    fine = nearest_whole(x * 255 / side)
    return F.call_function("div", fine, F.lit(255)) if toward_zero else F.call_function("div", fine - F.pmod(fine, F.lit(255)), F.lit(255))


def tiles_of(x: Column, y: Column, side: float = SIDE) -> Column:
    """The 1, 2 or 4 tiles a point belongs to, as array<struct<tx, ty>>: its own, and any within a metre."""
    tx, ty = cell(x, side), cell(y, side)
    low = lambda v, t: v - t.cast("double") * side < BORDER
    high = lambda v, t: (t + 1).cast("double") * side - v < BORDER
    steps_x = F.array_compact(F.array(F.lit(0), F.when(low(x, tx), -1), F.when(high(x, tx), 1)))
    steps_y = F.array_compact(F.array(F.lit(0), F.when(low(y, ty), -1), F.when(high(y, ty), 1)))
    return F.flatten(F.transform(steps_x, lambda i: F.transform(steps_y, lambda j: F.struct((tx + i).alias("tx"), (ty + j).alias("ty")))))


def cell_span(v: Column, tile: Column, side: float = SIDE) -> tuple[Column, Column]:
    """The first and last tile coordinate that a coordinate in cell ``tile`` belongs to."""
    low, high = v - tile.cast("double") * side < BORDER, (tile + 1).cast("double") * side - v < BORDER
    return tile - low.cast("int"), tile + high.cast("int")


def common_tile(x1: Column, y1: Column, x2: Column, y2: Column, side: float = SIDE) -> Column:
    """The least tile that both points belong to; null if there is none. A point's tiles are all pairs of its spans on
    the two axes, so what two points share is the spans' overlap on each."""
    least, last = [], []
    for a, b in ((x1, x2), (y1, y2)):
        (a0, a1), (b0, b1) = cell_span(a, cell(a, side), side), cell_span(b, cell(b, side), side)
        least.append(F.greatest(a0, b0))
        last.append(F.least(a1, b1))
    shared = (least[0] <= last[0]) & (least[1] <= last[1])
    return F.when(shared, F.struct(least[0].alias("tx"), least[1].alias("ty")))


def quantise(v: Column, tile: Column, side: float = SIDE) -> Column:
    """Place inside a tile as 0 to 255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), nearest_whole((v - tile.cast("double") * side) * 255 / side))).cast("int")


def dequantise(c: Column, tile: Column, side: float = SIDE) -> Column:
    return tile.cast("double") * side + c / 255.0 * side


def view(x: Column, y: Column, centre: tuple[float, float], scale: float, angle: float, middle: tuple[int, int]) -> tuple[Column, Column]:
    """Screen place of a point: relative to the centre, scaled, turned, mirrored left to right, moved to the middle."""
    dx, dy = (x - centre[0]) * scale, (y - centre[1]) * scale
    turned_x = dx * math.cos(angle) - dy * math.sin(angle)
    turned_y = dx * math.sin(angle) + dy * math.cos(angle)
    return F.round(middle[0] - turned_x).cast("int"), F.round(middle[1] + turned_y).cast("int")


def piste(tags: Column) -> Column:
    """0 to 3 for the known difficulties, 4 for any aerialway, else null."""
    levels = {"novice": 0, "easy": 1, "intermediate": 2, "advanced": 3}
    level = F.coalesce(*(F.when(tags["piste:difficulty"] == k, F.lit(v)) for k, v in levels.items()))
    return F.when(tags["aerialway"].isNotNull(), F.lit(4)).otherwise(level)
