"""Polyline simplification under an error bound."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions.geometry import SIMPLIFY

#: Longer polylines are split before the exact method; parts down to this length are solved exactly.
EXACT_UP_TO, PART_UP_TO = 1000, 800


def segment_distances(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each point from the segment a-b."""
    along = b - a
    length2 = float(along @ along)
    if length2 == 0:
        return np.sqrt(((points - a) ** 2).sum(axis=1))
    t = np.clip(((points - a) @ along) / length2, 0, 1)
    return np.sqrt(((a + t[:, None] * along - points) ** 2).sum(axis=1))


def _ends_in_view(points: np.ndarray, i: int, epsilon: float) -> np.ndarray:
    """The vertices after ``i`` that a chord from it may end at, among which are all valid ones.

    A chord passes within ``epsilon`` of a vertex only in a direction inside the cone that the circle around the vertex
    fills; the cones of all vertices before its end must meet.
    """
    dx, dy = (points[i + 1 :] - points[i]).T
    far = np.hypot(dx, dy)
    outside = np.flatnonzero(far > epsilon * (1 + 1e-6))
    if not len(outside):
        return np.arange(i + 1, len(points))
    angle = np.arctan2(dy, dx)
    turn = np.remainder(angle - angle[outside[0]] + np.pi, 2 * np.pi) - np.pi
    half = np.full(len(far), np.inf)
    half[outside] = np.arcsin(np.minimum(1.0, epsilon / far[outside])) + 1e-7
    low = np.concatenate([[-np.inf], np.maximum.accumulate(turn - half)[:-1]])
    high = np.concatenate([[np.inf], np.minimum.accumulate(turn + half)[:-1]])
    # an end close by has any direction: its place decides, not its angle
    return i + 1 + np.flatnonzero(((low <= turn) & (turn <= high)) | ((far <= epsilon * (1 + 1e-6)) & (low <= high + np.pi)))


def fewest_points(points: np.ndarray, epsilon: float) -> list[int]:
    """Indices of the fewest vertices such that every skipped one lies within ``epsilon`` of its chord.

    This is the path with the fewest hops from the first vertex to the last over valid chords; among equals, each
    vertex is reached from the earliest one. Vertices are reached hop by hop, and each one is tried once by those of
    the hop before that can see it.
    """
    n = len(points)
    back = np.full(n, -1)
    back[0] = 0
    level = [0]
    while level and back[n - 1] < 0:
        reached: list[int] = []
        for i in level:
            for j in _ends_in_view(points, i, epsilon):
                if back[j] < 0 and (j - i == 1 or (segment_distances(points[i + 1 : j], points[i], points[j]) <= epsilon).all()):
                    back[j] = i
                    reached.append(int(j))
            if back[n - 1] >= 0:
                break
        level = sorted(reached)
    out = [n - 1]
    while out[-1]:
        out.append(int(back[out[-1]]))
    return out[::-1]


def _split(points: np.ndarray, first: int, epsilon: float) -> list[int]:
    if len(points) <= PART_UP_TO:
        return [first + i for i in fewest_points(points, epsilon)]
    if (points[0] == points[-1]).all():
        far = ((points - points[0]) ** 2).sum(axis=1)
    else:
        far = segment_distances(points, points[0], points[-1])
        if far.max() <= epsilon:
            return [first, first + len(points) - 1]
    at = len(far) - 1 - int(far[::-1].argmax())  # the last of the farthest
    if at in (0, len(points) - 1):
        return [first, first + len(points) - 1]
    return _split(points[: at + 1], first, epsilon)[:-1] + _split(points[at:], first + at, epsilon)


def kept_vertices(points: np.ndarray, epsilon: float = SIMPLIFY) -> list[int]:
    """Exact up to 1000 points; longer polylines are split at their farthest points until parts are short."""
    if len(points) < 2:
        return list(range(len(points)))
    return fewest_points(points, epsilon) if len(points) <= EXACT_UP_TO else _split(points, 0, epsilon)


def simplify(points: DataFrame, key: Sequence[str] = ("track_id",), epsilon: float = SIMPLIFY) -> DataFrame:
    """The vertices of each polyline ``(*key, seq, lon, lat)`` that stay; polylines that collapse to one place go."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        out = rows.iloc[kept_vertices(rows[["lon", "lat"]].to_numpy(float), epsilon)]
        return out if len(out[["lon", "lat"]].drop_duplicates()) > 1 else out.iloc[:0]

    rows = points.select(*key, "seq", "lon", "lat")
    return rows.groupBy(*key).applyInPandas(one, rows.schema)


def simplify_around(marked: DataFrame, epsilon: float = SIMPLIFY) -> DataFrame:
    """Tracks ``(track_id, seq, lon, lat, is_waypoint)`` simplified between waypoints, which all stay; what follows the
    last waypoint stays as it is."""
    order = Window.partitionBy("track_id").orderBy("seq")
    before = F.coalesce(F.sum(F.col("is_waypoint").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = marked.select("track_id", "seq", "lon", "lat", "is_waypoint", before.alias("piece"))
    total = F.sum(F.col("is_waypoint").cast("int")).over(Window.partitionBy("track_id"))
    # a waypoint ends its piece and begins the next one
    both = F.when(F.col("is_waypoint"), F.array(F.col("piece"), F.col("piece") + 1)).otherwise(F.array("piece"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq", kind="stable")
        if part["after_last"].iloc[0] or len(part) < 2:
            return part
        return part.iloc[kept_vertices(part[["lon", "lat"]].to_numpy(float), epsilon)]

    pieces = rows.withColumn("total", total).withColumn("part", F.explode(both)).withColumn("after_last", F.col("part") >= F.col("total"))
    pieces = pieces.select("track_id", "part", "seq", "lon", "lat", "after_last")
    kept = pieces.groupBy("track_id", "part").applyInPandas(one, pieces.schema)
    return kept.select("track_id", "seq", "lon", "lat").distinct()
