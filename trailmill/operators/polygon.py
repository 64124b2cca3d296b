"""The corridor around a track: the cells near it, their boundary, and the boundary as a ring."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.functions import geometry as g
from trailmill.operators import network


def corridor_cells(segments: DataFrame, side: float = 2 * g.SIDE, key: str = "track_id") -> DataFrame:
    """Cells at the ends of each segment and where it crosses grid lines along its longer axis, with the eight cells
    around each: ``key, tx, ty``."""
    swap = F.abs(F.col("y1") - F.col("y2")) > F.abs(F.col("x1") - F.col("x2"))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    rows = segments.select(key, swap.alias("swap"), pick("x1", "y1").alias("u1"), pick("y1", "x1").alias("v1"), pick("x2", "y2").alias("u2"), pick("y2", "x2").alias("v2"))
    u1, v1, u2, v2 = (F.col(c) for c in ("u1", "v1", "u2", "v2"))
    along = F.concat(F.array(u1, u2), g.grid_lines_between(u1, u2, side))
    rows = rows.where("u1 <> u2").withColumn("u", F.explode(along))
    v = F.when(F.col("u") == u1, v1).when(F.col("u") == u2, v2).otherwise(g.y_at_x(u1, v1, u2, v2, F.col("u")))
    rows = rows.withColumns({"a": F.floor(F.col("u") / side), "b": F.floor(v / side)})
    cells = rows.select(key, F.when(F.col("swap"), F.col("b")).otherwise(F.col("a")).alias("tx"), F.when(F.col("swap"), F.col("a")).otherwise(F.col("b")).alias("ty")).distinct()
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    cells = cells.withColumn("step", F.explode(steps))
    return cells.select(key, (F.col("tx") + F.col("step.i")).alias("tx"), (F.col("ty") + F.col("step.j")).alias("ty")).distinct()


def boundary(cells: DataFrame, key: str = "track_id") -> DataFrame:
    """Sides of cells without a cell beyond, clockwise: ``key, x1, y1, x2, y2`` in grid points."""
    # side: the step to the cell beyond, and the ends of the side from the cell's own corner
    sides = [(-1, 0, 0, 0, 0, 1), (1, 0, 1, 1, 1, 0), (0, 1, 0, 1, 1, 1), (0, -1, 1, 0, 0, 0)]
    names = ("i", "j", "x1", "y1", "x2", "y2")
    rows = cells.withColumn("side", F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, s))) for s in sides))))
    rows = rows.select(key, *((F.col(f"t{c}") + F.col(f"side.{s}")).alias(f"b{c}") for c, s in (("x", "i"), ("y", "j"))), *((F.col(f"t{n[0]}") + F.col(f"side.{n}")).alias(n) for n in names[2:]))
    beyond = cells.select(F.col(key), F.col("tx").alias("bx"), F.col("ty").alias("by"))
    return rows.join(beyond, [key, "bx", "by"], "left_anti").select(key, *names[2:])


def corridor_polygon(segments: DataFrame, side: float = 2 * g.SIDE, key: str = "track_id") -> DataFrame:
    """The outer ring of each track's corridor, closed, without straight vertices: ``key, seq, lon, lat``."""
    kind = dict(segments.dtypes)[key]

    def trace(rows: pd.DataFrame) -> pd.DataFrame:
        onward: dict[tuple, list[tuple]] = {}
        for x1, y1, x2, y2 in rows[["x1", "y1", "x2", "y2"]].itertuples(index=False):
            onward.setdefault((x1, y1), []).append((x2, y2))
        start = min(onward)
        ring, at, came = [start], onward[start][0], start
        while at != start:
            ring.append(at)
            # where cells touch at a corner only, keep to the same cell: turn right
            turn = lambda to: (at[0] - came[0]) * (to[1] - at[1]) - (at[1] - came[1]) * (to[0] - at[0])  # noqa: B023, E731
            nexts = onward[at]
            came, at = at, min(nexts, key=turn) if len(nexts) > 1 else nexts[0]
        around = [ring[-1], *ring, ring[0]]
        bent = [b for a, b, c in zip(around, around[1:], around[2:]) if not (a[0] == b[0] == c[0] or a[1] == b[1] == c[1])]
        bent.append(bent[0])
        return pd.DataFrame({key: rows[key].iloc[0], "seq": range(len(bent)), "lon": [x * side for x, _ in bent], "lat": [y * side for _, y in bent]})

    return boundary(corridor_cells(segments, side, key), key).groupBy(key).applyInPandas(trace, f"{key} {kind}, seq int, lon double, lat double")


def signed_area(ring: DataFrame, key: str = "track_id") -> DataFrame:
    """Shoelace area of closed rings ``(key, seq, lon, lat)``: positive if counter-clockwise."""
    rows = network.segments(ring, (key,))
    return rows.groupBy(key).agg((F.sum(F.expr("x1 * y2 - x2 * y1")) / 2).alias("area"))
