"""Live positions ``(device_id, ts, lon, lat)``: a stateful noise gate with heading, in batch and as a stream."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trailmill.functions.geometry import EARTH_RADIUS, NOISE_METRES
from trailmill.operators.track import valid_fixes

OUT = "ts timestamp, lon double, lat double, heading double"


def metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    y1, y2 = math.radians(a[1]), math.radians(b[1])
    u = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * EARTH_RADIUS * math.atan2(math.sqrt(u), math.sqrt(1 - u))


def gate(rows: pd.DataFrame, last: list[tuple[float, float]]) -> tuple[pd.DataFrame, list[tuple[float, float]]]:
    """The fixes accepted after those in ``last`` (oldest first), with the heading from two accepted fixes before, or
    the oldest known; and the last two accepted to go on from. A rejected fix moves nothing."""
    out = []
    for ts, lon, lat in rows.sort_values("ts", kind="stable")[["ts", "lon", "lat"]].itertuples(index=False):
        if last and metres(last[-1], (lon, lat)) < NOISE_METRES:
            continue
        heading = math.atan2(lat - last[0][1], lon - last[0][0]) if last else None
        out.append((ts, lon, lat, heading))
        last = [*last, (lon, lat)][-2:]
    return pd.DataFrame(out, columns=["ts", "lon", "lat", "heading"]).astype({"lon": float, "lat": float, "heading": float}), last


def accepted(fixes: DataFrame) -> DataFrame:
    """The gate over a table: ``device_id, ts, lon, lat, heading``."""
    kind = dict(fixes.dtypes)["device_id"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out, _ = gate(rows, [])
        out.insert(0, "device_id", rows["device_id"].iloc[0])
        return out

    return valid_fixes(fixes).select("device_id", "ts", "lon", "lat").groupBy("device_id").applyInPandas(one, f"device_id {kind}, {OUT}")


def accepted_stream(fixes: DataFrame, delay: str = "1 minute", idle_ms: int = 86_400_000) -> DataFrame:
    """The gate over a stream. Fixes of one trigger are sorted by time; rows later than ``delay`` behind the newest of
    the triggers before are dropped. A device unheard of for ``idle_ms`` is forgotten: its next fix is accepted."""
    kind = dict(fixes.dtypes)["device_id"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts))
        watermark = state.getCurrentWatermarkMs()
        rows = rows[rows["ts"] >= pd.Timestamp(watermark, unit="ms")]
        held = state.get if state.exists else (None,) * 4
        last = [(x, y) for x, y in (held[:2], held[2:]) if x is not None]
        out, last = gate(rows, last)
        flat = [v for fix in last for v in fix]
        state.update((*flat, *[None] * (4 - len(flat))))
        newest = int(rows["ts"].max().timestamp() * 1000) if len(rows) else watermark
        state.setTimeoutTimestamp(max(newest, watermark) + idle_ms)
        out.insert(0, "device_id", key[0])
        yield out

    rows = valid_fixes(fixes).select("device_id", "ts", "lon", "lat").withWatermark("ts", delay)
    return rows.groupBy("device_id").applyInPandasWithState(step, f"device_id {kind}, {OUT}", "x1 double, y1 double, x2 double, y2 double", "append", GroupStateTimeout.EventTimeTimeout)


def simulated(spark: SparkSession, box: tuple[float, float, float, float], per_second: int = 1, step: float = 1 / 5000) -> DataFrame:
    """A stream of fixes ``(device_id, ts, lon, lat)`` of one device that walks along the diagonal of the box
    (x0, y0, x1, y1) from its middle, a share ``step`` of it each time, there and back again."""
    x0, y0, x1, y1 = box
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    past = F.pmod(F.lit(0.5) + F.col("value") * step, F.lit(2.0))
    at = F.when(past <= 1, past).otherwise(2 - past)
    return rows.select(F.lit(0).alias("device_id"), F.col("timestamp").alias("ts"), (x0 + at * (x1 - x0)).alias("lon"), (y0 + at * (y1 - y0)).alias("lat"))


def with_viewport(fixes: DataFrame, edges: DataFrame, side: float) -> DataFrame:
    """Stream-static join: the edges in the 3 by 3 tiles around each fix."""
    tile = lambda c: F.floor(F.col(c) / side)
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    rows = fixes.withColumn("step", F.explode(steps))
    rows = rows.withColumns({"tx": tile("lon") + F.col("step.i"), "ty": tile("lat") + F.col("step.j")}).drop("step")
    return rows.join(edges, ["tx", "ty"])
