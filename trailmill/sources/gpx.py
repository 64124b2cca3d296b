"""Recorded tracks in GPX."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACK = "trkseg array<struct<trkpt: array<struct<_lat: double, _lon: double, ele: double, cmt: string>>>>"


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """``track_id`` (the file), ``seq, lon, lat, ele, is_waypoint``: each file's last track, its segments end to end;
    points with a comment are waypoints, as is every point at the same place."""
    rows = spark.read.format("xml").option("rowTag", "trk").schema(TRACK).load(path)
    rows = rows.select(F.input_file_name().alias("track_id"), F.monotonically_increasing_id().alias("pos"), "trkseg")
    last = rows.groupBy("track_id").agg(F.max_by("trkseg", "pos").alias("trkseg"))
    points = F.flatten(F.transform("trkseg", lambda s: F.coalesce(s["trkpt"], F.array())))
    points = last.select("track_id", F.posexplode(points).alias("seq", "p"))
    points = points.select("track_id", "seq", F.col("p._lon").alias("lon"), F.col("p._lat").alias("lat"), F.col("p.ele").alias("ele"), F.col("p.cmt").isNotNull().alias("commented"))
    places = points.where("commented").select("track_id", "lon", "lat", F.lit(True).alias("is_waypoint")).distinct()
    marked = points.drop("commented").join(places, ["track_id", "lon", "lat"], "left")
    return marked.select("track_id", "seq", "lon", "lat", "ele", F.coalesce("is_waypoint", F.lit(False)).alias("is_waypoint"))


def from_area(spark: SparkSession, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """The closed ring of a rectangle, as a track of corners."""
    ring = [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]
    return spark.createDataFrame([("area", i, x, y) for i, (x, y) in enumerate(ring)], "track_id string, seq int, lon double, lat double")
