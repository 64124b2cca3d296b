"""The driver's tables as nodes, ways, streets, tracks and points: integer arithmetic first, one division last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    lon, lat = 5.7 + key * 7919 % 1000 / F.lit(100000.0), 45.1 + key * 104729 % 1000 / F.lit(100000.0)
    return _table(spark, sf_dir, "part").select(key.alias("node_id"), lon.alias("lon"), lat.alias("lat"))


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = _table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(order) - 1)
    return rows.select(F.col("l_orderkey").alias("way_id"), "seq", F.col("l_partkey").alias("node_id"))


# What each order priority and status stands for.
HIGHWAYS = {"1-URGENT": "residential", "2-HIGH": "footway", "3-MEDIUM": "steps", "4-NOT SPECIFIED": "motorway", "5-LOW": "track"}
BICYCLE = {"O": "yes", "F": "no"}


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``way_id, tags, name``: the name is the customer's segment and the last digit of its key."""
    pick = lambda column, values: F.coalesce(*(F.when(F.col(column) == k, F.lit(v)) for k, v in values.items()))
    tags = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("highway").alias("k"), pick("o_orderpriority", HIGHWAYS).alias("v")),
        F.struct(F.lit("bicycle").alias("k"), pick("o_orderstatus", BICYCLE).alias("v")),
    ), lambda e: e["v"].isNotNull()))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way_id"), "o_custkey", tags.alias("tags"))
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    named = orders.join(customers, "o_custkey", "left")
    name = F.concat(F.col("c_mktsegment"), F.lit(" "), (F.col("o_custkey") % 10).cast("string"))
    return named.select("way_id", "tags", name.alias("name"))


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``track_id, seq, lon, lat, ele``: a user's events in order of time."""
    # dealt under the track's own name, so that what goes by track later isn't shuffled again, and without coordinates
    ele = F.get_json_object("props", "$.k").cast("double")
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), "ts", "event_id", "value", ele.alias("ele"))
    order = Window.partitionBy("track_id").orderBy("ts", "event_id")
    lon, lat = 5.7 + F.col("value") / 100000.0, 45.1 + F.col("event_id") % 1000 / F.lit(100000.0)
    return events.withColumn("seq", F.row_number().over(order) - 1).select("track_id", "seq", lon.alias("lon"), lat.alias("lat"), "ele")


def signed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``point_id, x, y`` on both sides of zero."""
    vector = F.col("embedding")
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), vector[0].cast("double").alias("x"), vector[1].cast("double").alias("y"))
