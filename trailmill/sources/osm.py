"""Map extracts in XML: nodes, ways, streets and points of interest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAGS = "tag array<struct<_k: string, _v: string>>"
NODE = f"_id string, _lat double, _lon double, {_TAGS}, _corrupt_record string"
WAY = f"_id string, nd array<struct<_ref: string>>, {_TAGS}, _corrupt_record string"


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of one kind; one that is cut off or malformed goes, what was complete before it stays."""
    rows = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").schema(schema).load(path)
    rows = rows.where("_corrupt_record is null").drop("_corrupt_record")
    # ids are whole numbers from 0; of several elements with one id, the last holds
    rows = rows.withColumn("id", F.expr("try_cast(_id as bigint)")).where("id >= 0").withColumn("pos", F.monotonically_increasing_id())
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "pos")]), "pos").alias("e")
    return rows.groupBy("id").agg(last).select("id", "e.*")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``node_id, lon, lat, tags: array<struct<k, v>>``."""
    rows = _elements(spark, path, "node", NODE)
    tags = F.transform(F.coalesce("tag", F.array()), lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v")))
    return rows.select(F.col("id").alias("node_id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), tags.alias("tags"))


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """``way_id, nd: array<bigint>, tags: map, name``; of repeated keys the last holds."""
    rows = _elements(spark, path, "way", WAY)
    refs = F.filter(F.transform(F.coalesce("nd", F.array()), lambda n: n["_ref"].try_cast("bigint")), lambda n: n >= 0)
    pairs = F.transform(F.coalesce("tag", F.array()), lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda t: t["k"]))
    tags = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda t: t["k"] == k), -1)["v"].alias("v"))))
    rows = rows.select(F.col("id").alias("way_id"), refs.alias("nd"), tags.alias("tags"))
    return rows.withColumn("name", F.col("tags")["name"])


def way_nodes(ways: DataFrame) -> DataFrame:
    return ways.select("way_id", F.posexplode("nd").alias("seq", "node_id"))


def overpass_query(corners: Sequence[tuple[float, float]], ski: bool = False) -> str:
    """The text of a request for the roads (or pistes) inside a polygon of (lon, lat) corners; sending it is the
    caller's part."""
    if any(c != c for corner in corners for c in corner):
        raise ValueError("a corner isn't a number")
    area = " ".join(f"{lat} {lon}" for lon, lat in corners)
    if ski:
        wanted = [f'way["piste:type"="downhill"](poly:"{area}");', f'way["aerialway"](poly:"{area}");']
    else:
        wanted = [f'way["highway"]["highway"!~"^(motorway|motorway_link|trunk|trunk_link)$"]["footway"!="crossing"]["area"!="yes"](poly:"{area}");']
    return "[out:xml];(" + "".join(wanted) + f'node(poly:"{area}"););(._;>;);out;'
