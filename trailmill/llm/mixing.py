"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 of the parts."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), *(F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("|")) for p in parts)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Per source: its size, weight and target, from a table of ``source, size``.

    Sharing what exceeds a cap again by weight, until no target is above its cap, ends where each target is the
    smaller of its cap and level * weight. With sources in order of cap / weight, the level is the greatest of
    (total - caps before) / (weights from here on), so one running sum replaces the rounds.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight.cast("bigint")).withColumn("cap", most * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = sources.withColumn("level", left / weights_left)
    level = F.max("level").over(everything)
    return levels.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select("source", "source_size", "weight", "target")


def mixing_plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target``, ``rate``, ``copies`` and ``taken``.

    Sources in order of code points, null last, get the weights in turn and share all words by them; a target stops
    at ``most`` times its source's size. A document gets floor(rate) copies, and one more with the probability of the
    fraction, drawn from a hash of seed, id and text, so reruns agree. A null or empty text has size 0; a source of
    size 0 has target and rate 0; equal rows get equal copies; columns of these names are replaced; an empty table
    stays empty. The table of sources is one row each; Spark broadcasts it only while its file is below its limit.
    """
    added = ("size", "source_size", "target", "rate", "copies", "taken")
    docs = docs.drop(*added)
    sizes = docs.select(F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    sources = cut(source_targets(sizes, weights, most))
    key, has = "mix source", F.col(source).isNotNull()  # a hot null source joins as any other: by a key that isn't null
    named = docs.withColumn(key, F.when(has, F.concat(F.lit("s"), F.col(source).cast("string"))).otherwise("n"))
    rates = sources.select(F.when(F.col("source").isNotNull(), F.concat(F.lit("s"), "source")).otherwise("n").alias(key), "source_size", "target")
    mixed = named.join(rates, key).drop(key)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mixed = mixed.withColumns({"size": word_count(F.col(text)), "rate": rate})
    extra = uniform(seed, F.col(doc_id), F.col(text)) < F.col("rate") - F.floor("rate")
    mixed = mixed.withColumn("copies", F.floor("rate") + extra.cast("bigint"))
    return mixed.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document as often as its plan says, with the columns it had."""
    plan = mixing_plan(docs, **options).where("copies > 0")
    return plan.withColumn("copy of", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(docs.columns)
