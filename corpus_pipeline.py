"""A corpus pipeline from raw documents to packed training sequences.

Each stage works on all that its predecessor kept: quality rules drop documents, near-dedup keeps one document of each
group, substring dedup cuts out passages that an earlier document has, mixing repeats and thins documents towards the
sources' target weights, and packing lays out the rest in sequences. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from trailmill.llm import mixing, neardup, packing, passages, quality
from trailmill.llm.common import cut, cuts, drop_cuts, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What the stage before wrote on its way: once its result is written, nothing reads it any more.
_left: set[str] = set()


def _drop(spark: SparkSession, docs: DataFrame, paths: set[str]) -> None:
    """Delete tables, but for those that the documents are read from."""
    read = docs.inputFiles()
    drop_cuts(spark, [path for path in paths if not any(path.rsplit("/", 1)[-1] in f for f in read)])


def _tidy(stage: Stage) -> Stage:
    """A stage that first deletes what the one before left, but for what its own documents are read from."""

    @wraps(stage)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _drop(spark, docs, _left)
        _left.clear()
        before = cuts(spark)
        out = stage(spark, docs, sf_dir)
        _left.update(cuts(spark) - before)
        return out

    return tidied


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


@_tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


@_tidy
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.without_repeats(docs)


@_tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, weights=(5, 2, 1), most=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tables of this last stage stay: its result reads them."""
    return packing.pack(docs, capacity=4096, end=1)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The verdicts of the language references, passages and packing aren't SQL; tests hold ``run`` against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what each keeps is written once, to the shared folder, for the next to read."""
    docs, before = table(spark, sf_dir, "documents"), cuts(spark)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        _drop(spark, docs, cuts(spark) - before)
    return STAGES[-1][1](spark, docs, sf_dir)
