"""Approximate nearest neighbours by inner product over shifted Hilbert curves.

Vectors are projected to a few dimensions, in several ways with different shifts, and ordered along a Hilbert curve in
each. Neighbours in space are mostly neighbours in some ordering, so a query is compared with the vectors in a window
around it in every ordering; the windows' results merge by exact score. How wide the windows must be depends on the
data: it is measured on a bounded sample of queries against brute force.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class Curves:
    """``fit_rows`` vectors fit the projection and ``probe_queries`` queries measure the windows: both are bounds."""

    curves: int = 3
    dims: int = 8
    bits: int = 7
    axes: int = 16
    block: int = 2048
    query_block: int = 4096
    fit_rows: int = 20_000
    probe_queries: int = 128
    recall: float = 0.96
    seed: int = 17


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of whole coordinates below 2**bits: the transposed index is found by
    undoing the curve's reflections and swaps from the top bit down, then read off bit by bit after a Gray decode."""
    x = [grid[:, i].astype(np.int64) for i in range(grid.shape[1])]
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        mask = bit - 1
        for i in range(n):
            high = (x[i] & bit) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & mask)
            x[0] = np.where(high, x[0] ^ mask, x[0] ^ swap)
            x[i] = x[i] ^ (swap if i else 0)
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip = np.where((x[-1] & bit) > 0, flip ^ (bit - 1), flip)
        bit >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ flip) >> b & 1)
    return key


def fit_axes(sample: np.ndarray, how: Curves) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per curve: a projection on random mixes of the sample's main axes, and the scale and shift to its grid."""
    rng = np.random.default_rng(how.seed)
    mean = sample.mean(axis=0)
    _, _, main = np.linalg.svd(sample - mean, full_matrices=False)
    main = main[: how.axes]
    dims = min(how.dims, len(main))
    out = []
    for _ in range(how.curves):
        mix, _ = np.linalg.qr(rng.standard_normal((len(main), len(main))))
        axes = (mix[:dims] @ main).T
        spread = np.maximum((sample @ axes).std(axis=0), 1e-12)
        out.append((axes, 1 / (12 * spread), rng.random(dims) / 2 + 0.25 - mean @ axes / (12 * spread)))
    return out


def _score(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in the order of the components, so that equal vectors score equal."""
    total = np.zeros(len(queries))
    for i in range(queries.shape[1]):
        total += queries[:, i] * vectors[:, i]
    return total


def best_in_block(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best vectors, never its own id, ties to the smaller id."""
    rough = queries @ vectors.T
    rough[qids[:, None] == ids[None, :]] = -np.inf
    out = []
    size = np.abs(rough, where=np.isfinite(rough), out=np.zeros_like(rough)).max(initial=1.0)
    floor = np.partition(rough, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)] - 1e-9 * size
    for i, least in enumerate(floor):
        near = np.flatnonzero((rough[i] >= least) & (qids[i] != ids))
        score = _score(np.broadcast_to(queries[i], (len(near), queries.shape[1])), vectors[near])
        order = np.lexsort((ids[near], -score))[:k]
        out.append((ids[near][order], score[order]))
    return out


def merge_best(parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    ids, score = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((-score, ids))  # one row an id: its best
    ids, score = ids[order], score[order]
    own = np.ones(len(ids), bool)
    own[1:] = ids[1:] != ids[:-1]
    ids, score = ids[own], score[own]
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


FOUND = "query_id bigint, ids array<bigint>, scores array<double>"
RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _merged(found: DataFrame, k: int) -> DataFrame:
    def merge(rows: pa.Table) -> pa.Table:
        ids, scores = merge_best([(np.array(i, np.int64), np.array(s, float)) for i, s in zip(rows["ids"].to_pylist(), rows["scores"].to_pylist())], k)
        n = len(ids)
        return pa.table({"query_id": rows["query_id"].slice(0, 1).to_pylist() * n, "rank": pa.array(range(1, n + 1), pa.int32()), "vec_id": ids, "score": scores})

    return found.groupBy("query_id").applyInArrow(merge, RESULT)


def exact_neighbours(vectors: DataFrame, qids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Brute force for a bounded set of queries, held by every task, against all rows in blocks."""

    def blocks(batches):
        for batch in batches:
            if batch.num_rows:
                best = best_in_block(qids, queries, batch["id"].to_numpy(zero_copy_only=False), _matrix(batch["vector"]), k)
                yield pa.RecordBatch.from_pydict({"query_id": qids, "ids": pa.array([i for i, _ in best], pa.list_(pa.int64())), "scores": pa.array([s for _, s in best], pa.list_(pa.float64()))})

    return _merged(vectors.select("id", "vector").mapInArrow(blocks, FOUND), k)


def usable(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id, vector`` of the rows that take part: an id, and finite components of which one isn't zero."""
    kept = table.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return kept.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(F.exists("vector", bad), F.lit(True)) & F.exists("vector", lambda x: x != 0))


def nearest(table: DataFrame, is_query: Column, k: int = 20, how: Curves = Curves(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` holds, the ``k`` nearest found by inner
    product (double precision on the vectors as given), nearest first, ties to the smaller id.

    All rows are indexed and candidates, but the query's own id. Rows with a null id, a null or zero vector or one with
    a null or non-finite component take no part. Vectors of different lengths have no inner product: each length is
    searched on its own. Rows that share an id count as one candidate, by the better score, and as one query, by the
    least of their vectors. Other columns are left out; an empty table gives an empty result.
    """
    asked = table.where(is_query).select(F.col(vec_id).cast("bigint").alias("id")).distinct()
    rows = cut(usable(table, vec_id, vector))
    queries = rows.join(asked, "id", "left_semi").groupBy("id").agg(F.min("vector").alias("vector"))
    out = table.sparkSession.createDataFrame([], RESULT)
    for size in sorted(r["size"] for r in rows.groupBy(F.size("vector").alias("size")).count().collect()):
        here = F.size("vector") == size
        out = out.unionByName(_nearest(rows.where(here), queries.where(here), k, how))
    return out


def _nearest(rows: DataFrame, queries: DataFrame, k: int, how: Curves) -> DataFrame:
    """The search among vectors of one length."""
    spark, n = rows.sparkSession, rows.count()
    share = how.fit_rows / n
    drawn = F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = _matrix(rows.where(drawn).select("vector").limit(2 * how.fit_rows).toArrow()["vector"])
    axes = fit_axes(sample if len(sample) else _matrix(rows.select("vector").limit(1).toArrow()["vector"]), how)

    @F.arrow_udf("array<struct<curve:int,key:bigint>>")
    def keys(vectors: pa.Array) -> pa.Array:
        x, top = _matrix(vectors), (1 << how.bits) - 1
        grids = [np.clip(((x @ a) * s + t) * (top + 1), 0, top).astype(np.int64) for a, s, t in axes]
        along = [hilbert_keys(g, how.bits) for g in grids]
        return pa.array([[{"curve": c, "key": int(key[i])} for c, key in enumerate(along)] for i in range(len(x))], pa.list_(pa.struct([("curve", pa.int32()), ("key", pa.int64())])))

    ordered = rows.withColumn("at", F.explode(keys(F.col("vector")))).select("id", "vector", "at.curve", "at.key")
    parts = max(1, math.ceil(n * how.curves / 50_000))
    ordered = ordered.repartitionByRange(parts, "curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    ordered = cut(ordered.withColumn("row", F.monotonically_increasing_id()).drop("key"))
    # a row's place in its curve: its place in the partition, after what earlier partitions hold of the curve
    firsts, seen = [], {}
    part = F.shiftright("row", 33)
    for r in ordered.groupBy(part.alias("part"), "curve").agg(F.min("row").alias("first"), F.count("*").alias("n")).orderBy("part", "curve").collect():
        firsts.append((r["part"], r["curve"], seen.get(r["curve"], 0) - r["first"]))
        seen[r["curve"]] = seen.get(r["curve"], 0) + r["n"]
    firsts = spark.createDataFrame(firsts, "part bigint, curve int, base bigint")
    placed = ordered.withColumn("part", part).join(firsts, ["part", "curve"]).select("id", "vector", "curve", (F.col("row") + F.col("base")).alias("place"))

    # windows as wide as the probes need: for their true neighbours, the least distance along any curve
    probes = queries.orderBy(F.xxhash64("id")).limit(how.probe_queries).toArrow()
    if not probes.num_rows:
        return spark.createDataFrame([], RESULT)
    truth = cut(exact_neighbours(rows, probes["id"].to_numpy(), _matrix(probes["vector"]), k))
    wanted = truth.select(F.col("query_id").alias("id")).unionByName(truth.select(F.col("vec_id").alias("id"))).distinct()
    spots = cut(placed.join(wanted, "id", "left_semi").groupBy("id", "curve").agg(F.min("place").alias("place")))
    far = truth.join(spots.withColumnRenamed("id", "query_id"), "query_id")
    far = far.join(spots.select(F.col("id").alias("vec_id"), "curve", F.col("place").alias("its")), ["vec_id", "curve"])
    far = far.groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("place") - F.col("its"))).alias("far")).toArrow()["far"].to_numpy()
    reach = int(np.quantile(far, how.recall, method="higher")) + 1 if len(far) else n

    last = (n - 1) // how.block
    n_queries = queries.count()
    salts = max(1, math.ceil(n_queries * min(1, (2 * reach + how.block) / n) / how.query_block))
    asked = placed.join(queries.select("id", F.col("vector").alias("asked")), "id").where(F.col("vector") == F.col("asked"))
    asked = asked.groupBy("id", "curve").agg(F.min("asked").alias("vector"), F.min("place").alias("place"))
    block = lambda place: F.floor(place / how.block).cast("int")
    asked = asked.withColumn("block", F.explode(F.sequence(block(F.greatest(F.col("place") - reach, F.lit(0))), F.least(block(F.col("place") + reach), F.lit(last)))))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).select("curve", "block", "salt", "id", "vector")
    held = placed.withColumn("block", block(F.col("place"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("curve", "block", "salt", "id", "vector")
    held = held.toDF(*held.columns)  # columns of its own, apart from the queries'

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float64()))})
        qids = asked["id"].to_numpy()
        best = best_in_block(qids, _matrix(asked["vector"]), held["id"].to_numpy(), _matrix(held["vector"]), k)
        return pa.table({"query_id": qids, "ids": pa.array([i for i, _ in best], pa.list_(pa.int64())), "scores": pa.array([s for _, s in best], pa.list_(pa.float64()))})

    spot = ("curve", "block", "salt")
    return _merged(asked.groupBy(*spot).cogroup(held.groupBy(*spot)).applyInArrow(compare, FOUND), k)
