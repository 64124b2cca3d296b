"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows that one task of the second permutation sorts, about.
BLOCK_ROWS = 1_000_000


def _stirling_error(n: float) -> float:
    """log(n!) less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - 1 / 1260 / n / n) / n / n) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without the loss of digits where they are close."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return (x * math.log(x / mean) if x else 0.0) + mean - x
    v = (x - mean) / (x + mean)
    total, term, j = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        if total + term / (2 * j + 1) == total:
            return total
        total += term / (2 * j + 1)
        j += 1


def _log_binomial(k: int, n: int, p: float) -> float:
    """Log of the binomial probability, to full precision at any size."""
    if k in (0, n):
        other = (1 - p) if k == 0 else p
        return n * math.log(other) if other else (0.0 if not n else -math.inf)
    errors = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k)
    return errors - _deviance(k, n * p) - _deviance(n - k, n * (1 - p)) + 0.5 * math.log(n / (2 * math.pi * k * (n - k)))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn without replacement are good: the exact law at any size.

    Within numpy's limit this is numpy's draw. Beyond, uniform points are taken in a box around the distribution's
    square root until one lies under it (the ratio of uniforms); a probability is three binomial ones.
    """
    total = good + bad
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    p = n / total
    log = lambda k: _log_binomial(k, good, p) + _log_binomial(n - k, bad, p)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    top, centre = log(mode), n * good / total + 0.5
    # The width of the box that holds the square root of any such law.
    width = 1.7155277699214135 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1)) + 0.5) + 0.8989161620588988
    while True:
        u, v = rng.random(), 1 - rng.random()
        k = math.floor(centre + width * (u - 0.5) / v)
        if low <= k <= high and 2 * math.log(v) <= log(k) - top:
            return k


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> np.ndarray:
    """How many rows each partition sends to each shard: as a uniform shuffle deals them, with these exact sums."""
    rng, left = np.random.default_rng(seed), np.array(shards, np.int64)
    out = np.zeros((len(rows), len(shards)), np.int64)
    for i, n in enumerate(rows):
        out[i] = _dealt(rng, left, n)
        left -= out[i]
    return out


def _dealt(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows over what is left of the shards: halves of them in turn."""
    if len(left) == 1 or not n:
        return np.array([n] + [0] * (len(left) - 1))
    half = len(left) // 2
    k = hypergeometric(rng, int(left[:half].sum()), int(left[half:].sum()), n)
    return np.concatenate([_dealt(rng, left[:half], k), _dealt(rng, left[half:], n - k)])


def shuffle_to_shards(df: DataFrame, n_shards: int = 16, seed: int = 11) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard), uniformly shuffled.

    Shard sizes differ by one row at most. The rows are written once with the partition they lie in, so that reruns of
    lost tasks see the same rows; each partition permutes its rows and deals its exact counts; each shard permutes
    what it got, in blocks of about ``BLOCK_ROWS`` rows. The driver holds the matrix: one row per partition, small up to
    about a million partitions. Values don't matter: nulls, equal rows and long texts are
    dealt like any other row. Columns of these names are replaced; an empty table stays empty.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    part, row, rank, block = (f"shuffle {x}" for x in ("part", "row", "rank", "block"))
    stamped = cut(df.withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id()}))
    counts = sorted((r[part], r["count"]) for r in stamped.groupBy(part).count().collect())  # one number per partition
    n = sum(c for _, c in counts)
    sizes = [n // n_shards + (i < n % n_shards) for i in range(n_shards)]
    ends = communication_matrix([c for _, c in counts], sizes, seed).cumsum(axis=1)
    matrix = spark.createDataFrame([(p, e.tolist()) for (p, _), e in zip(counts, ends)], f"`{part}` int, ends array<bigint>")
    locally = Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed), row), row)
    dealt = stamped.withColumn(rank, F.row_number().over(locally)).join(matrix, part)
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col(rank))).cast("int")).drop("ends", rank, part)
    blocks = max(1, -(-n // (n_shards * BLOCK_ROWS)), min(16, n // 1000))
    chance = F.xxhash64(F.lit(seed + 1), row)
    dealt = cut(dealt.withColumn(block, F.pmod(F.shiftrightunsigned(chance, 20), F.lit(blocks))))
    before = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", block).count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    again = Window.partitionBy("shard", block).orderBy(chance, row)
    placed = dealt.withColumn("slot", F.row_number().over(again) - 1).join(starts, ["shard", block])
    return placed.withColumn("slot", (F.col("slot") + F.col("start")).cast("bigint")).select(*df.columns, "shard", "slot")
