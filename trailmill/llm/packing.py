"""Best-fit packing of tokenised documents by bin completion over the histogram of their lengths.

Pieces of one length are interchangeable, so the whole problem is a table of at most ``capacity`` counts, however
large the corpus. The driver solves that table; each piece then finds its place from its length and its number among
the pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WordIds
from .common import cut, release, tokenizer_path

#: A filling of sequences: how many, and the (length, times) in each.
Pattern = tuple[int, tuple[tuple[int, int], ...]]


def lower_bound(counts: np.ndarray) -> int:
    """Least number of sequences that any packing needs: the best of the bounds that set large pieces apart, and of
    those that count pieces of which no more than m fit in one sequence."""
    capacity = len(counts) - 1
    lengths = np.arange(capacity + 1)
    below, volume = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * lengths))
    k, half = np.arange(capacity // 2 + 1), capacity // 2
    huge = below[-1] - below[capacity - k + 1]
    large = below[capacity - k + 1] - below[half + 1]
    large_volume = volume[capacity - k + 1] - volume[half + 1]
    small_volume = volume[half + 1] - volume[k]
    over = small_volume - (large * capacity - large_volume)
    m = np.arange(1, capacity + 1)
    longer = below[-1] - below[capacity // (m + 1) + 1]
    return int(max((huge + large + np.maximum(0, -(-over // capacity))).max(), (-(-longer // m)).max()))


class Stock:
    """Counts by length, with the lengths in stock in order."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.tolist()
        self.lengths = [i for i, n in enumerate(self.left) if n]
        self.volume = sum(i * self.left[i] for i in self.lengths)

    def take(self, length: int, n: int) -> None:
        before = self.left[length]
        self.left[length] -= n
        self.volume -= length * n
        if before and not self.left[length]:
            del self.lengths[bisect_right(self.lengths, length) - 1]
        elif not before and self.left[length]:
            insort(self.lengths, length)


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether each piece of b has a piece of a, of its own, that is at least as long (both from long to short)."""
    return len(a) >= len(b) and all(x >= y for x, y in zip(a, b))


def completions(stock: Stock, space: int, keep: int, nodes: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``space``, least waste first, longer pieces first among equals.

    Depth first from long pieces to short; a node is a length and how often it is taken, the most first. A branch ends
    where even all pieces of the lengths it has left would waste as much as the worst filling kept; a filling without
    waste ends the search once ``keep`` of them are found. ``nodes`` bounds the search.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    chosen: list[int] = []
    budget = nodes
    volumes = [0, *accumulate(n * stock.left[n] for n in stock.lengths)]

    def search(space: int, at: int) -> bool:
        """Fillings from ``stock.lengths[: at + 1]``. False: the search is over."""
        nonlocal budget
        at = min(at, bisect_right(stock.lengths, space) - 1)
        if at < 0:  # nothing more fits
            filling = tuple(chosen)
            if not any(dominates(other, filling) for _, other in found):
                found[:] = [x for x in found if not dominates(filling, x[1])]
                insort(found, (space, filling), key=lambda x: (x[0], [-i for i in x[1]]))
                del found[keep:]
            return len(found) < keep or found[-1][0] > 0
        for i in range(at, -1, -1):
            if len(found) >= keep and space - volumes[i + 1] >= found[-1][0]:
                break
            length = stock.lengths[i]
            for times in range(min(stock.left[length], space // length), 0, -1):
                budget -= 1
                if budget < 0:
                    return False
                chosen.extend([length] * times)
                more = search(space - times * length, i - 1)
                del chosen[-times:]
                if not more:
                    return False
        return True

    search(space, len(stock.lengths) - 1)
    return [filling for _, filling in found]


def best_fit(stock: Stock, space: int) -> tuple[int, ...]:
    """The longest piece that fits, again and again."""
    chosen: list[int] = []
    used: dict[int, int] = {}
    while True:
        at = bisect_right(stock.lengths, space) - 1
        while at >= 0 and used.get(stock.lengths[at], 0) >= stock.left[stock.lengths[at]]:
            at -= 1
        if at < 0:
            return tuple(chosen)
        length = stock.lengths[at]
        times = min(stock.left[length] - used.get(length, 0), space // length)
        used[length] = used.get(length, 0) + times
        chosen += [length] * times
        space -= times * length


def _apply(stock: Stock, filling: tuple[int, ...]) -> Pattern:
    """Take a filling from the stock as often as it lasts."""
    times: dict[int, int] = {}
    for length in filling:
        times[length] = times.get(length, 0) + 1
    n = min(stock.left[length] // m for length, m in times.items())
    for length, m in times.items():
        stock.take(length, n * m)
    return n, tuple(times.items())


def _beside_longest(stock: Stock, capacity: int, fill: Callable[[Stock, int], list[tuple[int, ...]]]) -> list[tuple[int, ...]]:
    """Fillings of a sequence that holds the longest piece."""
    longest = stock.lengths[-1]
    stock.take(longest, 1)
    fills = fill(stock, capacity - longest)
    stock.take(longest, -1)
    return [(longest, *f) for f in fills]


def best_fit_packing(counts: np.ndarray) -> list[Pattern]:
    """Longest first, each sequence filled with the longest pieces that fit."""
    stock, out = Stock(np.asarray(counts)), []
    while stock.lengths:
        out.append(_apply(stock, _beside_longest(stock, len(counts) - 1, lambda s, space: [best_fit(s, space)])[0]))
    return out


def solve(counts: np.ndarray, keep: int = 4, nodes: int = 400, tries: int = 12_000) -> list[Pattern]:
    """Patterns that use every piece of the histogram ``counts`` (index: length) once, in few sequences.

    The best-fit packing is the first incumbent, and the answer if it meets the lower bound. Else each step takes the
    longest piece left, fills the space around it with the completion of least waste, and repeats that filling as often
    as stock lasts; the search goes back over the other completions while the waste so far leaves room for fewer
    sequences than the incumbent has, until the lower bound is met or ``tries`` steps are spent. ``keep`` completions
    of a step are kept, found within ``nodes`` nodes. These three bound the driver's work; no piece is ever left out.
    """
    capacity, stock = len(counts) - 1, Stock(np.asarray(counts))
    least, best = lower_bound(np.asarray(counts)), best_fit_packing(counts)
    best_n = sum(n for n, _ in best)
    path: list[tuple[Pattern, list[tuple[int, ...]]]] = []
    used = 0
    while best_n > least:
        if not stock.lengths and used < best_n:
            best, best_n = [p for p, _ in path], used
            continue
        if stock.lengths and used + -(-stock.volume // capacity) < best_n and tries > 0:
            tries -= 1
            fills = _beside_longest(stock, capacity, lambda s, space: completions(s, space, keep, nodes) or [best_fit(s, space)])
            path.append((_apply(stock, fills[0]), fills[1:]))
            used += path[-1][0][0]
            continue
        while path and tries > 0:  # back to the last step with another completion
            (n, items), others = path.pop()
            used -= n
            for length, m in items:
                stock.take(length, -n * m)
            if others:
                path.append((_apply(stock, others[0]), others[1:]))
                used += path[-1][0][0]
                break
        else:
            break
    return best


def places(patterns: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """For each length and run of its pieces' numbers: the first sequence, pieces in each, and the first offset."""
    rows, taken, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for n, items in patterns:
        offset = 0
        for length, m in items:
            rows.append((length, taken[length], sequence, m, offset))
            taken[length] += n * m
            offset += m * length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "number", "sequence", "times", "offset"), table.T))


_ids: dict[int, WordIds] = {}


def pieces_of(docs: DataFrame, text: str, capacity: int, end: int, tokenizer: str | None, with_ids: bool) -> DataFrame:
    with open(tokenizer or tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    key, mark = hash(spec), end.to_bytes(4, "little")
    fields = [("piece", "int", pa.int32()), ("start", "bigint", pa.int64()), ("length", "bigint", pa.int64()), ("ids_crc32", "bigint", pa.int64())]
    fields += [("ids", "binary", pa.binary())] * with_ids

    @F.arrow_udf(f"array<struct<{','.join(f'{n}:{t}' for n, t, _ in fields)}>>")
    def pieces(texts: pa.Array) -> pa.Array:
        if key not in _ids:
            _ids.clear()
            _ids[key] = WordIds(spec)
        encode = _ids[key].encode
        out = []
        for x in texts:
            data, step = encode(x.as_py()) + mark, 4 * capacity
            parts = [data[i : i + step] for i in range(0, len(data), step)]
            out.append([{"piece": i, "start": i * capacity, "length": len(p) // 4, "ids_crc32": zlib.crc32(p), "ids": p} for i, p in enumerate(parts)])
        release()
        return pa.array(out, pa.list_(pa.struct([(n, t) for n, _, t in fields])))

    return docs.withColumn("packed piece", F.explode(pieces(F.col(text)))).select("*", "packed piece.*").drop("packed piece")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, end: int = 1, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` and, on
    request, ``ids`` (little-endian 32-bit numbers) and ``row``, a number for each row of ``docs``, which tells copies
    of a document apart.

    A document is its token ids and the id ``end``; only a longer one than ``capacity`` is cut. A null or empty text
    is its end alone. Repeated rows are packed each; a null id is carried; other columns are left out; an empty table
    gives an empty result. Reruns give the same packing, as the pieces are written once and numbered by row.
    """
    numbered = docs.select(doc_id, text, F.monotonically_increasing_id().alias("of row"))
    rows = pieces_of(numbered, text, capacity, end, tokenizer, with_ids).drop(text)
    rows = cut(rows.withColumn("piece row", F.monotonically_increasing_id()))
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    plan = places(solve(counts), capacity)
    starts_at = plan["length"] << 40 | plan["number"]

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        length, number = lengths.to_numpy(zero_copy_only=False), numbers.to_numpy(zero_copy_only=False)
        at = np.searchsorted(starts_at, length << 40 | number, side="right") - 1
        past = number - plan["number"][at]
        sequence = plan["sequence"][at] + past // plan["times"][at]
        offset = plan["offset"][at] + past % plan["times"][at] * length
        return pa.StructArray.from_arrays([pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["sequence_id", "offset"])

    # Number the pieces of each length, a hot length in many parts.
    parts = max(16, -(-int(counts.max()) // 100_000))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("piece row"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("piece row")) - 1
    numbered = rows.withColumn("own", own).join(firsts, ["length", "part"]).withColumn("number", F.col("first") + F.col("own"))
    placed = numbered.withColumn("place", place(F.col("length"), F.col("number")))
    return placed.select(doc_id, "piece", "start", "length", "ids_crc32", "place.*", *["ids", F.col("of row").alias("row")] * with_ids)
