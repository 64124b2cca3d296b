"""Near-duplicate passages by compact windows over token min-hashes.

The tokens of a text are its 5-word shingles. For one hash function, the Cartesian tree over the tokens' hashes groups
all runs of tokens whose least hash lies at the same place c: the runs that begin in [l, c] and end in [c, r]. Such a
compact window stands for all these runs at once, and only windows that hold a run of the least length are kept. Two
passages that share a least hash lie in two windows with the same value. Windows meet by value; where enough hash
functions link two texts, all their passages are found and verified on the words themselves.

First every window is held against the first text that has its value and the least token on one of its sides, in windows
of enough hash functions. What no verified passage covers then is held against all earlier windows that agree in value and side, by the
tokens around them, and the text that agrees best there is verified too; so an earlier text that is only somewhat like a
passage hides no copy of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounds, cut, mixed, pack, pack_sorted, release, shingle_prints, spread_join, text_prints, unpack, unpack_sorted


@dataclass(frozen=True)
class Passages:
    """Passages of at least ``words`` words; two are alike if their shingle sets overlap by ``percent``.

    Equal passages agree in the value and one side of each of the ``hashes`` functions' windows. Passages at the
    threshold do so for one function with probability 0.63, so for fewer than ``enough`` of 6 in 3 % of cases; of these,
    and of what an earlier text hides, those are found again that agree under one of the first ``again``: all of the
    equal ones, all but 14 % of those at the threshold.
    """

    words: int = 50
    shingle: int = 5
    percent: int = 75
    hashes: int = 6
    enough: int = 2
    again: int = 2
    seed: int = 9
    chunk_bytes: int = 8_000_000

    @property
    def run(self) -> int:
        return self.words - self.shingle + 1


def sliding_minimum(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n neighbours, from running minima to the end and to the beginning of blocks of n."""
    blocks = -(-len(x) // n)
    padded = np.full(blocks * n, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, n)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(x) - n + 1], ahead[n - 1 : len(x)])


def compact_windows(tokens: np.ndarray, starts: np.ndarray, run: int, a: np.uint64, b: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c, l and r of the compact windows that hold a run of ``run`` tokens, for texts that begin at ``starts``.

    Only places that are least in some run have such a window, and the nearest lesser places on both sides of one are
    of this kind too; so the tree is built over these places alone. Equal hashes count as rising from left to right.
    """
    empty = np.empty(0, np.int64)
    if len(tokens) < run:
        return empty, empty, empty
    bits = np.uint64(len(tokens).bit_length())
    low = np.arange(len(tokens), dtype=np.uint64)
    value = ((tokens * a + b) >> bits << bits) | low
    least = sliding_minimum(value, run)
    ends = np.append(starts[1:], len(tokens))
    whole = np.zeros(len(tokens) + 1, np.int64)
    fits = ends - starts >= run
    np.add.at(whole, starts[fits], 1)
    np.add.at(whole, ends[fits] - run + 1, -1)
    places = least[np.cumsum(whole)[: len(least)] > 0] & ((np.uint64(1) << bits) - np.uint64(1))
    chosen = np.zeros(len(tokens), bool)
    chosen[places.astype(np.int64)] = True
    c = np.flatnonzero(chosen)
    doc = np.searchsorted(starts, c, side="right") - 1
    left, right = _lesser(value[c], doc), len(c) - 1 - _lesser(value[c][::-1], doc[::-1])[::-1]
    first = np.where(left < 0, starts[doc], c[np.maximum(left, 0)] + 1)
    last = np.where(right >= len(c), ends[doc] - 1, c[np.minimum(right, len(c) - 1)] - 1)
    return c, first, last


def _lesser(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each value the place of the nearest lesser one before it in its text, its ancestor in the Cartesian tree; -1
    if there is none. All climb at once: whatever a place before has passed is greater than what passes that place."""
    at = np.arange(len(values)) - 1
    at[np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))[: len(at)]] = -1
    todo = np.flatnonzero(at >= 0)
    while len(todo):
        todo = todo[values[at[todo]] > values[todo]]
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
    return at


FIELDS = ("doc", "c", "sides")
BLOBS = "bucket bigint, keys binary, " + ", ".join(f"{f} binary" for f in FIELDS)
#: Links by hash functions or, with ``doc`` null, packed windows whose value and side several texts share.
PAIR = "doc bigint, hub bigint, hashes int, keys binary, docs binary, places binary"
_PAIR_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _windows(how: Passages, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    rng = np.random.default_rng(how.seed)
    a = rng.integers(0, 2**63, how.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, how.hashes, dtype=np.uint64)

    def chunk(ids: list[int], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts, tokens = np.cumsum(sizes) - sizes, np.concatenate(texts)
        of = np.array(ids, np.int64)
        parts = []
        half = how.run // 2
        spread = mixed(tokens)
        lows = [(sliding_minimum(spread, n) & np.uint64(0xFFFFFF), first, n) for first, n in ((1 - half, half - 1), (1, half))]
        for j in range(how.hashes):
            c, left, right = compact_windows(tokens, starts, how.run, a[j], b[j])
            doc = np.searchsorted(starts, c, side="right") - 1
            key = mixed(tokens[c] * a[j] + b[j]) >> np.uint64(3) << np.uint64(3) | np.uint64(j)
            # any run of the least length around c in its window holds the half run before or after it there; the least
            # token of a half stays the same where words are inserted or left out: 24 bits of each
            begin = starts[doc]
            sides = [low[np.clip(c + first, left, right + 1 - n)] for low, first, n in lows]
            parts.append((key, of[doc].view(np.uint64), (c - begin).view(np.uint64), sides[0] << np.uint64(24) | sides[1]))
        keys, *rest = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((rest[1], rest[0].view(np.int64), rest[-1], keys))
        keys, rest = keys[order], [x[order] for x in rest]
        # where several texts of a chunk agree in a window's value and sides, only the first goes on; it stands for them
        same = np.zeros(len(keys), bool)
        same[1:] = (keys[1:] == keys[:-1]) & (rest[-1][1:] == rest[-1][:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(keys))))
        linked = np.flatnonzero(same & (rest[0] != rest[0][head]))
        if len(linked):
            yield _blob(-1 - int(keys[linked[0]] >> np.uint64(40)), keys[linked], [*(x[linked] for x in rest), *(x[head[linked]] for x in rest[:2])])
        keys, rest = keys[~same], [x[~same] for x in rest]
        edges = bounds(keys, bits)
        for bucket in np.flatnonzero(np.diff(edges)):
            inside = slice(edges[bucket], edges[bucket + 1])
            yield _blob(int(bucket), keys[inside], [x[inside] for x in rest])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch["id"].to_pylist(), batch["text"]):
                data = text.as_py()
                tokens = shingle_prints(text_prints(data), how.shingle)
                if len(tokens) >= how.run:
                    ids.append(doc)
                    texts.append(tokens)
                    size += len(data)
                if size >= how.chunk_bytes:
                    yield from chunk(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield from chunk(ids, texts)

    return windows


def _blob(bucket: int, keys: np.ndarray, rest: list[np.ndarray]) -> pa.RecordBatch:
    """Windows of one bucket; those below 0 hold windows already linked, with the first text's fields at the end."""
    fields = rest[:3] if bucket >= 0 else [np.concatenate([x, y]) for x, y in zip(rest[:2], rest[3:])] + [rest[2]]
    return pa.RecordBatch.from_pydict({"bucket": [bucket], "keys": [pack_sorted(keys)]} | {f: [pack(x)] for f, x in zip(FIELDS, fields)})


def _pairs(doc: np.ndarray, hub: np.ndarray, keys: np.ndarray, shared: tuple[np.ndarray, np.ndarray, np.ndarray], again: int) -> pa.Table:
    """Each pair of texts once, with a bit for each hash function whose windows link them; then the windows (key, text,
    place) whose value and side several texts share."""
    order = np.lexsort((hub, doc))
    doc, hub, bit = doc[order], hub[order], np.int32(1) << (keys[order] & np.uint64(7)).astype(np.int32)
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (hub[1:] != hub[:-1]))[: len(doc)])
    hashes = np.bitwise_or.reduceat(bit, new) if len(new) else bit
    columns = [doc[new].view(np.int64).tolist(), hub[new].view(np.int64).tolist(), hashes.tolist(), *([None] * len(new) for _ in range(3))]
    shared = tuple(x[shared[0] & np.uint64(7) < again] for x in shared)
    if len(shared[0]):
        order = np.lexsort((shared[2], shared[1], shared[0]))
        same = np.append(False, np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in shared]))
        order = order[~same]
        for column, x in zip(columns, (None, None, None, pack_sorted(shared[0][order]), pack(shared[1][order]), pack(shared[2][order]))):
            column.append(x)
    return pa.table([pa.array(x, k) for x, k in zip(columns, _PAIR_KINDS)], [x.split()[0] for x in PAIR.split(", ")])


def _sided(keys: np.ndarray, sides: np.ndarray) -> list[np.ndarray]:
    """Of each window, its value with the least token of the side before it, and of the side behind; the last three bits
    still name the hash function."""
    halves = sides >> np.uint64(24), (sides & np.uint64(0xFFFFFF)) | np.uint64(1 << 24)
    return [mixed(keys ^ mixed(x + np.uint64(1))) >> np.uint64(3) << np.uint64(3) | keys & np.uint64(7) for x in halves]


def _linked(blobs: pa.Table, again: int) -> pa.Table:
    docs, places = ([np.split(unpack(x.as_py()), 2) for x in blobs[f]] for f in ("doc", "c"))
    (own, its), (c, its_c) = ([np.concatenate(x) for x in zip(*parts)] for parts in (docs, places))
    keys = np.concatenate([unpack_sorted(x.as_py()) for x in blobs["keys"]])
    sided = _sided(keys, np.concatenate([unpack(x.as_py()) for x in blobs["sides"]]))
    return _pairs(own, its, keys, tuple(np.concatenate(x) for x in (sided * 2, (own, own, its, its), (c, c, its_c, its_c))), again)


def _stars(blobs: pa.Table, again: int) -> pa.Table:
    """One bucket: every window is linked to the first text's that has its value and the same least token on one side,
    for either side."""
    if blobs["bucket"][0].as_py() < 0:
        return _linked(blobs, again)
    keys = np.concatenate([unpack_sorted(x.as_py()) for x in blobs["keys"]])
    doc, c, sides = (np.concatenate([unpack(x.as_py()) for x in blobs[f]]) for f in FIELDS)
    members, heads, shared = [], [], []
    for group in _sided(keys, sides):
        order = np.lexsort((c, doc.view(np.int64), group))
        k = group[order]
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        head = order[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))]
        other = doc[order] != doc[head]
        members.append(order[other])
        heads.append(head[other])
        several = np.zeros(len(k), bool)
        several[(np.cumsum(first) - 1)[other]] = True
        which = order[several[np.cumsum(first) - 1]]
        shared.append((group[which], doc[which], c[which]))
    links = np.unique(np.stack([np.concatenate(members), np.concatenate(heads)]), axis=1) if len(keys) else np.empty((2, 0), np.int64)
    m, h = links
    out = _pairs(doc[m], doc[h], keys[m], tuple(np.concatenate(x) for x in zip(*shared)), again)
    release()
    return out


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, docs, places in zip(*(batch[c] for c in ("keys", "docs", "places"))):
            keys = unpack_sorted(keys.as_py()).view(np.int64)
            yield pa.RecordBatch.from_pydict({"key": keys, "doc": unpack(docs.as_py()).view(np.int64), "place": unpack(places.as_py()).view(np.int64)})


AROUND = "key bigint, doc bigint, place bigint, open boolean, around binary"


def _around(how: Passages) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """16 bits of each token that a run of the least length over a window's place can hold, for each window of a text."""
    reach = how.run - 1

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text, windows in zip(batch["doc"].to_pylist(), batch["text"], batch["windows"]):
                tokens = mixed(shingle_prints(text_prints(text.as_py()), how.shingle))
                padded = np.zeros(len(tokens) + 2 * reach, "<u2")
                padded[reach : reach + len(tokens)] = tokens & np.uint64(0xFFFF)
                for key, place, is_open in {tuple(w.values()) for w in windows.as_py()}:
                    if place < len(tokens):  # else a window of another text with this id
                        for column, x in zip(out, (key, doc, place, is_open, padded[place : place + 2 * reach + 1].tobytes())):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], [x.split()[0] for x in AROUND.split(", ")])
        release()

    return around


#: Windows on one side of a square of one value.
SQUARE = 16_384
BEST = "key bigint, doc bigint, place bigint, hub bigint, shared int"


def _agreeing(doc: np.ndarray, side: np.ndarray, todo: np.ndarray, tokens: np.ndarray, i: int, j: int, how: Passages) -> Iterator[tuple[int, int, int]]:
    """For each window in ``todo`` the one of an earlier text, across the square, that shares most tokens of some run of
    the least length around it; with how many. ``tokens``: those around each window, 0 where the text ends.

    Who shares ``least`` tokens with a window shares one at least that isn't among its ``least - 1`` most frequent in
    the square: only these, mostly no one's, lead to others.
    """
    least = -(-how.percent * how.run // 100)
    ordered = np.sort(tokens, axis=1)
    counted = ordered > 0
    counted[:, 1:] &= ordered[:, 1:] != ordered[:, :-1]
    times = np.bincount(ordered[counted], minlength=1 << 16)
    frequent = np.where(counted, times[ordered], 0)
    todo = np.flatnonzero(todo & (np.partition(frequent, -least, axis=1)[:, -least] > 1))
    if not len(todo):
        return
    row, column = np.nonzero(counted & (frequent > 1))
    by_value = np.argsort(ordered[row, column], kind="stable")
    posted, values = row[by_value], ordered[row, column][by_value]
    width = tokens.shape[1]
    at = np.full(1 << 16, width)  # where a token stands around x; beyond the end if it doesn't
    for x in todo.tolist():
        own, n = ordered[x], frequent[x]
        rare = own[np.argsort(n)[: len(n) - least + 1]]
        rare = rare[(times[rare] > 1) & (rare > 0)]
        lo, hi = np.searchsorted(values, rare), np.searchsorted(values, rare, side="right")
        others = np.unique(np.concatenate([posted[a:b] for a, b in zip(lo, hi)])) if len(rare) else posted[:0]
        others = others[(doc[others] < doc[x]) & (side[others] == (j if side[x] == i else i))]
        if len(others):
            at[tokens[x][::-1]] = np.arange(width)[::-1]
            at[0] = width
            places = at[tokens[others]]
            at[own] = width
            both = np.zeros((2, len(others), width + 1), np.int32)
            both[0, np.arange(len(others))[:, None], places] = 1  # tokens of x, then tokens of the other
            both[1, :, :width] = places < width
            both[:, :, width] = 0
            total = np.cumsum(both, axis=2)
            total = np.concatenate([np.zeros((2, len(others), 1), np.int32), total[:, :, :width]], axis=2)
            shared = (total[:, :, how.run :] - total[:, :, : -how.run]).max(axis=(0, 2))
            top = np.lexsort((doc[others], -shared))[0]
            if shared[top] >= least:
                yield x, int(others[top]), int(shared[top])


def _best(how: Passages) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    width = 2 * how.run - 1
    names = ("key", "i", "j", "doc", "place", "side", "open")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key and square; for each open window the earlier text that agrees best, if one does enough."""
        held: list[np.ndarray] | None = None
        for batch in _and_end(batches):
            if batch is not None:
                new = [batch[c].to_numpy(zero_copy_only=False) for c in names]
                new.append(np.frombuffer(b"".join(batch["around"].to_pylist()), "<u2").reshape(-1, width))
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if held is None or not len(held[0]):
                continue
            changes = np.zeros(len(held[0]), bool)
            for x in held[:3]:
                changes[1:] |= x[1:] != x[:-1]
            edges = np.flatnonzero(changes)
            edges = np.concatenate([[0], edges, [len(changes)]] if batch is None else [[0], edges])
            out: list[tuple] = []
            for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
                key, i, j = (int(x[lo]) for x in held[:3])
                doc, place, side, todo, tokens = (x[lo:hi] for x in held[3:])
                if hi - lo > 1 and (todo & (doc > doc.min())).any():
                    out += [(key, int(doc[x]), int(place[x]), int(doc[y]), n) for x, y, n in _agreeing(doc, side, todo, tokens, i, j, how)]
            held = [x[edges[-1] :] for x in held]
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.int32()])], [x.split()[0] for x in BEST.split(", ")])
        release()

    return best


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _hidden_pairs(links: DataFrame, spans: DataFrame, texts: DataFrame, how: Passages) -> DataFrame:
    """Pairs of texts ``doc, hub`` to verify beside the stars: of each open window, the earlier text that agrees best.

    A window is open if several texts share its value and the least token of one side, and no verified passage of its
    text covers it. It is held against all windows of the value but those in exact copies of an earlier text's passage.
    """
    windows = links.where("doc is null").select("keys", "docs", "places").mapInArrow(_unpacked, "key bigint, doc bigint, place bigint")
    found = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "words", "similarity")).alias("spans"))
    over = F.filter("spans", lambda s: (s["start"] <= F.col("place")) & (F.col("place") + how.shingle <= s["start"] + s["words"]))
    best = F.array_max(F.transform(over, lambda s: s["similarity"]))
    windows = windows.join(found, "doc", "left").select("key", "doc", "place", best.alias("best"))
    # an exact copy stands behind the text it was copied from, which has the same value
    windows = cut(windows.where("best is null or best < 1").select("key", "doc", "place", F.isnull("best").alias("open")))
    values = windows.groupBy("key").agg(F.min("doc").alias("least"), F.max(F.when(F.col("open"), F.col("doc"))).alias("last"), F.ceil(F.count("*") / SQUARE).cast("int").alias("sides"))
    values = values.where("last > least").select("key", "sides")
    windows = spread_join(windows, values.select("key"), "key", "doc")
    of_text = windows.groupBy("doc").agg(F.collect_list(F.struct("key", "place", "open")).alias("windows"))
    around = of_text.join(texts.withColumnRenamed("id", "doc"), "doc").select("doc", "text", "windows").mapInArrow(_around(how), AROUND)
    members = spread_join(around, values, "key", "doc").withColumn("side", F.pmod(F.xxhash64("doc", "place"), F.col("sides")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    members = members.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", "sides")
    members = members.select("key", "i", "j", "doc", "place", "side", "open", "around").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    best = members.mapInArrow(_best(how), BEST)
    best = best.groupBy("key", "doc", "place").agg(F.max_by("hub", F.struct("shared", -F.col("hub"))).alias("hub"))
    return best.select("doc", "hub").distinct()


SPAN = "start bigint, words bigint, other_start bigint, other_words bigint, similarity double"


def _alike(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b))
    return common / max(1, len(np.unique(a)) + len(np.unique(b)) - common)


def _dense(shared: np.ndarray, how: Passages) -> list[tuple[int, int]]:
    """Stretches [s, e) made of runs of the least length in which enough places are shared, from the first shared place
    to the last."""
    total = np.zeros(len(shared) + 1, np.int32)
    np.cumsum(shared, out=total[1:])
    full = np.flatnonzero(total[how.run :] - total[: -how.run] >= -(-how.percent * how.run // 100))
    if not len(full):
        return []
    breaks = np.flatnonzero(full[1:] - full[:-1] > how.run).tolist()
    out = []
    for i, j in zip([-1, *breaks], [*breaks, len(full) - 1]):
        x, y = int(full[i + 1]), int(full[j]) + how.run
        inside = shared[x:y]
        out.append((x + int(inside.argmax()), y - int(inside[::-1].argmax())))
    return out


def _densest(shared: np.ndarray, n: int) -> int:
    total = np.append(0, np.cumsum(shared))
    return int((total[n:] - total[:-n]).argmax())


def _runs(tokens: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of each run of n tokens, from runs of powers of two."""
    out, size = tokens, 1
    while 2 * size <= n:
        out = mixed(out[:-size] * np.uint64(3) + out[size:])
        size *= 2
    return mixed(out[: len(out) - (n - size)] * np.uint64(5) + out[n - size :]) if n > size else out


class Words:
    """A text's words by fingerprint, its shingles, and these in order with their places."""

    def __init__(self, words: np.ndarray, how: Passages) -> None:
        self.words, self.shingles = words, shingle_prints(words, how.shingle)
        self.order = np.argsort(self.shingles)
        self.ordered = self.shingles[self.order]

    def places(self, shingles: np.ndarray) -> np.ndarray:
        """Where any of the shingles stand, in order."""
        wanted = np.unique(shingles)
        lo, hi = (np.searchsorted(self.ordered, wanted, side) for side in ("left", "right"))
        size = hi - lo
        return np.sort(self.order[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())])

    def has(self, shingles: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ordered, shingles)
        return self.ordered[np.minimum(at, len(self.ordered) - 1)] == shingles if len(self.ordered) else np.zeros(len(shingles), bool)


def _longest(x: np.ndarray) -> int:
    """Length of the longest run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], x, [False]])))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def spans_between(mine: np.ndarray, other: np.ndarray, how: Passages, its: Words | None = None) -> list[tuple[int, int, int, int, float]]:
    """Verified passages of ``mine`` (word fingerprints) that ``other`` has too: start, words, start and words there,
    similarity. ``its``: the other text prepared, if there are many texts to hold against it."""
    if len(mine) == len(other) and (mine == other).all():
        return [(0, len(mine), 0, len(other), 1.0)]
    its = its or Words(other, how)
    a, b = shingle_prints(mine, how.shingle), its.shingles
    known_there = its.has(a)
    if 100 * known_there.sum() < how.percent * how.run:
        return []
    # shared shingles by number, all others by one number that is never marked
    numbers = np.unique(a[known_there])
    numbered = lambda x: np.where(numbers[at := np.minimum(np.searchsorted(numbers, x), len(numbers) - 1)] == x, at, len(numbers))
    own_numbers, its_numbers, marks = numbered(a), numbered(b), np.zeros(len(numbers) + 1, bool)

    def within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of x are in y."""
        marks[y] = True
        marks[-1] = False
        out = marks[x]
        marks[y] = False
        return out
    found: list[tuple[int, int, int, int, float]] = []
    covered = np.zeros(len(a), bool)

    def verified(s: int, e: int, hs: int, he: int) -> bool:
        likeness = _alike(a[s:e], b[hs:he])
        if 100 * likeness < how.percent:
            return False
        found.append((s, e - s + how.shingle - 1, hs, he - hs + how.shingle - 1, likeness))
        covered[s:e] = True
        return True

    parts = [(0, len(a), 0, len(b))]
    while parts:
        s, e, hs, he = parts.pop()
        if e - s < how.run or he - hs < how.run or covered[s:e].all():
            continue
        if he - hs > 4 * (e - s):  # a long text: only the places near what is shared count
            at = its.places(a[s:e])
            at = at[(at >= hs) & (at < he)]
            ends = np.flatnonzero(np.diff(at) > how.run)
            near = [(int(at[x]), int(at[y]) + 1) for x, y in zip(np.append(0, ends + 1), np.append(ends, len(at) - 1))] if len(at) else []
            if near != [(hs, he)]:
                parts += [(s, e, x, y) for x, y in reversed(near)]
                continue
        both = within(own_numbers[s:e], its_numbers[hs:he])
        dense = _dense(both, how)
        if dense != [(0, e - s)]:
            parts += [(s + x, s + y, hs, he) for x, y in reversed(dense)]
            continue
        back = within(its_numbers[hs:he], own_numbers[s:e])
        dense = _dense(back, how)
        if dense != [(0, he - hs)]:
            parts += [(s, e, hs + x, hs + y) for x, y in reversed(dense)]
            continue
        if verified(s, e, hs, he):
            continue
        # the wider gap of the two sides parts the stretch; where nothing long enough is left, the best runs are tried
        at, there = np.flatnonzero(both), np.flatnonzero(back)
        gap, its_gap = int(np.diff(at).argmax()), int(np.diff(there).argmax())
        width, its_width = at[gap + 1] - at[gap], there[its_gap + 1] - there[its_gap]
        if max(width, its_width) > 1:
            if its_width > width:
                pieces = [(s, e, hs, hs + int(there[its_gap]) + 1), (s, e, hs + int(there[its_gap + 1]), he)]
            else:
                pieces = [(s, s + int(at[gap]) + 1, hs, he), (s + int(at[gap + 1]), e, hs, he)]
            pieces = [p for p in pieces if p[1] - p[0] >= how.run and p[3] - p[2] >= how.run]
            parts += reversed(pieces)
            if pieces:
                continue
        x = s + _densest(both, how.run)
        y = hs + _densest(within(its_numbers[hs:he], own_numbers[x : x + how.run]), how.run)
        verified(x, x + how.run, y, y + how.run)
    # equal runs in what is left
    if min(len(a), len(b)) < how.run or _longest(known_there) < how.run or covered[known_there].all():
        return found
    runs, its_runs = _runs(a, how.run), _runs(b, how.run)
    known, first = np.unique(its_runs, return_index=True)
    place = np.minimum(np.searchsorted(known, runs), len(known) - 1)
    for x in np.flatnonzero(known[place] == runs).tolist():
        if covered[x : x + how.run].all():
            continue
        y = int(first[place[x]])
        n, m = min(len(mine) - x, len(other) - y), min(x, y)
        ahead = mine[x : x + n] != other[y : y + n]
        behind = mine[x - m : x][::-1] != other[y - m : y][::-1]
        fore = int(ahead.argmax()) if ahead.any() else n
        aft = int(behind.argmax()) if behind.any() else m
        if fore + aft >= how.words:
            found.append((x - aft, fore + aft, y - aft, fore + aft, 1.0))
            covered[x - aft : x + fore - how.shingle + 1] = True
    return found


def _verify(how: Passages) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ("doc", "print", "hub", "start", "words", "other_start", "other_words", "similarity")
    kinds = [pa.int64()] * 7 + [pa.float64()]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by hub and chunk, the hub's own text first."""
        at, hubs = None, []
        for batch in batches:
            rows = []
            for hub, chunk, role, doc, own_print, text in zip(*(batch[c].to_pylist() for c in ("hub", "chunk", "role", "id", "print")), batch["text"]):
                own = text_prints(text.as_py())
                if at != (hub, chunk):
                    at, hubs = (hub, chunk), []
                if role == 0:
                    hubs.append(Words(own, how))
                    continue
                for held in hubs:
                    rows += [(doc, own_print, hub, *span) for span in spans_between(own, held.words, how, held)]
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], list(names))
        release()

    return verify


def _verified(pairs: DataFrame, texts: DataFrame, how: Passages) -> DataFrame:
    """The passages of the pairs ``doc, hub``. A hub with many partners is dealt out in chunks with a copy of its text
    each."""
    times = pairs.groupBy("hub").agg(F.count("*").alias("times"))
    chunk = F.pmod(F.xxhash64("id"), F.floor(F.col("times") / 64) + 1).alias("chunk")
    members = spread_join(pairs.withColumnRenamed("doc", "id"), times, "hub", "id").select("id", "hub", chunk, F.lit(1).alias("role"))
    hubs = members.select(F.col("hub").alias("id"), "hub", "chunk", F.lit(0).alias("role")).distinct()
    rows = members.unionByName(hubs).join(texts, "id").repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "role")
    return rows.mapInArrow(_verify(how), f"doc bigint, print bigint, hub bigint, {SPAN}")


def _found(docs: DataFrame, how: Passages, doc_id: str, text: str) -> DataFrame:
    """``doc, print, hub`` and a span: every verified passage, with a fingerprint of the text that has it."""
    texts = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("binary").alias("text")).where("id is not null and text is not null")
    texts = texts.withColumn("print", F.xxhash64("text"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(0, (n_bytes // 6 * 2 * how.hashes // how.run // 100_000).bit_length())
    links = cut(texts.mapInArrow(_windows(how, bits), BLOBS).groupBy("bucket").applyInArrow(lambda blobs: _stars(blobs, how.again), PAIR))
    pairs = links.where("doc is not null").groupBy("doc", "hub").agg(F.bit_or("hashes").alias("hashes"))
    pairs = cut(pairs.where(F.bit_count("hashes") >= how.enough).select("doc", "hub"))
    spans = cut(_verified(pairs, texts, how))
    more = cut(_hidden_pairs(links, spans, texts, how).join(pairs, ["doc", "hub"], "left_anti"))
    return spans.unionByName(_verified(more, texts, how))


def repeated_passages(docs: DataFrame, how: Passages = Passages(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per passage that a document shares with an earlier one (by id): ``doc_id``, ``start`` and ``words`` (in
    words of the text, from 0), ``other_id``, ``other_start``, ``other_words``, ``similarity``.

    Words are lower-cased (A-Z). Ids are cast to bigint. A passage of at least 50 words that an earlier document has,
    or one like it, is reported with one such document at least; the first one is only ever ``other_id``. Null, empty
    and short texts and null ids take no part; repeats inside one text, or between rows that share an id, aren't
    reported; other columns are left out; an empty table gives an empty result.
    """
    spans = _found(docs, how, doc_id, text).drop("print").distinct()
    return spans.select(F.col("doc").alias(doc_id), "start", "words", F.col("hub").alias("other_id"), "other_start", "other_words", "similarity")


def _cut_out(text: str | None, spans: list | None) -> str | None:
    """The text without the words of the spans; what stands between two kept words stays as it was."""
    if not text or not spans:
        return text
    data = text.encode()
    words = data.split()
    gone = np.zeros(len(words), bool)
    for span in spans:
        gone[span["start"] : span["start"] + span["words"]] = True
    out, at = [], 0
    for word, drop in zip(words, gone):
        begin = data.index(word, at)
        if not drop:
            out.append(data[at : begin + len(word)])
        at = begin + len(word)
    return b"".join(out).decode()


def without_repeats(docs: DataFrame, how: Passages = Passages(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every passage cut out that an earlier document has; a document of which no word is left goes.

    Spans go to the rows that have both the id and the text that they were found in, so rows that share an id lose only
    what is theirs. Documents without such a passage, and rows with a null id or text, stay as they are.
    """
    spans = _found(docs, how, doc_id, text).groupBy(F.col("doc").alias("passage doc"), F.col("print").alias("passage print"))
    spans = spans.agg(F.collect_set(F.struct("start", "words")).alias("passage spans"))

    @F.arrow_udf("string")
    def edited(texts: pa.Array, gone: pa.Array) -> pa.Array:
        return pa.array((_cut_out(t.as_py(), s.as_py()) if s.is_valid else t.as_py() for t, s in zip(texts, gone)), pa.string())

    here = (docs[doc_id].cast("bigint") == F.col("passage doc")) & (F.xxhash64(F.col(text).cast("binary")) == F.col("passage print"))
    joined = docs.join(spans, here, "left")
    joined = joined.withColumn(text, edited(F.col(text), F.col("passage spans")))
    left = F.col("passage spans").isNull() | F.regexp_like(F.col(text), F.lit(r"[^\x20\x09-\x0D]"))
    return joined.where(left).select(docs.columns)
