"""Language identification by prediction by partial matching.

For each language, byte contexts of up to ``ORDER`` bytes form a tree with counts. The code length of a byte is that of
its share among the bytes seen after the longest known context (method C: n / (total + kinds)), plus one escape
(kinds / (total + kinds)) for each longer context that doesn't know the byte; below the empty context all 256 bytes
are alike. The statistics are frozen after training, so a text's exact code length in every language is a sum of
entries that are worked out beforehand, one per position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ragged

ORDER = 3
#: What stands before a text's first byte.
BEFORE = b"\n" * ORDER
#: Bounds of the training sample: bytes of text per language, about, in windows drawn from all training texts.
SAMPLE_BYTES, WINDOW = 2_000_000, 4096

LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """``child[k][node * width + symbol]`` is the node for a run of k + 1 bytes, the level's last entry standing for
    all unknown ones; ``cost`` and ``escape`` hold bits per language for a run's last byte and for leaving a context."""

    langs: list[str]
    symbol: np.ndarray
    width: int
    child: list[np.ndarray]
    cost: list[np.ndarray]
    escape: list[np.ndarray]
    escape_root: np.ndarray

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each (non-empty) text in each language."""
        out = np.empty((len(texts), len(self.langs)))
        begin = 0
        while begin < len(texts):  # runs that stay in the cache
            end, n = begin, 0
            while end < len(texts) and (end == begin or n + len(texts[end]) <= 100_000):
                n += len(texts[end]) + ORDER
                end += 1
            out[begin:end] = self._bits(texts[begin:end])
            begin = end
        return out

    def _bits(self, texts: list[bytes]) -> np.ndarray:
        data, starts = ragged([np.frombuffer(BEFORE + t, np.uint8) for t in texts], np.uint8)
        symbols = self.symbol[data]
        own = np.ones(len(data), bool)
        for i in range(ORDER):
            own[starts + i] = False
        nodes = [self.child[0][symbols]]
        for k in range(1, ORDER + 1):
            node = np.full(len(data), len(self.cost[k][0]) - 1, np.int64)
            node[1:] = self.child[k][nodes[-1][:-1] * self.width + symbols[1:]]
            nodes.append(node)
        rare = np.flatnonzero(own & (nodes[ORDER] == len(self.cost[ORDER][0]) - 1))
        out = np.empty((len(texts), len(self.langs)))
        for lang in range(len(self.langs)):
            bits = np.where(own, self.cost[ORDER][lang][nodes[ORDER]], 0.0)
            bits[rare] = self._shorter(rare, nodes, lang)
            out[:, lang] = np.add.reduceat(bits, starts)
        return out

    def _shorter(self, at: np.ndarray, nodes: list[np.ndarray], lang: int) -> np.ndarray:
        """Bits where no language knows the longest run: escapes down to the longest one that some language knows."""
        total, todo = np.zeros(len(at)), np.ones(len(at), bool)
        for k in range(ORDER, -1, -1):
            node = nodes[k][at]
            known = todo & (node < len(self.cost[k][lang]) - 1)
            total[known] += self.cost[k][lang][node[known]]
            todo &= ~known
            total[todo] += self.escape[k - 1][lang][nodes[k - 1][at[todo] - 1]] if k else self.escape_root[lang] + 8.0
        return total



def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The frozen trees, from each language's counts of runs of ORDER + 1 bytes (as big-endian numbers)."""
    langs = sorted(counts)
    runs = np.unique(np.concatenate([codes for codes, _ in counts.values()]))
    full = np.zeros((len(langs), len(runs)))
    for i, lang in enumerate(langs):
        full[i, np.searchsorted(runs, counts[lang][0])] = counts[lang][1]
    # levels[k]: runs of k + 1 bytes: longer ones without their last byte (contexts) or without their first, which
    # alone have counts
    levels, tables = [runs], [full]
    for k in range(ORDER - 1, -1, -1):
        shorter = np.unique(np.concatenate([levels[0] >> 8, levels[0] & ((1 << 8 * (k + 1)) - 1)]))
        inverse = np.searchsorted(shorter, levels[0] & ((1 << 8 * (k + 1)) - 1))
        table = np.zeros((len(langs), len(shorter)))
        for i in range(len(langs)):
            table[i] = np.bincount(inverse, weights=tables[0][i], minlength=len(shorter))
        levels.insert(0, shorter)
        tables.insert(0, table)
    symbol = np.zeros(256, np.int64)
    symbol[levels[0]] = np.arange(1, len(levels[0]) + 1)
    width = len(levels[0]) + 1
    child, cost, escape = [], [], []
    total, kinds = tables[0].sum(axis=1), (tables[0] > 0).sum(axis=1)
    escape_root = -np.log2(kinds / (total + kinds))
    for k, (codes, table) in enumerate(zip(levels, tables)):
        last = symbol[codes & 255]
        if k == 0:
            parent, at = np.zeros(len(codes), np.int64), np.full(width, len(codes), np.int64)
            n, q = total[:, None], kinds[:, None]
            shorter_cost, leaving = np.full(table.shape, 8.0), np.broadcast_to(escape_root[:, None], table.shape)
        else:
            parent = np.searchsorted(levels[k - 1], codes >> 8)
            at = np.full((len(levels[k - 1]) + 1) * width, len(codes), np.int64)
            follow = np.zeros((len(langs), len(levels[k - 1])))
            followers = np.zeros_like(follow)
            for i in range(len(langs)):
                follow[i] = np.bincount(parent, weights=table[i], minlength=follow.shape[1])
                followers[i] = np.bincount(parent, weights=table[i] > 0, minlength=follow.shape[1])
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = np.where(follow > 0, -np.log2(followers / (follow + followers)), 0.0)
            escape.append(np.append(leave, np.zeros((len(langs), 1)), axis=1))
            n, q, leaving = follow[:, parent], followers[:, parent], leave[:, parent]
            shorter_cost = cost[-1][:, np.searchsorted(levels[k - 1], codes & ((1 << 8 * k) - 1))]
        at[parent * width + last] = np.arange(len(codes))
        child.append(at)
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = np.where(table > 0, -np.log2(table / (n + q)), leaving + shorter_cost)
        cost.append(np.append(bits, np.zeros((len(langs), 1)), axis=1))
    return Model(langs, symbol, width, child, cost, escape, escape_root)


def _windows(text: bytes, share: float, seed: int) -> Iterator[bytes]:
    """The text's sampled windows, each after the bytes that precede it."""
    own = xxhash.xxh3_64_intdigest(text, seed)
    for i in range(0, len(text), WINDOW):
        if share >= 1 or xxhash.xxh3_64_intdigest(i.to_bytes(8, "little"), own) < share * 2.0**64:
            yield (BEFORE + text)[i : i + ORDER + WINDOW]


def _count(shares: dict[str, float], seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sampled: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                for window in _windows(text.as_py(), shares[lang], seed):
                    b = np.frombuffer(window, np.uint8).astype(np.int64)
                    code = b[ORDER:].copy()
                    for j in range(1, ORDER + 1):
                        code |= b[ORDER - j : len(b) - j] << (8 * j)
                    sampled.setdefault(lang, []).append(code)
            for lang, parts in sampled.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(codes), "run": codes, "n": n})

    return count


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES, seed: int = 3) -> Model | None:
    """A model of the languages in ``docs``; None if no row has both a text and a language.

    It learns from a bounded sample, about ``sample_bytes`` of text per language in windows of 4096 bytes that a hash
    draws from all of a language's texts; what reaches the driver is bounded by the sample.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text")).where("lang is not null and length(text) > 0")
    shares = {r["lang"]: sample_bytes / r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    if not shares:
        return None
    counted = rows.mapInArrow(_count(shares, seed), "lang string, run bigint, n bigint").groupBy("lang", "run").agg(F.sum("n").alias("n")).toArrow()
    counts = {}
    langs = np.array(counted["lang"].to_pylist(), object)
    for name in shares:
        own = langs == name
        if own.any():
            codes = counted["run"].to_numpy()[own]
            order = np.argsort(codes)
            counts[name] = codes[order], counted["n"].to_numpy()[own][order].astype(float)
    return build(counts) if counts else None


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the language of the shortest code and its posterior probability.

    A null text or one without a letter gets ``und`` and 0, as does every text if there is no model; equal code
    lengths go to the first language by name. Texts of any length are read whole; equal texts get equal answers;
    columns of these names are replaced; an empty table stays empty.
    """
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        found = [t.as_py() for t in texts]
        rows = [{"lang_pred": "und", "score": 0.0} for _ in found]
        known = [i for i, t in enumerate(found) if model and t and LETTER.search(t)]
        if known:
            bits = model.bits([found[i].encode() for i in known])
            ahead = np.exp2(bits.min(axis=1, keepdims=True) - bits)
            for i, best, row in zip(known, bits.argmin(axis=1), ahead):
                rows[i] = {"lang_pred": model.langs[best], "score": float(row[best] / row.sum())}
        return pa.array(rows, kind)

    spare = next(f"predicted{i}" for i in range(len(docs.columns) + 1) if f"predicted{i}" not in docs.columns)
    out = docs.withColumn(spare, predict(F.col(text)))
    return out.withColumns({"lang_pred": F.col(f"{spare}.lang_pred"), "score": F.col(f"{spare}.score")}).drop(spare)


def fit_identify(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the rows where ``learn`` is true, then identify every row."""
    return identify(docs, train(docs.where(learn), text, lang), text)
