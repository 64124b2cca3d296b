"""Scores under a smoothed n-gram model, kept as a weighted backoff automaton.

A state is a context seen in training. It has an arc for each token seen after it, with the weight
``log10((1 - e) * c(context, token) / c(context) + e * p)``, where p is the token's probability in the next shorter
context, and a failure arc to that context with the weight ``log10(e)``. e is the share of the context's class (contexts
seen about as often) that training itself would have escaped from, had each token been left out once: tokens seen once
after their context, among all tokens after contexts of the class. So a context seen once promises nothing, and the
weights of each state sum to 1. The root gives ``(c + 1) / (N + V + 1)``.

The automaton grows with the corpus, so no machine holds all of it. Texts are dealt into chunks of bounded size; each
chunk asks, one order after another, for the counts of the n-grams that its texts run through and that can occur
elsewhere, which are summed over all chunks by fingerprint, and so gets the part of the automaton that its texts can
reach. One left-to-right traversal then carries the state from token to token, down failure arcs where a state has no
arc, and adds up the weights.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _M1, all_prints, bounds, cut, mixed, numbered, numbered_codes, pack, pack_sorted, release, unpack, unpack_sorted

#: Marks before the first and after the last word; no word holds a blank.
START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" start", b" end"))
#: Bytes of text in a chunk, and n-grams that meet in one bucket, about.
CHUNK_BYTES, BUCKET_ENTRIES = 8_000_000, 2_000_000
#: Tokens that one lane of the traversal scores; a lane first reads the few tokens before them to find its state.
LANE = 256


def context_class(count: np.ndarray) -> np.ndarray:
    """0 for 1, 1 for 2, 2 for 3 and 4, 3 for 5 to 8, and so on."""
    return np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)


class Chunk:
    """The n-grams of some texts: which one ends at each position, for each order, and how often training has them."""

    def __init__(self, texts: pa.Array | list[bytes | None], train: np.ndarray) -> None:
        inner, sizes = all_prints(pa.array(texts, pa.large_binary()) if isinstance(texts, list) else texts)
        sizes = sizes + 2
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        words, within = np.empty(sizes.sum(), np.uint64), np.ones(sizes.sum(), bool)
        words[self.starts], words[ends - 1] = START, END
        within[self.starts] = within[ends - 1] = False
        words[within] = inner
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        self.place = (np.arange(len(words)) - np.repeat(self.starts, sizes)).astype(np.int32)
        self.train = train.astype(bool)[self.doc]
        keys, own = numbered(words)
        self.prints, self.entry = [keys], [own]
        #: Of each n-gram: its context, its last token, and itself without its first token.
        self.context, self.token, self.suffix = [None], [np.arange(len(keys))], [None]
        self.own = [np.bincount(own[self.train], minlength=len(keys))]
        self.counts: list[np.ndarray] = []
        self.asked: list[np.ndarray] = [np.argsort(keys)]

    def longer(self) -> None:
        """The n-grams of the next order. Where training has the context, or the n-gram without its first token, in
        this chunk alone, this chunk's count of the n-gram is the whole count; the others are asked for."""
        k = len(self.entry)
        at = np.flatnonzero(self.place >= k)
        bits, context_bits = (len(self.prints[i]).bit_length() for i in (0, k - 1))
        code = self.entry[k - 1][at - 1].astype(np.int64) << bits | self.entry[0][at]
        codes, own, places = numbered_codes(code, bits + context_bits)
        context, token = codes >> bits, codes & (2**bits - 1)
        suffix = self.entry[k - 1][at[places]]
        entry = np.full(len(self.place), -1, np.int32)
        entry[at] = own
        counts, local = self.counts[k - 1], self.own[k - 1]
        elsewhere = (counts[context] > local[context]) & (counts[suffix] > local[suffix])
        prints = mixed(self.prints[k - 1][context] * _M1 + self.prints[0][token])
        asked = np.flatnonzero(elsewhere)
        self.asked.append(asked[np.argsort(prints[asked])])
        self.own.append(np.bincount(own[self.train[at]], minlength=len(codes)))
        for held, new in ((self.prints, prints), (self.entry, entry), (self.context, context), (self.token, token), (self.suffix, suffix)):
            held.append(new)

    def learn(self, answers: pa.Table | None) -> None:
        """Take the answers of the highest order so far: the counts of what was asked for, in that order."""
        counts = self.own[-1].copy()
        if answers is not None and answers.num_rows:
            order = np.argsort(answers["bucket"].to_numpy())
            counts[self.asked[-1]] = np.concatenate([unpack(answers["counts"][int(i)].as_py()) for i in order]).astype(np.int64)
        self.counts.append(counts)

    def settled(self) -> np.ndarray:
        """Which n-grams of the highest order training has in this chunk alone."""
        alone = self.own[-1] > 0
        alone[self.asked[-1]] = False
        return np.flatnonzero(alone)

    def classes(self, which: np.ndarray) -> np.ndarray:
        """Of n-grams of the highest order, before their counts are known, the class of their context."""
        return context_class(self.counts[-1][self.context[-1][which]])

    def weights(self, n: int, v: int, escapes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per order, log10 of each n-gram's probability after its context, and of leaving it as a context."""
        p = (self.counts[0] + 1) / (n + v + 1)
        arcs, fails = [np.log10(p)], []
        for k in range(1, len(self.entry)):
            leave = escapes[k - 1][context_class(self.counts[k - 1])]
            fails.append(np.log10(leave))
            c = self.counts[k - 1][self.context[k]]
            e = leave[self.context[k]]
            p = np.where(c > 0, (1 - e) * self.counts[k] / np.maximum(c, 1) + e * p[self.suffix[k]], p[self.suffix[k]])
            arcs.append(np.log10(p))
        return arcs, fails

    def traverse(self, n: int, v: int, escapes: np.ndarray, lane: int = LANE) -> np.ndarray:
        """Per text: log10 of its probability under the automaton.

        All texts are read at once, cut into lanes. A state is known by the number of tokens of its context, which end
        before the place it stands at. The last tokens alone decide the state, so a lane that begins inside a text
        finds it by reading the few tokens before its own from the root.
        """
        arcs, fails = self.weights(n, v, escapes)
        order = len(arcs)
        ends = np.append(self.starts[1:], len(self.place))
        lanes = -(-(ends - self.starts - 1) // lane)
        begins = np.repeat(self.starts + 1, lanes) + lane * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stops = np.minimum(begins + lane, np.repeat(ends, lanes))
        at = np.maximum(begins - order + 1, np.repeat(self.starts + 1, lanes))
        first = at == np.repeat(self.starts + 1, lanes)
        state = np.where(first & (self.counts[0][self.entry[0][at - 1]] > 0) & (order > 1), 1, 0)
        total = np.zeros(len(at))
        live = np.arange(len(at))
        while len(live):
            i, k, weight = at[live], state[live], np.zeros(len(live))
            for length in range(order - 1, 0, -1):
                here = np.flatnonzero(k == length)
                failed = here[self.counts[length][self.entry[length][i[here]]] == 0]
                weight[failed] += fails[length - 1][self.entry[length - 1][i[failed] - 1]]
                k[failed] -= 1
            for length in range(order):
                here = np.flatnonzero(k == length)
                weight[here] += arcs[length][self.entry[length][i[here]]]
            known = self.counts[0][self.entry[0][i]] > 0
            state[live] = np.where(known, np.minimum(k + 1, order - 1), 0)
            total[live] += np.where(i >= begins[live], weight, 0.0)
            at[live] += 1
            live = live[at[live] < stops[live]]
        return np.add.reduceat(total, np.cumsum(lanes) - lanes) if len(lanes) else total

    def base(self, n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: base score, tokens, known tokens."""
        is_token, c = self.place > 0, self.counts[0][self.entry[0]]
        parts = np.where(is_token, np.log10((c + 1) / (n + v + 1)), 0.0), is_token.astype(np.int64), (is_token & (c > 0)).astype(np.int64)
        return tuple(np.add.reduceat(x, self.starts) if len(self.starts) else x for x in parts)


ASKED = "bucket bigint, chunk bigint, keys binary, counts binary, classes binary"
#: Counts for a chunk, or (chunk -1) what a bucket adds to a class of contexts: tokens, and tokens seen once there.
ANSWER = "level int, chunk bigint, bucket bigint, counts binary, class int, n bigint, once bigint"


def _rebuilt(docs: pa.Table, answers: pa.Table | None, level: int) -> Chunk:
    """A chunk with its n-grams up to ``level``, and the counts of the orders before."""
    chunk = Chunk(docs["text"].cast(pa.large_binary()).combine_chunks(), docs["train"].to_numpy())
    for k in range(level):
        chunk.learn(answers.filter(pc.equal(answers["level"], k)))
        chunk.longer()
    return chunk


def _ask(level: int, bits: int) -> Callable[..., pa.Table]:
    def ask(docs: pa.Table, answers: pa.Table | None) -> pa.Table:
        chunk, number = _rebuilt(docs, answers, level), docs["chunk"][0].as_py()
        asked = chunk.asked[-1]
        keys, counts = chunk.prints[-1][asked], chunk.own[-1][asked]
        classes = chunk.classes(asked) if level else np.zeros(len(asked), np.int64)
        edges = bounds(keys, bits)
        rows = [
            (int(b), number, pack_sorted(keys[edges[b] : edges[b + 1]]), *(pack(x[edges[b] : edges[b + 1]]) for x in (counts, classes)))
            for b in np.flatnonzero(np.diff(edges))
        ]
        if level and len(alone := chunk.settled()):
            kinds, own = chunk.classes(alone), chunk.own[-1][alone]
            rows.append((-1 - number % 64, number, pack(np.bincount(kinds, weights=own).astype(np.uint64)), pack(np.bincount(kinds, weights=own == 1).astype(np.uint64)), b""))
        del chunk
        release()
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, _ASKED_KINDS)], _ASKED_NAMES)

    return ask if level else lambda docs: ask(docs, None)


_ASKED_NAMES, _ASKED_KINDS = [x.split()[0] for x in ASKED.split(", ")], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_ANSWER_NAMES = [x.split()[0] for x in ANSWER.split(", ")]
_ANSWER_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]


def _answer(level: int) -> Callable[[pa.Table], pa.Table]:
    def answer(asked: pa.Table) -> pa.Table:
        """One bucket: the sum of each key's counts, sent back to every chunk that asked, in the order of its keys."""
        bucket, rows = asked["bucket"][0].as_py(), []
        if bucket < 0:
            for row in asked.to_pylist():
                rows += [(level, -1, bucket, None, c, int(n), int(once)) for c, (n, once) in enumerate(zip(unpack(row["keys"]), unpack(row["counts"])))]
        else:
            keys = [unpack_sorted(x.as_py()) for x in asked["keys"]]
            own = np.concatenate([unpack(x.as_py()) for x in asked["counts"]]).astype(np.int64)
            found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(inverse, weights=own, minlength=len(found)).astype(np.int64)
            classes = np.zeros(len(found), np.int64)
            classes[inverse] = np.concatenate([unpack(x.as_py()) for x in asked["classes"]]).astype(np.int64)
            real = (sums > 0) & (found != START) if not level else sums > 0
            n, once = (np.bincount(classes[real], weights=x[real], minlength=1) for x in (sums, sums == 1 if level else real))
            rows = [(level, -1, bucket, None, c, int(n[c]), int(once[c])) for c in np.flatnonzero(n)]
            ends = np.cumsum([len(k) for k in keys])
            rows += [(level, c, bucket, pack(sums[inverse[e - len(k) : e]]), None, None, None) for c, k, e in zip(asked["chunk"].to_pylist(), keys, ends)]
        release()
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 7, _ANSWER_KINDS)], _ANSWER_NAMES)

    return answer


def score_texts(docs: DataFrame, train: Column, order: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows where ``train`` is true. Tokens are words, A-Z lower-cased, then one end; a null or
    empty text is its end alone. With no training rows, N and V are 0 and every token has probability 1. Words and
    n-grams are told apart by 64-bit fingerprints. Equal rows get equal scores, and meet in one chunk; other columns
    are left out; an empty table gives an empty result. ``order`` is the longest n-gram's length. ``docs`` is read once
    for each order and once to score.
    """
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(1, -(-n_bytes // CHUNK_BYTES))
    bits = max(0, (n_bytes // 6 // BUCKET_ENTRIES).bit_length())
    dealt = texts.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks))).repartition(chunks, "chunk").groupBy("chunk")

    answers, classes = None, []
    for level in range(order):
        known = answers.where("chunk >= 0").select("level", "chunk", "bucket", "counts") if level else None
        asked = dealt.cogroup(known.groupBy("chunk")).applyInArrow(_ask(level, bits), ASKED) if level else dealt.applyInArrow(_ask(level, bits), ASKED)
        found = cut(asked.groupBy("bucket").applyInArrow(_answer(level), ANSWER))
        classes.append({r["class"]: (r["n"], r["once"]) for r in found.where("chunk < 0").groupBy("class").agg(F.sum("n").alias("n"), F.sum("once").alias("once")).collect()})
        answers = answers.unionByName(found) if level else found
    n, v = classes[0].get(0, (0, 0))
    escapes = np.full((order, 64), 0.5)
    for k, own in enumerate(classes[1:]):
        for c, (tokens, once) in own.items():
            escapes[k, c] = (once + 1) / (tokens + 2)

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _rebuilt(docs, answers, order - 1)
        chunk.learn(answers.filter(pc.equal(answers["level"], order - 1)))
        base, sizes, known = chunk.base(n, v)
        out = pa.table({"id": docs["id"], "n_tokens": sizes, "n_known": known, "train_tokens": np.full(len(sizes), n), "base_score": base, "score": chunk.traverse(n, v, escapes)})
        del chunk
        release()
        return out

    kind = dict(texts.dtypes)["id"]
    known = answers.where("chunk >= 0").select("level", "chunk", "bucket", "counts")
    scored = dealt.cogroup(known.groupBy("chunk")).applyInArrow(score, f"id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return scored.withColumnRenamed("id", doc_id)
