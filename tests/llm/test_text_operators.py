"""Token counts, packing, quality rules, language id and LM scores against direct computation."""

import math
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmill.llm import bpe, common, langid, lm, packing, quality, tokens
from trailmill.llm.common import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


def library(name):
    return tokenizers.Tokenizer.from_file(tokenizer_path(name))


def spec(name):
    with open(tokenizer_path(name), encoding="utf-8") as f:
        return f.read()


COUNTER = bpe.TokenCounter(spec("byte_bpe_50k.json"), bpe.ByteBpe(spec("byte_bpe_50k.json")).whole_tokens())
IDS = bpe.WordIds(spec("word_bpe_49k.json"))
COUNTS, WORDS = library("byte_bpe_50k.json"), library("word_bpe_49k.json")


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("abc 'sß\n\té1  ́")))))
def test_tokenizers_agree(text):
    assert COUNTER.count(text) == len(COUNTS.encode(text, add_special_tokens=False).ids)
    assert list(np.frombuffer(IDS.encode(text), "<u4")) == WORDS.encode(text, add_special_tokens=False).ids


def test_whole_tokens_are_proven():
    for text in COUNTER.whole[::500]:
        assert len(COUNTS.encode(text, add_special_tokens=False).ids) == 1 or len(COUNTS.pre_tokenizer.pre_tokenize_str(text)) > 1


def test_token_counts(docs, rows, empty):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(docs, limit=100).collect())
    n = [len(COUNTS.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    assert got == Counter((r[0], len((r[1] or "").encode()), k, k > 100) for r, k in zip(rows, n))
    assert tokens.count_tokens(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=14))
def test_packing_is_optimal(lengths):
    counts = np.bincount(lengths, minlength=21)
    patterns = packing.solve(counts, tries=50_000)
    used = np.zeros(21, int)
    for n, items in patterns:
        assert sum(length * m for length, m in items) <= 20
        for length, m in items:
            used[length] += n * m
    assert (used == counts).all()

    def fits(left, bins):
        if not left:
            return True
        seen = set()
        for i, room in enumerate(bins):
            if room >= left[0] and room not in seen:
                seen.add(room)
                if fits(left[1:], bins[:i] + [room - left[0]] + bins[i + 1 :]):
                    return True
        return False

    n = sum(p[0] for p in patterns)
    assert packing.lower_bound(counts) <= n and (n == 1 or not fits(sorted(lengths, reverse=True), [20] * (n - 1)))


def test_pack(docs, rows, empty):
    got = packing.pack(docs, capacity=512).collect()
    want = Counter()
    for r in rows:
        ids = WORDS.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 512):
            part = np.array(ids[k : k + 512], "<u4").tobytes()
            want[r[0], k // 512, k, len(part) // 4, zlib.crc32(part), part] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 512
    assert len(sequences) == packing.lower_bound(np.bincount([r["length"] for r in got], minlength=513))
    assert packing.pack(empty).count() == 0


def slow_repeats(text):
    words = text.encode().split()
    windows = Counter(zip(words, words[1:], words[2:]))
    return len({i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)})


def test_quality(docs, rows, empty):
    got = {}
    for r in quality.judge(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for doc_id, text, *_ in rows:
        if doc_id in (None, 3, 5):
            continue
        (r,), words = got[doc_id], (text or "").encode().split()
        repeats = slow_repeats(text or "")
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        assert r["n_words"] == len(words) and r["n_repeat_words"] == repeats and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["word_chars"] == sum(len(w.decode()) for w in words)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["base_failed"] == (len(words) < 50 or 100 * repeats > 50 * len(words)) and (not r["kept"] or not r["base_failed"])
    assert quality.judge(empty).count() == 0 and quality.keep(docs).columns == docs.columns


def test_divergence():
    p, q = np.array([1.0, 1, 0]), np.array([0, 0, 1.0])
    assert quality.js_distance(p, p) == 0 and abs(quality.js_distance(p, q) - 1) < 1e-12
    assert quality.repeat_words(b"a b c a b c x".split()) == 6 and quality.repeat_words(b"a a a a".split()) == 4


def test_quality_reference_finds_strange_texts(spark):
    import random

    rng = random.Random(3)
    common = "the of and to in that is was for on with as by at from".split()
    plain = lambda: " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("aeiounrst", k=6)) for _ in range(90))
    texts = [plain() for _ in range(60)] + [" ".join(f"{rng.randrange(10**8)}$$$" for _ in range(90))]
    judged = quality.judge(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string"))
    assert [r["doc_id"] for r in judged.where("not kept").collect()] == [60]


def test_language_id(spark, docs, empty):
    import random

    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(40))
    rows = [(i, make("abcde" if i % 2 else "défgh"), "xx" if i % 2 else "yy") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = langid.fit_identify(table, F.col("doc_id") < 100).collect()
    assert all(r["lang_pred"] == r["lang"] and 0.99 < r["score"] <= 1 for r in out)
    model = langid.train(table)
    odd = {r["doc_id"]: r for r in langid.identify(docs.where("doc_id <> 3"), model).collect()}
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[2]["lang_pred"] == "und" and odd[13]["lang_pred"] != "und"
    assert langid.fit_identify(empty, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(table, None).collect()} == {"und"}


def slow_bits(training, text):
    """Code length by walking one language's tree byte by byte."""
    counts = {}
    data = langid.BEFORE + training
    for i in range(3, len(data)):
        for k in range(4):
            counts.setdefault(data[i - k : i], Counter())[data[i]] += 1
    total, data = 0.0, langid.BEFORE + text
    for i in range(3, len(data)):
        for k in range(3, -2, -1):
            if k < 0:
                total += 8
                break
            seen = counts.get(data[i - k : i])
            if seen is None:
                continue
            n, q = seen.total(), len(seen)
            if data[i] in seen:
                total -= math.log2(seen[data[i]] / (n + q))
                break
            total -= math.log2(q / (n + q))
    return total


def test_code_lengths_are_exact():
    training = {"a": b"abracadabra and a cat", "b": b"xyzzy plugh xyz"}
    counts = {}
    for lang, text in training.items():
        data = langid.BEFORE + text
        codes = Counter(int.from_bytes(data[i - 3 : i + 1], "big") for i in range(3, len(data)))
        counts[lang] = np.array(sorted(codes)), np.array([codes[c] for c in sorted(codes)], float)
    model = langid.build(counts)
    for text in (b"abra", b"xyz cat", b"QQQ!", b"a"):
        got = model.bits([text])[0]
        assert np.allclose(got, [slow_bits(training[x], text) for x in ("a", "b")])


def slow_scores(texts, learns, order):
    """Scores by dictionaries: texts are (id, words)."""
    texts = [(i, [*words, " end"]) for i, words in texts]
    counts, contexts, kinds, n = Counter(), Counter(), set(), 0
    places = []
    for i, t in texts:
        if learns(i):
            n += len(t)
            kinds |= set(t)
            s = [" start", *t]
            for j in range(1, len(s)):
                for k in range(min(order - 1, j) + 1):
                    counts[tuple(s[j - k : j + 1])] += 1
                    if k:
                        contexts[tuple(s[j - k : j])] += 1
                        places.append((k, tuple(s[j - k : j]), tuple(s[j - k : j + 1])))
    tokens, once = Counter(), Counter()
    for k, context, gram in places:
        of = k, math.ceil(math.log2(contexts[context]))
        tokens[of] += 1
        once[of] += counts[gram] == 1
    v, out = len(kinds), []
    for i, t in texts:
        base = score = 0.0
        s = [" start", *t]
        for j in range(1, len(s)):
            p = (counts[(s[j],)] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(1, min(order - 1, j) + 1):
                if c := contexts[tuple(s[j - k : j])]:
                    of = k, math.ceil(math.log2(c))
                    e = (once[of] + 1) / (tokens[of] + 2)
                    p = (1 - e) * counts[tuple(s[j - k : j + 1])] / c + e * p
            score += math.log10(p)
        out.append((i, len(t), sum(counts[(w,)] > 0 for w in t), n, round(base, 5), round(score, 5)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm(docs, rows, empty, order, monkeypatch):
    learns = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2
    want = Counter(slow_scores([(r[0], (r[1] or "").encode().lower().split()) for r in rows], learns, order))
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    for chunk_bytes, entries in ((8_000_000, 2_000_000), (20_000, 3_000)):
        monkeypatch.setattr(lm, "CHUNK_BYTES", chunk_bytes)
        monkeypatch.setattr(lm, "BUCKET_ENTRIES", entries)
        got = lm.score_texts(docs, train, order).collect()
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in got) == want
    if order == 2:
        assert lm.score_texts(empty, F.lit(True)).count() == 0
        untrained = lm.score_texts(docs, F.lit(False)).collect()
        assert all(r["score"] == 0 and r["train_tokens"] == 0 for r in untrained)


def test_lanes_carry_the_state():
    """Lanes of any length give the sum that one pass over each text gives; every state's weights sum to 1."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9, n)).encode() for n in (0, 1, 40, 333, 7)]
    chunk = lm.Chunk(texts, np.array([True, True, True, False, True]))
    for k in range(3):
        chunk.learn(None)
        if k < 2:
            chunk.longer()
    n, v = int(chunk.own[0].sum() - chunk.own[0][chunk.prints[0] == lm.START].sum()), int(((chunk.own[0] > 0) & (chunk.prints[0] != lm.START)).sum())
    escapes = np.full((3, 64), 0.3)
    whole = chunk.traverse(n, v, escapes, lane=1000)
    for lane in (1, 2, 7, 64):
        assert np.allclose(chunk.traverse(n, v, escapes, lane), whole)


def test_steps_of_a_chunk_do_not_grow_with_its_texts():
    """A chunk is worked on as a whole: a hundred times the texts take as many calls, in Python and into numpy."""

    def calls(n):
        texts = [b"the Quick brown fox %d and again the quick brown Fox" % (i % 10) for i in range(n)]
        seen = []
        sys.setprofile(lambda frame, event, arg: seen.append(event) if event in ("call", "c_call") else None)
        try:
            chunk = lm.Chunk(texts, np.ones(n, bool))
            for _ in range(2):
                chunk.learn(None)
                chunk.longer()
        finally:
            sys.setprofile(None)
        assert len(chunk.place) == 13 * n
        return len(seen)

    calls(10)
    assert calls(2000) <= calls(20) + 20


LETTERS = st.sampled_from([*b"abAB \t\n\v\f\r\0", 0x1C, 0x85, 0xA0, 0xC3, 0xFF])
TEXTS = st.one_of(st.none(), st.lists(LETTERS, max_size=40).map(bytes), st.lists(st.sampled_from([7, 8, 9, 16, 17, 63, 64, 65, 130]), max_size=5).map(lambda n: b" ".join(b"aB" * (x // 2) + b"b" * (x % 2) for x in n)))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=12), st.integers(0, 3))
def test_fingerprints_of_many_texts(texts, skipped):
    """They tell words apart as the words themselves do, text by text, also in a slice of an array."""
    words = [common.lower_words(t) for t in texts[skipped:]]
    prints, sizes = common.all_prints(pa.array(texts, pa.binary())[skipped:])
    assert list(sizes) == [len(w) for w in words]
    pairs = set(zip([w for t in words for w in t], prints.tolist(), strict=True))
    assert len(pairs) == len({w for w, _ in pairs}) == len({p for _, p in pairs})


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 62).flatmap(lambda bits: st.tuples(st.just(bits), st.lists(st.integers(0, 2**bits - 1) | st.integers(0, 1), max_size=50))))
def test_numbered_codes(case):
    """With and without room for a number's place beside it."""
    bits, values = case
    x = np.array(values, np.int64)
    found, own, at = common.numbered_codes(x, bits)
    assert sorted(found) == sorted(set(values))
    assert (found[own] == x).all() and (x[at] == found).all()


def test_lm_tells_copies_from_the_rest(spark):
    """Texts that training has twice score above texts that it has once, a token of theirs on average."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    once, twice = [word(150) for _ in range(300)], [word(150) for _ in range(20)]
    texts = [" ".join(t) for t in [*once, *twice, *twice]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["score"] - r["base_score"]) / r["n_tokens"] for r in lm.score_texts(table, F.col("doc_id") % 7 != 2).collect()}
    learned = [i for i in range(300, 320) if i % 7 != 2 and (i + 20) % 7 != 2]
    assert min(got[i] for i in learned) > max(got[i] for i in range(300))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1)))
def test_packed_numbers(values):
    x = np.array(values, np.uint64)
    assert (common.unpack(common.pack(x)) == x).all()
    assert (common.unpack_sorted(common.pack_sorted(np.sort(x))) == np.sort(x)).all()
