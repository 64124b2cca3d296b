"""Near duplicates, passages, mixing, sharding, neighbours and the pipeline against brute force."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmill.llm import ann, components, mixing, neardup, passages, sharding


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def slow_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    of = {i: i for i, _ in sets if i is not None}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                of[y] = x
    return {i: root(i) for i in of}, sets


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 400, n))


def near_rows(seed=0, groups=6, members=9):
    """Groups of texts around a base with more and more words changed: similarities on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(100)]
        for m in range(members):
            text = list(base)
            for at in rng.choice(100, rng.integers(0, 6), replace=False):
                text[at] = f"x{rng.integers(10**9)}"
            out.append((len(out), " ".join(text)))
    return out


def test_near_duplicates(spark, docs, rows, empty):
    for table, plain in ((docs, [(r[0], r[1]) for r in rows]), (spark.createDataFrame(near_rows(), "doc_id bigint, text string"), near_rows())):
        of, sets = slow_components(plain)
        want = Counter((i, len(s), of.get(i), i is None or of[i] == i) for i, s in sets)
        got = neardup.near_duplicates(table).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    of, _ = slow_components([(r[0], r[1]) for r in rows])
    of_texts = Counter({(r[0], r[1]) for r in rows if r[0] is not None and of[r[0]] == r[0]})
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None) == of_texts and ids.count(None) == 2
    assert neardup.near_duplicates(empty).count() == 0


def test_blocks_link_what_stars_leave_apart(spark, monkeypatch):
    """Without any star, the buckets alone link all that is similar."""
    rows, how = near_rows(seed=5, groups=2, members=40), neardup.MinHash()
    monkeypatch.setattr(neardup, "BLOCK", 16)
    pool = spark.createDataFrame([(i, t.encode()) for i, t in rows], "id bigint, text binary")
    made = pool.select("id", neardup._sketches(how)(F.col("text")).alias("s"), neardup._sets(F.col("text"), how).alias("set"))
    banded = made.select("id", F.explode("s.bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    nothing = spark.createDataFrame([], "node bigint, component bigint")
    links = neardup._residual(banded, buckets, made.select("id", "s.sketch"), made.select("id", "set"), nothing, how)
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    of, _ = slow_components(rows)
    assert got == {i: c for i, c in of.items() if i != c}


@settings(max_examples=10, deadline=None)
@given(edges=st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    of = {}
    for a, b in edges:
        merged = of.get(a, {a}) | of.get(b, {b})
        for x in merged:
            of[x] = merged
    table = spark.createDataFrame([*edges, (None, 1)], "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in components.components(table).collect()}
    assert got == {x: min(s) for x, s in of.items() if x != min(s)}


def test_compact_windows():
    rng = np.random.default_rng(0)
    for trial in range(100):
        n, run = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        tokens = rng.integers(0, 30 if trial % 2 else 2**62, n).astype(np.uint64)
        starts = np.unique(np.concatenate([[0], rng.integers(0, n, 2)]))
        a, b = np.uint64(2**63 + 24691359), np.uint64(77)
        got = set(zip(*(v.tolist() for v in passages.compact_windows(tokens, starts, run, a, b))))
        bits = np.uint64(n.bit_length())
        value = ((tokens * a + b) >> bits << bits) | np.arange(n, dtype=np.uint64)
        want = set()
        for s, e in zip(starts, [*starts[1:], n]):
            for c in range(s, e):
                left, right = c, c
                while left > s and value[left - 1] > value[c]:
                    left -= 1
                while right < e - 1 and value[right + 1] > value[c]:
                    right += 1
                if right - left + 1 >= run:
                    want.add((c, left, right))
        assert got == want


def test_passages(spark, docs, rows, empty):
    plain = {}
    for i, t, *_ in rows:
        if i is not None and t:
            plain.setdefault(i, []).append(t.encode().lower().split())
    first, want = {}, set()
    for i in sorted(plain):
        for words in plain[i]:
            for s in range(len(words) - 49):
                key = tuple(words[s : s + 50])
                if first.setdefault(key, i) != i:
                    want.add(i)
    got = passages.repeated_passages(docs).collect()
    assert want <= {r["doc_id"] for r in got} and all(r["other_id"] < r["doc_id"] for r in got)
    for r in got:
        assert r["words"] >= 50 and r["similarity"] >= 0.75
        mine = [w[r["start"] : r["start"] + r["words"]] for w in plain[r["doc_id"]]]
        its = [w[r["other_start"] : r["other_start"] + r["other_words"]] for w in plain[r["other_id"]]]
        alike = lambda a, b: len(a & b) / len(a | b) if a | b else 0
        assert max(alike(shingles(b" ".join(a).decode()), shingles(b" ".join(b).decode())) for a in mine for b in its) >= 0.75
    assert {r["doc_id"] for r in got} <= {6, 7, 8, 10}
    out = passages.without_repeats(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.where("doc_id in (9, 10, 11)").collect()}
    before = {r[0]: r[1] for r in rows}
    assert texts[9] == before[9] and texts[11] == before[11] and len(texts[10].split()) == 60
    assert passages.repeated_passages(empty).count() == 0


def edited_passages(kind, pairs=40, seed=3):
    """Pairs of texts of their own random words that share a passage, the second with words inserted or left out."""
    rng = np.random.default_rng(seed)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    n, places = kind
    out = []
    for p in range(pairs):
        passage = fresh(n)
        copy = list(passage)
        for at in sorted((abs(x) for x in places), reverse=True):
            copy[at : at + (-at in places)] = [] if -at in places else fresh(1)
        out += [(2 * p, " ".join(fresh(70) + passage + fresh(70))), (2 * p + 1, " ".join(fresh(70) + copy + fresh(70)))]
    return out


@pytest.mark.parametrize("kind", [(50, (25,)), (80, (27, 53)), (100, (25, 50, 75)), (60, (-30,)), (100, (-33, 66))])
def test_passages_with_words_inserted_and_left_out(spark, kind):
    rows = edited_passages(kind)
    got = {(r["doc_id"], r["other_id"]) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {(i, i - 1) for i in range(1, len(rows), 2)}
    assert got <= want and len(got) >= 0.95 * len(want)


def covered(spans, doc, begin, words):
    """Share of a text's words in [begin, begin + words) that its reported passages hold."""
    inside = set()
    for r in spans:
        if r["doc_id"] == doc:
            inside |= set(range(max(begin, r["start"]), min(begin + words, r["start"] + r["words"])))
    return len(inside) / words


def hidden_passages(trials, n, versions, change, seed):
    """Per trial, earlier texts with versions of a passage that aren't like it, then two texts with the passage itself."""
    rng = np.random.default_rng(seed)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    out = []
    for _ in range(trials):
        passage = fresh(n)
        texts = [change(rng, list(passage), fresh) for _ in range(versions)] + [passage, passage]
        out += [(len(out) + i, " ".join(fresh(60) + t + fresh(60))) for i, t in enumerate(texts)]
    return out


def shares_42_words(rng, passage, fresh):
    return passage[:42] + fresh(8) if rng.random() < 0.5 else fresh(8) + passage[8:]


def has_five_others(rng, passage, fresh):
    for at in rng.choice(len(passage), 5, replace=False):
        passage[at] = fresh(1)[0]
    return passage


@pytest.mark.parametrize(("n", "versions", "change"), [(50, 1, shares_42_words), (60, 4, has_five_others), (60, 25, has_five_others)])
def test_earlier_versions_hide_no_copies(spark, n, versions, change):
    trials = 150 if versions == 1 else 20
    rows = hidden_passages(trials, n, versions, change, seed=versions)
    for how in (passages.Passages(), passages.Passages(chunk_bytes=3000)):
        got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string"), how).collect()
        last = [t * (versions + 2) + versions + 1 for t in range(trials)]
        assert sum(round(covered(got, i, 60, n) * n) >= 50 for i in last) == trials  # an earlier version may be like most of it
        plain = {i: t.split() for i, t in rows}
        for r in got:
            own, its = (" ".join(plain[r[d]][r[s] : r[s] + r[w]]) for d, s, w in (("doc_id", "start", "words"), ("other_id", "other_start", "other_words")))
            assert 100 * len(shingles(own) & shingles(its)) >= 75 * len(shingles(own) | shingles(its))


@pytest.mark.parametrize("least", [0.75, 0.8, 0.85, 0.9, 0.95])
def test_recall_of_near_passages(spark, least):
    """Passages of 50 to 150 words with words replaced down to a similarity: 95 % of them and more are found."""
    rng = np.random.default_rng(int(100 * least))
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    out = []
    for _ in range(120):
        passage = fresh(int(rng.integers(50, 151)))
        copy = list(passage)
        for at in rng.permutation(len(copy)):
            other = copy[:at] + fresh(1) + copy[at + 1 :]
            a, b = shingles(" ".join(passage)), shingles(" ".join(other))
            if len(a & b) < least * len(a | b):
                break
            copy = other
        out += [(len(out), " ".join(fresh(70) + passage + fresh(70))), (len(out) + 1, " ".join(fresh(70) + copy + fresh(70)))]
    got = {(r["doc_id"], r["other_id"]) for r in passages.repeated_passages(spark.createDataFrame(out, "doc_id bigint, text string")).collect()}
    want = {(i, i - 1) for i in range(1, len(out), 2)}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_rows_that_share_an_id_keep_their_own_words(spark):
    passage, other = words(60, 71), words(100, 72)
    rows = [(1, words(40, 73) + " " + passage), (2, words(30, 74) + " " + passage), (2, other), (None, passage), (3, None)]
    left = Counter((r[0], r[1]) for r in passages.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert left == Counter([rows[0], (2, words(30, 74)), rows[2], rows[3], rows[4]])


@pytest.mark.parametrize("stray", [0, 8, 20, 40])
def test_passages_beside_a_repeated_phrase(stray):
    """An edited passage of which a 5-word run occurs once more in the other text, before or after it."""
    rng, how = np.random.default_rng(stray), passages.Passages()
    fresh = lambda n: rng.integers(0, 2**62, n).astype(np.uint64)
    for trial in range(20):
        passage = fresh(80)
        copy = passage.copy()
        copy[40] = 1
        phrase, at = passage[20:25], (fresh(60), fresh(stray))
        sides = [fresh(60), np.concatenate([at[1], phrase, at[0]])]
        if trial % 2:
            sides = [np.concatenate([at[0], phrase, at[1]]), fresh(60)]
        mine, other = np.concatenate([fresh(70), copy, fresh(70)]), np.concatenate([sides[0], passage, sides[1]])
        for x, y in ((mine, other), (other, mine)):
            got = passages.spans_between(x, y, how)
            assert len(got) == 1 and got[0][1] >= 75 and got[0][4] >= 0.75


def test_cut_out():
    assert passages._cut_out("a b  c\nd é", [{"start": 1, "words": 2}]) == "a\nd é"
    assert passages._cut_out(None, [{"start": 0, "words": 1}]) is None and passages._cut_out("a a", [{"start": 0, "words": 2}]) == ""


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over


def test_mixing(docs, rows, empty):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    want = slow_targets(dict(sizes))
    plan = mixing.mixing_plan(docs).collect()
    assert len(plan) == len(rows)
    for r in plan:
        assert r["source_size"] == sizes[r["source"]] and r["size"] == len((r["text"] or "").encode().split())
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        rate = want[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert int(rate) <= r["copies"] <= int(rate) + 1 and r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in plan)
    assert mixing.mixing_plan(empty).count() == 0


def test_targets_are_level(spark):
    for sizes in ({"a": 1, "b": 100, "c": 1000}, {"a": 0, None: 0}, {"x": 5}, {f"s{i}": i * i for i in range(12)}):
        table = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
        got = {r["source"]: r["target"] for r in mixing.source_targets(table, (5, 2, 1), 3).collect()}
        want = slow_targets(sizes)
        assert all(abs((got[s] or 0) - want[s]) < 1e-6 for s in sizes)


def test_sharding(docs, rows, empty):
    got = sharding.shuffle_to_shards(docs, 7).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(s) for s in slots.values()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shuffle_to_shards(docs, 7).collect()
    key = lambda rs: Counter((r["doc_id"], r["shard"], r["slot"]) for r in rs)
    assert key(got) == key(again)
    assert sharding.shuffle_to_shards(empty, 7).count() == 0


def test_communication_matrix():
    rows, shards = [5, 0, 17, 3], [9, 8, 8]
    matrix = sharding.communication_matrix(rows, shards, 1)
    assert matrix.sum(axis=1).tolist() == rows and matrix.sum(axis=0).tolist() == shards
    mean = np.mean([sharding.communication_matrix(rows, shards, s) for s in range(800)], axis=0)
    assert np.allclose(mean, np.outer(rows, shards) / 25, atol=0.25)


def test_hypergeometric_law():
    """The draw beyond numpy's limit against the exact law, and its moments at sizes that numpy refuses."""
    from math import comb, exp, sqrt

    for good, bad, n in ((10, 15, 7), (30, 5, 12), (100, 300, 50)):
        for k in range(max(0, n - bad), min(n, good) + 1):
            logs = [sharding._log_binomial(a, b, n / (good + bad)) for a, b in ((k, good), (n - k, bad), (n, good + bad))]
            assert abs(exp(logs[0] + logs[1] - logs[2]) - comb(good, k) * comb(bad, n - k) / comb(good + bad, n)) < 1e-12
    rng = np.random.default_rng(1)
    good, bad, n = 6 * 10**9, 4 * 10**9, 9 * 10**9
    drawn = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(4000)], float)
    mean, variance = n * 0.6, n * 0.6 * 0.4 * 0.1
    assert abs(drawn.mean() - mean) < 4 * sqrt(variance / 4000) and abs(drawn.var() / variance - 1) < 0.1
    matrix = sharding.communication_matrix([5 * 10**9, 0, 7 * 10**9], [6 * 10**9, 6 * 10**9], 3)
    assert matrix.sum(axis=0).tolist() == [6 * 10**9] * 2 and matrix.sum(axis=1).tolist() == [5 * 10**9, 0, 7 * 10**9]


def test_shuffle_is_uniform(spark):
    """Each row is in each shard, and at each place of it, equally often over many seeds."""
    table = spark.range(24).repartition(3, "id")
    shard, slot = np.zeros((24, 4)), np.zeros((24, 6))
    for seed in range(60):
        for r in sharding.shuffle_to_shards(table, 4, seed).collect():
            shard[r["id"], r["shard"]] += 1
            slot[r["id"], r["slot"]] += 1
    for counts in (shard, slot):
        expected = counts.sum(axis=1, keepdims=True) / counts.shape[1]
        chi = ((counts - expected) ** 2 / expected).sum()
        freedom = 24 * (counts.shape[1] - 1)
        assert chi < freedom + 5 * np.sqrt(2 * freedom)


def test_hilbert_steps():
    import itertools

    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = ann.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 16)) * 3
    x = (centres[rng.integers(0, 20, 600)] + rng.standard_normal((600, 16))).astype(np.float32)
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    rows += [(1000, None, ""), (1020, [0.0] * 16, ""), (1040, [1.0, None] * 8, ""), (1060, [float("nan")] * 16, ""), (1080, [1.0] * 3, ""), (1081, [2.0] * 3, ""), (None, x[0].tolist(), ""), (40, x[40].tolist(), "")]
    rows += [(2000 + i, x[20].tolist(), "") for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id string")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, 10, ann.Curves(block=64)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array([*range(600), *range(2000, 2060)])
    vectors = np.concatenate([x, np.repeat(x[20:21], 60, axis=0)]).astype(np.float64)
    assert got.pop(1080) == [(1, 1081, 6.0)]  # another length is searched on its own
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        score = vectors @ vectors[np.flatnonzero(ids == q)[0]]
        best = [i for i in np.lexsort((ids, -score.round(9))) if ids[i] != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(abs(score[np.flatnonzero(ids == v)[0]] - s) < 1e-9 for _, v, s in found)
        hits += len({int(ids[i]) for i in best} & {f[1] for f in found})
    assert hits / (10 * len(got)) >= 0.9
    twins = ann.merge_best([(np.array([7, 3]), np.array([1.0, 1.0])), (np.array([5, 3]), np.array([1.0, 0.5]))], 2)
    assert twins[0].tolist() == [3, 5] and twins[1].tolist() == [1.0, 1.0]
    assert ann.nearest(table.limit(0), F.lit(True)).count() == 0


def test_pipeline(spark, sf_dir, docs):
    import os

    import corpus_pipeline as pipeline

    if not os.path.exists(sf_dir):
        pytest.skip("no tables")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in table.collect()}
    kept = pipeline.quality_rules(spark, table, sf_dir)
    assert kept.columns == table.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    one = pipeline.near_dedup(spark, kept, sf_dir)
    of, _ = slow_components(sorted(texts.items()))
    ids = {r["doc_id"] for r in one.collect()}
    assert one.columns == table.columns and ids == {i for i in of if of[i] == i}
    cleaned = pipeline.substring_dedup(spark, one, sf_dir)
    assert cleaned.columns == table.columns
    left = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    seen = {}
    for i in sorted(left):
        words = left[i].encode().lower().split()
        assert len(words) <= len(rows[i].split())
        for s in range(len(words) - 49):
            assert seen.setdefault(tuple(words[s : s + 50]), i) == i
    packed = pipeline.run(spark, sf_dir)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids", "row"]
    assert {r["doc_id"] for r in packed.collect()} <= set(left)


def test_pipeline_on_awkward_tables(spark, docs, rows, empty, tmp_path):
    """Nulls, ties, repeated rows and ids, clashing names; and no rows at all."""
    import corpus_pipeline as pipeline

    for k, (table, plain) in enumerate(((docs, rows), (empty, []))):
        path = str(tmp_path / str(k))
        table.write.parquet(f"{path}/documents.parquet")
        before, sizes = table, [len(plain)]
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, before, path)
            assert out.columns == table.columns
            written = f"{path}/{len(sizes)}"
            out.write.parquet(written)
            before = spark.read.parquet(written)
            sizes.append(before.count())
        assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3]
        mixed = Counter(r["doc_id"] for r in before.collect())
        packed = pipeline.run(spark, path).collect()
        assert Counter({i: len({r["row"] for r in packed if r["doc_id"] == i}) for i in mixed}) == mixed
        used = {}
        for r in packed:
            used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            assert len(r["ids"]) == 4 * r["length"]
        for pieces in used.values():
            pieces.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and pieces[0][0] == 0 and sum(n for _, n in pieces) <= 4096
    kept = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/0/2").collect()}
    assert not kept & {0, 1, 2, 3, 12} and {(r[0], r[1]) for r in rows if r[0] in kept} >= {(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/0/2").collect()}
