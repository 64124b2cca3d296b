"""The contract queries with SQL, side by side with DuckDB on the smallest tables; the verdicts of op6 by brute force."""

import math
import os
from collections import Counter, defaultdict

import pytest

from trailmill.llm import oracles, quality, queries

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    if not os.path.exists(sf_dir):
        pytest.skip("no tables")
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.sql(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    frame = queries.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    found = db.sql(oracles.oracle_sql()[name])
    assert sorted(found.columns) == columns
    plain = lambda rows: Counter(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows)
    assert plain(tuple(r[c] for c in columns) for r in frame.collect()) == plain(found.select(", ".join(f'"{c}"' for c in columns)).fetchall())


KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\v\f\r", ".,;:!?'\"()-", "#*$%&|<>"]


def slow_kind(c):
    """Class of a character: of the six lists, 7 beyond ASCII, 6 for the rest."""
    return next((i for i, chars in enumerate(KINDS) if c in chars), 7 if ord(c) > 127 else 6)


def slow_distance(p, q):
    keys, a, b = set(p) | set(q), sum(p.values()), sum(q.values())
    total = 0.0
    for k in keys:
        x, y = p.get(k, 0) / a, q.get(k, 0) / b
        for z in (x, y):
            if z:
                total += z * math.log2(2 * z / (x + y)) / 2
    return math.sqrt(max(0.0, total))


def slow_verdicts(rows, rules):
    """doc_id -> (base failed, character distance, word distance, kept), each language's reference counted plainly."""
    measured, chars, words, total = [], defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for i, text, lang in rows:
        text = text or ""
        own = text.encode().split()
        windows = [tuple(own[j : j + 3]) for j in range(len(own) - 2)]
        times = Counter(windows)
        repeated = {j + k for j, w in enumerate(windows) if times[w] > 1 for k in range(3)}
        failed = len(own) < rules.min_words or 100 * len(repeated) > rules.max_repeat_percent * len(own)
        measured.append((i, text, lang, own, failed))
        if lang is not None:
            total[lang].update(own)
            if not failed:
                chars[lang].update(map(slow_kind, text))
                words[lang].update(own)
    references = {}
    for lang in total:
        if words[lang].total() >= rules.min_reference_words:
            common = {w for w, n in total[lang].items() if n >= total[lang].total() * quality.COMMON}
            references[lang] = chars[lang], Counter({w: n for w, n in words[lang].items() if w in common} | {None: sum(n for w, n in words[lang].items() if w not in common)}), common
    out = {}
    for i, text, lang, own, failed in measured:
        near = [references[lang]] if lang in references else list(references.values())
        far = [(slow_distance(Counter(map(slow_kind, text)), c), slow_distance(Counter(x if x in common else None for x in own), w)) for c, w, common in near] if own else []
        char_d = min((x for x, _ in far), default=None) if len(text) >= rules.guard_chars else None
        word_d = min((x for _, x in far), default=None) if len(own) >= rules.guard_words else None
        out[i] = failed, char_d, word_d, not failed and (char_d or 0) <= rules.max_char_distance and (word_d or 0) <= rules.max_word_distance
    return out


def test_quality_verdicts(spark, sf_dir):
    if not os.path.exists(sf_dir):
        pytest.skip("no tables")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = slow_verdicts([(r["doc_id"], r["text"], r["lang"]) for r in table.collect()], quality.Rules())
    close = lambda a, b: a == b or (a is not None and b is not None and abs(a - b) < 1e-9)
    got = queries.op6_quality_rules(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        failed, char_d, word_d, kept = want[r["doc_id"]]
        assert r["base_failed"] == failed and close(r["char_distance"], char_d) and close(r["word_distance"], word_d) and r["kept"] == kept
    assert any(not r["kept"] and not r["base_failed"] for r in got) or any(r["char_distance"] is not None for r in got)


def test_language_id_from_a_sample(spark, sf_dir):
    """Windows drawn by hash, a small share of the training text, still tell the languages apart."""
    from trailmill.llm import langid

    if not os.path.exists(sf_dir):
        pytest.skip("no tables")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null and n_chars > 300")
    model = langid.train(table.where("doc_id % 3 <> 1"), sample_bytes=60_000)
    got = langid.identify(table.where("doc_id % 3 = 1"), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
