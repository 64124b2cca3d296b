import random

import pytest

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, n_tokens string, `group` int"


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def sample_rows():
    """Nulls in every column, empty, blank and very long texts, copies, near copies, repeated rows and ids."""
    base, passage = words(120, 1), words(60, 2)
    near = base.split()
    near[60] = "other"
    texts = [None, "", " \n\t ", "one", "two words", base, base, " ".join(near), base.upper(), words(30, 3) + " " + passage + " " + words(30, 4),
             words(40, 5) + "\n" + passage + "\n" + words(20, 6), words(30_000, 7, 5000), "a b c " * 40, "<|endoftext|> café ﬁ İstanbul Σας 😀 日本語", "x" * 5000]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s0"][i % 4], None if t is None else len(t), i, "clash", None) for i, t in enumerate(texts)]
    rows += [(None, base, "en", "s1", 1, 1, "clash", 1), (None, None, None, None, None, None, None, None), rows[5], rows[5], (3, "again three", "en", "s1", 1, 1, "c", 2)]
    rows += [(100 + i, words(80 + i, 50 + i), ["en", "fr"][i % 2], f"s{i % 5}", 1, 1, "c", 3) for i in range(20)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return sample_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KIND)
