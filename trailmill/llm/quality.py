"""Quality rules: repetition and length counts, and the distance of a text's histograms from its language's.

Each language's reference is two histograms over all its texts that pass the base rules: character classes, and its
common words (all words that make up at least ``COMMON`` of the language) plus one bin for the rest. A text's verdict
compares its own histograms to them by Jensen-Shannon distance.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
#: Share of a language's words from which a word is common.
COMMON = 1 / 400


@dataclass(frozen=True)
class Rules:
    """Limits and length guards; a histogram of a shorter text isn't judged."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_char_distance: float = 0.31
    max_word_distance: float = 0.45
    guard_chars: int = 200
    guard_words: int = 50
    #: A language with fewer words in passing texts has no reference of its own.
    min_reference_words: int = 1000


def _byte_classes() -> np.ndarray:
    """Class of each UTF-8 byte; a character beyond ASCII counts by its first byte, the others go to bin 8."""
    out = np.full(256, 6)
    out[0x80:0xC0], out[0xC0:] = 8, 7
    for i, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", SPACES, PUNCTUATION, SYMBOLS)):
        out[[ord(c) for c in chars]] = i
    return out


BYTE_CLASSES, N_CLASSES = _byte_classes(), 8


def char_histogram(data: bytes) -> np.ndarray:
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return np.bincount(BYTE_CLASSES, weights=by_byte, minlength=9)[:N_CLASSES].astype(np.int64)


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    inside = np.zeros(len(words) + 1, np.int32)
    starts = np.fromiter((times[w] > 1 for w in windows), bool, len(windows)).nonzero()[0]
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.minimum(starts + 3, len(words)), -1)
    return int((np.cumsum(inside)[:-1] > 0).sum())


def dup_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits: 0 for equal, 1 for disjoint distributions."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


@dataclass
class Reference:
    chars: np.ndarray
    words: np.ndarray
    bins: dict[bytes, int] = field(repr=False)

    def distances(self, chars: np.ndarray, words: list[bytes]) -> tuple[float, float]:
        own = np.zeros(len(self.words))
        for word, n in Counter(map(self.bins.get, words)).items():
            own[-1 if word is None else word] = n
        return js_distance(chars, self.chars), js_distance(own, self.words)


def _chunks(batches: Iterator[pa.RecordBatch], words: int = 300_000) -> Iterator[list[tuple[str | None, str]]]:
    """(lang, text) of a partition, in runs of about so many words at most (one text is never split)."""
    held, n = [], 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            if (lang := lang.as_py()) is not None and (text := text.as_py()):
                held.append((lang, text))
                n += len(text) // 6
                if n >= words:
                    yield held
                    held, n = [], 0
    if held:
        yield held


def _rows(found: Counter, kind: str) -> pa.RecordBatch:
    langs, keys = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, kind), pa.array(found.values(), pa.int64())], ["lang", "key", "n"])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that make up COMMON / 2 of a chunk's words in a language, and the number of words (key null)."""
    for chunk in _chunks(batches):
        counts: dict[str, Counter] = {}
        for lang, text in chunk:
            counts.setdefault(lang, Counter()).update(text.encode().split())
        out: Counter = Counter()
        for lang, words in counts.items():
            total = words.total()
            out[lang, None] = total
            out.update({(lang, w): n for w, n in words.items() if n >= total * COMMON / 2})
        yield _rows(out, pa.binary())
    release()


def _measured(candidates: dict[str, list[bytes]], rules: Rules) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per language: at 0.. the classes' counts, then the words in passing texts and in all, then two per candidate."""
        bins = {lang: {w: i for i, w in enumerate(words)} for lang, words in candidates.items()}
        for chunk in _chunks(batches):
            sums = {lang: np.zeros(N_CLASSES + 2 + 2 * len(bins.get(lang, ())), np.int64) for lang in {lang for lang, _ in chunk}}
            for lang, text in chunk:
                data = text.encode()
                words, own, at = data.split(), sums[lang], N_CLASSES
                passes = not base_failed(len(words), repeat_words(words), rules)
                times = Counter(map(bins.get(lang, {}).get, words))
                own[at + 1] += len(words)
                if passes:
                    own[:at] += char_histogram(data)
                    own[at] += len(words)
                for i, n in times.items():
                    if i is not None:
                        own[at + 3 + 2 * i] += n
                        own[at + 2 + 2 * i] += n * passes
            yield _rows(Counter({(lang, i): int(n) for lang, own in sums.items() for i, n in enumerate(own)}), pa.int64())
        release()

    return measure


def base_failed(n_words: int, n_repeat_words: int, rules: Rules) -> bool:
    return n_words < rules.min_words or 100 * n_repeat_words > rules.max_repeat_percent * n_words


def references(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> dict[str, Reference]:
    """The references of all languages, from all documents: two passes, each sending a bounded sum per language.

    Every word that makes up COMMON of a language makes up at least COMMON / 2 of it in what ``_frequent`` emits, so
    no common word is missed and at most 2 / COMMON candidates per language reach the driver.
    """
    texts = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sums = texts.mapInArrow(_frequent, "lang string, key binary, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in sums.where("key is null").collect()}
    if not totals:
        return {}
    spark = docs.sparkSession
    limits = spark.createDataFrame([(k, v * COMMON / 2) for k, v in totals.items()], "lang string, least double")
    candidates: dict[str, list[bytes]] = {}
    for r in sums.where("key is not null").join(limits, "lang").where("n >= least").collect():
        candidates.setdefault(r["lang"], []).append(bytes(r["key"]))
    candidates = {k: sorted(v) for k, v in candidates.items()}
    rows = texts.mapInArrow(_measured(candidates, rules), "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[int, int]] = {}
    for r in rows.collect():
        counts.setdefault(r["lang"], {})[r["key"]] = r["n"]
    out = {}
    for name, own in counts.items():
        passing, total = own[N_CLASSES], own[N_CLASSES + 1]
        if passing < rules.min_reference_words:
            continue
        common = [(w, own[N_CLASSES + 2 + 2 * i]) for i, w in enumerate(candidates.get(name, [])) if own[N_CLASSES + 3 + 2 * i] >= total * COMMON]
        words = np.array([n for _, n in common] + [passing - sum(n for _, n in common)], float)
        out[name] = Reference(np.array([own[i] for i in range(N_CLASSES)], float), words, {w: i for i, (w, _) in enumerate(common)})
    return out


SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "char_distance double, word_distance double, kept boolean"
)


def measure(text: str | None, lang: str | None, known: dict[str, Reference], rules: Rules) -> dict:
    text = text or ""
    data = text.encode()
    words = data.split()
    repeats = repeat_words(words)
    failed = base_failed(len(words), repeats, rules)
    word_chars = len(text) - sum(map(text.count, SPACES))
    chars = char_histogram(data)
    near = [known[lang]] if lang in known else list(known.values())
    far = [r.distances(chars, words) for r in near] if words else []
    char_d = min((d for d, _ in far), default=None) if len(text) >= rules.guard_chars else None
    word_d = min((d for _, d in far), default=None) if len(words) >= rules.guard_words else None
    strange = (char_d or 0.0) > rules.max_char_distance or (word_d or 0.0) > rules.max_word_distance
    return {
        "n_words": len(words), "word_chars": word_chars, "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": dup_lines(text),
        "n_repeat_words": repeats, "base_failed": failed, "char_distance": char_d, "word_distance": word_d, "kept": not failed and not strange,
    }


def judge(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with the counts, distances and ``kept``; columns of these names are replaced.

    A null or empty text has counts of 0 and fails the base rules. A text whose language is null, unknown or too rare
    for a reference is held against the nearest reference; with no reference at all, or below the length guards, its
    distances are null and don't count against it. Repeated rows get the same verdict; an empty table stays empty.
    """
    known = references(docs, rules, text, lang)
    kind = pa.struct([(n, {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])

    @F.arrow_udf(f"struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>")
    def verdict(texts: pa.Array, langs: pa.Array) -> pa.Array:
        out = pa.array((measure(t.as_py(), x.as_py(), known, rules) for t, x in zip(texts, langs)), kind)
        release()
        return out

    taken = {*docs.columns, "kept"}
    spare = next(f"verdict{i}" for i in range(len(taken) + 1) if f"verdict{i}" not in taken)
    judged = docs.withColumn(spare, verdict(F.col(text), F.col(lang).cast("string")))
    return judged.withColumns({x.split()[0]: F.col(f"{spare}.{x.split()[0]}") for x in SCHEMA.split(", ")}).drop(spare)


def keep(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that ``judge`` keeps, with the columns they had."""
    return judge(docs, rules, text, lang).where("kept").select(docs.columns)
