"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBpe, TokenCounter
from .common import release, tokenizer_path


@lru_cache(maxsize=2)
def _proof(path: str) -> tuple[str, list[str]]:
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    return spec, ByteBpe(spec).whole_tokens()


_counters: dict[int, TokenCounter] = {}


def _counter(spec: str, whole: list[str]) -> TokenCounter:
    key = hash(spec)
    if key not in _counters:
        _counters.clear()
        _counters[key] = TokenCounter(spec, whole)
    return _counters[key]


def token_count(text: Column, tokenizer: str | None = None) -> Column:
    """Number of tokens of a text column. The proof runs once, on the driver; its size is that of the vocabulary."""
    spec, whole = _proof(tokenizer or tokenizer_path("byte_bpe_50k.json"))

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        counter = _counter(spec, whole)
        out = pa.array((counter.count(x.as_py()) for x in texts), pa.int64())
        release()
        return out

    return count(text)


def count_tokens(docs: DataFrame, text: str = "text", limit: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    A null or empty text has 0 bytes and 0 tokens. Special strings inside a text count as the library counts them,
    as one token each. Texts of any length are counted whole; repeated rows are counted alike; columns of the same
    names are replaced; an empty table stays empty.
    """
    counted = docs.withColumn("n_tokens", token_count(F.col(text), tokenizer))
    n_bytes = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint")
    return counted.withColumns({"n_bytes": n_bytes, "over_limit": F.col("n_tokens") > limit})
