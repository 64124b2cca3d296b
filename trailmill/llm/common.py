"""What the training-data operators share: reading, cutting lineage, words and their fingerprints."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; any other master raises.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            _own_dir = _own_dir or tempfile.mkdtemp(prefix="trailmill-")
            base = "file://" + _own_dir
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/trailmill-cuts/{spark.sparkContext.applicationId}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: later stages neither repeat nor lose it.

    The shuffle files of the write go as soon as it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def cuts(spark: SparkSession) -> set[str]:
    """The tables that ``cut`` has written in this application and that are still there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {str(f.getPath()) for f in files.listStatus(path)} if files.exists(path) else set()


def drop_cuts(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that ``cut`` wrote. Results that read them must be written before."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except AttributeError:  # another C library
    _trim = None


def release() -> None:
    """Give what a worker no longer uses back to the system: reused workers wait beside the ones at work."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def sliced(texts: pa.Array, n: int = 1000) -> Iterator[pa.Array]:
    """The texts of a batch, so many at a time."""
    for i in range(0, len(texts), n):
        yield texts.slice(i, n)


#: Parts that the rows of one key are dealt into where a join on the key could meet a hot one.
SPREAD = 16


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``per_key``, which has one row a key: the rows of a key are dealt out by ``by``, so that no
    task holds all rows of a hot one; the row of the key is sent to each part."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    dealt = rows.withColumn("spread", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int"))
    return dealt.join(per_key.withColumn("spread", parts), [key, "spread"]).drop("spread")


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of a value written as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def lower_words(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased. ``bytes`` methods touch ASCII only, as the definition of a word does."""
    return text.lower().split() if text else []


#: Each byte's value in a word: A-Z as a-z, white space 0.
_LETTERS = np.array([0 if b in (0x20, *range(0x09, 0x0E)) else b + 1 for b in bytes(range(256)).lower()], np.uint64)
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number, modulo 2**64, as far as the longest word so far needs."""
    if len(_POWERS[0]) < n:
        steps = np.full(2 * n, 0x9E3779B97F4A7C15, np.uint64)
        steps[0] = 1
        _POWERS[0] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0]


def text_prints(text: bytes | None) -> np.ndarray:
    """64-bit fingerprints of a text's words, A-Z lower-cased, in order. All words at once, and nothing is remembered:
    a worker's memory doesn't grow with the vocabulary."""
    if not text:
        return np.empty(0, np.uint64)
    letters = _LETTERS[np.frombuffer(text, np.uint8)]
    inside = letters != 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if inside[0]:
        starts = np.concatenate([[0], starts])
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = np.diff(starts, append=len(letters))  # with the white space after a word, which counts as 0
    letters = letters[starts[0] :]
    letters *= _powers(int(sizes.max()))[np.arange(len(letters), dtype=np.int32) - np.repeat((starts - starts[0]).astype(np.int32), sizes)]
    return mixed(np.add.reduceat(letters, starts - starts[0]))


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums and products of fingerprints spread over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * _M2
    x = x ^ (x >> np.uint64(29))
    x = x * _M1
    return x ^ (x >> np.uint64(32))


#: Lower-cases A-Z and makes every white space a blank; and the low bytes of eight that a word's last 0 to 8 letters fill.
_PLAIN = bytes(0x20 if b in range(0x09, 0x0E) else b for b in bytes(range(256)).lower())
_FILLED = np.array([256**n - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG = 64


def all_prints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit fingerprints of the words of many texts, A-Z lower-cased, in order, and how many each text has. The letters
    are only looked at for white space; then each word is read 8 letters at a time. Not those of ``text_prints``."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    n = int(edges[-1] - edges[0])
    plain = data.slice(int(edges[0]), n).to_pybytes().translate(_PLAIN) if n else b""
    edges = edges - edges[0]
    letters = np.frombuffer(plain + bytes(16 - n % 8), np.uint8)
    inside = letters[:n] != 0x20
    first, last = inside.copy(), inside.copy()
    first[1:] = inside[1:] > inside[:-1]
    last[:-1] = inside[:-1] > inside[1:]
    opens, closes = edges[:-1][edges[:-1] < n], edges[1:][edges[1:] > 0] - 1
    first[opens], last[closes] = inside[opens], inside[closes]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts

    blocks = letters.view("<u8")

    def eight(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        block, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        found = blocks[block] >> shift | blocks[block + 1] << np.uint64(1) << (np.uint64(63) - shift)
        return found & _FILLED[np.minimum(left, 8)]

    out = mixed(eight(starts, sizes) ^ sizes.astype(np.uint64) * _M2)
    for done in range(8, _LONG, 8):
        more = np.flatnonzero(sizes > done)
        if not len(more):
            break
        out[more] = mixed(out[more] * _M1 + eight(starts[more] + done, sizes[more] - done))
    for i in np.flatnonzero(sizes > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(plain[starts[i] : starts[i] + sizes[i]])
    return out, np.diff(np.searchsorted(starts, edges))


def shingle_prints(words: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of each run of n words; one fingerprint of the whole sequence if it has fewer, none if empty."""
    n = min(n, len(words))
    if not n:
        return words[:0]
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mixed(out * _M1 + words[i : len(words) - n + 1 + i])
    return out


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, like bytes together."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where in sorted keys each bucket, named by the top bits, begins and ends."""
    if not bits:
        return np.array([0, len(keys)])
    edges = np.arange(1, 2**bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of an array, in order of their first places, and which of them is at each place."""
    encoded = pa.array(x).dictionary_encode()
    return encoded.dictionary.to_numpy(zero_copy_only=False), encoded.indices.to_numpy(zero_copy_only=False)


def numbered_codes(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of an array of numbers below 2**bits, in some order, which of them is at each place, and a
    place of each. A number and its place are sorted as one, where 64 bits hold both."""
    places = len(x).bit_length()
    if bits + places > 64:
        found, own = numbered(x)
        at = np.empty(len(found), np.int64)
        at[own] = np.arange(len(x))
        return found, own, at
    both = x.astype(np.uint64) << np.uint64(places) | np.arange(len(x), dtype=np.uint64)
    both.sort()
    at = (both & np.uint64(2**places - 1)).astype(np.int64)
    both >>= np.uint64(places)
    new = np.ones(len(x), bool)
    new[1:] = both[1:] != both[:-1]
    own = np.empty(len(x), np.int32)
    own[at] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return both[new].astype(np.int64), own, at[new]


def ragged(parts: Iterable[np.ndarray], dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The parts end to end, and the place where each starts."""
    parts = list(parts)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    return (np.concatenate(parts) if parts else np.empty(0, dtype)).astype(dtype, copy=False), np.cumsum(sizes) - sizes


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; ``TOKENIZERS_DIR`` overrides the installed package."""
    if os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(os.environ["TOKENIZERS_DIR"], name)
    import public_tokenizers

    return public_tokenizers.path(name)
