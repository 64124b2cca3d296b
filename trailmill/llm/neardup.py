"""MinHash near-duplicates: banded signatures, verification on full shingle sets, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mixed, pack_sorted, ragged, release, shingle_prints, sliced, spread_join, text_prints, unpack_sorted
from .components import components


@dataclass(frozen=True)
class MinHash:
    """40 bands of 4 minima: a pair at the threshold of 0.75 misses every band with probability 2.6e-7."""

    bands: int = 40
    rows: int = 4
    shingle: int = 5
    percent: int = 75
    seed: int = 5
    #: Least share of equal minima that signature verification lets through: five deviations below the threshold.
    least_match: float = 0.55

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct fingerprints of a text's n-word shingles."""
    return np.unique(shingle_prints(text_prints(text), n))


def minima(sets: list[np.ndarray], how: MinHash) -> np.ndarray:
    """For each (non-empty) set and each universal hash a * x + b mod 2**64, the least value."""
    rng = np.random.default_rng(how.seed)
    a = rng.integers(0, 2**63, how.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**64, how.hashes, dtype=np.uint64, endpoint=False)
    out = np.empty((len(sets), how.hashes), np.uint64)
    begin = 0
    while begin < len(sets):  # runs that stay in the cache
        end, n = begin, 0
        while end < len(sets) and (end == begin or n + len(sets[end]) <= 32_768):
            n += len(sets[end])
            end += 1
        x, starts = ragged(sets[begin:end], np.uint64)
        y = np.empty_like(x)
        for j in range(how.hashes):
            np.multiply(x, a[j], out=y)
            np.add(y, b[j], out=y)
            out[begin:end, j] = np.minimum.reduceat(y, starts)
        begin = end
    return out


SKETCH = "struct<n:bigint,print:binary,bands:array<bigint>,sketch:binary>"
_SKETCH_KINDS = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]


def _sketched(texts: pa.Array, how: MinHash) -> pa.Array:
    sets = [shingle_set(t.as_py(), how.shingle) for t in texts]
    full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    low = mixed(minima([sets[i] for i in full], how))
    keys = np.zeros((len(full), how.bands), np.uint64)
    for r in range(how.rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, r :: how.rows])
    keys = mixed(keys + np.arange(how.bands, dtype=np.uint64)).view(np.int64)
    own = (low & np.uint64(0xFFFF)).astype("<u2")
    prints, sketches = [None] * len(sets), [None] * len(sets)
    for j, i in enumerate(full.tolist()):
        prints[i], sketches[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), own[j].tobytes()
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.zeros(len(sets) + 1, np.int32)
    np.cumsum(np.where(n > 0, how.bands, 0), out=ends[1:])
    bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
    return pa.StructArray.from_arrays([pa.array(n), pa.array(prints, pa.binary()), bands, pa.array(sketches, pa.binary())], ["n", "print", "bands", "sketch"])


def _sketches(how: MinHash) -> Callable:
    @F.arrow_udf(SKETCH)
    def sketches(texts: pa.Array) -> pa.Array:
        out = [_sketched(part, how) for part in sliced(texts)]
        release()
        return pa.concat_arrays(out) if out else pa.array([], pa.struct(list(zip(("n", "print", "bands", "sketch"), _SKETCH_KINDS))))

    return sketches


def _sets(text: Column, how: MinHash) -> Column:
    """The texts' sets, packed: shingled once for all comparisons that follow."""

    @F.arrow_udf("binary")
    def sets(texts: pa.Array) -> pa.Array:
        out = pa.array((pack_sorted(shingle_set(t.as_py(), how.shingle)) for t in texts), pa.binary())
        release()
        return out

    return sets(text)


def _match(a: Column, b: Column) -> Column:
    """Share of equal minima of two sketches."""

    @F.arrow_udf("double")
    def match(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([float((np.frombuffer(x.as_py(), "<u2") == np.frombuffer(y.as_py(), "<u2")).mean()) for x, y in zip(a, b)], pa.float64())

    return match(a, b)


def _verify(how: MinHash) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by hub and chunk, the hub's own set first: the pairs whose sets are similar enough."""
        at, hubs = None, []
        for batch in batches:
            us, vs = [], []
            for hub, chunk, role, own, packed in zip(*(batch[c].to_pylist() for c in ("hub", "chunk", "role", "id")), batch["set"]):
                shingles = unpack_sorted(packed.as_py())
                if at != (hub, chunk):
                    at, hubs = (hub, chunk), []
                if role == 0:  # more than one, where rows of several texts share an id
                    hubs.append(shingles)
                elif any(similar(shingles, held, how.percent) for held in hubs):
                    us.append(own)
                    vs.append(hub)
            yield pa.RecordBatch.from_pydict({"u": us, "v": vs}, pa.schema([("u", batch.schema.field("id").type), ("v", batch.schema.field("hub").type)]))
        release()

    return verify


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def verified(pairs: DataFrame, pool: DataFrame, how: MinHash) -> DataFrame:
    """Of the pairs ``id, hub``, those whose sets are similar, as ``u, v``. A hub with many partners is dealt out in
    chunks with a copy of its set each; a task holds one hub's set at a time."""
    times = pairs.groupBy("hub").agg(F.count("*").alias("times"))
    chunk = F.pmod(F.xxhash64("id"), F.floor(F.col("times") / 64) + 1).alias("chunk")
    members = spread_join(pairs, times, "hub", "id").select("id", "hub", chunk, F.lit(1).alias("role"))
    hubs = members.select(F.col("hub").alias("id"), "hub", "chunk", F.lit(0).alias("role")).distinct()
    rows = members.unionByName(hubs).join(pool, "id").repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "role")
    kind = dict(pairs.dtypes)["id"]
    return rows.mapInArrow(_verify(how), f"u {kind}, v {kind}")


#: Classes that live in one block; a task holds them and the strangers that visit them.
BLOCK = 512


def _promising(how: MinHash) -> Callable[[pa.Table], pa.Table]:
    def promising(rows: pa.Table) -> pa.Table:
        """The classes of a block that are similar to some class of another component there, by signature. A pair is one
        of a stranger and a class that lives in the block; two strangers meet where the one of larger id lives."""
        known, ids = rows["component"].to_numpy(zero_copy_only=False), rows["id"].to_numpy(zero_copy_only=False)
        strange, lives = rows["strange"].to_numpy(zero_copy_only=False), ~rows["visits"].to_numpy(zero_copy_only=False)
        sketch = np.stack([np.frombuffer(x.as_py(), "<u2") for x in rows["sketch"]])
        wanted, here = np.zeros(len(ids), bool), np.flatnonzero(lives)
        for x in np.flatnonzero(strange):
            others = here[(known[here] != known[x]) & (~strange[here] | (ids[here] > ids[x]))]
            near = others[(sketch[others] == sketch[x]).mean(axis=1) >= how.least_match]
            wanted[near] = True
            wanted[x] |= len(near) > 0
        release()
        return rows.filter(pa.array(wanted)).drop_columns(["sketch"])

    return promising


def _block(how: MinHash) -> Callable[[pa.Table], pa.Table]:
    def block(rows: pa.Table) -> pa.Table:
        """All pairs of a stranger and a class that lives in the block, counted on full sets: edges that span what is
        similar there.

        Each set's intersections with all others come from one count over the postings of its shingles.
        """
        ids, known = rows["id"].to_pylist(), rows["component"].to_pylist()
        strange, lives = rows["strange"].to_numpy(zero_copy_only=False), ~rows["visits"].to_numpy(zero_copy_only=False)
        sets = [unpack_sorted(x.as_py()) for x in rows["set"]]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        values, _ = ragged(sets, np.uint64)
        owner = np.repeat(np.arange(len(sets)), n)
        found, number = np.unique(values, return_inverse=True)
        order = np.argsort(number, kind="stable")
        posted, begins = owner[order], np.searchsorted(number[order], np.arange(len(found) + 1))
        parent = list(range(len(sets)))
        first: dict = {}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, component in enumerate(known):  # what is linked already needs no edge
            parent[x] = first.setdefault(component, x)
        us, vs = [], []
        ends = np.cumsum(n)
        for x in np.flatnonzero(strange):
            own = number[ends[x] - n[x] : ends[x]]
            size = begins[own + 1] - begins[own]
            at = np.repeat(begins[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
            common = np.bincount(posted[at], minlength=len(sets))
            for y in np.flatnonzero((100 * common >= how.percent * (n + n[x] - common)) & lives & (n > 0)):
                a, b = root(x), root(int(y))
                if a != b:
                    parent[a] = b
                    us.append(ids[x])
                    vs.append(ids[y])
        kind = rows.schema.field("id").type
        return pa.table({"u": pa.array(us, kind), "v": pa.array(vs, kind)})

    return block


def _residual(banded: DataFrame, buckets: DataFrame, sketches: DataFrame, pool: DataFrame, of: DataFrame, how: MinHash) -> DataFrame:
    """Edges between components that stars left apart, from every pair that shares a bucket.

    A bucket that holds several components belongs to the largest of them there (ties: the least); of two classes of
    different components in it, one at least is a stranger to that. The classes of all buckets that belong to one
    component live, once each, in blocks of about 512, and its strangers visit all of them: first by signature, then,
    where that is promising, on full sets. A task holds a block and its visitors and sends back only edges that span.
    """
    rows = banded.join(buckets.select("key"), "key").join(of, F.col("id") == of["node"], "left")
    rows = cut(rows.select("key", "id", F.coalesce("component", "id").alias("component")))
    shares = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = F.min(F.struct((-F.col("n")).alias("n"), "component"))["component"].alias("home")
    owners = shares.groupBy("key").agg(largest, F.count("*").alias("kinds")).where("kinds > 1").select("key", "home")
    members = spread_join(rows, owners, "key", "id").select("home", "id", "component").distinct()
    members = cut(members.withColumn("strange", F.col("component") != F.col("home")))
    sizes = members.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = spread_join(members, sizes, "home", "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    places = F.when(F.col("strange"), F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).otherwise(F.array("own"))
    members = members.withColumn("block", F.explode(places)).withColumn("visits", F.col("block") != F.col("own"))
    kind = dict(rows.dtypes)["id"]
    members = members.select("home", "block", "id", "component", "strange", "visits").join(sketches, "id")
    near = members.groupBy("home", "block").applyInArrow(_promising(how), f"id {kind}, home {kind}, block bigint, component {kind}, strange boolean, visits boolean")
    near = cut(near)
    return near.join(pool, "id").groupBy("home", "block").applyInArrow(_block(how), f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, how: MinHash = MinHash(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id, ``n_shingles``, ``component_id`` (smallest id reachable over similar texts) and ``kept``.

    Texts are similar if their sets of distinct 5-word shingles (A-Z lower-cased; with fewer words, the whole
    sequence) have 100 * intersection >= 75 * union. Rows of equal sets form a class, which its smallest id stands
    for. Classes that agree in a band are candidates. Each class is first held against one hub, by signature and then
    on full sets; where buckets still hold several components, these are compared whole, by signature and on full sets. Null and empty texts
    have no shingles and link with nothing; a row with a null id links with nothing, has a null component and is kept.
    Rows that share an id are one node. Other columns are left out; an empty table gives an empty result.
    """
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"))
    made = texts.select("id", _sketches(how)(F.col("text")).alias("s"))
    sketched = cut(made.select("id", "s.n", "s.print", "s.bands", "s.sketch"))
    classes = sketched.where("n > 0 and id is not null").groupBy("print").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = cut(classes)
    banded = reps.select("id", F.explode("bands").alias("key"))
    buckets = cut(banded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1"))
    star = cut(banded.join(buckets, "key").where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("shared")))
    involved = star.select("id").unionByName(star.select(F.col("hub").alias("id"))).distinct()
    # merged at every size: the ids have no bound that would allow sending them to all tasks
    pool = texts.join(involved.hint("merge"), "id", "left_semi")
    pool = cut(pool.select("id", _sets(F.col("text"), how).alias("set")).distinct())

    # Each class tries one hub: the least of those that share half the bands of a pair at the threshold, so that most
    # of a group meets in one, else the one that shares most. What is still apart is compared in blocks.
    likely_hub = F.min(F.when(F.col("shared") >= how.bands * (how.percent / 100) ** how.rows / 2, F.col("hub")))
    best = star.groupBy("id").agg(F.coalesce(likely_hub, F.max_by("hub", F.struct("shared", "hub"))).alias("hub"))
    own, its = reps.select("id", F.col("sketch").alias("own")), reps.select(F.col("id").alias("hub"), F.col("sketch").alias("its"))
    likely = best.join(own, "id").join(its, "hub").where(_match(F.col("own"), F.col("its")) >= how.least_match)
    links = cut(verified(likely.select("id", "hub"), pool, how))
    more = cut(_residual(banded, buckets, reps.select("id", "sketch"), pool, components(links), how))
    of = components(links.unionByName(more))

    rep = reps.select("print", F.col("id").alias("rep")).join(of, F.col("rep") == of["node"], "left").select("print", F.coalesce("component", "rep").alias("component"))
    found = sketched.select("id", "n", "print").join(rep, "print", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    found = found.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, how: MinHash = MinHash(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with the columns they had: of each component, the one of smallest id.

    Where rows share that id, one row of each text stays: the least by a hash of all its columns. Rows with a null id
    stay.
    """
    found = near_duplicates(docs, how, doc_id, text).groupBy(F.col(doc_id).alias("kept id")).agg(F.min("kept").alias("kept row"), F.count("*").alias("times"))
    marked = docs.join(found.where("`kept id` is not null and (not `kept row` or times > 1)"), F.col(doc_id) == F.col("kept id"), "left")
    single = marked.where("`kept id` is null").select(docs.columns)
    alike = Window.partitionBy(doc_id, text).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    again = marked.where("`kept row` and times > 1").withColumn("times", F.row_number().over(alike)).where("times = 1").select(docs.columns)
    return single.unionByName(again)
