"""N-gram Jaccard join by MinHash banding.

Texts are compared on their sets of ``n``-word shingles (a text with fewer words
is one shingle). ``bands`` x ``rows`` MinHash values follow from the target recall: the band
count is the least that finds a pair of similarity ``threshold`` with probability
``recall``. Each band is one hash, and a shuffle on band hashes ties the texts of
a bucket to the bucket's smallest key (a star, not all pairs).

A star's edge stands only if the sketches of its texts, one byte of each MinHash value, agree in
``SKETCH_SHARE`` of all places or more; a pair over the threshold misses that less often than
once in 10^6. A bucket in which all edges stand is one group. In any other bucket all texts are compared by sketch, so
chance collisions never tie groups together and no pair of a bucket is lost.

Inside a group every pair of different texts is verified on its full shingle sets, as sorted
hashes, in blocks of at most ``BLOCK`` texts and about ``BLOCK_SHINGLES`` hashes: a task holds two
blocks, and returns link counts and a spanning forest, never pairs. Classes are the components of
verified links.

Everything is keyed by the text's digest, so exact copies are one text and repeated doc_ids
don't matter.

Defined results for odd input: null and wordless texts have no shingles and are classes of equal texts
(null equals null) with 0 links; a class id is the smallest doc_id of the class, null if all its rows have none; rows that share a doc_id
are separate rows, each with the class of its own text, and classes that share their smallest doc_id share the id;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclens.llm.common import Scratch, written
from srclens.llm.components import connected_components

N = 5
THRESHOLD = 0.8
ROWS = 6
RECALL = 0.9999
#: Texts and shingle hashes in one side of a verification block; a longer text is a block of its own.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
#: Texts in one side of a block of sketches.
SKETCH_BLOCK = 4096
#: Share of equal sketch bytes of a candidate pair; the estimate's deviation at 0.8 is 0.03.
SKETCH_SHARE = 0.65
#: Columns of the shingle-by-text matrix that are multiplied at once.
CHUNK = 4096
#: Words whose hashes a Python worker keeps.
CACHED_WORDS = 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def band_count(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands that find a pair at the threshold with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class Shingler:
    """64-bit shingle hashes of texts; keeps a bounded cache of word hashes."""

    def __init__(self, n: int = N) -> None:
        self.n = n
        self.cache: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at \x20 and \x09-\x0D alone
        if not found:
            return np.empty(0, np.uint64)
        cache = self.cache
        if len(cache) > CACHED_WORDS:
            cache.clear()
        try:
            hashes = [cache[w] for w in found]
        except KeyError:
            for w in set(found):
                if w not in cache:
                    cache[w] = xxhash.xxh3_64_intdigest(w)
            hashes = [cache[w] for w in found]
        h = np.array(hashes, np.uint64)
        k = min(self.n, len(h))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * _MIX
            out ^= out >> np.uint64(29)
        return out


def digest(text: str = "text") -> Column:
    """The key of a text, as :func:`signatures` has it; null has the empty one."""
    return F.coalesce(F.unhex(F.md5(F.col(text).cast("binary"))), F.lit(b""))


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, key`` (digest of the text), ``bands array<bigint>``, ``sketch`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20240229)
        a = rng.integers(1, 1 << 32, (bands * rows, 1), np.uint32) | np.uint32(1)
        b = rng.integers(0, 1 << 32, (bands * rows, 1), np.uint32)
        shingle = Shingler(n)
        for batch in batches:
            keys, found, sketches = [], [], []
            for text in batch.column("text").to_pylist():
                keys.append(b"" if text is None else hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest())
                h = shingle(text)
                if not len(h):
                    found.append([])
                    sketches.append(b"")
                    continue
                h = (h >> np.uint64(32)).astype(np.uint32)
                least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
                for start in range(0, len(h), 512):  # so that the product stays in the cache
                    np.minimum(least, (h[start : start + 512] * a + b).min(axis=1), out=least)
                mixed = np.zeros(bands, np.uint64) + np.arange(bands, dtype=np.uint64)
                for row in least.reshape(bands, rows).T.astype(np.uint64):
                    mixed = (mixed ^ row) * _MIX
                    mixed ^= mixed >> np.uint64(29)
                found.append(mixed.view(np.int64))
                # The upper bits of a minimum are mostly zero; a product spreads all of them.
                sketches.append(((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "key", "bands", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, key binary, bands array<long>, sketch binary")


def _rows_of(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """A matrix of binary values of one length."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


class Forest:
    """Union-find over positions; the root is the smallest key."""

    def __init__(self, keys: list[bytes]) -> None:
        self.keys = keys
        self.root = list(range(len(keys)))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            if self.keys[x] > self.keys[y]:
                x, y = y, x
            self.root[y] = x


def _standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``a, b`` with ``stands``, whether their sketches agree."""
    for batch in batches:
        if batch.num_rows:
            share = (_rows_of(batch.column("sketch_a"), np.uint8) == _rows_of(batch.column("sketch_b"), np.uint8)).mean(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share >= SKETCH_SHARE)], ["a", "b", "stands"])


def _sketch_blocks(key, table):
    """A spanning forest of the pairs of a bucket, or of two blocks of one, whose sketches agree."""
    bi, bj = key[1].as_py(), key[2].as_py()
    keys, sketches = table.column("key").to_pylist(), _rows_of(table.column("sketch"), np.uint8)
    block = np.array(table.column("block").to_pylist())
    forest = Forest(keys)
    left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    for i in left:
        later = right[right > i] if bi == bj else right
        for start in range(0, len(later), 1024):
            part = later[start : start + 1024]
            for j in part[(sketches[part] == sketches[i]).mean(axis=1) >= SKETCH_SHARE]:
                forest.join(int(i), int(j))
    tied = [(keys[x], keys[forest.find(x)]) for x in range(len(keys)) if forest.find(x) != x]
    return pa.table({"a": pa.array([x[0] for x in tied], pa.binary()), "b": pa.array([x[1] for x in tied], pa.binary())})


def _link_blocks(threshold: float):
    def similar(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """Boolean matrix of the pairs at or over the threshold."""
        both = left + right
        ids = np.unique(np.concatenate(both), return_inverse=True)[1]
        owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
        shared = np.bincount(ids) > 1
        use = shared[ids]
        ids, owner = (np.cumsum(shared) - 1)[ids[use]], owner[use]
        order = np.argsort(ids, kind="stable")
        ids, owner = ids[order], owner[order]
        common = np.zeros((len(left), len(right)), np.float32)
        width = int(shared.sum())
        for start in range(0, width, CHUNK):
            lo, hi = np.searchsorted(ids, [start, start + CHUNK])
            cells = np.zeros((len(both), min(CHUNK, width - start)), np.float32)
            cells[owner[lo:hi], ids[lo:hi] - start] = 1
            common += cells[: len(left)] @ cells[len(left) :].T
        size = np.array([len(x) for x in both], np.float64)
        union = size[: len(left), None] + size[None, len(left) :] - common
        return common >= threshold * union - 1e-9

    def run(key, table):
        bi, bj = key[1].as_py(), key[2].as_py()
        keys, block = table.column("key").to_pylist(), np.array(table.column("block").to_pylist())
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        left = np.flatnonzero(block == bi)
        right = left if bi == bj else np.flatnonzero(block == bj)
        count, forest = np.zeros(len(keys), np.int64), Forest(keys)
        if len(left) and len(right):
            links = similar([sets[i] for i in left], [sets[i] for i in right])
            if bi == bj:
                np.fill_diagonal(links, False)
            count[left] += links.sum(axis=1)
            if bi != bj:
                count[right] += links.sum(axis=0)
            for i, j in zip(*np.nonzero(links), strict=True):
                forest.join(int(left[i]), int(right[j]))
        linked = np.flatnonzero(count)
        return pa.table(
            {
                "key": pa.array([keys[x] for x in linked], pa.binary()), "n_links": pa.array(count[linked]),
                "root": pa.array([keys[forest.find(int(x))] for x in linked], pa.binary()),
            }
        )

    return run


def _shingle_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            sets = [np.unique(shingle(x)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("component"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())],
                ["key", "component", "n_shingles", "shingles"],
            )

    return run


def dealt_pairs(df: DataFrame, *columns: str) -> DataFrame:
    """The columns and ``bi, bj``: every row of ``block`` in ``n_blocks`` once for each block that it meets."""
    met = df.select(*columns, "block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
    return met.select(*columns, "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))


def candidate_groups(texts: DataFrame) -> DataFrame:
    """``id, component`` of the texts (``key, bands, sketch``) that share a group with another one."""
    with Scratch(texts.sparkSession) as scratch:
        entries = scratch.written(texts.select("key", F.explode("bands").alias("bucket")), "band-hashes")
        buckets = entries.groupBy("bucket").agg(F.min("key").alias("b"), F.max("key").alias("hi"), F.count("*").alias("n_texts"))
        buckets = scratch.written(buckets.where(F.col("hi") > F.col("b")).drop("hi"), "buckets")
        tied = scratch.written(entries.join(buckets.select("bucket", "b").hint("merge"), "bucket"), "shared-buckets")
        stars = scratch.written(tied.where(F.col("key") != F.col("b")).select(F.col("key").alias("a"), "b").distinct(), "stars")
        sketch = texts.select("key", "sketch")
        both = stars.join(sketch.select(F.col("key").alias("a"), F.col("sketch").alias("sketch_a")).hint("merge"), "a")
        both = both.join(sketch.select(F.col("key").alias("b"), F.col("sketch").alias("sketch_b")).hint("merge"), "b")
        stars = scratch.written(both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_standing, "a binary, b binary, stands boolean"), "sketched-stars")
        # Buckets with an edge that doesn't stand are looked at pair by pair.
        weak = stars.where(~F.col("stands")).select(F.col("a").alias("key"), "b")
        mixed = tied.join(weak, ["key", "b"], "left_semi").select("bucket").distinct()
        mixed = scratch.written(buckets.join(mixed, "bucket", "left_semi").select("bucket", F.ceil(F.col("n_texts") / SKETCH_BLOCK).cast("int").alias("n_blocks")), "mixed-buckets")
        members = tied.join(mixed, "bucket").join(sketch, "key")
        members = members.withColumn("block", F.pmod(F.xxhash64("key"), "n_blocks").cast("int"))
        pairs = dealt_pairs(members, "bucket", "key", "sketch").groupBy("bucket", "bi", "bj").applyInArrow(_sketch_blocks, "a binary, b binary")
        return connected_components(stars.where("stands").select("a", "b").unionByName(pairs))


_ROW_KEY = ["_none", "_id", "_key"]


def _row_key(doc_id: Column, key: Column) -> list[Column]:
    """Columns that two rows share if doc_id, null or not, and text are equal; copies under other ids fall elsewhere."""
    return [doc_id.isNull().alias("_none"), F.coalesce(doc_id, F.lit(0)).alias("_id"), key.alias("_key")]


def text_classes(
    docs: DataFrame, n: int = N, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """The rows ``doc_id, key`` and the texts ``key, component, n_copies, n_links, rep`` (smallest doc_id of the text)."""
    bands = band_count(threshold, rows, recall)
    signed = written(signatures(docs, n, bands, rows), "signatures")
    texts = signed.groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    with Scratch(docs.sparkSession) as scratch:
        texts = scratch.written(texts, "texts")
        groups = candidate_groups(texts.where(F.size("bands") > 0))
        # Members may be as many as documents, so both sides are always shuffled; of copies only the smallest doc_id's text goes on.
        members = groups.withColumnRenamed("id", "key").join(texts.select("key", "rep"), "key").select("component", *_row_key(F.col("rep"), F.col("key")))
        with_text = docs.select(*_row_key(F.col("doc_id").cast("long"), digest()), "text").join(members.hint("merge"), _ROW_KEY)
        with_text = with_text.groupBy(*_ROW_KEY, "component").agg(F.first("text").alias("text"))
        sets = scratch.written(
            with_text.select(F.col("_key").alias("key"), "component", "text").mapInArrow(_shingle_sets(n), "key binary, component binary, n_shingles long, shingles binary"), "shingle-sets"
        )
        sizes = sets.groupBy("component").agg(
            F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("n_blocks")
        )
        members = sets.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("key"), "n_blocks").cast("int"))
        dealt = dealt_pairs(members, "component", "key", "shingles")
        linked = dealt.groupBy("component", "bi", "bj").applyInArrow(_link_blocks(threshold), "key binary, n_links long, root binary")
        linked = scratch.written(linked, "links")
        classes = connected_components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")))
        counts = linked.groupBy("key").agg(F.sum("n_links").alias("n_links")).join(classes.withColumnRenamed("id", "key"), "key")
        out = texts.select("key", "rep", "n_copies").join(counts, "key", "left").select(
            "key", "rep", "n_copies", F.coalesce("component", "key").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
        )
        return signed.select("doc_id", "key"), written(out, "text-classes")


def similarity_classes(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, class_id, n_copies, n_links`` for every row of ``docs``.

    ``class_id``: the smallest doc_id that copies and links lead to; ``n_copies``: rows
    with the same text, itself included; ``n_links``: different texts of
    similarity ``threshold`` or more.
    """
    signed, texts = text_classes(docs, **options)
    classes = texts.groupBy("component").agg(F.min("rep").alias("class_id"))
    of_text = texts.join(classes, "component").select("key", "class_id", "n_copies", "n_links")
    return signed.join(of_text, "key").select("doc_id", "class_id", "n_copies", "n_links")


def keep_one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, with the columns of ``docs``: the smallest doc_id, nulls last, then digest and row hash."""
    signed, texts = text_classes(docs, **options)
    best = texts.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "key")).alias("best"))
    kept = best.select(*_row_key(F.col("best.rep"), F.col("best.key")))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *_row_key(F.col("doc_id").cast("long"), digest()))
    out = held.join(kept.hint("merge"), _ROW_KEY, "left_semi")
    first = Window.partitionBy(*_ROW_KEY).orderBy(F.xxhash64("doc"))
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("doc.*")
