"""MinHash near-duplicates by one-permutation hashing.

A document's set of word shingles is hashed once per shingle.  The top bits of
a hash name one of ``_BINS`` bins, whose least hash is its entry; an empty bin
takes the entry of the first filled bin in an order of its own (optimal
densification, Shrivastava 2017).  ``_ROWS`` bins at a time make a band, whose
entries name a bucket.  Two sets of similarity 0.8 share none of the 32 buckets
with a chance of 5 in 10^8.

1.  Equal word sequences are one class.  In each bucket every class is tied to
    the bucket's smallest one: a star, not all pairs.  Star edges are confirmed
    on the whole shingle sets and joined to components.
2.  What the stars cannot tell: classes of one bucket that are still in
    different components.  Buckets holding such classes, their centre aside
    (it has met them all), are cut into slices of bounded size, and each pair
    of slices is searched through an index of its shingles; only links come
    out, as stars.  So no link between texts sharing a bucket is lost, and
    nothing is capped.

Defined cases: null, empty and blank texts have no shingles and are linked with
nothing, not even with each other; a text of fewer words than a shingle has is
one shingle; equal and repeated rows are linked; a null doc_id takes part but
never names a component unless no other id is in it; an empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpost.llm.base import partitions, ship, stored
from watchpost.llm.components import components

#: Bins of the one permutation, and how many of them make a band.
_BINS, _ROWS = 128, 4
_SHIFT = np.uint64(64 - 7)
#: Shingles of a slice of a bucket, about.
_SLICE = 1_000_000
#: Counts of common shingles held at once.
_COUNTS = 4_000_000


def _orders() -> np.ndarray:
    """For each bin the rank of every other in the order in which it looks for an entry."""
    rng = np.random.default_rng(13)
    return np.array([rng.permutation(_BINS) for _ in range(_BINS)], np.uint8)


_RANK = _orders()
_SEEDS = np.random.default_rng(31).integers(1, 1 << 63, _BINS // _ROWS, dtype=np.uint64)
_PRIME = np.uint64(0x9E3779B185EBCA87)


def shingles(words: list[bytes], size: int) -> set[bytes]:
    """The distinct shingles; a shorter sequence is one, no words are none."""
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    if size == 2:
        return set(map(b"%b %b".__mod__, zip(words, words[1:], strict=False)))
    return {b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)}


def buckets(own: set[bytes]) -> np.ndarray:
    """The bucket of each band, as signed 64-bit integers."""
    digest = xxhash.xxh64_intdigest
    hashes = np.sort(np.fromiter((digest(s, 13) for s in own), np.uint64, len(own)))
    bins = (hashes >> _SHIFT).astype(np.intp)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    filled = bins[first]
    entry = np.zeros(_BINS, np.uint64)
    entry[filled] = hashes[first]
    if len(filled) < _BINS:
        empty = np.ones(_BINS, bool)
        empty[filled] = False
        entry[empty] = hashes[first][_RANK[empty][:, filled].argmin(axis=1)]
    mixed = _SEEDS.copy()
    for column in entry.reshape(-1, _ROWS).T:
        mixed = (mixed ^ column) * _PRIME
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def _prints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, key, n, slots, words): a digest of the words, the size of the set, its buckets, the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, slots, joined = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                line = b" ".join(words)
                own = shingles(words, size)
                key.append(hashlib.blake2b(line, digest_size=16).digest() if own else None)
                n.append(len(own))
                slots.append(buckets(own) if own else np.zeros(0, np.int64))
                joined.append(line)
            bounds = np.concatenate(([0], np.cumsum([len(s) for s in slots]))).astype(np.int32)
            values = pa.array(np.concatenate([*slots, np.zeros(0, np.int64)]))
            yield pa.record_batch(
                [batch.column(0), pa.array(key, pa.binary()), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(bounds), values), pa.array(joined, pa.binary())],
                ["doc_id", "key", "n", "slots", "words"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, key binary, n long, slots array<long>, words binary"
    )


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) of the pairs (centre, key) whose sets are similar enough."""
    other = texts.select("key", F.col("words").alias("theirs"))
    centre = texts.select(F.col("key").alias("centre"), F.col("words").alias("ours"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, set()
        for batch in batches:
            a, b, ours, theirs = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for i, (x, text, against) in enumerate(zip(a, ours, theirs, strict=True)):
                if x != last:
                    last, mine = x, shingles(text.split(), size)
                found = shingles(against.split(), size)
                common = len(mine & found)
                if 100 * common >= percent * (len(mine) + len(found) - common):
                    keep.append(i)
            yield pa.record_batch([pa.array([a[i] for i in keep], pa.binary()),
                                   pa.array([b[i] for i in keep], pa.binary())], ["a", "b"])

    ready = pairs.join(other, "key").join(centre, "centre").select("centre", "key", "ours", "theirs")
    return ready.mapInArrow(run, "a binary, b binary")


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of each pair; a set is named by its smallest member."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _search(roots: np.ndarray, texts: list[bytes], size: int, percent: int) -> np.ndarray:
    """The label of each row once all links between different roots are joined."""
    ids: dict[bytes, int] = {}
    sets = []
    for text in texts:
        own = shingles(text.split(), size)
        sets.append(np.fromiter((ids.setdefault(s, len(ids)) for s in own), np.int64, len(own)))
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    posting, edge = row[order], np.searchsorted(every[order], np.arange(len(ids) + 1))
    label = np.arange(len(sets))
    # Rows of the most common root meet the others as those search.
    asks = np.flatnonzero(roots != np.bincount(roots).argmax())
    at = 0
    while at < len(asks):
        some, total = [], 0
        while at < len(asks) and (not some or total < _COUNTS):
            some.append(asks[at])
            total += len(sets)
            at += 1
        for q in some:
            own = sets[q]
            places = np.concatenate([posting[edge[s]:edge[s + 1]] for s in own])
            common = np.bincount(places, minlength=len(sets))
            near = np.flatnonzero((100 * common >= percent * (n + n[q] - common)) & (roots != roots[q]))
            if len(near):
                _unite(label, np.full(len(near), q), near)
    return label


def _rest(met: DataFrame, texts: DataFrame, member: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) between classes of one bucket and different components that no star has met.

    ``met`` has the slot, key and n of every class that shares a bucket with a centre.
    """
    spark = met.sparkSession
    rows = met.select("slot", "key", "n").join(member.withColumnRenamed("node", "key"), "key", "left").select(
        "slot", "key", "n", F.coalesce("root", "key").alias("root")
    )
    open_ = rows.groupBy("slot").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.sum("n").alias("total")
    ).where(F.col("least") != F.col("most"))
    slices = F.ceil(F.col("total") / F.lit(_SLICE)).cast("int")
    dealt = stored(rows.join(open_.select("slot", slices.alias("slices")), "slot"), "minhash-rest")
    if dealt.isEmpty():
        return spark.createDataFrame([], "a binary, b binary")
    own = F.pmod(F.xxhash64("key"), F.col("slices")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    blocks = dealt.select("slot", "key", "root", own.alias("own"), other.alias("other")).select(
        "slot", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "key", "root"
    )
    block = ["slot", "low", "high"]
    ready = blocks.join(texts, "key").repartition(
        partitions(spark), *block
    ).sortWithinPartitions(*block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, bytes]] = []
        now = None

        def solved() -> pa.RecordBatch:
            keys, roots, texts = zip(*held, strict=True)
            number: dict[bytes, int] = {}
            label = _search(np.array([number.setdefault(r, len(number)) for r in roots]), list(texts), size, percent)
            tied = np.flatnonzero(label != np.arange(len(label)))
            return pa.record_batch([pa.array([keys[i] for i in tied], pa.binary()),
                                    pa.array([keys[label[i]] for i in tied], pa.binary())], ["a", "b"])

        for batch in batches:
            slot, low, high, key, root, words = (batch.column(i).to_pylist() for i in range(6))
            for i, this in enumerate(zip(slot, low, high, strict=True)):
                if this != now:
                    if len(held) > 1:
                        yield solved()
                    held, now = [], this
                held.append((key[i], root[i], words[i]))
        if len(held) > 1:
            yield solved()

    return ready.select(*block, "key", "root", "words").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of each document's set, and the smallest doc_id it is linked to.

    ``size`` is the number of words of a shingle, ``percent`` the least
    similarity (common shingles to all shingles of the two sets) of a link.
    The bands are made for 80 and more; lower ones raise.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the bands find links of 80 percent and more")
    ship(docs.sparkSession)
    prints = stored(_prints(docs, size), "minhash")
    classes = stored(
        prints.where("n > 0").select("key", "n", "slots", "words").dropDuplicates(["key"]), "minhash-classes"
    )
    texts = classes.select("key", "words")
    rows = classes.select("key", "n", F.explode("slots").alias("slot"))
    head = F.min(F.struct("key", "n")).alias("head")
    heads = rows.groupBy("slot").agg(head, F.count(F.lit(1)).alias("members")).where("members > 1").select(
        "slot", F.col("head.key").alias("centre"), F.col("head.n").alias("centre_n")
    )
    met = stored(rows.join(heads, "slot").where(F.col("key") != F.col("centre")), "minhash-met")
    similar = F.least("n", "centre_n") * 100 >= F.greatest("n", "centre_n") * percent
    pairs = met.where(similar).select("centre", "key").distinct()
    edges = stored(_confirmed(pairs, texts, size, percent), "minhash-links")
    member = components(edges)
    more = stored(_rest(met, texts, member, size, percent), "minhash-more")
    member = components(member.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    first = prints.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"))
    named = first.join(member.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "first", F.coalesce("root", "key").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = named.join(smallest, "root").select("key", "component_id")
    found = prints.select("doc_id", "key", "n").join(label, "key", "left")
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
