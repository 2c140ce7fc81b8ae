"""SimHash near-duplicates over BK-trees.

Every document gets a 64-bit SimHash of its word shingles.  Distinct
fingerprints are cut into three bands; two fingerprints that differ in at most
two bits agree in at least one whole band (pigeonhole), so the fingerprints
sharing a band value form a shard in which all their links lie.  Each shard is
held as BK-trees, whose children are keyed by the integer Hamming distance to
their parent.  A band value with more than ``SHARD`` fingerprints is cut into
several trees, and each tree is sent to every slice of the fingerprints of its
band value, so no task holds more than two slices.  A search follows only the
edges within the radius of its distance to a node.

A shard returns a star per group of linked fingerprints instead of all its
pairs; the stars are joined to components by alternating large-star and
small-star steps.

Defined cases: null, empty and blank texts have no words and the fingerprint
zero, linked like any other; fewer words than a shingle has give one shingle;
equal texts, and different texts with one fingerprint, are linked; a null
doc_id takes part but never names a component unless no other id is in it; an
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpost.llm.base import free, partitions, ship, stored
from watchpost.llm.components import components

#: Fingerprints in one BK-tree at most.
SHARD = 32_768
#: Fingerprints whose shards are built and searched together.
_TOGETHER = 200_000
#: Pairs of a fingerprint and a tree node that a search looks at together.
_FRONTIER = 1 << 20
_BANDS = ((0, 21), (21, 21), (42, 22))


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit SimHash of a text: bit set where over half of the shingles' XXH64 have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts)
    )
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i:i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, tie, fp): a hash of the text and its SimHash, as signed 64-bit integers, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [*batch.columns[:2], pa.array(np.array(got, np.uint64).view(np.int64))], ["doc_id", "tie", "fp"]
            )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("tie"), text).mapInArrow(
        run, "doc_id long, tie long, fp long"
    )


def _grow(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all groups at once: their roots, and the sorted edge codes with the child of each.

    An edge code is 65 times the parent's number plus the distance to it, so
    the children of a node within a range of distances lie side by side.
    """
    parent = np.full(len(fp), -1, np.int64)
    edge = np.zeros(len(fp), np.int64)
    items, key = np.arange(len(fp)), group.astype(np.int64)
    roots = None
    while len(items):
        order = np.argsort(key, kind="stable")
        items, key = items[order], key[order]
        first = np.ones(len(items), bool)
        first[1:] = key[1:] != key[:-1]
        nodes = items[first]
        if roots is None:
            roots = nodes
        under = nodes[np.cumsum(first) - 1][~first]
        items = items[~first]
        parent[items] = under
        edge[items] = np.bitwise_count(fp[items] ^ fp[under])
        key = under * 65 + edge[items]
    children = np.flatnonzero(parent >= 0)
    codes = parent[children] * 65 + edge[children]
    order = np.argsort(codes)
    return (np.zeros(0, np.int64) if roots is None else roots), codes[order], children[order]


def _search(fp: np.ndarray, codes: np.ndarray, children: np.ndarray, query: np.ndarray,
            node: np.ndarray, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) within the radius, starting from the given nodes."""
    stack = [(query, node)]
    while stack:
        query, node = stack.pop()
        if len(query) > _FRONTIER:
            stack.append((query[_FRONTIER:], node[_FRONTIER:]))
            query, node = query[:_FRONTIER], node[:_FRONTIER]
        apart = np.bitwise_count(asked[query] ^ fp[node]).astype(np.int64)
        near = apart <= radius
        if near.any():
            yield query[near], node[near]
        low = np.searchsorted(codes, node * 65 + np.maximum(apart - radius, 0))
        count = np.searchsorted(codes, node * 65 + np.minimum(apart + radius, 64), "right") - low
        total = int(count.sum())
        if total:
            at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            stack.append((np.repeat(query, count), children[at]))


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of each pair; a set is named by its smallest member."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def _stars(block: np.ndarray, fp: np.ndarray, tree: np.ndarray, asks: np.ndarray,
           radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) that link what lies within the radius inside each block."""
    fp = fp.view(np.uint64)
    label = np.arange(len(fp))
    inside = np.flatnonzero(tree)
    if len(inside):
        roots, codes, children = _grow(block[inside], fp[inside])
        root_of = np.full(int(block.max()) + 1, -1, np.int64)
        root_of[block[inside][roots]] = roots
        query = np.flatnonzero(asks & (root_of[block] >= 0))
        for q, n in _search(fp[inside], codes, children, query, root_of[block[query]], fp, radius):
            label = _unite(label, q, inside[n])
    tied = np.flatnonzero(label != np.arange(len(fp)))
    return fp[tied].view(np.int64), fp[label[tied]].view(np.int64)


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links."""
    if not 0 <= radius <= 2:
        raise ValueError("three bands prove links of at most two bits")
    spark = prints.sparkSession
    bands = F.array(*[
        F.struct(F.lit(i).alias("band"),
                 F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)).alias("value"))
        for i, (at, width) in enumerate(_BANDS)
    ])
    keys = prints.select("fp", F.inline(bands)).select("band", "value", "fp")
    large = keys.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD)
    slices = F.coalesce(F.ceil(F.col("n") / F.lit(SHARD)), F.lit(1)).cast("int")
    dealt = keys.join(large, ["band", "value"], "left").select(
        "band", "value", "fp", slices.alias("n"),
        F.pmod(F.xxhash64("fp"), slices).cast("int").alias("own"),
    )
    # One row per pair of slices that the fingerprint's slice belongs to.
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    blocks = dealt.select("band", "value", "fp", "own", other.alias("other")).select(
        "band", "value", "fp", "own",
        F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("asks"),
    )
    block = ["band", "value", "tree", "asks"]
    cut = (block, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
            cols = {c: rows.column(c).to_numpy() for c in rows.column_names}
            new = np.zeros(len(rows), bool)
            new[:1] = True
            for c in cut[0]:
                new[1:] |= cols[c][1:] != cols[c][:-1]
            end = len(rows) if last else int(np.flatnonzero(new)[-1])
            number = np.cumsum(new)[:end] - 1
            size = np.bincount(number, minlength=1)[number] if end else number
            some = np.flatnonzero(size > 1)  # a fingerprint alone in its band value has no link
            own, tree, asks = (cols[c][:end][some] for c in ("own", "tree", "asks"))
            a, b = _stars(number[some], cols["fp"][:end][some], own == tree, own == asks, cut[1])
            return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"]), rows.slice(end)

        for batch in batches:
            held.append(batch)
            if sum(len(x) for x in held) >= _TOGETHER:
                out, rest = solve(pa.Table.from_batches(held), False)
                yield out
                held = rest.to_batches()
        if held:
            yield solve(pa.Table.from_batches(held), True)[0]

    ready = blocks.repartition(partitions(spark), *block).sortWithinPartitions(*block)
    return ready.select("fp", "own", *block).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, tie, fp, root, component_id) per document: its SimHash, and the smallest doc_id it is linked to.

    ``shingle`` is the number of words of a shingle, ``radius`` the most bits
    by which linked fingerprints differ.  ``tie`` is a hash of the text, ``root``
    the smallest fingerprint that it is linked to.
    """
    ship(docs.sparkSession)
    prints = stored(fingerprints(docs, shingle), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = stored(links(nodes.select("fp"), radius).distinct(), "simhash-links")
    member = components(edges)
    named = nodes.join(member.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = named.join(smallest, "root").select("fp", "root", "component_id")
    return prints.join(label, "fp").select("doc_id", "tie", "fp", "root", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The documents with one of each group of near-duplicates, that of the smallest doc_id.

    A null doc_id gives way to any other; of rows that share the smallest one
    the smallest by a hash of the text stays, and of equal rows one.
    """
    found = near_duplicates(docs, shingle, radius)
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("best")
    doc, tie = free(docs, "__doc_id", "__tie")
    kept = found.groupBy("root").agg(best).select(F.col("best.doc_id").alias(doc), F.col("best.tie").alias(tie))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (
        F.xxhash64(docs["text"].cast("string")) == F.col(tie)
    )
    return docs.join(kept, same).dropDuplicates([doc, tie]).select(*[docs[c] for c in docs.columns])
