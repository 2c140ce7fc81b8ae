"""Token-id files in fixed-width bit packing.

A file set is a folder of Parquet files whose rows are segments.  A segment
holds the ids of some successive documents, each in the fewest bits that the
vocabulary needs, in blocks of ``BLOCK`` ids that start on a byte; block k of a
segment begins at ``block_offsets[k]`` of ``packed``, so any id is reached by
one lookup and the ids of a document are unpacked by numpy from the blocks it
lies in.  Segments are numbered within their shard and shards in ascending
doc_id order; ``first`` is the number of ids before a segment in its shard.

The documents are dealt to shards by ranges of doc_id and sorted in them; a
document longer than ``SEGMENT`` ids is a segment of its own.  Only one number
per shard, its count of ids, reaches the driver.

Defined cases: a null or empty text is the end id alone; rows that repeat a
doc_id are written one after the other, by text; a null doc_id sorts first;
an empty table writes no segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchpost.llm.base import partitions, ship
from watchpost.llm.tokens import encoder, forget

#: Ids of a segment, about, and of a block.
SEGMENT = 1 << 18
BLOCK = 4096

_SCHEMA = (
    "shard int, segment long, first long, n_ids long, bits int, doc_ids array<long>, "
    "starts array<long>, block_offsets array<long>, packed binary"
)


def pack(ids: np.ndarray, bits: int) -> tuple[bytes, list[int]]:
    """The ids in ``bits`` bits each, least significant first, and where each block begins."""
    out, offsets, at = [], [], 0
    for i in range(0, len(ids), BLOCK):
        part = ids[i:i + BLOCK].astype("<u4")
        if bits == 16:
            raw = part.astype("<u2").tobytes()
        else:
            flags = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
            raw = np.packbits(flags.ravel(), bitorder="little").tobytes()
        out.append(raw)
        offsets.append(at)
        at += len(raw)
    return b"".join(out), offsets


def unpack(packed: memoryview | bytes, offsets, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to before ``stop`` of a segment, read from the blocks that hold them."""
    if stop <= start:
        return np.zeros(0, "<u4")
    first, last = start // BLOCK, (stop - 1) // BLOCK
    out = []
    for k in range(first, last + 1):
        end = int(offsets[k + 1]) if k + 1 < len(offsets) else len(packed)
        raw = np.frombuffer(packed, np.uint8, end - int(offsets[k]), int(offsets[k]))
        low, high = max(start - k * BLOCK, 0), min(stop - k * BLOCK, BLOCK)
        if bits == 16:
            out.append(raw.view("<u2")[low:high].astype("<u4"))
            continue
        flags = np.unpackbits(raw, bitorder="little")[: len(raw) * 8 // bits * bits].reshape(-1, bits)[low:high]
        whole = np.zeros((len(flags), 32), np.uint8)
        whole[:, :bits] = flags
        out.append(np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel())
    return np.concatenate(out)


def write(docs: DataFrame, path: str, vocabulary: Callable[[], str], end: int) -> None:
    """Write the ids of every whole text and ``end`` after each, in ascending doc_id order."""
    spark = docs.sparkSession
    ship(spark)

    def segments(shard: int, at: int, number: int, ids: list[bytes], names: list, bits: int) -> dict:
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        every = np.frombuffer(b"".join(ids), "<u4")
        packed, offsets = pack(every, bits)
        return {
            "shard": shard, "segment": number, "first": at, "n_ids": len(every), "bits": bits, "doc_ids": names,
            "starts": (np.cumsum(sizes) - sizes).tolist(), "block_offsets": offsets, "packed": packed,
        }

    kinds = pa.schema([
        ("shard", pa.int32()), ("segment", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()),
        ("bits", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
        ("block_offsets", pa.list_(pa.int64())), ("packed", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), encoder(vocabulary())
        bits = max(1, int(max(enc.size - 1, end)).bit_length())
        mark = np.array([end], "<u4").tobytes()
        held: list[bytes] = []
        names: list[int | None] = []
        size = at = number = 0
        for batch in batches:
            i = 0
            while i < len(batch):
                texts, chars = [], 0
                while i + len(texts) < len(batch) and (not texts or chars < enc.budget.chars):
                    texts.append(batch.column(1)[i + len(texts)].as_py() or "")
                    chars += len(texts[-1])
                for name, raw in zip(batch.column(0).slice(i, len(texts)).to_pylist(), enc.encode(texts), strict=True):
                    if held and size + len(raw) // 4 + 1 > SEGMENT:
                        row = segments(shard, at, number, held, names, bits)
                        yield pa.RecordBatch.from_pylist([row], kinds)
                        at, number, held, names, size = at + size, number + 1, [], [], 0
                    held.append(raw + mark)
                    names.append(name)
                    size += len(raw) // 4 + 1
                i += len(texts)
        if held:
            yield pa.RecordBatch.from_pylist([segments(shard, at, number, held, names, bits)], kinds)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Ranges are found from a sample of their keys at the driver: ids and hashes, not texts.  The hash deals out the
    # rows of an id that very many share.
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows.repartitionByRange(partitions(spark), *order[:2]).sortWithinPartitions(*order).mapInArrow(
        run, _SCHEMA
    ).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The segments, each with ``base``: the number of ids in all shards before its own."""
    rows = spark.read.schema(_SCHEMA).parquet(path)
    # A row per shard, of which there are as many as the writer had partitions.
    totals = sorted((r["shard"], r["n"]) for r in rows.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    base, at = [], 0
    for shard, n in totals:
        base.append((shard, at))
        at += n
    before = spark.createDataFrame(base, "shard int, base long")
    return rows.join(F.broadcast(before), "shard")


def documents(segments: DataFrame) -> DataFrame:
    """Per document of a file set: doc_id, start, n_tokens and its ids as little-endian unsigned 32-bit integers."""
    ship(segments.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the worker may have written the files
        for batch in batches:
            for row in range(len(batch)):
                r = {n: batch.column(n)[row] for n in batch.schema.names}
                starts = r["starts"].values.to_numpy()
                stops = np.append(starts[1:], r["n_ids"].as_py())
                offsets = r["block_offsets"].values.to_numpy()
                packed, bits = r["packed"].as_buffer(), r["bits"].as_py()
                before = r["base"].as_py() + r["first"].as_py()
                whole = unpack(packed, offsets, bits, 0, r["n_ids"].as_py())
                yield pa.record_batch([
                    r["doc_ids"].values, pa.array(before + starts), pa.array(stops - starts),
                    pa.array([whole[a:b].tobytes() for a, b in zip(starts, stops, strict=True)], pa.binary()),
                ], ["doc_id", "start", "n_tokens", "ids"])

    return segments.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
