"""Suffix-array deduplication of repeated byte strings.

A byte goes if it lies in a string of ``length`` bytes that also starts
earlier: in a smaller document, or earlier in the same one.  In terms of the
longest-previous-factor array, position i starts such a string when
LPF[i] >= length, where LPF[i] is the larger of the common prefixes with the
previous and the next smaller position in suffix order.

One suffix array over a corpus lives nowhere on a cluster, so the suffixes are
dealt to shards such that all equal strings of this length meet in one:

1. Of documents with one and the same text all but the first are repeats as a
   whole; a bitmap of the first ones lets the scans skip the others.
2. Each window of ``length`` bytes has an anchor, the place of its smallest
   hash among its GRAM-byte strings (a minimizer), which depends on the
   window's bytes only.  By its distance to the anchor a window falls in one of
   CELLS cells; a block is a run of successive windows with one anchor and
   cell.  All windows of a cell share its core, the bytes from the last one's
   start to the first one's end.  Two equal windows have equal anchors at the
   same distance, hence equal cores: the hash of core and cell is the block's
   key.
3. Cores that occur once anywhere cannot lie in a repeated window.  Hashes of
   cores are counted (each task sends every hash once) and the repeated ones
   marked in a bitmap.  Bitmaps have a fixed size; false marks only cost work:
   where repeated cores outnumber the bits (beyond some ten gigabytes of text
   with the default), most blocks go through the shuffles of step 4, about
   ten times the input, and a larger ``_BITMAP`` pays.
4. Of blocks with marked cores, all but the first of equal blocks (by 128 bits:
   64 of the core, 64 of the whole block) are repeats as a whole.  The first
   ones whose core also occurs in other blocks go with their bytes to the shard
   of their core; windows of a core with very many blocks are dealt on by their
   own hash.
5. Each shard is read in slices of whole cores.  A slice's suffix array over
   the windows that may repeat, with LPF from previous and next smaller
   positions, gives the repeated windows.

Texts are read in place by each of these scans; only the bytes of blocks in
step 4 and the texts that lose bytes are shuffled.

Positions never leave their documents, so matches do not cross documents.
Every step keeps all rows; copies of a document or passage weigh one row per
task in the counts and are split by adaptive execution in the joins.

Defined cases: null and empty texts, and those shorter than ``length``, keep
all; rows with one doc_id but different texts are separate documents ordered
by a hash of their text; rows equal in doc_id and text are one document, whose
result each of them gets; a null doc_id comes before all others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpost.llm.base import key_of, partitions, ship, stored

#: Bytes of the strings whose smallest hash is a window's anchor.
GRAM = 32
#: Cells of a window's distance to its anchor.
CELLS = 3
#: Bits of a bitmap (16 MB), and the slices it is made in.
_BITMAP, _SLICES = 27, 6
#: Windows of a block at most; a block's spot is its place times this, plus its
#: number of windows less one.
_WINDOWS = 256
#: Bytes whose anchors are found together; place and hash share 64 bits.
_BUFFER, _PLACE = 1 << 17, 20
#: Blocks of one core in one slice of a shard, and bytes of a slice, about.
_HOT, _SLICE = 20_000, 2_000_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(29))
    h = h * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _blocks(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Core hash, first and last window of each block of the documents that lie side by side in ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(_U), none, none
    # Polynomial hashes of 1, 2, 4, ... bytes from each place on.
    levels, n = [data.astype(_U) + _U(1)], 1
    width = length - GRAM + 1
    cell = -(-width // CELLS)
    core = length - cell + 1
    while 2 * n <= max(GRAM, core):
        h = levels[-1]
        levels.append(h[:-n] * _U(pow(_BASE, n, 1 << 64)) + h[n:])
        n *= 2
    low = _U((1 << _PLACE) - 1)
    grams = _mixed(levels[GRAM.bit_length() - 1])
    v = (grams & ~low) | np.arange(len(grams), dtype=_U)
    n = 1
    while n * 2 <= width:
        v = np.minimum(v[:-n], v[n:])
        n *= 2
    if n < width:
        v = np.minimum(v[:n - width], v[width - n:])
    place = (v & low).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    begins = np.concatenate(([0], ends[:-1]))
    new[begins[begins < len(place)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    # Windows must end in the document they start in.
    last = np.minimum(last, ends[np.searchsorted(ends, first, "right")] - length)
    first, last = first[last >= first], last[last >= first]
    anchor = place[first]
    # The run of an anchor, cut into cells by the distance to it.
    far = (anchor - first) // cell
    count = far - (anchor - last) // cell + 1
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    anchor, far = np.repeat(anchor, count), np.repeat(far, count) - nth
    first = np.maximum(np.repeat(first, count), anchor - (far + 1) * cell + 1)
    last = np.minimum(np.repeat(last, count), anchor - far * cell)
    at, key = anchor - far * cell, np.zeros(len(anchor), _U)
    for bit in reversed(range(len(levels))):
        if core >> bit & 1:
            key = key * _U(pow(_BASE, 1 << bit, 1 << 64)) + levels[bit][at]
            at = at + (1 << bit)
    # The cores of two cells can be the same bytes; with the cell they differ.
    return _mixed(key + far.astype(_U) * _U(0x9FB21C651E98DF25)), first, last


def _buffers(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, list[tuple[int, int]]]]:
    """Documents side by side in buffers: bytes, ends, and (document, place of its part) of each.

    A text beyond a buffer goes in parts that overlap by a window less a byte.
    """
    held: list[bytes] = []
    names: list[tuple[int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for at in range(0, len(t) - length + 1, _BUFFER):
            part = t if len(t) <= _BUFFER else t[at:at + _BUFFER + length - 1]
            if held and size + len(part) > 2 * _BUFFER:
                yield b"".join(held), np.cumsum([len(x) for x in held]), names
                held, names, size = [], [], 0
            held.append(part)
            names.append((i, at))
            size += len(part)
            if part is t:
                break
    if held:
        yield b"".join(held), np.cumsum([len(x) for x in held]), names


def _texts(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _packed_bytes(hashes: np.ndarray) -> bytes:
    """Of hashes of one slice of the bitmap, the 40 bits after those that name it."""
    return (hashes << _U(_SLICES)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(raw: bytes, one: int) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return (wide.view(">u8").ravel().astype(_U) >> _U(_SLICES)) | (_U(one) << _U(64 - _SLICES))


def _slices(hashes: np.ndarray) -> list[np.ndarray]:
    """Sorted hashes by the slice of the bitmap they fall in."""
    cut = np.searchsorted(hashes, np.arange(1, 1 << _SLICES, dtype=_U) << _U(64 - _SLICES))
    return np.split(hashes, cut)


def _bitmap(hashes: DataFrame, repeated: bool) -> bytes:
    """A bitmap of the hashes in rows (slice, more, hashes): of all, or of those that occur more than once.

    ``more`` tells that each hash of the row occurs more than once by itself.
    """
    slices = 1 << _SLICES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}
        bits: dict[int, np.ndarray] = {}

        def take(one: int) -> None:
            """Fold what has come for a slice: sorted distinct hashes, and marks."""
            found, count = np.unique(np.concatenate(seen[one]), return_counts=True)
            marked = found[count > 1] if repeated else found
            bits[one][(marked >> _U(64 - _BITMAP)).astype(np.int64) - (one << (_BITMAP - _SLICES))] = True
            seen[one] = [found if repeated else found[:0]]

        for batch in batches:
            for one, more, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                have = seen.setdefault(one, [])
                bits.setdefault(one, np.zeros(1 << (_BITMAP - _SLICES), bool))
                have.extend([_unpacked(raw, one)] * (1 + more))
                if len(have) > 1 and sum(map(len, have[1:])) > max(1_000_000, len(have[0])):
                    take(one)
        for one in seen:
            take(one)
        if bits:
            yield pa.record_batch([
                pa.array(list(bits), pa.int32()),
                pa.array([zlib.compress(np.packbits(b, bitorder="little"), 1) for b in bits.values()], pa.binary()),
            ], ["slice", "bits"])

    rows = hashes.repartition(min(slices, partitions(hashes.sparkSession)), "slice").mapInArrow(
        mark, "slice int, bits binary"
    ).collect()  # 16 MB at most, whatever the input
    out = bytearray(1 << (_BITMAP - 3))
    each = len(out) // slices
    for r in rows:
        out[r["slice"] * each:(r["slice"] + 1) * each] = zlib.decompress(r["bits"])
    return bytes(out)


def _marked(bitmap: bytes, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> _U(64 - _BITMAP)).astype(np.int64)
    return (np.frombuffer(bitmap, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


_PACKED = "slice int, more boolean, hashes binary"


def _packed(once: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of sorted hashes by slice."""
    for flag, hashes in ((False, once), (True, more)):
        full = [(i, _packed_bytes(part)) for i, part in enumerate(_slices(hashes)) if len(part)]
        yield pa.record_batch([
            pa.array([i for i, _ in full], pa.int32()), pa.array([flag] * len(full), pa.bool_()),
            pa.array([raw for _, raw in full], pa.binary()),
        ], ["slice", "more", "hashes"])


def _bitmap_of(column: DataFrame) -> bytes:
    """The bitmap of a frame of one column of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(batch.column(0).to_numpy().view(_U))
            yield from _packed(found, found[:0])

    return _bitmap(column.mapInArrow(run, _PACKED), repeated=False)


def _firsts_only(batch: pa.RecordBatch, firsts: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Rows of (key, tie, id hash, text) that may be the first of their text, and their texts."""
    rows = np.flatnonzero(_marked(firsts, batch.column(2).to_numpy().view(_U)))
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(3).take(pa.array(rows)).to_pylist()]
    return rows, texts


def _repeated_cores(docs: DataFrame, firsts, length: int) -> bytes:
    """The bitmap of core hashes that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            found, count = np.unique(np.concatenate(held), return_counts=True)
            return _packed(found[count == 1], found[count > 1])

        for batch in batches:
            for data, ends, _ in _buffers(_firsts_only(batch, firsts.value)[1], length):
                held.append(_blocks(np.frombuffer(data, np.uint8), ends, length)[0])
                size += len(held[-1])
                if size > 1_500_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return _bitmap(docs.select("key", "tie", "id", "text").mapInArrow(run, _PACKED), repeated=True)


def _scan(docs: DataFrame, firsts, bitmap: bytes, length: int, bytes_too: bool) -> DataFrame:
    """(core, half, key, tie, spot) of every block whose core is marked, and its bytes on request."""
    marks = docs.sparkSession.sparkContext.broadcast(bitmap)
    names = ["core", "half", "key", "tie", "spot"] + ["data"] * bytes_too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = _firsts_only(batch, firsts.value)
            key, tie = (batch.column(i).to_numpy()[rows] for i in (0, 1))
            for data, ends, owners in _buffers(texts, length):
                core, first, last = _blocks(np.frombuffer(data, np.uint8), ends, length)
                some = np.flatnonzero(_marked(marks.value, core))
                if not len(some):
                    continue
                core, first, last = core[some], first[some], last[some]
                parts = [data[a:b] for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
                half = np.array([xxhash.xxh3_64_intdigest(x) for x in parts], _U).view(np.int64)
                part = np.searchsorted(ends, first, "right")
                owner = np.array([o for o, _ in owners], np.int64)[part]
                moved = np.array([at for _, at in owners], np.int64)[part] - np.concatenate(([0], ends[:-1]))[part]
                out = [core.view(np.int64), half, key[owner], tie[owner], (first + moved) * _WINDOWS + last - first]
                yield pa.record_batch([*map(pa.array, out), *[pa.array(parts, pa.binary())] * bytes_too], names)

    return docs.select("key", "tie", "id", "text").mapInArrow(
        run, "core long, half long, key long, tie long, spot long" + ", data binary" * bytes_too
    )


def _dealt(windows: DataFrame, length: int) -> DataFrame:
    """Blocks with their salts to (core, salt, key, tie, low, starts, data), a row per block and salt.

    ``starts`` are the windows of the block that belong to the salt; null: all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for core, key, tie, spot, data, salts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine: list[tuple[int, np.ndarray | None]] = [(0, None)]
                if salts > 1:
                    windows = range(len(data) - length + 1)
                    salt = np.array([xxhash.xxh3_64_intdigest(data[i:i + length]) % salts for i in windows])
                    mine = [(int(x), np.flatnonzero(salt == x)) for x in np.unique(salt)]
                for x, starts in mine:
                    for o, v in zip(out, (core, x, key, tie, spot // _WINDOWS, starts, data), strict=True):
                        o.append(v)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32()), pa.binary()]
            yield pa.record_batch(
                [pa.array(o, k) for o, k in zip(out, kinds, strict=True)],
                ["core", "salt", "key", "tie", "low", "starts", "data"],
            )

    return windows.select("core", "key", "tie", "spot", "data", "salts").mapInArrow(
        run, "core long, salt long, key long, tie long, low long, starts array<int>, data binary"
    )


def suffix_order(words: np.ndarray) -> np.ndarray:
    """Suffix order by the leading bytes, given as big-endian words; ties in text order."""
    return np.lexsort(words.T[::-1])


def previous_factors(words: np.ndarray) -> np.ndarray:
    """Whether LPF reaches the full width, for suffixes numbered in text order.

    In suffix order, the previous and next smaller position of each suffix are
    its earlier suffixes with the longest common prefixes.
    """
    n = len(words)
    order = suffix_order(words)
    sorted_ = words[order]
    same = np.ones(n, np.int64)
    same[1:] = (sorted_[1:] != sorted_[:-1]).any(axis=1)
    rank = np.cumsum(same)  # equal for suffixes that agree in all leading bytes
    found = np.zeros(n, bool)
    for step in (-1, 1):
        near = np.arange(n) + step
        while True:
            inside = (near >= 0) & (near < n)
            at = np.flatnonzero(inside)
            up = at[order[near[at]] > order[at]]
            if not len(up):
                break
            near[up] = near[near[up]]
        at = np.flatnonzero((near >= 0) & (near < n))
        found[order[at]] |= rank[near[at]] == rank[at]
    return found


def _repeats(key: np.ndarray, tie: np.ndarray, low: np.ndarray, starts: list[np.ndarray], data: list[bytes],
             length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start in it) of the windows of a slice that start earlier too."""
    order = np.lexsort((low, tie, key))  # the order of the text
    joined = np.frombuffer(b"".join([data[i] for i in order]) + bytes(8), np.uint8)
    sizes = np.array([len(data[i]) for i in order], np.int64)
    base = np.cumsum(sizes) - sizes
    count = np.array([len(starts[i]) for i in order], np.int64)
    within = np.concatenate([starts[i] for i in order]).astype(np.int64)
    row = np.repeat(np.arange(len(order)), count)
    place = base[row] + within
    # Windows of unequal hash are unequal; only those of equal hash are sorted.
    h, n, p = joined.astype(_U) + _U(1), 1, 0x9E3779B97F4A7C15
    width, left, total = length, None, 0
    while width:
        if width & 1:
            if left is None:
                left, total = h.copy(), n
            else:
                m = min(len(left) - n, len(h)) if len(left) > n else 0
                left = h[:m] * _U(pow(0x9E3779B97F4A7C15, total, 1 << 64)) + left[n:n + m]
                total += n
        width >>= 1
        if width:
            h = h[:-n] * _U(p) + h[n:]
            p, n = p * p % (1 << 64), n * 2
    mixed = left[place]
    _, back, times = np.unique(mixed, return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[back] > 1)
    if not len(some):
        return some, some
    steps = list(range(0, length - 7, 8)) + ([length - 8] if length % 8 else [])
    eight = np.lib.stride_tricks.sliding_window_view(joined, 8)
    words = np.stack([
        np.ascontiguousarray(eight[place[some] + s]).view(">u8").ravel().astype(_U) for s in steps
    ], axis=1)
    hit = some[previous_factors(words)]
    return order[row[hit]], within[hit]


def _open_repeats(windows: DataFrame, length: int) -> DataFrame:
    """(key, tie, start, stop): byte runs covered by repeated windows of the shards."""
    names = ["key", "tie", "start", "stop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def solve(last: bool) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
            rows = pa.Table.from_batches(held).combine_chunks()
            core, salt = rows.column("core").to_numpy(), rows.column("salt").to_numpy()
            new = np.flatnonzero((core[1:] != core[:-1]) | (salt[1:] != salt[:-1])) + 1
            end = len(rows) if last else int(new[-1]) if len(new) else 0
            mine = rows.slice(0, end)
            if not end:
                empty = pa.array([], pa.int64())
                return pa.record_batch([empty] * 4, names), rows.to_batches()
            key, tie, low = (mine.column(c).to_numpy() for c in ("key", "tie", "low"))
            data = mine.column("data").to_pylist()
            starts = [
                np.arange(len(d) - length + 1) if x is None else np.array(x, np.int64)
                for x, d in zip(mine.column("starts").to_pylist(), data, strict=True)
            ]
            row, start = _repeats(key, tie, low, starts, data, length)
            order = np.lexsort((start, row))
            row, start = row[order], start[order]
            head = np.ones(len(row), bool)
            head[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
            first = np.flatnonzero(head)
            final = np.append(first[1:], len(row))[: len(first)] - 1
            out = pa.record_batch([
                pa.array(key[row[first]]), pa.array(tie[row[first]]), pa.array(low[row[first]] + start[first]),
                pa.array(low[row[final]] + start[final] + length),
            ], names)
            return out, rows.slice(end).to_batches()

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > _SLICE:
                out, held = solve(False)
                size = sum(b.nbytes for b in held) // 2 if len(out) == 0 else sum(b.nbytes for b in held)
                yield out
        if held:
            yield solve(True)[0]

    return windows.repartition(partitions(windows.sparkSession), "core", "salt").sortWithinPartitions(
        "core", "salt"
    ).mapInArrow(run, "key long, tie long, start long, stop long")


def repeated_spans(rows: DataFrame, firsts, length: int) -> DataFrame:
    """(key, tie, start, stop) byte runs, overlapping or not, whose union is what goes."""
    blocks = stored(_scan(rows, firsts, _repeated_cores(rows, firsts, length), length, False), "blocks")
    place = F.struct("key", "tie", "spot")
    kinds = stored(blocks.groupBy("core", "half").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "kinds")
    of_core = stored(kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "open")
    copies = blocks.join(kinds.where("n > 1"), ["core", "half"]).where(place != F.col("first")).select(
        "key", "tie", F.floor(F.col("spot") / F.lit(_WINDOWS)).alias("start"), "spot"
    ).withColumn("stop", F.col("start") + F.col("spot") % _WINDOWS + F.lit(length)).drop("spot")
    # The first one of equal blocks with its bytes; copies of it combine before the shuffle.
    marked = _scan(rows, firsts, _bitmap_of(of_core.select("core")), length, True)
    first = marked.groupBy("core", "half").agg(F.min(F.struct("key", "tie", "spot", "data")).alias("b"))
    hot = stored(of_core.where(F.col("kinds") > _HOT), "hot")
    salted = first.select("core", "b.*").join(hot, "core", "left").withColumn(
        "salts", F.coalesce(F.ceil(F.col("kinds") / F.lit(_HOT)), F.lit(1)).cast("long")
    )
    return copies.unionByName(_open_repeats(_dealt(salted, length), length))


def _cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a text without the union of the spans, and the number of maximal runs removed."""
    kept, at, runs = [], 0, 0
    for start, stop in sorted(spans):
        if start > at or not runs:
            kept.append(text[at:start])
            runs += 1
        at = max(at, stop)
    kept.append(text[at:])
    return b"".join(kept), runs


def deduplicate(docs: DataFrame, length: int = 100) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept``, the remaining bytes.

    ``kept`` is null where all bytes remain; the text itself is then the result.
    """
    if not GRAM + 8 <= length < GRAM + _WINDOWS:
        raise ValueError(f"strings of {GRAM + 8} to {GRAM + _WINDOWS - 1} bytes")
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of("doc_id").alias("key"), text.alias("text"))
    ids = stored(named.select(
        "doc_id", "key", F.xxhash64("text").alias("tie"), F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("sha"),
    ), "ids")
    first = ids.groupBy("sha").agg(F.min(F.struct("key", "tie")).alias("first"))
    # The tie matters only where rows share a doc_id, and only then must equal rows be folded.
    count, keys = ids.agg(F.count(F.lit(1)), F.count_distinct("key")).first()
    rows = named.select("key", F.xxhash64("text").alias("tie"), "text")
    if count == keys:
        ids, rows = (x.withColumn("tie", F.lit(0).cast("long")) for x in (ids, rows))
    else:
        rows = rows.dropDuplicates(["key", "tie"])
    rows = rows.withColumn("id", F.xxhash64("key", "tie"))
    first = first.select("sha", F.col("first.key").alias("first"))
    firsts = spark.sparkContext.broadcast(_bitmap_of(ids.join(first, "sha").where("key = first").select(
        F.xxhash64("key", "tie"))))
    spans = stored(repeated_spans(rows, firsts, length).groupBy("key", "tie").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans")
    ), "spans")
    losing = spark.sparkContext.broadcast(_bitmap_of(spans.select(F.xxhash64("key", "tie"))))

    def lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = _marked(losing.value, batch.column(0).to_numpy().view(_U))
            yield batch.filter(pa.array(mine)).select([1, 2, 3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = _texts(batch.column(2)), []
            for t, s in zip(texts, batch.column(3).to_pylist(), strict=True):
                out.append(_cut(t, [(x["start"], x["stop"]) for x in s]))
            yield pa.record_batch([
                batch.column(0), batch.column(1),
                pa.array([len(t) - len(k) for t, (k, _) in zip(texts, out, strict=True)], pa.int64()),
                pa.array([n for _, n in out], pa.int64()), pa.array([k for k, _ in out], pa.binary()),
            ], ["key", "tie", "n_removed", "n_spans", "kept"])

    texts = rows.select("id", "key", "tie", "text").mapInArrow(lose, "key long, tie long, text string")
    cut = texts.join(spans, ["key", "tie"]).select("key", "tie", "text", "spans").mapInArrow(
        run, "key long, tie long, n_removed long, n_spans long, kept binary"
    )
    copy = (F.col("key") != F.col("first")) & (F.col("n_bytes") >= length)
    every = ids.join(first, "sha").join(cut, ["key", "tie"], "left")
    none = F.lit(b"")
    return every.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(none, 256)).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.col("sha"))
        .alias("kept_sha256"), F.when(copy, none).otherwise(F.col("kept")).alias("kept"),
    )
