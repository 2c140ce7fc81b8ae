"""Benchmark decontamination by suffix arrays over the training documents.

The documents are read in shards of a bounded number of words.  Each shard's
suffix array holds its word suffixes in lexical order (to the depth of a
window; a suffix that leaves the benchmark's vocabulary before the shortest
window ends can match nothing and is left out).  Every suffix of every
benchmark item, the test suffixes, is binary-searched in it: the lower and
upper bound of its window give all occurrences with their places, and
successive occurrences along one alignment give the longest verbatim match.

The benchmark is the stated query set.  It reaches the tasks in blocks of at
most ``BLOCK_CHARS`` characters (an item longer than that is a block of its
own); with more than one block the documents are passed once per block and the
results of a document are merged.  Documents are never shuffled otherwise, so
a passage that many of them share weighs on no single task.

Defined cases: a null or empty text has no words and is clean; an item without
words matches nothing; an item of fewer words than the window is one window;
equal items are all reported; a null item_id is reported as no item but its
words count as hit; rows that repeat a doc_id are judged one by one; an empty
benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from watchpost.llm.base import ship, stored

#: Words of one shard, about; a longer document is a shard of its own.
SHARD_WORDS = 1 << 20
#: Characters of benchmark text that a task holds at once.
BLOCK_CHARS = 4_000_000
#: Places of documents and of items lined up at once, about.
_ALIGNMENTS = 1_000_000

_SCHEMA = (
    "n_words long, longest_match long, item_ids array<string>, "
    "spans array<struct<start: long, stop: long>>"
)
_SEPARATE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all characters beyond ASCII."""
    # str.split would also cut at blanks beyond ASCII; bytes.split does not.
    return (text or "").encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


class TestSuffixes:
    """The windows of all benchmark suffixes of a block, as packed word numbers.

    ``alignments`` lists, for each distinct window, the (item, offset) places
    it stands at; equal items are kept once with all their ids.
    """

    def __init__(self, items: list[tuple[list[str], str]], window: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.ids: list[list[str]] = []
        number = self.numbers
        rows: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for ids, text in items:
            seq = [number.setdefault(w, len(number) + 1) for w in words(text)]
            if not seq:
                continue
            for at in range(max(1, len(seq) - window + 1)):
                rows.setdefault(tuple(seq[at:at + window]), []).append((len(self.ids), at))
            self.ids.append(ids)
        self.wide = 16 if len(number) < (1 << 16) - 1 else 31
        self.length = np.array([len(r) for r in rows], np.int64)
        padded = np.zeros((len(rows), window), np.int64)
        for i, r in enumerate(rows):
            padded[i, :len(r)] = r
        self.keys = self.pack(lambda j: padded[:, j])
        mask = np.arange(window) < self.length[:, None]
        self.masks = self.pack(lambda j: np.where(mask[:, j], (1 << self.wide) - 1, 0))
        places = list(rows.values())
        self.first = np.concatenate(([0], np.cumsum([len(p) for p in places]))).astype(np.int64)
        flat = np.array([x for p in places for x in p], np.int64).reshape(-1, 2)
        self.item, self.offset = flat[:, 0], flat[:, 1]
        each = [sorted({i for i, _ in p}) for p in places]  # the items of a window, each once
        self.item_first = np.concatenate(([0], np.cumsum([len(e) for e in each]))).astype(np.int64)
        self.items = np.array([i for e in each for i in e], np.int64)
        self.shortest = int(self.length.min()) if len(rows) else 0

    def pack(self, column) -> list[np.ndarray]:
        """The words of windows, several to an integer, most significant first."""
        per = 62 // self.wide
        out = []
        for j in range(0, self.window, per):
            key = 0
            for k in range(j, j + per):
                key = key << self.wide
                if k < self.window:
                    key = key | column(k)
            out.append(np.asarray(key, np.int64))
        return out


def _bounds(suffixes: list[np.ndarray], test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """Of every test suffix, the range of sorted suffixes that start with its window."""

    def search(after: bool) -> np.ndarray:
        low = np.zeros(len(test.length), np.int64)
        high = np.full(len(test.length), len(suffixes[0]), np.int64)
        while (open_ := low < high).any():
            mid = np.minimum((low + high) // 2, len(suffixes[0]) - 1)
            less = np.zeros(len(mid), bool)
            equal = np.ones(len(mid), bool)
            for key, mask, want in zip(suffixes, test.masks, test.keys, strict=True):
                have = key[mid] & mask
                less |= equal & (have < want)
                equal &= have == want
            right = open_ & (less | equal if after else less)
            low = np.where(right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)
        return low

    return search(False), search(True)


def _spread(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers low, low + 1, ... of each range, one after the other."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


def _occurrences(seq: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(place, window number) of every occurrence of a benchmark window in a shard."""
    none = np.zeros(0, np.int64)
    if not len(test.length):
        return none, none
    gaps = np.append(np.flatnonzero(seq == 0), len(seq))
    ahead = gaps[np.searchsorted(gaps, np.arange(len(seq)))] - np.arange(len(seq))
    starts = np.flatnonzero(ahead >= test.shortest)
    if not len(starts):
        return none, none
    padded = np.concatenate((seq, np.zeros(test.window, np.int64)))
    # Words beyond a run in the vocabulary (or document) must not count.
    left = ahead[starts]
    keys = test.pack(lambda j: np.where(j < left, padded[starts + j], 0))
    array = np.lexsort(keys[::-1])
    low, high = _bounds([k[array] for k in keys], test)
    count = high - low
    return starts[array[_spread(low, count)]], np.repeat(np.arange(len(count)), count)


def _runs(place: np.ndarray, window: np.ndarray, test: TestSuffixes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, words) of the verbatim matches with one item: successive windows on one diagonal.

    Occurrences, sorted by place, are lined up with the places of their window
    in the items slice by slice; matches that reach the end of a slice go on
    in the next.
    """
    count = np.diff(test.first)[window]
    total = np.cumsum(count)
    item = diagonal = begun = np.zeros(0, np.int64)  # of the matches that reach the last place looked at
    low = 0
    while low < len(place):
        high = int(np.searchsorted(total, (total[low - 1] if low else 0) + _ALIGNMENTS)) + 1
        high = int(np.searchsorted(place, place[min(high, len(place)) - 1], "right"))
        some, n = slice(low, high), count[low:high]
        where = _spread(test.first[window[some]], n)
        at = np.repeat(place[some], n)
        words_ = np.repeat(test.length[window[some]], n)
        if low and place[low] != place[low - 1] + 1:
            item = diagonal = begun = np.zeros(0, np.int64)
        i = np.concatenate([item, test.item[where]])
        d = np.concatenate([diagonal, at - test.offset[where]])
        a = np.concatenate([np.full(len(item), place[low] - 1), at])
        start = np.concatenate([begun, at])
        size = np.concatenate([np.zeros(len(item), np.int64), words_])
        order = np.lexsort((a, d, i))
        i, d, a, start, size = i[order], d[order], a[order], start[order], size[order]
        new = np.ones(len(a), bool)
        new[1:] = (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(a)) - 1
        ended = size[tails] > 0  # a match from before that ends there was told then
        yield start[heads][ended], (a[tails] + size[tails] - start[heads])[ended]
        on = a[tails] == place[high - 1]
        item, diagonal, begun = i[tails][on], d[tails][on], start[heads][on]
        low = high


def _any(texts: list[list[bytes]], test: TestSuffixes) -> np.ndarray:
    """Whether any window of the benchmark occurs, for every document of a shard."""
    begins, seq = _numbered(texts, test)
    place, _ = _occurrences(seq, test)
    hit = np.zeros(len(texts), bool)
    hit[np.searchsorted(begins, place, "right") - 1] = True
    return hit


def _numbered(texts: list[list[bytes]], test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """Where each document begins, and the numbers of all words; zero stands for others and between documents."""
    get = test.numbers.get
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    seq = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    for t, at in zip(texts, begins.tolist(), strict=True):
        seq[at:at + len(t)] = [get(w, 0) for w in t]
    return begins, seq


def _judge(texts: list[list[bytes]], test: TestSuffixes) -> list[tuple]:
    """(n_words, longest_match, item_ids, spans) of every document of a shard."""
    begins, seq = _numbered(texts, test)
    place, window = _occurrences(seq, test)
    out = [(len(t), 0, [], []) for t in texts]
    if not len(place):
        return out
    # Words hit: overlapping occurrences joined to maximal spans.
    order = np.argsort(place, kind="stable")
    place, window = place[order], window[order]
    stop = np.maximum.accumulate(place + test.length[window])
    new = np.ones(len(place), bool)
    new[1:] = place[1:] > stop[:-1]
    heads = np.flatnonzero(new)
    span_start, span_stop = place[heads], stop[np.append(heads[1:], len(place)) - 1]
    owner = np.searchsorted(begins, span_start, "right") - 1
    doc = np.searchsorted(begins, place, "right") - 1
    met = np.unique(doc * len(test.length) + window)
    own = met % len(test.length)
    listed = test.items[_spread(test.item_first[own], np.diff(test.item_first)[own])]
    pairs = np.unique(np.repeat(met // len(test.length), np.diff(test.item_first)[own]) * len(test.ids) + listed)
    longest = np.zeros(len(texts), np.int64)
    for at, long in _runs(place, window, test):
        np.maximum.at(longest, np.searchsorted(begins, at, "right") - 1, long)
    found: dict[int, set[str]] = {}
    for d_, i_ in zip((pairs // len(test.ids)).tolist(), (pairs % len(test.ids)).tolist(), strict=True):
        found.setdefault(d_, set()).update(test.ids[i_])
    spans: dict[int, list[dict]] = {}
    for o, a_, b_ in zip(owner.tolist(), span_start.tolist(), span_stop.tolist(), strict=True):
        begin = int(begins[o])
        spans.setdefault(o, []).append({"start": a_ - begin, "stop": b_ - begin})
    for o, s in spans.items():
        out[o] = (out[o][0], int(longest[o]), sorted(found.get(o, ())), s)
    return out


def _merge(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], stop)
        else:
            out.append({"start": start, "stop": stop})
    return out


def _pass(docs: DataFrame, keep: list[str], shared: Broadcast) -> DataFrame:
    """The kept columns of every document, with what one block of the benchmark finds in it."""
    schema = docs.select(*keep).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    found = pa.struct([
        ("n_words", pa.int64()), ("longest_match", pa.int64()), ("item_ids", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = shared.value
        for batch in batches:
            texts = batch.column(0)
            at = 0
            while at < len(batch):
                shard, size = [], 0
                while at + len(shard) < len(batch) and (not shard or size < SHARD_WORDS):
                    shard.append(words(texts[at + len(shard)].as_py()))
                    size += len(shard[-1])
                rows = [
                    dict(zip(("n_words", "longest_match", "item_ids", "spans"), r, strict=True))
                    for r in _judge(shard, test)
                ]
                new = pa.array(rows, found).flatten()
                held = [batch.column(1 + j).slice(at, len(shard)) for j in range(len(keep))]
                yield pa.record_batch([*held, *new], [*keep, *[f.name for f in found]])
                at += len(shard)

    # Duplicated names cannot clash: only the text and the kept columns go in.
    return docs.select(F.col("text").cast("string").alias("__text"), *keep).mapInArrow(
        run, f"{fields}, {_SCHEMA}"
    )


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[list[str], str]]]:
    """The distinct item texts with their ids, in blocks of bounded size."""
    items = benchmark.where(F.length("text") > 0).groupBy(F.col("text").cast("string").alias("text")).agg(
        F.collect_set(F.col("item_id").cast("string")).alias("ids")
    )
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-chars // BLOCK_CHARS) or 1
    if n == 1:
        yield [(list(r["ids"]), r["text"]) for r in items.toLocalIterator()]
        return
    items = stored(items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(2 * n))), "benchmark")
    for i in range(2 * n):  # twice as many, as they differ in size
        yield [(list(r["ids"]), r["text"]) for r in items.where(F.col("block") == i).toLocalIterator()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document (a row of ``docs``): doc_id, n_words, n_hit, item_ids (sorted), spans, longest_match.

    ``spans`` are the maximal runs of hit words (from word ``start`` to before
    word ``stop``); ``longest_match`` the words of the longest verbatim match
    with one item.
    """
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    tests = (TestSuffixes(b, window) for b in blocks(benchmark))
    first = next(tests)
    second = next(tests, None)
    if second is None:
        found = _pass(docs, ["doc_id"], sc.broadcast(first))
    else:
        rows = stored(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__row")), "documents")
        parts = []
        test: TestSuffixes | None = first
        while test is not None:
            shared = sc.broadcast(test)
            parts.append(stored(_pass(rows, ["__row", "doc_id"], shared), "contamination"))
            shared.destroy()
            test, second = second, next(tests, None)
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        merge = F.udf(
            lambda x: _merge([(s["start"], s["stop"]) for part in x for s in part]),
            "array<struct<start: long, stop: long>>",
        )
        found = every.groupBy("__row").agg(
            F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
            F.max("longest_match").alias("longest_match"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
            merge(F.collect_list("spans")).alias("spans"),
        )
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    ids = F.array_sort(F.col("item_ids").cast(ArrayType(benchmark.schema["item_id"].dataType)))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), ids.alias("item_ids"), "spans", "longest_match")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without those in which a benchmark window occurs."""
    spark = docs.sparkSession
    ship(spark)
    tests = (TestSuffixes(b, window) for b in blocks(benchmark))
    kept, test = docs, next(tests)
    while test is not None:
        after = next(tests, None)
        shared = spark.sparkContext.broadcast(test)
        kept = _clean(kept, shared)
        if after is not None:  # one block's words at a time on the executors
            kept = stored(kept, "decontaminated")
            shared.destroy()
        test = after
    return kept


def _clean(docs: DataFrame, shared: Broadcast) -> DataFrame:
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[bool] = []
            texts = batch.column(at)
            while len(keep) < len(batch):
                shard, size = [], 0
                while len(keep) + len(shard) < len(batch) and (not shard or size < SHARD_WORDS):
                    shard.append(words(texts[len(keep) + len(shard)].as_py()))
                    size += len(shard[-1])
                keep.extend((~_any(shard, shared.value)).tolist())
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
