"""Phrases whose words stand together more often than chance, by top-order marginalisation.

Every word opens one window: the columns w1, w2, ... hold the word and those
that lead it, padded with nulls behind the end of its piece.  Only these
longest windows are counted; no shorter n-grams are written out.  Windows are
combined per batch, dealt by their prefix (all words but the last) and
summed.  A ROLLUP over the prefix columns then gives the counts of
successively shorter prefixes: every occurrence of a phrase is the prefix of
exactly one window.

A prefix met fewer than ``least`` times cannot hold a candidate or a part of
one, so its windows go into the ROLLUP under the next shorter prefix; all
counts that are used stay exact.  Where all words of a prefix are hot (each
half a task's even share of all words, so twice as many as tasks at most) its
windows are dealt by their last word too, so a common pair does not gather its
followers in one task.

Defined cases: a null text is empty, a text without words counts nothing;
a null lang counts as ``und``, together with rows of that name; a phrase never
crosses a piece's or a document's end; repeated rows count each; an empty
table gives an empty result; further columns of the input are ignored.  Counts
must stay below 10^16 (38 decimal digits hold the exact products).
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchpost.llm.base import partitions, ship, stored

#: Bytes of a word that can count as hot, which bounds the list of hot words.
_SHORT = 64
#: Words whose windows are counted together.
_STEP = 2_000_000
#: Bytes of texts gathered before their windows are counted.
_BYTES = 6_000_000
#: Sorted windows added up together.
_TOGETHER = 500_000
#: Rows handed back to Spark at once.
_OUT = 50_000
#: Documents whose words tell which are hot.  This sample steers how windows are dealt, no count.
_SAMPLE = 20_000
#: How a lang is written in keys, whose parts are set apart by blanks.
_ESCAPES = (("%", "%25"), (" ", "%20"))
_PIECE = b".,;:!?\n\x0b\x0c\r"
_BLANK = b" \t"


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[list(_PIECE)] = 2
    kind[list(_BLANK)] = 1
    return kind


def _words(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a batch of (lang, text), the piece and the row of each."""
    texts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in batch.column(1).to_pylist()]
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    kind = _kinds()[raw]
    word = kind == 0
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(raw[word]))
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts).astype(np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.searchsorted(np.cumsum(lengths + 1), starts, "right")
    return words, piece, row


def _codes(columns: list[np.ndarray]) -> np.ndarray:
    """One number per row, the same where all columns are the same."""
    key = columns[0].astype(np.int64)
    for column in columns[1:]:
        width = int(column.max(initial=0)) + 1
        if (int(key.max(initial=0)) + 1) * width >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + column
    return key


def _windows(batch: pa.RecordBatch, order: int) -> Iterator[tuple[list[pa.Array], pa.Array, np.ndarray]]:
    """The word columns w1 .. w``order`` of a batch's distinct padded windows, their lang, and how often each occurs."""
    words, piece, row = _words(batch)
    lang = batch.column(0).dictionary_encode()
    of_row = lang.indices.to_numpy()
    for at in range(0, len(words), _STEP):
        held = words.slice(at, _STEP + order - 1).dictionary_encode()
        code, here = held.indices.to_numpy(), piece[at:at + _STEP]
        n, pad = len(here), len(held.dictionary)
        columns = []
        for i in range(order):
            lead = np.full(n, pad, np.int64)
            ahead = piece[at + i:at + i + n]
            same = np.flatnonzero(ahead == here[:len(ahead)])
            lead[same] = code[same + i]
            columns.append(lead)
        _, first, count = np.unique(
            _codes([of_row[row[at:at + n]], *columns]), return_index=True, return_counts=True
        )
        out = []
        for lead in columns:
            got = lead[first]
            out.append(held.dictionary.take(pa.array(got, mask=got == pad)))
        yield out, lang.dictionary.take(pa.array(of_row[row[at + first]])), count.astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= _BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(len(b) for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _frequent(frame: DataFrame, parts: int) -> list[tuple[str, str]]:
    """(lang, word) of each word that makes up one of ``parts`` parts of a sample's words, so of ``parts`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            for (word,), lang, count in _windows(batch, 1):
                yield pa.record_batch([lang, word, pa.array(count)], ["lang", "w", "c"])

    some = frame.sample(fraction=min(1.0, _SAMPLE / max(1, frame.count())), seed=11)
    count = some.mapInArrow(run, "lang string, w string, c long").groupBy("lang", "w").agg(F.sum("c").alias("f"))
    count = stored(count, "phrase-words")
    total = count.agg(F.sum("f")).first()[0] or 0
    often = count.where((F.col("f") * parts >= F.lit(total)) & (F.octet_length("w") <= _SHORT))
    return [(lang, w) for lang, w in often.select("lang", "w").collect()]


def _salts(columns: list[pa.Array], lang: pa.Array, hot: dict[str, pa.Array], spread: int) -> pa.Array:
    """Text that deals out the windows of hot prefixes by their last word, empty elsewhere."""
    every = np.zeros(len(lang), bool)
    for name, words in hot.items():
        own = pc.equal(lang, name)
        for column in columns[:-1]:
            own = pc.and_(own, pc.is_in(column, value_set=words))
        every |= own.to_numpy(zero_copy_only=False)
    salt = np.full(len(lang), -1, np.int64)
    at = np.flatnonzero(every)
    last = columns[-1].take(pa.array(at)).dictionary_encode()
    crc = np.fromiter((crc32(w.encode()) % spread for w in last.dictionary.to_pylist()), np.int64, len(last.dictionary))
    salt[at] = np.append(crc, 0)[last.indices.fill_null(len(crc)).to_numpy()]
    names = pa.array([*map(str, range(spread)), ""])
    return names.take(pa.array(np.where(salt < 0, spread, salt)))


def _summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(key, w, f) of rows (key, w, c, h) sorted by a hash of the key: the sum of each key (w null) and of each
    frequent whole window.

    Of a key met fewer than ``least`` times the prefix loses its last word;
    one with a salt may be met in other tasks too and stays.
    """
    names = ["key", "w", "f"]

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        whole = rows.filter((pc.field("c") >= least) & pc.field("w").is_valid())
        yield from whole.select(["key", "w", "c"]).rename_columns(names).to_batches(_OUT)
        total = rows.group_by("key", use_threads=False).aggregate([("c", "sum")])
        rare = total.filter((pc.field("c_sum") < least) & pc.starts_with(pc.field("key"), " "))
        cut = pc.list_element(pc.split_pattern(rare.column("key"), " ", max_splits=1, reverse=True), 0)
        short = pa.table([pc.binary_join_element_wise(cut, "", " "), rare.column("c_sum")], ["key", "c_sum"])
        rest = total.filter((pc.field("c_sum") >= least) | ~pc.starts_with(pc.field("key"), " ")).select(["key", "c_sum"])
        for part in (short.group_by("key", use_threads=False).aggregate([("c_sum", "sum")]), rest):
            part = part.combine_chunks()
            yield from pa.table(
                [part.column("key"), pa.nulls(len(part), pa.string()), part.columns[1 - part.column_names.index("key")]],
                names,
            ).to_batches(_OUT)

    held: list[pa.RecordBatch] = []
    least_rows = _TOGETHER
    for batch in batches:
        held.append(batch)
        if sum(len(b) for b in held) >= least_rows:
            rows = pa.Table.from_batches(held).group_by(["key", "w", "h"], use_threads=False).aggregate([("c", "sum")])
            rows = rows.rename_columns({"c_sum": "c"}).select(batch.schema.names)
            last = batch.column("h")[-1]  # its key may go on in the next rows
            yield from solve(rows.filter(pc.field("h") != last))
            held = rows.filter(pc.field("h") == last).combine_chunks().to_batches()
            least_rows = _TOGETHER + sum(len(b) for b in held)
    if held:
        rows = pa.Table.from_batches(held).group_by(["key", "w"], use_threads=False).aggregate([("c", "sum")])
        yield from solve(rows.rename_columns({"c_sum": "c"}))


def grams(docs: DataFrame, order: int = 3, least: int = 10) -> DataFrame:
    """(lang, size, phrase, f): all phrases of up to ``order`` words met ``least`` times, size 0 the words of a lang."""
    if order < 2:
        raise ValueError("a window needs two words at least")
    spark = docs.sparkSession
    ship(spark)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    for mark, written in _ESCAPES:
        lang = F.replace(lang, F.lit(mark), F.lit(written))
    frame = docs.select(lang.alias("lang"), F.col("text").cast("string"))
    spread = partitions(spark)
    hot: dict[str, list[str]] = {}
    for name, word in _frequent(frame, 2 * spread):
        hot.setdefault(name, []).append(word)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between batches
        sets = {name: pa.array(words, pa.string()) for name, words in hot.items()}
        for batch in _gathered(batches):
            for columns, lang, count in _windows(batch, order):
                prefix = [pc.fill_null(c, "") for c in columns[:-1]]
                key = pc.binary_join_element_wise(_salts(columns, lang, sets, spread), lang, *prefix, " ")
                yield from pa.table([key, columns[-1], pa.array(count)], ["key", "w", "c"]).to_batches(_OUT)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from _summed(batches, least)

    # A key is a window's salt, its lang and its prefix, none of which holds a blank.
    dealt = frame.mapInArrow(count, "key string, w string, c long").repartition(spread, "key")
    sums = dealt.withColumn("h", F.xxhash64("key")).sortWithinPartitions("h").mapInArrow(
        add, "key string, w string, f long"
    )
    part = F.split("key", " ")
    prefix = [f"w{i + 1}" for i in range(order - 1)]
    lang = part[1]
    for mark, written in reversed(_ESCAPES):
        lang = F.replace(lang, F.lit(written), F.lit(mark))
    sums = stored(sums.select(
        lang.alias("lang"), *[F.when(part[i + 2] != "", part[i + 2]).alias(w) for i, w in enumerate(prefix)], "w", "f",
    ), "phrase-windows")
    rolled = sums.where("w IS NULL").rollup("lang", *prefix).agg(F.sum("f").alias("f"), F.grouping_id().alias("level"))
    size = F.size(F.array_compact(F.array(*prefix)))
    asked = F.lit(order - 1) - F.log2(F.col("level") + 1).cast("int")  # each prefix left out sets one more bit
    rolled = rolled.where(F.col("level") < (1 << order) - 1).select(
        "lang", asked.alias("size"), F.concat_ws(" ", *prefix).alias("phrase"), "f", size.alias("filled")
    ).where("filled = size").drop("filled")  # a padded prefix is no phrase
    longest = sums.where("w IS NOT NULL").select(
        "lang", F.lit(order).alias("size"), F.concat_ws(" ", *prefix, "w").alias("phrase"), "f"
    )
    kept = rolled.union(longest).where((F.col("f") >= least) | (F.col("size") == 0))
    return stored(kept, "phrases")


def _cut(words: str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.col(words), start, length), " ")


def collocations(docs: DataFrame, order: int = 3, least: int = 10, cover: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's ``top`` phrases of 2 to ``order`` words.

    a, l and r count a phrase, its first part and the rest at its lowest-scoring
    cut, n all words of the lang; the score is floor(10^6 a^2 / (l r)).  A phrase
    of which a longer one takes up ``cover`` percent of the occurrences is left out.
    """
    found = grams(docs, order, least)
    spread = partitions(docs.sparkSession)
    phrases = found.where("size >= 2").select("lang", "size", "phrase", F.col("f").alias("a"))
    words = F.split("phrase", " ", -1)
    parts = found.where("size >= 1").select("lang", F.col("phrase").alias("part"), F.col("f").alias("count"))
    cuts = phrases.withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", _cut("words", F.lit(1), F.col("k")).alias("first"),
        _cut("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"),
    )
    for side, name in (("first", "l"), ("rest", "r")):
        part = parts.select(F.col("lang"), F.col("part").alias(side), F.col("count").alias(name))
        cuts = cuts.join(part, ["lang", side])
    exact = "(1000000BD * cast(a as decimal(16, 0)) * cast(a as decimal(16, 0)))"
    cuts = cuts.withColumn("score", F.expr(
        f"cast({exact} div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as long)"
    ))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select(
        "lang", "phrase", "a", "best.l", "best.r", "best.score"
    )
    # The places of a longer phrase at which a shorter one can lie.
    longer = phrases.where("size >= 3").withColumn("words", words).withColumn(
        "part_size", F.explode(F.sequence(F.lit(2), F.col("size") - 1))
    ).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part_size") + 1)))
    inside = longer.groupBy(
        "lang", _cut("words", F.col("at"), F.col("part_size")).alias("phrase")
    ).agg(F.max("a").alias("longest"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (F.lit(100) * F.col("longest") < F.lit(cover) * F.col("a"))
    )
    order_by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A first choice per slice of a lang, so that no task sorts a whole lang.
    sliced = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(spread)))
    first = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order_by)))
    ranked = first.where(F.col("rank") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order_by)).cast("long")
    )
    total = found.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.where(F.col("rank") <= top).join(total, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
