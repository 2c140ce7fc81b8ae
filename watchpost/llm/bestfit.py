"""Vector best-fit packing of token sequences.

An item is a vector (tokens, documents, attention cost), a sequence has a
capacity in each.  Items are placed in falling order of length.  Of the open
sequences that can take an item under every constraint the one with the
smallest residual after it is chosen: the weighted norm of what stays free
(rule ``norm``), or the largest weighted dot product of item and free capacity
(rule ``dot``), each as shares of the capacities; of equal ones the one with
the least free.  The attention cost of an item is the square of its length, as
the documents of a sequence do not attend to each other.

Items of one length are alike, so best-fit needs only their number: the driver
gets at most one count per length up to the sequence length, and open
sequences with equal free capacities are held as one class with its size.  The
result is a list of runs "the next n items of this length go to these
sequences", which the tasks apply to the items by their rank among those of
their length.  Neither items nor sequences are gathered anywhere.

Texts longer than a sequence are cut into full pieces and a shorter last one.

Defined cases: a null or empty text is the end id alone; rows that repeat a
doc_id are packed each; a null doc_id stays null; an empty table has no
pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchpost.llm.base import ship, stored
from watchpost.llm.tokens import LARGE, Budget, encoder

#: Weights of the residual tokens, documents and attention cost.
WEIGHTS = (1.0, 1.0, 1.0)


def pieces(docs: DataFrame, vocabulary: Callable[[], str], end: int, capacity: int,
           with_ids: bool = False, keep: tuple[str, ...] = (), budget: Budget = LARGE) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, part, and rank.

    ``rank`` numbers the pieces of one length within the task ``part``; ``ids``
    are added on request, and the columns ``keep`` as they are.
    """
    ship(docs.sparkSession)
    fields = [f for f in docs.select(*keep).schema] if keep else []
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(vocabulary(), budget)
        mark = np.array([end], "<u4").tobytes()
        seen = [0] * (capacity + 1)
        for batch in batches:
            i = 0
            while i < len(batch):
                texts, chars = [], 0
                while i + len(texts) < len(batch) and (not texts or chars < budget.chars):
                    texts.append(batch.column(1)[i + len(texts)].as_py() or "")
                    chars += len(texts[-1])
                owner, start, length, check, rank, raws = [], [], [], [], [], []
                for row, raw in enumerate(enc.encode(texts), i):
                    raw += mark
                    for at in range(0, len(raw), 4 * capacity):
                        cut = raw[at:at + 4 * capacity]
                        n = len(cut) // 4
                        owner.append(row)
                        start.append(at // 4)
                        length.append(n)
                        check.append(crc32(cut))
                        rank.append(seen[n])
                        seen[n] += 1
                        if with_ids:
                            raws.append(cut)
                take = pa.array(owner, pa.int64())
                starts = np.array(start, np.int64)
                cols = [
                    batch.column(0).take(take), pa.array((starts // capacity).astype(np.int32)), pa.array(starts),
                    pa.array(length, pa.int64()), pa.array(check, pa.int64()),
                    pa.array(np.full(len(starts), part, np.int32)), pa.array(rank, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                cols += [batch.column(2 + j).take(take) for j in range(len(fields))]
                names += [f.name for f in fields]
                if with_ids:
                    cols.append(pa.array(raws, pa.binary()))
                    names.append("ids")
                yield pa.record_batch(cols, names)
                i += len(texts)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("__text"), *keep
    ).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + extra
    )


def score(free: np.ndarray, item: np.ndarray, rule: str, weights: tuple[float, float, float]) -> np.ndarray:
    """The number by which an item's sequence is chosen, the smallest first; a row of shares for each."""
    each = (free - item) ** 2 if rule == "norm" else -free * item
    return each[:, 0] * weights[0] + each[:, 1] * weights[1] + each[:, 2] * weights[2]


def plan(counts: dict[int, int], capacity: int, max_docs: int, max_cost: int, rule: str = "norm",
         weights: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit over lengths with their counts; the default weights are those of scalar best-fit.

    Returns runs (length, first rank, items, first sequence, items a sequence,
    offset): the items of this length from the first rank on are dealt to
    successive sequences, so many to each, from the offset on.
    """
    full = np.array([capacity, max_docs, max_cost], np.float64)
    if min(weights) < 0:
        raise ValueError("weights must not be negative")
    runs: list[tuple[int, int, int, int, int, int]] = []
    # Classes of open sequences: free vector -> [(first sequence, how many)].
    open_: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    sequences = 0

    def fits(free: tuple[int, int, int], n: int) -> int:
        """How many items of length n the free capacities take."""
        return min(free[0] // n, free[1], free[2] // (n * n))

    for n in sorted(counts, reverse=True):
        left, rank = counts[n], 0
        if fits((capacity, max_docs, max_cost), n) < 1:
            raise ValueError(f"a piece of {n} tokens fits no empty sequence")
        while left:
            able = [f for f in open_ if fits(f, n)]
            if able:
                value = score(np.array(able, np.float64) / full, np.array([n, 1, n * n]) / full, rule, weights)
                best = min(able[i] for i in np.flatnonzero(value == value.min()))
                first, many = open_[best].pop()
                if not open_[best]:
                    del open_[best]
            else:
                best, first = (capacity, max_docs, max_cost), sequences
                many = -(-left // fits(best, n))
                sequences += many
            # An item lowers every part of what its sequence has free. So by
            # the norm best-fit goes on with that sequence while it takes items
            # of this length, and by the dot product with an untouched one of
            # its class. A new one is the only one that takes them.
            each = 1 if able and rule == "dot" else fits(best, n)
            used = min(many, left // each)
            offset = capacity - best[0]
            parts = [(used, each)] if used else []
            if used < many and left - used * each:
                parts.append((1, left - used * each))
            at = first
            for m, k in parts:
                runs.append((n, rank, m * k, at, k, offset))
                rank, left, at = rank + m * k, left - m * k, at + m
                rest = (best[0] - n * k, best[1] - k, best[2] - n * n * k)
                if rest[0] and rest[1] and rest[2]:
                    open_.setdefault(rest, []).append((at - m, m))
            if at < first + many:
                open_.setdefault(best, []).append((at, first + many - at))
    return runs


def pack(found: DataFrame, capacity: int, max_docs: int | None = None, max_cost: int | None = None,
         rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """Pieces (see ``pieces``, as a stored table) with sequence_id and offset in place of part and rank.

    The defaults of ``max_docs`` and ``max_cost`` never bind before the tokens do.
    """
    spark = found.sparkSession
    # A row per task and length, then one per length.
    each = found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = each.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(counts, capacity, max_docs or capacity, max_cost or capacity * capacity, rule, weights)
    table = np.array(runs or np.zeros((0, 6)), np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    # At most a few runs per length.
    shared = spark.sparkContext.broadcast(table)
    base = int(max(counts.values(), default=0)) + 1
    rows = found.join(shift, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("shift"))
    rows = rows.drop("shift", "part")
    others = [c for c in rows.columns if c != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        if base > (2**62) // (capacity + 1):
            raise OverflowError("more pieces of one length than a run can be searched for")
        keys = table[:, 0] * base + table[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            length = batch.column("length").to_numpy()
            r = table[np.searchsorted(keys, length * base + rank, "right") - 1]
            nth = rank - r[:, 1]
            yield pa.record_batch(
                [*[batch.column(c) for c in others], pa.array(r[:, 3] + nth // r[:, 4]),
                 pa.array(r[:, 5] + nth % r[:, 4] * length)],
                [*others, "sequence_id", "offset"],
            )

    return rows.mapInArrow(run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: Callable[[], str], end: int, capacity: int = 2048,
                   **options) -> DataFrame:
    """Cut and pack every whole text into sequences of at most ``capacity`` tokens."""
    mine = {k: options.pop(k) for k in ("with_ids", "budget") if k in options}
    return pack(stored(pieces(docs, vocabulary, end, capacity, **mine), "pieces"), capacity, **options)
