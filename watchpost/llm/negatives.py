"""Hard negatives by threshold joins in the manner of L2AP.

Vectors lie in blocks, the searching anchors in smaller ones, and every block
meets every block of anchors (a stated query set against all rows).  Within
two blocks only pairs that reach the anchors' thresholds are looked for:

* the inverted index of a block holds a vector's components from the place on
  where the norm of those before it, times an anchor's norm, could reach the
  threshold (the Cauchy-Schwarz bound of L2AP); the components before it are
  left out, and a vector that cannot reach it at all is not indexed;
* partial scores are summed over the index from its last components on, and a
  pair goes when its partial score and the norms of what remains of both
  vectors stay below the threshold;
* what is left is completed with the components that the index leaves out.

An anchor asks for a number of rows per window: first its positives (rows of
its label), then for each positive the rows of other labels whose scores lie
in a range below the positive's.  Thresholds start high; anchors whose windows
are not filled ask again with lower ones, the last of which leaves nothing out.

Defined cases: rows with a null id, label or vector, or with any null or
non-finite component take no part; a vector shorter than another counts as
ending in zeros; other rows are rows of another id, repeated rows of one id
count each, but an anchor's id is searched once, by its smallest (label,
vector); an anchor with no positive or an empty range gives no row; an empty
table gives an empty result; further columns of the input are ignored.
Scaled components must stay below 2^27, else it raises: scores would leave 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchpost.llm.base import partitions, ship, stored

#: Vectors of a block and anchors of a block, about.
_BLOCK, _ASK = 8192, 256
#: Components summed together.
_STRIDE = 8
#: What the first threshold is of the greatest score that norms allow, and how it falls.
_FIRST, _FALL, _LAST = 0.8, 0.5, 0.1
#: Share of all pairs below which those that are left are completed one by one.
_FEW = 0.05
_PAIRS = 100_000
#: Bounds are raised by this much, so that rounding never drops a pair.
_SLACK = 1 + 1e-9
_CELLS = (
    "block int, kind int, width int, ids binary, labels binary, least binary, lows binary, highs binary, data binary"
)
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


def _bytes(values, kind: str) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _matrix(vectors: list, scale: float | None) -> np.ndarray:
    """Rows of the vectors, padded with zeros and scaled to whole numbers."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    if scale is not None:
        out = np.floor(scale * out)
    if out.size and not np.abs(out).max() < 1 << 27:
        raise ValueError("scaled components of 2^27 and more: scores would leave 64 bits")
    return out.astype(np.int64)


def above(rows: np.ndarray, asks: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, ask, score) of the pairs whose inner product is ``least[ask]`` or more."""
    width = max(rows.shape[1], asks.shape[1], 1)
    width += -width % _STRIDE
    rows, asks = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (rows, asks))
    exact = float(np.abs(rows).max(initial=0)) * float(np.abs(asks).max(initial=0)) * width < 1 << 53
    kind = np.float64 if exact else np.int64
    rows, asks = rows.astype(kind), asks.astype(kind)
    # Weak components first: the longest part can then be left out of the index.
    order = np.argsort(np.abs(rows).max(axis=0, initial=0), kind="stable")
    rows, asks = rows[:, order], asks[:, order]

    def before(m: np.ndarray) -> np.ndarray:
        """The norm of the components before each stride, the last of all."""
        parts = (m.astype(np.float64) ** 2).reshape(len(m), -1, _STRIDE).sum(axis=2)
        return np.sqrt(np.concatenate([np.zeros((len(m), 1)), np.cumsum(parts, axis=1)], axis=1)) * _SLACK

    row_norm, ask_norm = before(rows), before(asks)
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where(least > 0, least / ask_norm[:, -1], -np.inf).min(initial=np.inf)
    # The index of a row begins at the last stride before which its norm cannot reach.
    begins = (row_norm < reach).sum(axis=1) - 1
    begins = np.maximum(begins, 0)
    kept = np.flatnonzero(row_norm[:, -1] >= reach)
    kept = kept[np.argsort(begins[kept], kind="stable")]
    begins, rows, row_norm = begins[kept], rows[kept], row_norm[kept]
    score = np.zeros((len(kept), len(asks)), rows.dtype)
    strides = width // _STRIDE
    upto = 0
    alive = np.ones(score.shape, bool)
    for c in reversed(range(strides)):
        m = int(np.searchsorted(begins, c, "right"))  # rows that have this stride in the index
        if m:
            at = slice(c * _STRIDE, (c + 1) * _STRIDE)
            score[:m] += rows[:m, at] @ asks[:, at].T
        missing = np.maximum(begins, c)
        remain = row_norm[np.arange(len(kept)), missing][:, None] * ask_norm.T[missing]
        alive = score + remain * _SLACK >= least
        upto = c
        if alive.sum() <= _FEW * alive.size:
            break
    r, a = np.nonzero(alive)
    for i in range(0, len(r), _PAIRS):
        x, q = r[i:i + _PAIRS], a[i:i + _PAIRS]
        got = score[x, q]
        missing = np.maximum(begins[x], upto)
        for c in range(int(missing.max(initial=0))):
            some = np.flatnonzero(missing > c)
            at = slice(c * _STRIDE, (c + 1) * _STRIDE)
            got[some] += (rows[x[some], at] * asks[q[some], at]).sum(axis=1)
        near = np.flatnonzero(got >= least[q])
        yield kept[x[near]], q[near], got[near].astype(np.int64)


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of each group's best ``most`` entries: higher scores, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    start = np.flatnonzero(np.diff(group[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < most]


def _cell(block: int, kind: int, data: np.ndarray, parts: list[bytes]) -> pa.RecordBatch:
    """One row of ``_CELLS``: vectors (kind 0) or anchors (kind 1) of a block."""
    values = [pa.array([v], pa.int32()) for v in (block, kind, data.shape[1])]
    values += [pa.array([v], pa.binary()) for v in (*parts, _bytes(data, "<i4"))]
    return pa.record_batch(values, [c.split()[0] for c in _CELLS.split(", ")])


def _blocks(rows: DataFrame, scale: float) -> DataFrame:
    """All vectors as whole numbers, about ``_BLOCK`` of them in a row."""
    count = max(1, -(-rows.count() // _BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        got = pa.Table.from_batches(held)
        data = _matrix(got.column("vector").to_pylist(), scale)
        yield _cell(TaskContext.get().partitionId(), 0, data, [
            _bytes(got.column("vec_id").to_numpy(), "<i8"), _bytes(got.column("label").to_numpy(), "<i8"), b"", b"", b"",
        ])

    return stored(rows.repartition(count).mapInArrow(run, _CELLS), "negatives-blocks")


def _asks(anchors: DataFrame, many: int) -> DataFrame:
    """Unfilled anchors (vec_id, label, vector, least, lows, highs), ``_ASK`` of them in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _ASK):
                got = batch.slice(at, _ASK)
                data = _matrix(got.column("vector").to_pylist(), None)
                lows, highs = (np.array(got.column(c).to_pylist(), np.int64) for c in ("lows", "highs"))
                yield _cell(0, 1, data, [
                    _bytes(got.column("vec_id").to_numpy(), "<i8"), _bytes(got.column("label").to_numpy(), "<i8"),
                    _bytes(got.column("least").to_numpy(), "<f8"), _bytes(lows, "<i8"), _bytes(highs, "<i8"),
                ])

    packed = anchors.repartition(max(1, -(-many // _ASK))).mapInArrow(run, _CELLS)
    return packed


def _round(blocks: DataFrame, count: int, anchors: DataFrame, many: int, same: bool, most: int) -> DataFrame:
    """(anchor_id, window, vec_id, score): the best rows of each window that reach the anchors' thresholds.

    ``same``: rows of the anchor's label, or of others.  A window's rows have
    scores from its low to its high.
    """
    spark = blocks.sparkSession
    columns = blocks.columns
    packed = _asks(anchors, many).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    cells = blocks.union(packed.select(*columns)).repartition(
        max(count, partitions(spark)), "block"
    ).sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base = None, None
        for batch in batches:
            for i in range(len(batch)):
                block, kind, width, ids, labels, least, lows, highs, data = (
                    batch.column(c)[i].as_py() for c in range(9)
                )
                ids, labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                data = np.frombuffer(data, "<i4").reshape(len(ids), width)
                if kind == 0:
                    now, base = block, (ids, labels, data)
                elif block == now:
                    lows, highs = (np.frombuffer(x, "<i8").reshape(len(ids), -1) for x in (lows, highs))
                    yield from met(base, (ids, labels, data), np.frombuffer(least, "<f8"), lows, highs)

    def met(base, asks, least, lows, highs) -> Iterator[pa.RecordBatch]:
        best: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 3 for _ in range(lows.shape[1])]
        for row, ask, score in above(base[2], asks[2], least):
            right = ((base[1][row] == asks[1][ask]) == same) & (base[0][row] != asks[0][ask])
            row, ask, score = row[right], ask[right], score[right]
            for k in range(lows.shape[1]):
                some = np.flatnonzero((score >= lows[ask, k]) & (score <= highs[ask, k]))
                held = [np.concatenate(x) for x in zip(best[k], (ask[some], base[0][row[some]], score[some]), strict=True)]
                top = _first(held[0], held[2], held[1], most)
                best[k] = [x[top] for x in held]
        for k, (ask, ids, score) in enumerate(best):
            if len(ask):
                yield pa.record_batch(
                    [pa.array(asks[0][ask]), pa.array(np.full(len(ask), k, np.int32)), pa.array(ids), pa.array(score)],
                    ["anchor_id", "window", "vec_id", "score"],
                )

    found = cells.mapInArrow(run, "anchor_id long, window int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def _filled(blocks: DataFrame, anchors: DataFrame, same: bool, most: int, lower: Column, ends: Column) -> DataFrame:
    """(anchor_id, window, vec_id, score, rank) of all windows: thresholds fall until every window is filled.

    ``anchors`` has vec_id, label, vector, least, lows, highs; a window is
    complete with ``most`` rows or once the threshold is not above its low.
    ``lower`` is the next threshold, ``ends`` the last one.
    """
    count = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    parts = []
    while many := anchors.count():
        found = stored(_round(blocks, count, anchors, many, same, most), "negatives-found")
        windows = anchors.select(
            F.col("vec_id").alias("anchor_id"), "least", F.posexplode("lows").alias("window", "low")
        )
        have = found.groupBy("anchor_id", "window").agg(F.count(F.lit(1)).alias("n"))
        open_ = windows.join(have, ["anchor_id", "window"], "left").where(
            (F.coalesce("n", F.lit(0)) < most) & (F.col("least") > F.col("low"))
        ).select(F.col("anchor_id").alias("vec_id")).distinct()
        again = anchors.join(open_, "vec_id", "left_semi")
        parts.append(found.join(open_.withColumnRenamed("vec_id", "anchor_id"), "anchor_id", "left_anti"))
        anchors = stored(again.withColumn("least", F.greatest(lower, ends)), "negatives-anchors")
    if not parts:
        return blocks.sparkSession.createDataFrame([], "anchor_id long, window int, vec_id long, score long, rank int")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def hard_negatives(vectors: DataFrame, anchor: Column, low: int = 80, high: int = 100, positives: int = 5,
                   negatives: int = 5, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has vec_id, label and embedding, ``anchor`` tells the rows that
    search.  Each of an anchor's ``positives`` best rows of its label gets the
    best ``negatives`` rows of other labels that score from ``low`` to ``high``
    percent of it.  Scores are inner products of floor(``scale`` * component).
    """
    spark = vectors.sparkSession
    ship(spark)
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("vector"),
        anchor.alias("asks"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(sound)
    blocks = _blocks(rows.select("vec_id", "label", "vector"), scale)
    whole = F.transform("vector", lambda x: F.floor(x * F.lit(scale)).cast("long"))
    asks = rows.where("asks").groupBy("vec_id").agg(F.min(F.struct("label", whole.alias("vector"))).alias("own"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    asks = asks.select("vec_id", "own.label", "own.vector")
    longest = rows.agg(F.max(F.aggregate(
        "vector", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * F.lit(scale)).cast("double"), F.lit(2.0))
    ))).first()[0] or 0.0
    most = F.sqrt(square) * F.lit(float(longest) ** 0.5)  # no score passes this
    first = stored(asks.select(
        "*", (most * F.lit(_FIRST)).alias("least"), F.array(F.lit(_LOWEST)).alias("lows"),
        F.array(F.lit(_HIGHEST)).alias("highs"),
        (most * F.lit(_LAST)).alias("until"),
    ), "negatives-anchors")
    falls = F.when(F.col("least") > F.col("until"), F.col("least") * F.lit(_FALL)).otherwise(F.lit(float("-inf")))
    found = stored(_filled(blocks, first, True, positives, falls, F.lit(float("-inf"))), "negatives-positives")
    # Per anchor one window for each positive whose range holds any score.
    own = found.where("score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("own")
    )
    places = F.sequence(F.lit(0), F.lit(positives - 1))

    def bounds(percent: int, up: bool, missing: int) -> Column:
        def one(i: Column) -> Column:
            share = F.get("own", i)["score"].cast("decimal(20, 0)") * F.lit(percent) / F.lit(100)
            return F.coalesce((F.ceil(share) if up else F.floor(share)).cast("long"), F.lit(missing))

        return F.transform(places, one)

    ready = asks.join(own, "vec_id").withColumn("lows", bounds(low, True, _HIGHEST)).withColumn(
        "highs", bounds(high, False, _LOWEST)
    )
    # A little below the lowest low, so that rounding leaves nothing out.
    until = F.array_min("lows").cast("double") * F.lit(1 - 1e-9) - 1
    least = F.array_min(F.transform("highs", lambda x: F.when(x > _LOWEST, x))).cast("double")
    ready = stored(ready.withColumn("until", until).withColumn("least", (least + until) / 2), "negatives-anchors")
    found = _filled(blocks, ready.drop("own"), False, negatives, F.col("until"), F.col("until"))
    owner = ready.select(F.col("vec_id").alias("anchor_id"), F.posexplode("own").alias("window", "own"))
    return found.join(owner, ["anchor_id", "window"]).select(
        "anchor_id", F.col("own.id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("own.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
