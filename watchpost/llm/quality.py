"""Quality classifier: regularised quadratic discriminant analysis.

Every whole text becomes a vector of transformed document statistics (logs of
counts, logits of shares).  The training rows' moments per class (count, sum,
sum of outer products) are added up across the cluster, so any number of
labelled rows may be learnt from; only these moments reach the driver.  Each
class covariance is shrunk towards the pooled one and then towards a scaled
identity, factored once by Cholesky, and a document's score is the logistic of
the difference of the two class log-densities (Mahalanobis distance and
log-determinant from the factors) plus the log-odds of the classes, divided by
a temperature, as neighbouring statistics are not independent.

Inputs of a score are the text's statistics alone.

Defined cases: a null or empty text has the statistics of no bytes and gets a
score like any other; rows that repeat a doc_id are scored each, and count as
often in training as they match a label; a null label or doc_id trains nothing;
without two rows of each class every score is the share of the larger class's
label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchpost.llm.base import ship, stored

#: Weight of the pooled covariance, weight of the identity, temperature.
SHRINK_POOLED, SHRINK_IDENTITY, TEMPERATURE = 0.9, 0.02, 4.0

_CLASS = np.zeros((256, 7))
for _c in range(256):
    _CLASS[_c, 0] = 0x61 <= _c <= 0x7A
    _CLASS[_c, 1] = 0x41 <= _c <= 0x5A
    _CLASS[_c, 2] = 0x30 <= _c <= 0x39
    _CLASS[_c, 3] = _c in b".,"
    _CLASS[_c, 4] = 0x21 <= _c <= 0x7E and not chr(_c).isalnum() and _c not in b".,"
    _CLASS[_c, 5] = _c in b" \t\n\r\x0b\x0c"
    _CLASS[_c, 6] = _c >= 0x80

NAMES = (
    "words", "word_bytes", "long_words", "short_words", "lower", "upper", "digits", "stops", "symbols",
    "blanks", "high", "entropy", "distinct_words", "repeated_next", "capital_words", "top_word",
    "symbol_words", "lines", "distinct_lines", "distinct_sentences", "ends_with_stop",
)


def _logit(part: float, whole: float) -> float:
    """The logit of a share, with half a count added to either side."""
    return math.log((part + 0.5) / (max(whole - part, 0.0) + 0.5))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text, in the order of NAMES."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lower, upper, digits, stops, symbols, blanks, high = (bytes_ @ _CLASS).tolist()
    share = bytes_[bytes_ > 0] / max(n, 1)
    entropy = float(-(share * np.log2(share)).sum()) if n else 0.0
    words = data.split()
    k = len(words)
    sizes = np.fromiter(map(len, words), np.int64, k)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    sentences = [x for x in data.replace(b"\n", b". ").split(b". ") if x.strip()]
    marked = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 0x80 and w[-1] not in b".,")
    return [
        math.log1p(k), math.log1p(float(sizes.mean()) if k else 0.0),
        _logit(int((sizes > 12).sum()), k), _logit(int((sizes <= 3).sum()), k),
        _logit(lower, n), _logit(upper, n), _logit(digits, n), _logit(stops, n), _logit(symbols, n),
        _logit(blanks, n), _logit(high, n), entropy, _logit(len(counts), k),
        _logit(sum(map(eq, words, words[1:])), k), _logit(sum(1 for w in words if w.isupper()), k),
        _logit(max(counts.values(), default=0), k), _logit(marked, k),
        math.log1p(len(lines)), _logit(len(set(lines)), len(lines)), _logit(len(set(sentences)), len(sentences)),
        _logit(sum(1 for x in lines if x.rstrip()[-1:] in (b".", b"!", b"?")), len(lines)),
    ]


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``stats``, the statistics of the text, per document."""
    fields = docs.select(*keep).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(t) for t in batch.column(0).to_pylist()], np.float64)
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(NAMES)), pa.array(stats.ravel())
            )
            yield pa.record_batch([*batch.columns[1:], flat], [*keep, "stats"])

    return docs.select(F.col("text").cast("string").alias("__text"), *keep).mapInArrow(
        run, schema + ", stats array<double>"
    )


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of ``stats`` per ``label`` (0 or 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(NAMES) + 1
        total = np.zeros((2, p, p))
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, p - 1)
            x = np.hstack([np.ones((len(x), 1)), x])
            label = batch.column(0).to_numpy()
            for c in (0, 1):
                total[c] += x[label == c].T @ x[label == c]
        at = np.arange(total.size, dtype=np.int32)
        yield pa.record_batch([pa.array(at), pa.array(total.ravel())], ["at", "value"])

    p = len(NAMES) + 1
    sums = rows.select(F.col("label").cast("int").alias("label"), "stats").mapInArrow(
        run, "at int, value double"
    ).groupBy("at").agg(F.sum("value").alias("value")).collect()  # 2 (p + 1)^2 numbers
    total = np.zeros(2 * p * p)
    for r in sums:
        total[r["at"]] = r["value"]
    total = total.reshape(2, p, p)
    return {c: (round(total[c, 0, 0]), total[c, 0, 1:], total[c, 1:, 1:]) for c in (0, 1)}


class Discriminant:
    """Two Gaussian classes with their cached Cholesky factors."""

    def __init__(self, found: dict[int, tuple[int, np.ndarray, np.ndarray]], pooled: float = SHRINK_POOLED,
                 identity: float = SHRINK_IDENTITY, temperature: float = TEMPERATURE):
        n = {c: found[c][0] for c in (0, 1)}
        self.temperature = temperature
        self.prior = math.log((n[1] + 1) / (n[0] + 1))
        self.trained = min(n.values()) >= 2
        if not self.trained:
            return
        self.mean = {c: found[c][1] / n[c] for c in (0, 1)}
        scatter = {c: found[c][2] - n[c] * np.outer(self.mean[c], self.mean[c]) for c in (0, 1)}
        both = (scatter[0] + scatter[1]) / (n[0] + n[1])
        # Statistics are scaled to pooled variance one, so that the identity is a fair target.
        self.scale = 1 / np.sqrt(np.maximum(np.diag(both), 1e-12))
        outer = np.outer(self.scale, self.scale)
        size = len(self.scale)
        self.root, self.logdet = {}, {}
        for c in (0, 1):
            own = (1 - pooled) * scatter[c] / n[c] + pooled * both
            own = own * outer
            own = (1 - identity) * own + identity * max(np.trace(own) / size, 1e-6) * np.eye(size)
            low = np.linalg.cholesky(own)
            self.root[c] = np.linalg.inv(low)
            self.logdet[c] = 2 * float(np.log(np.diag(low)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability-like score of class 1 for each row of statistics."""
        if not self.trained:
            return np.full(len(x), 1 / (1 + math.exp(-self.prior)))
        density = {}
        for c in (0, 1):
            z = ((x - self.mean[c]) * self.scale) @ self.root[c].T
            density[c] = -0.5 * ((z * z).sum(axis=1) + self.logdet[c])
        raw = (density[1] - density[0] + self.prior) / self.temperature
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def train(stats: DataFrame, labels: DataFrame, learn: Column, **options: float) -> Discriminant:
    """Fit on the documents with a label for which ``learn`` (of doc_id) holds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(
        F.col("label").isin(0, 1) & learn
    )
    rows = stats.select(F.col("doc_id").cast("long").alias("doc_id"), "stats").join(known, "doc_id")
    return Discriminant(moments(rows), **options)


def scored(rows: DataFrame, model: Discriminant, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns and ``score`` of measured documents."""
    fields = rows.select(*keep).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.record_batch([*batch.columns[1:], pa.array(model.score(x))], [*keep, "score"])

    return rows.select("stats", *keep).mapInArrow(run, schema + ", score double")


def held_out() -> Column:
    """Whether a document's label is kept from training."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1: good) of every document."""
    ship(docs.sparkSession)
    stats = stored(measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "quality")
    model = train(stats, labels, ~held_out())
    return scored(stats, model, ("doc_id",)).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier does not reject."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    # Measured here for training and once more for the decision: cheaper than shuffling the texts.
    stats = measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    model = train(stats, labels, ~held_out())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(at).to_pylist()], np.float64)
            yield batch.filter(pa.array(model.score(x.reshape(-1, len(NAMES))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
