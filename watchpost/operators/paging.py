"""Paging (``page_*``): a complete order, then the rows of given ranks, or a seek key.

A page is ``orderBy(...).offset(o).limit(n)``, planned as a single
``TakeOrderedAndProject``: every partition keeps only its best ``o + n`` rows
and the survivors are merged.  So that no task ever holds more than
``RANK_ROWS`` rows, the range that holds the page's first rank is narrowed
until the offset inside it is small: a sample of keys cuts the range into
smaller ones, one aggregate counts the rows of each, and their running sum
tells which one holds the rank.  The sample only steers; all counts are exact.
Rows equal to a sampled key are counted apart, so a key repeated very often is
never ranked at all: its rows are the same as shown.  The order ends with all
display columns, so every row is on exactly one page.

Each round reads all rows of its range, so the frame's rows are written to the
shared checkpoint folder first: what stands below them (joins, and the tables
these broadcast through the driver) runs once for a page, not once a round.

``page_after`` offers seek paging (``WHERE key >= last ORDER BY key``), whose
cost does not depend on how deep the page is.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from watchpost.functions.clean import select_existing
from watchpost.schema import ALERTS, DEPS, PAGE_SIZE_MAX, SECRETS, Binding
from watchpost.session import scratch_dir


def check_page(page: int, page_size: int) -> None:
    if page < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= page_size <= PAGE_SIZE_MAX:
        raise ValueError(f"page_size must be within 1..{PAGE_SIZE_MAX}")


def order_names(df: DataFrame, binding: Binding) -> list[str]:
    """The page order's columns, completed by the remaining display columns."""
    names = [*binding.page_order, *[c for c in binding.display if c not in binding.page_order]]
    return [c for c in names if c in df.columns] or df.columns


def order_columns(df: DataFrame, binding: Binding) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order_names(df, binding)]


#: Rows of the page order that a task holds at most.
RANK_ROWS = 10_000
#: Keys sampled to cut a range, and the cuts made of them.
_SAMPLE_KEYS, _CUTS = 2_000, 32


def _key(df: DataFrame, names: list[str], row: Row | None = None) -> Column:
    """The order key of each row, or of the given one: compares as ``ASC NULLS LAST`` of the columns."""
    parts = []
    for name in names:
        value = F.col(f"`{name}`") if row is None else F.lit(row[name]).cast(df.schema[name].dataType)
        parts += [value.isNull(), value]
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def _cuts(rows: DataFrame, names: list[str], count: int) -> list[Row]:
    """Some keys of the rows, in order and about evenly spread."""
    share = _SAMPLE_KEYS / count
    while True:
        some = rows if share >= 1 else rows.sample(fraction=share, seed=count)
        keys = some.select(*[F.col(f"`{n}`") for n in names]).distinct()
        found = keys.orderBy(*[F.col(f"`{n}`").asc_nulls_last() for n in names]).limit(2 * _SAMPLE_KEYS).collect()
        if found or share >= 1:
            return found[:: max(1, len(found) // _CUTS)]
        share *= 8


def _stored(rows: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read back."""
    spark = rows.sparkSession
    path = scratch_dir(spark, "page")
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def page(df: DataFrame, binding: Binding, page: int = 1, page_size: int = 50) -> DataFrame:
    """Rows of one page of an (already filtered) frame, display columns only."""
    check_page(page, page_size)
    shown = select_existing(df, binding.display)
    names, order = order_names(shown, binding), order_columns(shown, binding)
    key = _key(shown, names)
    skip, count = (page - 1) * page_size, None
    if skip + page_size > RANK_ROWS:
        shown = _stored(shown)
    rows = shown
    while skip + page_size > RANK_ROWS:
        count = rows.count() if count is None else count
        if skip >= count:
            return shown.limit(0)
        cuts = _cuts(rows, names, count)
        bounds = F.array(*[_key(shown, names, c) for c in cuts])
        # Even numbers lie between two cuts, odd ones are equal to a cut.
        place = 2 * F.size(F.filter(bounds, lambda b: b < key)) + F.array_contains(bounds, key).cast("int")
        sizes = {r[0]: r[1] for r in rows.groupBy(place.alias("place")).count().collect()}
        before = 0
        for at in sorted(sizes):
            if before + sizes[at] > skip:
                break
            before += sizes[at]
        skip -= before
        cut = _key(shown, names, cuts[at // 2]) if at // 2 < len(cuts) else None
        if at % 2:
            same = shown.where(key == cut).limit(min(page_size, sizes[at] - skip))
            rest = page_size - (sizes[at] - skip)
            if rest <= 0:
                return same
            return same.union(shown.where(key > cut).orderBy(*order).limit(rest)).orderBy(*order)
        if at:
            rows = rows.where((key > _key(shown, names, cuts[at // 2 - 1])) & _from(names[0], cuts[at // 2 - 1][0]))
        # Up to the first cut behind the page.
        total = 0
        for far in sorted(p for p in sizes if p >= at):
            total += sizes[far]
            if total >= skip + page_size:
                break
        if far // 2 < len(cuts):
            rows = rows.where((key <= _key(shown, names, cuts[far // 2])) & _upto(names[0], cuts[far // 2][0]))
            total += 0 if far % 2 else sizes.get(far + 1, 0)
        count = total
    return rows.orderBy(*order).offset(skip).limit(page_size)


def _from(name: str, value) -> Column:
    """What a lower bound of the whole key says of its first column, in a form that reaches the scan."""
    column = F.col(f"`{name}`")
    return column.isNull() if value is None else column.isNull() | (column >= F.lit(value))


def _upto(name: str, value) -> Column:
    return F.lit(True) if value is None else F.col(f"`{name}`") <= F.lit(value)


def _after(columns: list[str], last: list) -> Column:
    """Rows strictly after ``last`` in ``col ASC NULLS LAST`` order."""
    terms = []
    for i, col in enumerate(columns):
        c, v = F.col(col), last[i]
        if v is None:
            # Nothing sorts after NULL at this position.
            greater = F.lit(False)
        else:
            greater = (c > F.lit(v)) | c.isNull()
        equal_prefix = [
            F.col(columns[j]).isNull() if last[j] is None else (F.col(columns[j]) == F.lit(last[j]))
            for j in range(i)
        ]
        term = reduce(lambda a, b: a & b, equal_prefix, greater)
        terms.append(term)
    return F.coalesce(reduce(or_, terms), F.lit(False))


def page_after(df: DataFrame, binding: Binding, last: list | None, page_size: int = 50,
               repeats: int = 1) -> DataFrame:
    """Seek paging: the ``page_size`` rows following the row whose order key
    is ``last`` (``None`` for the first page).

    ``last`` holds the values of ``order_names``, all of them.  ``repeats`` is
    the number of rows equal to ``last`` that were already shown, so a page
    may end inside a run of equal rows.
    """
    check_page(1, page_size)
    if repeats < 1:
        raise ValueError("repeats must be >= 1")
    shown = select_existing(df, binding.display)
    cols = order_names(shown, binding)
    ordered = order_columns(shown, binding)
    if last is None:
        return shown.orderBy(*ordered).limit(page_size)
    if len(last) != len(cols):
        raise ValueError(f"seek paging needs the whole key: {', '.join(cols)}")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(cols, last, strict=True)])
    at_or_after = shown.where(_after(cols, list(last)) | same)
    return at_or_after.orderBy(*ordered).offset(repeats).limit(page_size)


def envelope(df: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    """page_envelope + page_span: one row of paging facts for a filtered frame.

    ``total_pages = max(1, ceil(total / page_size))``; ``first_row`` and
    ``last_row`` are the 1-based span the table prints ("showing a-b"):
    ``first_row`` is not clamped, ``last_row`` is ``min(page*size, total)``.
    """
    check_page(page, page_size)
    total = F.col("total")
    start = (page - 1) * page_size
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        total,
        F.lit(page).cast("long").alias("page"),
        F.lit(page_size).cast("long").alias("page_size"),
        F.greatest(F.lit(1).cast("long"), F.expr(f"(total + {page_size - 1}) div {page_size}"))
        .alias("total_pages"),
        F.lit(start + 1).cast("long").alias("first_row"),
        F.least(F.lit(page * page_size).cast("long"), total).alias("last_row"),
    )


def alerts(df: DataFrame, page_no: int = 1, page_size: int = 50) -> DataFrame:
    return page(df, ALERTS, page_no, page_size)


def deps(df: DataFrame, page_no: int = 1, page_size: int = 50) -> DataFrame:
    return page(df, DEPS, page_no, page_size)


def secrets(df: DataFrame, page_no: int = 1, page_size: int = 50) -> DataFrame:
    return page(df, SECRETS, page_no, page_size)
