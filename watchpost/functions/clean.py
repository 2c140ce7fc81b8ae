"""Cleaning projections (``cln_*``) and delivery of results.

Every function here is a single ``select``/``withColumns`` of built-in
expressions, so it stays inside whole-stage codegen and is pushed through by
Catalyst like any other projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Text that starts with year, month and day.
FULL_DATE = r"^\s*\d{4,}-\d{1,2}-\d{1,2}($|[\sT])"
#: A number with a Java type letter.
TYPE_LETTER = r"[0-9.][dDfF]\s*$"
#: What counts as a whole number in text: digits, single underscores between them.
WHOLE_NUMBER = r"^\s*[+-]?\d+(_\d+)*\s*$"


def try_timestamp(df: DataFrame, columns: list[str]) -> DataFrame:
    """cln_try_timestamp: text date columns to timestamp; bad text -> NULL.

    Columns that are absent are skipped, columns that are already temporal
    are left alone (the reference only repairs VARCHAR columns).  A value needs
    a full date: Spark alone would read a bare time as today's and a bare year
    or month as its first day.
    """
    types = dict(df.dtypes)
    fix = {
        c: F.when(F.col(c).rlike(FULL_DATE), F.col(c).try_cast("timestamp"))
        for c in columns if types.get(c) == "string"
    }
    return df.withColumns(fix) if fix else df


def try_double(col: str | Column) -> Column:
    """cln_try_double: text or number to double, unparseable -> NULL."""
    c = F.col(col) if isinstance(col, str) else col
    # Java's parser takes a type letter after a number; no export means one.
    return F.when(~c.cast("string").rlike(TYPE_LETTER), c.try_cast("double"))


def empty_to_null(df: DataFrame) -> DataFrame:
    """cln_empty_to_null: ``''`` becomes NULL on every string column."""
    types = dict(df.dtypes)
    return df.select([
        F.nullif(F.col(c), F.lit("")).alias(c) if types[c] == "string" else F.col(c)
        for c in df.columns
    ])


def finite(col: str | Column) -> Column:
    """NaN and +/-Infinity become NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def nonfinite_to_null(df: DataFrame) -> DataFrame:
    """cln_nonfinite_to_null over every float/double column."""
    fix = {
        f.name: finite(f.name).cast(f.dataType)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fix) if fix else df


def safe_int(col: str | Column) -> Column:
    """cln_safe_int: any value to a whole number; NULL, NaN, Inf, bad -> 0.

    By type, as Python's ``int()`` does: whole numbers and booleans as they
    are, other numbers truncated toward zero, text only if it is a whole
    number (``'12.7'`` and ``'1e3'`` are 0).
    """
    c = F.col(col) if isinstance(col, str) else col
    kind = F.typeof(c)
    text = c.cast("string")
    digits = F.when(text.rlike(WHOLE_NUMBER), F.regexp_replace(F.trim(text), "_", ""))
    real = finite(text.try_cast("double"))
    whole = (
        F.when(kind.isin("tinyint", "smallint", "int", "bigint"), text.try_cast("long"))
        .when(kind.isin("double", "float"), real.try_cast("long"))
        .when(kind.startswith("decimal"), F.regexp_extract(text, r"^-?\d+", 0).try_cast("long"))
        .when(kind == "boolean", F.when(text == "true", F.lit(1)).otherwise(F.lit(0)).cast("long"))
        .when(kind == "string", digits.try_cast("long"))
    )
    return F.coalesce(whole, F.lit(0).cast("long"))


def select_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """prj_display_*: the wanted columns that exist, in order; all if none."""
    present = [c for c in wanted if c in df.columns]
    return df.select(*present) if present else df


def iso_text(col: str | Column) -> Column:
    """Timestamp as ISO-8601 text, the way a JSON payload carries it.

    Fractions are printed only when non-zero (``2024-01-01T00:00:07.179575``
    vs ``1995-01-01T00:00:00``), matching Python's ``isoformat``.
    """
    c = F.col(col) if isinstance(col, str) else col
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(c.isNull(), F.lit(None)).when(
        micros == F.lit("000000"), whole
    ).otherwise(F.concat(whole, F.lit("."), micros))


def deliver(df: DataFrame) -> DataFrame:
    """Final projection before rows leave the engine.

    Mirrors the reference's record cleaning: non-finite doubles become NULL
    and timestamps become ISO text.
    """
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(finite(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(iso_text(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(out)
