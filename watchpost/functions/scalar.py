"""Scalar column functions (``fn_*``), all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchpost.schema import (
    CVE_LINK_BASE,
    CVSS_BAND_BOUNDS,
    ELLIPSIS,
    NOT_OPEN_SOURCE_LABEL,
    OPEN_SOURCE_LABEL,
    TRUE_FLAG_TEXTS,
    TRUNCATE_AT,
)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def flag_text(col: str | Column) -> Column:
    """fn_flag_text: a bool-or-text flag is true when its text is True/true.

    ``TRUE`` does not count; NULL is false.
    """
    return F.coalesce(_c(col).cast("string").isin(*TRUE_FLAG_TEXTS), F.lit(False))


def is_lower_true(col: str | Column) -> Column:
    """``LOWER(x) = 'true'`` with SQL three-valued logic (NULL stays NULL)."""
    return F.lower(_c(col)) == F.lit("true")


def os_category(col: str | Column) -> Column:
    """fn_os_category: lower-case 'true' is open source, everything else
    (NULL included) is not."""
    return F.when(is_lower_true(col), F.lit(OPEN_SOURCE_LABEL)).otherwise(
        F.lit(NOT_OPEN_SOURCE_LABEL)
    )


def cvss_band(col: str | Column) -> Column:
    """fn_cvss_band: >=9 critical, >=7 high, >=4 medium, else low; NULL none."""
    c = _c(col).try_cast("double")
    crit, high, medium = CVSS_BAND_BOUNDS
    return (
        F.when(c.isNull(), F.lit(None))
        .when(c >= crit, F.lit("critical"))
        .when(c >= high, F.lit("high"))
        .when(c >= medium, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def cve_link(col: str | Column) -> Column:
    """fn_cve_link: NVD detail URL for a CVE id; NULL/empty gives NULL."""
    c = _c(col)
    return F.when(c.isNull() | (c == F.lit("")), F.lit(None)).otherwise(
        F.concat(F.lit(CVE_LINK_BASE), c)
    )


def truncate(col: str | Column, n: int = TRUNCATE_AT) -> Column:
    """fn_truncate: first n characters plus an ellipsis when longer.

    NULL is shown as empty text, as the table does.
    """
    c = F.coalesce(_c(col), F.lit(""))
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ELLIPSIS))).otherwise(c)


def iso_day(col: str | Column) -> Column:
    """fn_iso_day: timestamp to ``YYYY-MM-DD`` in the session zone (UTC)."""
    return F.date_format(_c(col), "yyyy-MM-dd")
