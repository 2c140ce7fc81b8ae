"""Row filters (``flt_*``): membership lists AND a free-text search.

A filter is one ``where`` of built-in predicates, so Catalyst pushes the
membership tests (``In``) into the Parquet scan as row-group filters, and the
search runs inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchpost.schema import ALERTS, DEPS, SECRETS, Binding


def like_escape(text: str) -> str:
    """Make user text safe for Spark's LIKE without changing its meaning.

    ``%`` and ``_`` stay wildcards, as in the reference.  Spark treats a
    backslash as the escape character (DuckDB has none by default), so each
    backslash is doubled to stand for itself.
    """
    return text.replace("\\", "\\\\")


def search_predicate(q: str, columns: Iterable[str]) -> Column:
    """Case-insensitive substring match OR-ed over ``columns``; NULL reads as ''."""
    pattern = "%" + like_escape(q) + "%"
    preds = [F.coalesce(F.col(c), F.lit("")).ilike(pattern) for c in columns]
    return reduce(or_, preds) if preds else F.lit(False)


def predicate(df: DataFrame, binding: Binding, search: str = "",
              is_open_source: str | None = None, **members: list[str] | None) -> Column | None:
    """Build the conjunction for ``binding``; ``None`` means no filter.

    Empty or missing lists mean "no filter".  ``is_open_source`` (dependencies
    only) applies whenever it is not None, so ``''`` is a real filter that
    matches nothing.
    """
    unknown = set(members) - set(binding.members)
    if unknown:
        raise ValueError(f"unknown filter(s) for {binding.name}: {sorted(unknown)}")
    preds: list[Column] = []
    for arg, col in binding.members.items():
        values = members.get(arg)
        if isinstance(values, str):
            values = [values]
        if values:
            preds.append(F.col(col).isin(list(values)))
    if is_open_source is not None:
        preds.append(F.col("is_open_source") == F.lit(is_open_source))
    if search:
        cols = [c for c in binding.search if c in df.columns]
        preds.append(search_predicate(search, cols))
    return reduce(and_, preds) if preds else None


def apply(df: DataFrame, binding: Binding, search: str = "",
          is_open_source: str | None = None, **members) -> DataFrame:
    p = predicate(df, binding, search, is_open_source, **members)
    return df if p is None else df.where(p)


def alerts(df: DataFrame, search: str = "", severity=None, state=None, ecosystem=None,
           org=None) -> DataFrame:
    """flt_alerts / flt_alerts_search."""
    return apply(df, ALERTS, search, severity=severity, state=state, ecosystem=ecosystem, org=org)


def deps(df: DataFrame, search: str = "", org=None, repo=None, package_file=None,
         is_open_source: str | None = None) -> DataFrame:
    """flt_deps / flt_deps_search."""
    return apply(df, DEPS, search, is_open_source, org=org, repo=repo, package_file=package_file)


def secrets(df: DataFrame, search: str = "", secret_type=None, state=None, validity=None,
            org=None) -> DataFrame:
    """flt_secrets (search columns are a design choice: type, repo, org)."""
    return apply(df, SECRETS, search, secret_type=secret_type, state=state, validity=validity,
                 org=org)
