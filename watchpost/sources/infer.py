"""Types of text columns, found from a sample and applied to all rows.

Each value fits some of the candidate types; a column's type is the first of
``boolean``, ``bigint``, ``double``, ``date``, ``timestamp`` that all its
sampled values fit, else it stays text.  What is known of a column is one flag
per candidate, so samples of several files are merged by AND.  Values beyond
the sample that do not fit become NULL; nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows looked at, the first ones of the input.
SAMPLE_ROWS = 20_000

#: What a value of each type looks like, in the order in which types are tried.
PATTERNS = {
    "boolean": r"(?i)^(true|false)$",
    "bigint": r"^[+-]?[0-9]+$",
    "double": r"(?i)^([+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)(e[+-]?[0-9]+)?|[+-]?(inf|infinity|nan))$",
    "date": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$",
    "timestamp": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?)?$",
}


def typed(value: Column, kind: str) -> Column:
    """A text value as the type, NULL where it does not look like one or is out of range."""
    bare = F.trim(value)
    return F.when(F.regexp_like(bare, F.lit(PATTERNS[kind])), bare.try_cast(kind))


def flags(sample: DataFrame, columns: list[str]) -> DataFrame:
    """One row: per column whether it has a value, and per candidate type whether all values fit."""
    out = []
    for i, name in enumerate(columns):
        value = F.col(f"`{name.replace('`', '``')}`")
        fits = [F.coalesce(F.bool_and(typed(value, kind).isNotNull() | value.isNull()), F.lit(True)).alias(kind)
                for kind in PATTERNS]
        seen = F.coalesce(F.bool_or(value.isNotNull()), F.lit(False)).alias("seen")
        out.append(F.struct(seen, *fits).alias(f"c{i}"))
    return sample.agg(*out)


def kinds(samples: list[DataFrame], columns: list[str]) -> dict[str, str]:
    """The type of each column that is not text, from the samples of all inputs that have it."""
    known: dict[str, dict[str, bool]] = {}
    for sample in samples:
        own = [c for c in columns if c in sample.columns]
        if not own:
            continue
        found = flags(sample, own).first()
        for i, name in enumerate(own):
            got = found[f"c{i}"].asDict()
            old = known.setdefault(name, dict.fromkeys(got, True) | {"seen": False})
            known[name] = {k: old[k] or got[k] if k == "seen" else old[k] and got[k] for k in got}
    out = {}
    for name, got in known.items():
        fitting = [kind for kind in PATTERNS if got[kind]]
        if got["seen"] and fitting:
            out[name] = fitting[0]
    return out


def apply(df: DataFrame, found: dict[str, str]) -> DataFrame:
    """The columns cast to the types found."""
    return df.withColumns({
        name: typed(F.col(f"`{name.replace('`', '``')}`"), kind) for name, kind in found.items() if name in df.columns
    })
