"""Line deduplication by site-relative frequency.

For every site (the host of a page's url, the source of a document) and every
line, the number of the site's pages that hold the line is divided by the number of
the site's pages.  Lines whose share exceeds a ratio are boilerplate of that
site and are dropped from all its pages.  Pages of a site with one and the
same text are one page, else an article copied often would pass for
boilerplate.

DataFrame functions only.  Lines are exploded as two 64-bit hashes (128 bits)
once per page, and counted with a combine before the shuffle.  The result has
few rows however large the site: a site with L distinct lines a page on
average has fewer than L / ratio such lines.  They are written as one row per
site and joined to the documents; Catalyst broadcasts that table by its size
on disk, or else joins by site and splits a hot one.

Defined cases: a null text stays null; lines are compared without the blanks
around them, and blank lines are never counted or dropped; a null site is a
site of its own; a line must stand in at least ``min_pages`` pages, so small
sites lose nothing by chance; rows that repeat an id are pages like any other;
an empty table stays empty.  A host is compared in lower case, without user,
port and a last dot; a url without a host (null, relative, of another kind)
belongs to the null site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchpost.llm.base import free, stored

#: Share of a site's pages above which a line is boilerplate, and pages it must stand in (the README says why).
MAX_RATIO, MIN_PAGES = 0.06, 5

#: An absolute or scheme-relative url up to its host: the scheme, a user, then a name or a bracketed address.
_HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\s]*)"


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def _name(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def host(url: Column) -> Column:
    """The host of a url, null where it has none."""
    found = F.regexp_extract(url.cast("string"), _HOST, 1)
    return F.nullif(F.lower(F.regexp_replace(found, r"\.$", "")), F.lit(""))


def _site(docs: DataFrame, site: str, url: str | None) -> Column:
    return docs[site].cast("string") if url is None else host(docs[url])


def boilerplate(docs: DataFrame, site: str = "source", max_ratio: float = MAX_RATIO,
                min_pages: int = MIN_PAGES, url: str | None = None) -> DataFrame:
    """(site, lines): the hashes of each site's boilerplate lines; see ``drop_boilerplate`` for the site."""
    pages = docs.where(F.col("text").isNotNull()).select(
        _site(docs, site, url).alias("site"), F.col("text").cast("string").alias("text")
    )
    keyed = pages.select("site", _name(F.col("text")).alias("page"), "text")
    total = keyed.groupBy("site", "page").agg(F.lit(1).alias("one")).groupBy("site").agg(F.count("one").alias("pages"))
    own = F.array_distinct(F.transform(F.split("text", "\n"), _bare))
    lines = keyed.select("site", "page", F.explode(F.filter(own, lambda x: x != "")).alias("line"))
    each = lines.select("site", "page", _name(F.col("line")).alias("line")).groupBy("site", "line", "page").agg(
        F.lit(1).alias("one")
    )
    count = each.groupBy("site", "line").agg(F.count("one").alias("n")).where(F.col("n") >= min_pages)
    often = count.join(total, count["site"].eqNullSafe(total["site"])).where(F.col("n") > max_ratio * F.col("pages"))
    return often.groupBy(count["site"].alias("site")).agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, site: str = "source", max_ratio: float = MAX_RATIO,
                     min_pages: int = MIN_PAGES, url: str | None = None) -> DataFrame:
    """The documents with their boilerplate lines cut from ``text``.

    The site is the column ``site``, or the host of the column ``url`` if given.
    Adds ``__n_lines`` and ``__n_dropped`` (the lines that are not blank, and
    those of them dropped); a text without such lines stays as it is.
    """
    of, cut, left = free(docs, "__site", "__lines", "__kept")
    found = stored(boilerplate(docs, site, max_ratio, min_pages, url), "boilerplate").withColumnsRenamed(
        {"site": of, "lines": cut}
    )
    joined = docs.join(found, _site(docs, site, url).eqNullSafe(F.col(of)), "left")
    split = F.split(F.col("text"), "\n")
    kept = F.filter(split, lambda x: (_bare(x) == "") | ~F.array_contains(F.col(cut), _name(_bare(x))))
    has = F.col(cut).isNotNull()
    full = F.size(F.filter(split, lambda x: _bare(x) != ""))
    return joined.withColumn(left, F.when(has, kept)).withColumns({
        "__n_lines": F.coalesce(F.when(F.col("text").isNotNull(), full), F.lit(0)).cast("long"),
        "__n_dropped": F.coalesce(F.when(has, F.size(split) - F.size(left)), F.lit(0)).cast("long"),
    }).withColumn(
        "text", F.when(F.col("__n_dropped") > 0, F.array_join(left, "\n")).otherwise(F.col("text"))
    ).drop(of, cut, left)
