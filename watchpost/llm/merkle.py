"""Document fingerprints: a Merkle tree over blocks, paragraphs and sections.

Sections are what a double line end separates, paragraphs the lines of a
section, and blocks at most ``BLOCK`` code points of a paragraph in a row.  A
block's digest is the SHA-256 of its text; the digest of a paragraph, section
or document is the SHA-256 of its children's digests in order, with a letter
for the level before them.  Separators are fixed, so two texts have one root
exactly if they are equal.  Where roots differ, the differing sections,
paragraphs and blocks locate the edit: at each level equal nodes at the front
and at the back are set aside, the nodes between are compared one by one, and
the search goes down into those that differ.  What one tree has and the other
lacks at all differs with all its blocks.

The likeness of two trees is the Dice coefficient of their distinct block
digests: twice the common ones by the sum of both.

DataFrame functions only.  The order of documents by id is cut into ranges,
so that no step needs all rows in one task.

Defined cases: a null text is an empty one, whose tree is one empty block; of
rows that share a doc_id those with the larger text hash come first; a single
document is its own next one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchpost.llm.base import key_of, partitions, stored

#: Code points of a block at most.
BLOCK = 32


def _digest(level: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(level), F.array_join(children, "")), 256)


def tree(text: Column) -> Column:
    """The block digests of a text as sections of paragraphs of blocks."""

    def blocks(paragraph: Column) -> Column:
        cut = F.regexp_extract_all(paragraph, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
        return F.transform(F.when(paragraph == "", F.array(F.lit(""))).otherwise(cut), lambda b: F.sha2(b, 256))

    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), blocks))


def section_digests(nodes: Column) -> Column:
    """The section digests of a tree."""
    return F.transform(
        nodes, lambda s: _digest("s", F.transform(s, lambda p: _digest("p", p)))
    )


def root(nodes: Column) -> Column:
    """The root of a tree, in hexadecimal."""
    return _digest("d", section_digests(nodes))


def leaves(nodes: Column) -> Column:
    """The distinct block digests of a tree, 64 bits of each: enough to compare two documents."""
    return F.array_distinct(F.transform(F.flatten(F.flatten(nodes)), lambda d: F.xxhash64(d)))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of block digests."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _differing(x: Column, y: Column, found: Callable[[Column, Column], Column]) -> Column:
    """Of the nodes ``i`` of x that differ, ``found(i, paired)``; if not paired, y has nothing in that place."""

    def first(least: Column, same: Callable[[Column], Column]) -> Column:
        return F.array_min(F.filter(F.sequence(F.lit(0), least), lambda i: (i == least) | ~same(i)))

    def between(front: Column, back: Column) -> Column:
        end, last = F.size(x) - back, F.size(y) - back
        every = F.when(end > front, F.sequence(front, end - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            F.filter(every, lambda i: (i >= last) | (F.get(x, i) != F.get(y, i))), lambda i: found(i, i < last)
        )

    least = F.least(F.size(x), F.size(y))
    return _let(
        first(least, lambda i: F.get(x, i) == F.get(y, i)),
        lambda front: _let(
            first(least - front, lambda i: F.get(x, F.size(x) - 1 - i) == F.get(y, F.size(y) - 1 - i)),
            lambda back: between(front, back),
        ),
    )


def _paired(a: Column, b: Column, digests: Callable[[Column], Column],
            found: Callable[[Column, Column], Column]) -> Column:
    """``_differing`` by the digests of the nodes of a and b, computed once."""
    return _let(
        F.struct(digests(a).alias("x"), digests(b).alias("y")),
        lambda s: _differing(s["x"], s["y"], found),
    )


def _paragraph_digests(section: Column) -> Column:
    return F.transform(section, lambda p: _digest("p", p))


def _partner(nodes: Column, i: Column, paired: Column, kind: str) -> Column:
    return F.when(paired, F.get(nodes, i)).otherwise(F.array().cast(kind))


def edits(a: Column, b: Column) -> Column:
    """Numbers of the sections of the first tree that differ from the second."""
    return _paired(a, b, section_digests, lambda i, paired: i)


def edited_blocks(a: Column, b: Column) -> Column:
    """(section, paragraph, block): numbers of the blocks of the first tree that differ from the second.

    Empty if the second has all that the first has, and more; what it has
    more is found with the trees exchanged.
    """

    def in_paragraph(i: Column, j: Column, p: Column, q: Column) -> Column:
        return _differing(p, q, lambda k, paired: F.struct(i.alias("section"), j.alias("paragraph"), k.alias("block")))

    def in_section(i: Column, s: Column, t: Column) -> Column:
        return F.flatten(_paired(s, t, _paragraph_digests, lambda j, paired: _let(
            F.struct(F.get(s, j).alias("p"), _partner(t, j, paired, "array<string>").alias("q")),
            lambda pq: in_paragraph(i, j, pq["p"], pq["q"]),
        )))

    return F.flatten(_paired(a, b, section_digests, lambda i, paired: _let(
        F.struct(F.get(a, i).alias("s"), _partner(b, i, paired, "array<array<string>>").alias("t")),
        lambda st: in_section(i, st["s"], st["t"]),
    )))


def _numbered(docs: DataFrame) -> DataFrame:
    """(key, tie, n_chars, twin, pos): every row's place in falling order of doc_id.

    ``twin`` tells rows equal in key and tie apart.  The ranges are stored
    before they are counted, so that all later reads see the same ones.
    """
    spark = docs.sparkSession
    order = [F.col("key").desc(), F.col("tie").desc()]
    ranged = docs.select("key", "tie", "n_chars").repartitionByRange(partitions(spark), *order)
    rows = stored(ranged.withColumn("part", F.spark_partition_id()), "order")
    inside = Window.partitionBy("part").orderBy(*order)
    twin = Window.partitionBy("key", "tie").orderBy("n_chars")
    placed = rows.withColumn("nth", F.row_number().over(inside) - 1)
    # A row per range.
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    )
    return placed.join(before, "part").select(
        "key", "tie", "n_chars", F.row_number().over(twin).alias("twin"),
        (F.col("before") + F.col("nth")).cast("long").alias("pos"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (the root), sections (their digests) of every document."""
    nodes = tree(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), nodes.alias("nodes")).select(
        "doc_id", root(F.col("nodes")).alias("fingerprint"), section_digests(F.col("nodes")).alias("sections")
    )


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited, next_leaves of every document.

    ``edited`` is the text with its last third (rounded down) replaced by as
    many first code points, or all, of the next document in falling order of
    doc_id; after the last comes the first.

    Whole texts are shuffled once, by their keys; both joins read that shuffle.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(key_of("doc_id").alias("key"), F.xxhash64(text).alias("tie"), text.alias("text"))
    placed = stored(_numbered(rows.withColumn("n_chars", F.length("text"))), "places")
    every = placed.agg(F.count(F.lit(1)).alias("n"), F.max("twin").alias("twins")).first()
    names = ["key", "tie"]
    if every["twins"] and every["twins"] > 1:  # rows equal in both need a number to be told apart
        names.append("twin")
        rows = rows.withColumn("twin", F.row_number().over(Window.partitionBy("key", "tie").orderBy("key")))
    ahead = placed.select(
        F.pmod(F.col("pos") + 1, F.lit(every["n"] or 1)).alias("pos"),
        F.floor(F.col("n_chars") / 3).cast("int").alias("need"), *[F.col(c).alias(f"to_{c}") for c in names],
    )
    asked = placed.select("pos", *names).join(ahead, "pos").drop("pos")
    given = rows.join(asked, names).select(
        *[f"to_{c}" for c in names], "need", F.substring("text", F.lit(1), F.col("need")).alias("head"),
        leaves(tree(F.col("text"))).alias("next_leaves"),
    )
    same = [F.col(c) == F.col(f"to_{c}") for c in names]
    kept = F.substring("text", F.lit(1), F.length("text") - F.col("need"))
    return rows.join(given, same).select(
        F.nullif(F.col("key"), F.lit(-(2**63))).alias("doc_id"), "text", F.concat(kept, "head").alias("edited"),
        "next_leaves",
    )


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited and new blocks.

    ``edited_sections`` are the numbers of a document's sections that differ
    from its edited text, ``edited_blocks`` those of the sections, paragraphs
    and blocks; ``new_blocks`` are the blocks of the edited text that differ
    from the document.
    """
    rows = with_next(docs).withColumns({"nodes": tree(F.col("text")), "edited_nodes": tree(F.col("edited"))})
    own = rows.withColumns({"own": leaves(F.col("nodes")), "other": leaves(F.col("edited_nodes"))})
    return own.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        root(F.col("nodes")).alias("fingerprint"), root(F.col("edited_nodes")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_leaves")).alias("near_next"),
        edits(F.col("nodes"), F.col("edited_nodes")).alias("edited_sections"),
        edited_blocks(F.col("nodes"), F.col("edited_nodes")).alias("edited_blocks"),
        edited_blocks(F.col("edited_nodes"), F.col("nodes")).alias("new_blocks"),
    )
