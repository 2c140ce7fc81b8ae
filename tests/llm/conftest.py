from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

_PROSE = (
    "The old harbour wall was rebuilt in spring by the men of three villages, who carried stone from the quarry "
    "above the river and laid it in courses as their fathers had done before the war took the young ones away."
)
_OTHER = (
    "Nothing in the ledger explains why the second shipment of copper kettles left the warehouse at night, nor who "
    "signed for the crates when they came back empty a fortnight later with the seals unbroken and the ropes cut."
)
BENCH = [
    (1, "which of the seven bridges over the river was built last and by whom"), (2, "short item here"),
    (3, "Which of the seven bridges over the river was built last and by whom"), (4, None), (5, ""), (6, "?!"),
    (10, "name the largest moon of the outermost planet that the ancients knew without any telescope at all"),
]


def rows() -> list[tuple[int, str | None]]:
    """Texts with the cases that every operator has to stand: null, empty, blanks, ties, copies, long ones."""
    long_ = " ".join(f"word{i % 977}x{i % 31} run{i % 13}" for i in range(30_000))
    return [
        (0, _PROSE), (1, None), (2, ""), (3, "   \n\t "), (4, "x"), (5, "x"), (6, _PROSE), (7, _PROSE.upper()),
        (8, _PROSE.replace("quarry", "pit")), (9, _OTHER + "\n\n" + _PROSE), (10, _PROSE + " " + _OTHER),
        (11, "abc" * 200), (12, "Der Der " * 60), (13, "été ÀÉ 日本語 😀 " * 30), (14, "áb   c d"),
        (15, long_), (16, long_[5_000:90_000]), (17, "so " + BENCH[0][1] + ", they asked."),
        (18, "a SHORT item, here! and " + BENCH[6][1].upper()), (19, BENCH[6][1][:60]),
        (20, "Licensed under the Apache License, Version 2.0.\n" + _OTHER),
        (21, "All rights reserved. all RIGHTS reserved"), (22, "CC-BY or cc by cc by-nc"),
        (23, "GNU General Public License"), (24, "line one\nline two\n\nline three\n"), (25, "\n\n\n"),
        (26, "It's 'quoted' \"text\" -- with_marks 12 345 <|endoftext|>"), (27, "z" * 70_000),
        (28, " leading and trailing "), (29, "double  blanks\r\nand\x0bcontrol\x1c chars"),
    ]


def table(spark, values, schema):
    return spark.createDataFrame(values, schema)


@pytest.fixture(scope="session")
def documents(spark):
    data = [(d, t, "en", f"src{d % 3}", len(t or "")) for d, t in rows()]
    return spark.createDataFrame(data, DOCUMENTS).repartition(4).cache()


@pytest.fixture(scope="session")
def benchmark_table(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(spark):
    """Repeated rows, null ids, and further columns with names that operators use themselves."""
    data = [
        (1, _PROSE, 1), (1, _PROSE, 1), (1, _OTHER, 2), (None, _PROSE, 3), (None, None, 4), (2, None, 5),
        (3, _PROSE + " " + _OTHER, 6), (3, "", 7),
    ]
    return spark.createDataFrame(data, "doc_id long, text string, n int").selectExpr(
        "doc_id", "text", "'en' AS lang", "'s' AS source", "cast(n AS long) AS n_chars", "n AS fp", "n AS key",
        "n AS tie", "n AS spans", "n AS site", "n AS line", "n AS label", "n AS score", "n AS stats", "n AS part",
        "n AS rank", "n AS pos", "n AS start", "n AS n_words", "n AS __x", "n AS root", "n AS node",
    )
