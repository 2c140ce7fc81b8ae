"""Randomised cross-check of the search semantics (S3) against DuckDB itself.

Values and user queries are drawn from an alphabet full of LIKE
metacharacters (``%``, ``_``, backslash) and mixed case; every query is
evaluated by Spark (one job for all of them) and by DuckDB's ILIKE, which has
no escape character.  The two must agree on every (value, query) pair.
"""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from watchpost.operators.filters import search_predicate

ALPHABET = ["a", "A", "b", "%", "_", "\\", " ", "é", "É"]


def test_search_matches_duckdb_ilike(spark):
    rng = random.Random(7)
    values = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 6))) for _ in range(150)]
    values += [None]
    queries = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    cols = [search_predicate(q, ["v"]).alias(f"q{j}") for j, q in enumerate(queries)]
    got = {r["i"]: [r[f"q{j}"] for j in range(len(queries))]
           for r in df.select("i", *cols).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, v VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    for j, q in enumerate(queries):
        want = dict(con.execute(
            "SELECT i, COALESCE(v, '') ILIKE ? FROM t", ["%" + q + "%"]).fetchall())
        for i in range(len(values)):
            assert got[i][j] == want[i], (values[i], q)


def test_typeahead_blank_rule_matches_reference_logic(spark):
    from watchpost.operators.options import typeahead
    rng = random.Random(11)
    orgs = sorted({"".join(rng.choice("abAB _%") for _ in range(4)) for _ in range(80)})
    df = spark.createDataFrame([(o,) for o in orgs] + [(None,)], "org string")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (org VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(o,) for o in orgs] + [(None,)])
    for q in ["", "  ", "a", " a", "%", "_B", "ab%"]:
        got = [r[0] for r in typeahead(df, "org", q, 7).collect()]
        if q.strip():
            sql = "SELECT DISTINCT org FROM t WHERE org IS NOT NULL AND org ILIKE ? ORDER BY org LIMIT 7"
            want = [r[0] for r in con.execute(sql, ["%" + q + "%"]).fetchall()]
        else:
            sql = "SELECT DISTINCT org FROM t WHERE org IS NOT NULL ORDER BY org LIMIT 7"
            want = [r[0] for r in con.execute(sql).fetchall()]
        assert got == want, q
