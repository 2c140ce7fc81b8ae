"""The pipeline against its stages done by hand, and the registered queries' SQL."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline
from tests.llm import brute
from watchpost.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def base(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_stages_match_brute_force(spark, base, tmp):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op6_quality"](spark, SF).collect()}
    held = [r for r in base if scores[r[0]]]
    assert len(held) < len(base)

    def stage(name, frame):
        out = stages[name](spark, frame, SF)
        out.write.parquet(f"{tmp}/{name}")
        return spark.read.parquet(f"{tmp}/{name}")

    docs = stage("quality", docs)
    assert docs.columns == names and sorted(map(tuple, docs.collect())) == sorted(held)

    cut = brute.lines([(r[0], r[1], r[3]) for r in held])
    held = [
        (r[0], cut[r[0]][2], r[2], r[3], len(cut[r[0]][2]) if cut[r[0]][1] else r[4]) for r in held
    ]
    docs = stage("line_dedup", docs)
    assert docs.columns == names and sorted(map(tuple, docs.collect())) == sorted(held)

    near = brute.simhash([(r[0], r[1]) for r in held])
    held = [r for r in held if near[r[0]][1] == r[0]]
    docs = stage("simhash", docs)
    assert docs.columns == names and sorted(map(tuple, docs.collect())) == sorted(held)

    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = brute.contamination([(r[0], r[1]) for r in held], bench)
    held = [r for r in held if not found[r[0]][4]]
    docs = stage("decontaminate", docs)
    assert docs.columns == names and sorted(map(tuple, docs.collect())) == sorted(held)

    packed = stage("best_fit", docs).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in held}
    ran = corpus_pipeline.run(spark, SF).collect()
    pick = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
    assert pick == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in ran)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(cur.fetchall(), key=str) == sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_entry_imports_without_the_subpackage(tmp):
    """The guard in __spark_entry__ alone keeps the other queries."""
    code = (
        "import sys; sys.modules['watchpost.llm'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'met_alerts' in q and 'op1_simhash' not in q\n"
        "assert set(e.oracle_sql()) <= set(q)"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
