"""Deep pages by rank: the rows of the plain order at every depth, in small heaps."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from watchpost.operators import paging

SCHEMA = "Organization_Name string, Repository_Name string, Alert_Number long, State string, CVSS_Score double"


@pytest.fixture(scope="module")
def alerts(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["acme", "beta", None, "gamma"]), rng.choice(["r1", "r2", None]), rng.choice([None, *range(60)]),
             rng.choice(["open", "fixed"]), rng.choice([None, 1.5, float("nan"), float("inf")])) for _ in range(1_500)]
    rows += [("beta", "r1", 7, "open", 1.5)] * 900 + [(None, None, None, None, None)] * 400
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def _plain(df):
    return [str(tuple(r)) for r in df.orderBy(*paging.order_columns(df, paging.ALERTS)).collect()]


def test_pages_of_every_depth_make_up_the_order(spark, alerts, monkeypatch):
    monkeypatch.setattr(paging, "RANK_ROWS", 120)
    monkeypatch.setattr(paging, "_SAMPLE_KEYS", 60)
    monkeypatch.setattr(paging, "_CUTS", 6)
    shown = paging.select_existing(alerts, paging.ALERTS.display)
    want = _plain(shown)
    size = 70
    for number in (1, 2, 5, 9, 13, 14, 20, 27, 33, 39, 40, 41):
        got = [str(tuple(r)) for r in paging.alerts(alerts, number, size).collect()]
        assert got == want[(number - 1) * size:number * size], number


def test_a_deep_page_ranks_few_rows(spark, alerts, monkeypatch):
    monkeypatch.setattr(paging, "RANK_ROWS", 200)
    plan = paging.alerts(alerts, 30, 50)._jdf.queryExecution().executedPlan().toString()
    limits = [int(x) for x in re.findall(r"limit=(\d+)", plan)]
    assert limits and max(limits) <= 200 and "Window" not in plan
    assert "PushedFilters" not in plan or "Organization_Name" in plan


def test_a_deep_page_joins_once(spark, alerts, monkeypatch):
    """The rounds and the page read stored rows: what is joined below is broadcast for one pass only."""
    monkeypatch.setattr(paging, "RANK_ROWS", 200)
    orgs = spark.createDataFrame([("acme", 1), ("beta", 2), ("gamma", 3)], "Organization_Name string, n int")
    joined = alerts.join(F.broadcast(orgs), "Organization_Name", "left")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    found = paging.alerts(joined, 30, 50)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    want = _plain(paging.select_existing(alerts, paging.ALERTS.display))
    assert [str(tuple(r)) for r in found.collect()] == want[29 * 50:30 * 50]


def test_a_page_past_the_end_is_empty(spark, alerts, monkeypatch):
    monkeypatch.setattr(paging, "RANK_ROWS", 100)
    assert paging.alerts(alerts, 2_000, 50).collect() == []
    assert paging.alerts(alerts.limit(0), 2_000, 50).collect() == []
