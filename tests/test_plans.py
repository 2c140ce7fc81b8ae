"""Physical-plan shape: pushdown, pruning, no fact-table broadcast, top-k
without a global sort, no extra exchange for the overview join, AQE skew
splitting of a hot join key."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from watchpost.operators import filters as flt
from watchpost.operators import options as opt
from watchpost.operators import overview as ovw
from watchpost.operators import paging as pg
from watchpost.sources import views
from watchpost.sources.store import write_sorted


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    for name, build, org in [("alerts", views.alerts, "Organization_Name"),
                             ("secrets", views.secrets, "Organization_Name"),
                             ("deps", views.dependencies, "org_name")]:
        write_sorted(build(spark, SF_SMALL), f"{root}/{name}", org)
    return {n: spark.read.parquet(f"{root}/{n}") for n in ("alerts", "secrets", "deps")}


def broadcast_scans(text: str) -> list[str]:
    """File locations scanned directly under each BroadcastExchange."""
    out = []
    for seg in text.split("BroadcastExchange")[1:]:
        m = re.search(r"Location: \w+\([^)]*\)\[([^\]]+)\]", seg)
        if m:
            out.append(m.group(1))
    return out


@pytest.mark.parametrize("build", [views.alerts, views.secrets, views.dependencies])
def test_fact_tables_are_never_broadcast(spark, build):
    scans = broadcast_scans(plan(build(spark, SF_SMALL)))
    assert scans, "dimensions should be broadcast at this size"
    for loc in scans:
        assert not re.search(r"(orders|lineitem|events)\.parquet", loc), loc


def test_filters_and_pruning_reach_the_scan(store):
    text = plan(flt.deps(store["deps"], org=["NATION_3", "NATION_7"], is_open_source="true"))
    assert "PushedFilters: [" in text and "In(org_name" in text and "EqualTo(is_open_source,true)" in text
    ta = plan(opt.typeahead(store["alerts"], "Organization_Name", "ation", 10))
    assert re.search(r"ReadSchema: struct<Organization_Name:string>", ta)


def test_page_is_top_k_not_global_sort(store):
    text = plan(pg.alerts(flt.alerts(store["alerts"], state=["open"]), 3, 50))
    assert "TakeOrderedAndProject" in text and "offset=100" in text
    assert "rangepartitioning" not in text


def test_overview_join_adds_no_exchange(store):
    text = plan(ovw.orgs(store["alerts"], store["secrets"]))
    assert "SortMergeJoin" in text and "FullOuter" in text
    hash_exchanges = re.findall(r"Exchange hashpartitioning\(([^,]+)", text)
    # per side: (org, repo) for the distinct rewrite, then org; none for the join
    assert len(hash_exchanges) == 4
    assert len(re.findall(r"Exchange rangepartitioning", text)) == 1  # final order


def test_metrics_avoid_expand(store):
    from watchpost.operators import metrics as met
    assert "Expand" not in plan(met.alerts(store["alerts"]))


def test_hot_join_key_is_split_by_aqe(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        # one customer holds a third of all orders
        orders = spark.range(0, 30000).select(
            F.col("id").alias("o_orderkey"),
            F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 997).alias("o_custkey"))
        customer = spark.range(0, 997).select(F.col("id").alias("c_custkey"),
                                              F.concat(F.lit("c"), F.col("id")).alias("c_name"))
        joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        text = final_plan(joined)
        assert joined.count() == 30000
        assert "SortMergeJoin(skew=true)" in text
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_heat_reads_each_fact_table_once(spark):
    """The largest total comes from the few cells, not from a second aggregation."""
    board = ovw.orgs(views.alerts(spark, SF_SMALL), views.secrets(spark, SF_SMALL))
    text = plan(ovw.heat(board))
    assert text.count("/orders.parquet") == 1 and text.count("/events.parquet") == 1


def test_nothing_is_marked_for_broadcast(spark):
    """Catalyst alone decides, by size; views are built without a job."""
    for build in (views.alerts, views.secrets, views.dependencies):
        logical = build(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" not in logical
