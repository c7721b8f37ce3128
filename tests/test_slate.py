"""Every registered query against its SQL on the smallest tables; those without SQL against what they must satisfy."""

from __future__ import annotations

import comparing
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from midden import registry
from midden.plans import slate


@pytest.fixture(scope="module")
def con():
    return comparing.duck(SMALL)


@pytest.mark.parametrize("name", sorted(slate.ORACLES))
def test_matches_sql(spark, con, name):
    assert comparing.differences(slate.QUERIES[name](spark, SMALL), con, slate.ORACLES[name]) == []


def test_em_shares_are_probabilities(spark):
    rows = slate.em_two_component(spark, SMALL).collect()
    assert rows and all(0 < r["share"] < 1 for r in rows)


def test_pagerank_sums_to_one(spark):
    assert abs(sum(r["rank"] for r in slate._ranked(spark, SMALL).collect()) - 1) < 1e-6


def test_communities_cover_all_nodes(spark):
    rows = slate.consensus_communities(spark, SMALL).groupBy("resolution", "seed").agg(F.count("*").alias("nodes"), F.countDistinct("label").alias("labels")).collect()
    assert len(rows) == 9 and len({r["nodes"] for r in rows}) == 1 and all(1 <= r["labels"] < r["nodes"] for r in rows) and max(r["labels"] for r in rows) > 3


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert registry.FLAGSHIP in registry.ORACLES
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
