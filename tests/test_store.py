"""Bucketed stores: same rows as the plain operators, no shuffle of raw rows in the plans."""

import pytest
from pyspark.sql import functions as F

from tidecast.operators import facts
from tidecast.plans import inputs as I
from tidecast.sources import store

SF = "/root/testdata/sf0.001"
N = 6


@pytest.fixture(scope="module")
def sources(spark):
    a, b = facts.source_a(I.raw_a(spark, SF)), facts.source_b(I.raw_b(spark, SF))
    odd = a.limit(3).withColumn("transaction_id", F.lit(None).cast("string"))
    return a.unionByName(odd), b.unionByName(b.limit(50))


@pytest.fixture(scope="module")
def stored(spark, sources):
    """Two deliveries in one table."""
    path = store.fresh_path(spark, "txn-store")
    name = store.open_store(spark, path, sources[0].schema, "transaction_id", N)
    for s in sources:
        store.append(s, name, "transaction_id", N)
    return spark.table(name)


def rows(df):
    return sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["dedup_highest", "dedup_priority"])
def test_dedupe_without_shuffle(sources, stored, how):
    got = getattr(store, how)(stored)
    assert rows(got) == rows(getattr(facts, how)(facts.union_txn(*sources)))
    p = plan(got)
    assert "Exchange" not in p and "SortAggregate" not in p
    assert p.count("Sort [") == 1


def test_item_lines_join_without_shuffle(spark, sources, stored):
    lines = store.stored(I.items(spark, SF), "lines", "transaction_id", N)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        txn = store.dedup_highest(stored)
        sold = facts.order_items(lines).join(txn, "transaction_id")
        p = plan(sold)
        assert "Exchange" not in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = facts.order_items(I.items(spark, SF)).join(facts.dedup_highest(facts.union_txn(*sources)), "transaction_id")
    assert rows(sold) == rows(plain)


def test_a_store_is_found_again(spark, stored, sources):
    """The same folder declared anew (as another session does) has the same rows."""
    path = stored.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    name = store.open_store(spark, path, sources[0].schema, "transaction_id", N)
    n = stored.count()
    spark.sql(f"DROP TABLE {name}")
    assert spark.table(store.open_store(spark, path, sources[0].schema, "transaction_id", N)).count() == n


def test_an_empty_delivery(spark, sources):
    empty = store.stored(sources[0].limit(0), "none", "transaction_id", N)
    assert store.dedup_highest(empty).collect() == []
