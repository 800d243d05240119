"""Every query with an oracle against DuckDB on the smallest tables; the others against their contracts."""

import os

import duckdb
import pytest

from wardline.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda j: columns[j])
    return sorted(columns), sorted(repr([r[j] for j in order]) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_oracle(spark, tables, name):
    got, want = catalog.QUERIES[name](spark, SMALL), tables.sql(catalog.ORACLE[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_greedy_mix_has_quotas_and_no_seen_item(spark):
    from wardline.plans import adapters as A

    got = catalog.QUERIES["mmr_quota_mix"](spark, SMALL)
    assert got.groupBy("u", "i").count().where("count > 1").count() == 0
    assert got.join(A.interactions(spark, SMALL), ["u", "i"]).count() == 0
    per = {r["bucket"]: r["n"] for r in got.where("u = 1").groupBy("bucket").count().withColumnRenamed("count", "n").collect()}
    assert per["mmr"] == 60 and per["popularity"] == 20 and sum(per.values()) == 100


def test_hard_pairs_are_unseen_and_of_both_kinds(spark):
    got = catalog.QUERIES["hard_safety_pair"](spark, SMALL)
    assert got.where("safe_item = unsafe_item").count() == 0 and got.count() == 150


def test_bootstrap_interval_holds_the_mean(spark):
    r = catalog.QUERIES["paired_bootstrap"](spark, SMALL).first()
    assert r["low"] <= r["mean"] <= r["high"] and r["high"] - r["low"] < 0.2


def test_slots_start_with_needed_tags(spark):
    got = catalog.QUERIES["rag_slot_select"](spark, SMALL).collect()
    asked = spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert len(got) == 5 * asked and {r["slot"] for r in got} == {1, 2, 3, 4, 5}


def test_learned_safety_tells_safe_pairs(spark):
    got = catalog.QUERIES["learned_safety"](spark, SMALL).collect()
    assert len(got) > 100 and all(0 <= r["p_safe"] <= 1 for r in got)
    assert sum((r["p_safe"] > 0.5) == bool(r["safe"]) for r in got) > 0.9 * len(got)
