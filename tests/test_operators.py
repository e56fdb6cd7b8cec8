"""Joins, routing, keyed tables, reads, splits and metrics on hand-written rows."""

import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from txnflow.operators import history, keyed, metrics, route, sizing, split
from txnflow.operators.enrich import enrich
from txnflow.operators.sizing import broadcast_if_small, measured_bytes
from txnflow.functions.times import normalize_time
from txnflow.plans.importing import import_transactions
from txnflow.schemas import ENRICHED, LABEL

TS = datetime.datetime


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_enrich(spark, customers, make_transactions, as_of, limit):
    raw = make_transactions({}, {"trans_num": "t2", "cc_num": "9"}, {"trans_num": "t3", "cc_num": None},
                            {"trans_num": "t4", "merch_lat": None})
    found = enrich(normalize_time(raw), customers, as_of, broadcast_limit=limit)
    assert found.columns == [*ENRICHED, LABEL]
    rows = {r["trans_num"]: r for r in found.collect()}
    assert set(rows) == {"t1", "t4"}
    assert rows["t1"]["distance"] == 139.69 and rows["t1"]["age"] == 24
    assert rows["t4"]["distance"] is None
    twice = enrich(normalize_time(raw), customers.unionByName(customers), as_of, broadcast_limit=limit)
    assert twice.where("trans_num = 't1'").count() == 2


def test_broadcast_only_below_the_limit(spark, customers, make_transactions, as_of):
    raw = normalize_time(make_transactions({}))
    assert "ResolvedHint (strategy=broadcast)" in plan_of(enrich(raw, customers, as_of))
    assert "strategy=broadcast" not in plan_of(enrich(raw, customers, as_of, broadcast_limit=10))


def test_measured_bytes(spark):
    rows = spark.createDataFrame([("abc", 1), (None, 2)], "s string, n int")
    assert measured_bytes(rows) == 2 * (32 + 2 * 16) + 3
    assert measured_bytes(rows.where("false")) == 0
    assert measured_bytes(rows.select(F.array("s").alias("a"))) == 2 * (32 + 16) + 2 * 16 + 3
    nested = rows.select(F.struct("s").alias("a"))
    assert measured_bytes(nested) is None
    assert "broadcast" not in plan_of(broadcast_if_small(nested))


def test_a_hot_card_is_split(spark):
    """A card with most rows, joined by a shuffle, is read by several tasks."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        left = spark.range(200_000).repartition(8).select(
            F.when(F.col("id") % 10 < 7, "7").otherwise((F.col("id") % 1000).cast("string")).alias("cc_num"),
            F.col("id").cast("string").alias("trans_num"), F.lit(None).cast("timestamp").alias("trans_time"),
            F.lit("c").alias("category"), F.lit("m").alias("merchant"), F.rand(1).alias("amt"),
            F.lit(1.0).alias("merch_lat"), F.lit(2.0).alias("merch_long"))
        right = spark.range(1000).select(F.col("id").cast("string").alias("cc_num"), F.lit(1.0).alias("lat"),
                                         F.lit(1.0).alias("long"), F.lit("2000-01-01").cast("timestamp").alias("dob"))
        joined = enrich(left, right, broadcast_limit=0)
        assert len(joined.collect()) == 200_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


LABELS = [0.0, 1.0, 2.0, None]


def test_routes_of_stored_labels_and_of_predictions(spark):
    rows = spark.createDataFrame([(x,) for x in LABELS], "is_fraud double")
    counts = Observation("routes")
    found = route.route_by_label(rows, counts=counts).collect()
    assert {(r["is_fraud"], r["route"]) for r in found} == {(0.0, "non_fraud"), (1.0, "fraud")}
    assert counts.get == {"routed": 2, "unrouted": 2}
    predicted = route.route_by_label(rows, rest_is_negative=True).collect()
    assert {(r["is_fraud"], r["route"]) for r in predicted} == {(0.0, "non_fraud"), (2.0, "non_fraud"), (1.0, "fraud")}
    assert route.with_label(rows, 1).count() == 1


def test_import_counts_what_it_does_not_store(spark, customers, make_transactions, as_of):
    raw = make_transactions(
        {}, {"trans_num": "t2", "amt": 11.0}, {"trans_num": "t3", "is_fraud": 1.0}, {"trans_num": "t4", "is_fraud": 2.0},
        {"trans_num": "t5", "is_fraud": None}, {"trans_num": "t6", "trans_date": None},
        {"trans_num": "t7", "trans_date": "bad"}, {"trans_num": "t8", "cc_num": "unknown"})
    counts = Observation("import")
    found = {(r["route"], r["trans_num"]) for r in import_transactions(raw, customers, as_of, counts=counts).collect()}
    # t1 and t2 have one key, t2 the greater transaction number.
    assert found == {("non_fraud", "t2"), ("fraud", "t3")}
    assert counts.get == {"routed": 3, "unrouted": 2, "rejected": 2}


def keyed_rows(spark, *rows):
    return spark.createDataFrame(list(rows), "cc_num string, trans_time timestamp, trans_num string, amt double")


def test_latest_by_key_and_upsert(spark):
    t1, t2 = TS(2023, 1, 1), TS(2023, 1, 2)
    old = keyed_rows(spark, ("1", t1, "z", 1.0), ("1", t2, "b", 2.0), ("2", t1, "c", 3.0))
    new = keyed_rows(spark, ("1", t1, "a", 9.0), ("1", t1, "a", 10.0), ("3", t1, "d", 4.0))
    assert {tuple(r) for r in keyed.upsert(old, new).collect()} == {
        ("1", t1, "a", 10.0), ("1", t2, "b", 2.0), ("2", t1, "c", 3.0), ("3", t1, "d", 4.0)}
    assert keyed.upsert(old, new.where("false")).count() == 3
    latest = keyed.latest_by_key(old.unionByName(new))
    assert {tuple(r) for r in latest.collect()} == {
        ("1", t1, "z", 1.0), ("1", t2, "b", 2.0), ("2", t1, "c", 3.0), ("3", t1, "d", 4.0)}


def test_equal_keys_are_thinned_before_the_shuffle(spark):
    plan = keyed.latest_by_key(keyed_rows(spark, ("1", TS(2023, 1, 1), "a", 1.0)))
    text = plan._jdf.queryExecution().sparkPlan().toString()
    assert "row_number(), 1, Partial" in text


def test_offsets(spark):
    rows = spark.createDataFrame([(0, 5), (0, 7), (1, 2)], "partition int, offset bigint")
    assert {tuple(r) for r in keyed.latest_offsets(rows).collect()} == {(0, 7), (1, 2)}


def test_newest_and_history(spark):
    rows = keyed_rows(spark, *[(str(i % 2), TS(2023, 1, 1 + i), f"t{i}", float(i)) for i in range(8)])
    assert [r["trans_num"] for r in history.newest(rows, 3, "trans_time").collect()] == ["t7", "t6", "t5"]
    assert [r["trans_num"] for r in history.newest_first(rows, "trans_time").collect()] == [f"t{i}" for i in range(7, -1, -1)]
    assert [r["trans_num"] for r in history.card_history(rows, "1").collect()] == ["t7", "t5", "t3", "t1"]
    assert [r["trans_num"] for r in history.card_history(rows).collect()] == ["t6", "t4", "t2", "t0", "t7", "t5", "t3", "t1"]
    plan = history.newest(rows, 3, "trans_time")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_a_busy_card_spreads_over_storage_partitions(spark):
    rows = spark.range(10_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("cc_num"),
        (F.lit("2023-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("trans_time"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = history.cluster_by_card(rows).withColumn("part", F.spark_partition_id())
        assert laid.where("cc_num = 'hot'").select("part").distinct().count() > 2
        assert laid.count() == 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_splits_are_whole(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("trans_num"))
    rows = rows.unionByName(spark.createDataFrame([(None,)], "trans_num string"))
    for make in (split.hash_split, split.random_split):
        train, test = make(rows)
        assert train.count() + test.count() == 3001
        assert train.unionAll(test).exceptAll(rows).count() == 0
        assert 0.66 < train.count() / 3001 < 0.74
    again = split.hash_split(rows.repartition(3))[0]
    assert again.exceptAll(split.hash_split(rows)[0]).count() == 0


@pytest.mark.parametrize("pairs", [
    [(0.0, 0.0, 5), (0.0, 1.0, 2), (1.0, 0.0, 1), (1.0, 1.0, 3)],
    [(0.0, 0.0, 4), (1.0, 0.0, 2)],
    [(0.0, 2.0, 3), (1.0, 1.0, 1)],
])
def test_weighted_f1_equals_the_evaluator(spark, pairs):
    rows = spark.createDataFrame([(a, b) for a, b, n in pairs for _ in range(n)], "label double, prediction double")
    assert metrics.weighted_f1(rows).first()[0] == pytest.approx(metrics.evaluate(rows), abs=1e-12)
    assert {tuple(r) for r in metrics.confusion(rows).collect()} == set(pairs)


def test_unions_match_columns_by_name(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3, 4)], "y int, x int")
    assert {tuple(r) for r in route.union_tables(a, b).collect()} == {(1, 2), (4, 3)}
    assert {tuple(r) for r in route.label_union(a, b).collect()} == {(1, 2, 1.0), (4, 3, 0.0)}


def test_shuffled_holders_are_hashed_where_they_fit(customers, make_transactions, as_of, monkeypatch):
    """Then transactions aren't sorted for the join; holders too many for that are joined by sorting, with the same rows."""
    raw = make_transactions({}, {"cc_num": "2"}, {"cc_num": "9"}, {"cc_num": None})
    found = []
    for limit in (sizing.HASH_LIMIT_BYTES, 0):
        monkeypatch.setattr(sizing, "HASH_LIMIT_BYTES", limit)
        joined = enrich(normalize_time(raw), customers, as_of, broadcast_limit=0)
        assert ("strategy=shuffle_hash" in plan_of(joined)) == bool(limit)
        found.append(sorted(map(str, joined.collect())))
    assert found[0] == found[1] and len(found[0]) == 2
