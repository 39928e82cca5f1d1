"""Ranks of groups that are most of a table: counts are shuffled, not rows."""

import random

import pytest
from pyspark.sql import functions as F

from driftmark.operators import ranks


def shuffled(spark):
    """Records that finished stages wrote for a shuffle, by stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), sc._gateway.jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}


def test_rows_of_a_group_stay_where_they_are(spark):
    """100 000 rows of two groups and 500 values: no round sorts a group's rows in one task."""
    rows = spark.range(0, 100_000, numPartitions=4).select((F.col("id") % 2).cast("string").alias("k"), (F.col("id") % 500 * 1_000).alias("v"))
    wanted = spark.createDataFrame([("0", 0), ("0", 25_000), ("1", 25_000), ("1", 49_999), ("1", 50_000)], "k string, rank long")
    before = shuffled(spark)
    got = {(r["k"], r["rank"]): (r["v"], r["tie"]) for r in ranks.at_ranks(rows, ["k"], ["v"], wanted).collect()}
    assert got == {("0", 0): (0, 0), ("0", 25_000): (250_000, 0), ("1", 25_000): (251_000, 0), ("1", 49_999): (499_000, 199)}
    after = shuffled(spark)
    assert 0 < sum(n for stage, n in after.items() if stage not in before) < 10_000


@pytest.mark.parametrize("small", [0, 10_000])
def test_more_ranks_than_are_broadcast(spark, monkeypatch, small):
    monkeypatch.setattr(ranks, "BROADCAST_RANKS", small, raising=False)
    rng = random.Random(5)
    rows = [(k, rng.choice([None, 7, -(2**40), rng.randint(-(10**9), 10**9)])) for k in "abc" for _ in range(100)]
    wanted = [(k, r) for k in "abd" for r in range(0, 110, 3)]
    got = {(r["k"], r["rank"]): r["v"] for r in ranks.at_ranks(spark.createDataFrame(rows, "k string, v long").repartition(3), ["k"], ["v"], spark.createDataFrame(wanted, "k string, rank long")).collect()}
    want = {k: sorted((v for kk, v in rows if kk == k), key=lambda v: (v is not None, v or 0)) for k in "ab"}
    assert got == {(k, r): want[k][r] for k, r in wanted if k in want and r < 100}
