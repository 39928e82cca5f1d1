"""Ranks of large groups against sorting."""

import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftmark.operators import ranks, rollups


def grouped(rows):
    out = defaultdict(list)
    for k, *v in rows:
        out[k].append(tuple(v))
    return out


def ordered(values):
    return sorted(values, key=lambda v: [(x is not None, x or 0) for x in v])


def test_values_at_ranks(spark):
    rng = random.Random(2)
    wide = [None, -(2**63), 2**63 - 1, 0, -1, 2**32, -(2**32), 65535, 65536, -65536]
    rows = [(k, rng.choice([*wide, rng.randint(-(10**12), 10**12)]), rng.choice([None, 1, 2])) for k in "ab" for _ in range(300)] + [("c", 5, 5)]
    df = spark.createDataFrame(rows, "k string, v long, w long").repartition(3)
    wanted = [(k, r) for k in "abc" for r in (0, 1, 77, 150, 299, 300)]
    got = {(r["k"], r["rank"]): (r["v"], r["w"], r["tie"]) for r in ranks.at_ranks(df, ["k"], ["v", "w"], spark.createDataFrame(wanted, "k string, rank long")).collect()}
    want = {}
    for k, values in grouped(rows).items():
        values = ordered(values)
        want |= {(k, r): (*values[r], r - values.index(values[r])) for kk, r in wanted if kk == k and r < len(values)}
    assert got == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xy"), st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1))), min_size=1, max_size=40))
def test_upper_medians(spark, rows):
    few = len(rows) % 2 * 1_000  # both ways
    got = {r["k"]: r["median"] for r in ranks.upper_medians(spark.createDataFrame(rows, "k string, v long"), "k", "v", few).collect()}
    want = {k: sorted(x for (x,) in v if x is not None) for k, v in grouped(rows).items()}
    assert got == {k: v[len(v) // 2] if v else 0 for k, v in want.items()}


def test_spread_rows(spark):
    rows = [("many", k // 3, f"x{k}") for k in range(100)] + [("few", 1, "a"), ("few", None, "b"), ("one", 7, "c")]
    df = spark.createDataFrame(rows, "k string, v long, name string").repartition(4)
    got = grouped([tuple(r) for r in ranks.spread(df, "k", ["v"], few=0).collect()])
    assert [v for v, _ in ordered(got["many"])] == [0, 8, 16, 24, 33] and {n for _, n in got["few"]} == {"a", "b"} and got["one"] == [(7, "c")]
    plain = grouped([tuple(r) for r in rollups.spread_sample(df, "k", ["v"]).collect()])
    assert [v for v, _ in ordered(plain["many"])] == [v for v, _ in ordered(got["many"])]


def test_no_task_gets_a_hot_group(spark):
    """A third of all rows has one key: what is shuffled are counts, not rows."""
    df = spark.range(0, 200_000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.xxhash64("id").alias("v"))
    plan = ranks.upper_medians(df, "k", "v", few=1_000)
    values = sorted(r["v"] for r in df.where("k = 0").collect())
    assert {r["k"]: r["median"] for r in plan.collect()}[0] == values[len(values) // 2]
    text = plan._jdf.queryExecution().toString()
    assert "Sort [v" not in text and "percentile" not in text


def test_totals_of_a_run(spark):
    schema = "decision string, emitted boolean, derived boolean, bytes_in long, bytes_out long"
    rows = [("shipped", False, False, n, n // 2) for n in (5, 9, 1, 7)] + [("shipped", True, False, 100, 1), ("failed", False, False, 50, 5)]
    for few in (0, 100):
        assert tuple(ranks.run_totals(spark.createDataFrame(rows, schema), few).first()) == (22, 9, 7)
        assert tuple(ranks.run_totals(spark.createDataFrame([], schema), few).first()) == (0, 0, 0)
