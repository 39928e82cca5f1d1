"""Ends of messages."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftmark.operators import status


def tail(text, most=status.MESSAGE_BYTES):
    return text and next(text[k:] for k in range(len(text) + 1) if len(text[k:].encode()) <= most)


def tails(spark, texts, most=status.MESSAGE_BYTES):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, v string").select("k", status.message_tail(F.col("v"), most).alias("tail"))
    return [r["tail"] for r in df.orderBy("k").collect()]


def test_ends_of_long_texts(spark):
    texts = [None, "", "short", "a" * 400, "a" * 401, "é" * 200, "é" * 201, "a" + "é" * 200, "é" * 200 + "a", "€" * 134, "€" * 133 + "a", "€" * 133 + "aa", "𝄞" * 100, "𝄞" * 101]
    texts += ["𝄞" * 100 + "a" * n for n in range(5)] + ["aé€𝄞" * 50_000]
    assert tails(spark, texts) == [tail(t) if t and len(t) < 1_000 else t and tail(t[-400:]) for t in texts]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(st.sampled_from("aé€𝄞\n"), max_size=30), min_size=1, max_size=20), st.integers(4, 20))
def test_ends_of_any_length(spark, texts, most):
    assert tails(spark, texts, most) == [tail(t, most) for t in texts]


def test_a_text_is_cut_once(spark):
    """No loop over lengths, each of which reads the whole text."""
    plan = spark.range(1).select(status.message_tail(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "sequence" not in plan
