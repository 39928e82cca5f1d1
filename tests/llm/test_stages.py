"""The pipeline's stages against brute force over rows of their own."""

import random
from collections import Counter

import pytest
from test_operators import DOCS, brute_components, edited, shingle_set, words

import corpus_pipeline


def test_near_duplicate_stage_links_from_080(spark):
    rng, rows = random.Random(11), []
    for _ in range(40):  # two edits in 90 to 100 words: most pairs lie between 0.80 and 0.85
        base = words(rng, rng.randint(90, 100), 5_000)
        rows += [(len(rows) + k, t) for k, t in enumerate([base, edited(rng, base, 2), words(rng, 60, 5_000)])]
    text = dict(rows)
    likeness = lambda a, b: len(shingle_set(text[a]) & shingle_set(text[b])) / len(shingle_set(text[a]) | shingle_set(text[b]))
    assert sum(0.8 <= likeness(k, k + 1) < 0.85 for k in range(0, 120, 3)) >= 10
    want = {i for i, (_, component) in brute_components(rows, 80).items() if component == i}
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS).repartition(3)
    got = corpus_pipeline.keep_one_of_each(spark, df, "").collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want)


def test_repeated_rows_and_rows_without_id_are_deduplicated(spark):
    rng = random.Random(12)
    a, b, c, d = (words(rng, 80, 5_000) for _ in range(4))
    row = lambda i, t: (i, t, "en", "a", len(t))
    rows = [row(1, a)] * 3 + [row(5, a), row(None, a)] + [row(None, b)] * 2 + [row(9, c), row(None, c), row(9, d), row(7, edited(rng, d, 1))]
    got = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, DOCS).repartition(3), "").collect()
    want = [(1, a), (None, b), (9, c), (7, rows[-1][1])]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)


def test_repeated_rows_and_rows_without_id_are_mixed(spark):
    rng = random.Random(13)
    row = lambda i, s, n: (i, words(rng, n), "en", s, 0)
    rows = [row(k, "abc"[k % 3], rng.randint(5, 60)) for k in range(150)]
    rows += rows[:30] + [row(None, "abc"[k % 3], rng.randint(5, 60)) for k in range(150)]
    size = lambda t: len(t.split())
    got = corpus_pipeline.mix(spark, spark.createDataFrame(rows, DOCS).repartition(3), "").collect()
    has = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in "abc"}
    # weights 3, 1, 2 of 1.5 times all words, no source above twice its own: a fills up, b and c share the rest
    total, full = 1.5 * sum(has.values()), 2 * has["a"]
    target = {"a": full, "b": (total - full) / 3, "c": (total - full) * 2 / 3}
    assert target["c"] <= 2 * has["c"]
    for s in "abc":
        assert abs(sum(size(r["text"]) for r in got if r["source"] == s) - target[s]) <= 5


AWKWARD = [*DOCS.split(", "), *(f"{c} string" for c in ("_copies", "_copy", "_row", "_doc", "component_id", "size", "_q", "_kept", "bin"))]


def awkward_rows():
    rng = random.Random(14)
    text = [words(rng, rng.randint(60, 120), 5_000) for _ in range(12)]
    rows = [(k, t, "en", "ab"[k % 2], 0) for k, t in enumerate(text)]
    rows += rows[:2] + [(None, text[3], None, None, 0), (None, None, None, None, None), (50, None, "en", "a", 0), (51, "", "de", "a", 0), (52, " \n\t", "en", None, 0), (53, words(rng, 30_000), "en", "b", 0), (54, "x" * 500_000, "en", "b", 0)]
    return [(*r, *["clash"] * (len(AWKWARD) - 5)) for r in rows]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_and_empty_tables(spark, tmp_path, name, stage):
    """Nulls, empty and very long texts and words, repeated rows, columns of the stages' own names; then no rows at all."""
    spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = awkward_rows()
    docs = spark.createDataFrame(rows, ", ".join(AWKWARD)).repartition(3)
    out = stage(spark, docs, str(tmp_path))
    got = out.collect()
    if name != "best-fit packing":
        assert out.columns == docs.columns and all(tuple(r) in rows for r in got)
        assert all(r["_copies"] == "clash" for r in got)
    if name == "quality rules":
        assert not any(r["text"] is None or len(r["text"].split()) < 50 for r in got)
    if name == "near-duplicate removal":
        assert Counter(tuple(r) for r in got) == Counter(set(rows)) - Counter([next(r for r in rows if r[0] is None and r[1])])
    if name == "mixing sources":
        size = lambda r: len((r["text"] or "").split())
        # a copy of the longest document is 30 000 words: nearer than half of that can't be asked for
        assert abs(sum(map(size, got)) - 1.5 * sum(len((r[1] or "").split()) for r in rows)) <= 15_500
    if name == "best-fit packing":
        assert sum(r["size"] for r in got) == sum(len((r[1] or "").split()) for r in rows) and len({(r["bin"], r["source"]) for r in got if r["source"]}) == sum(bool(r["source"]) for r in got)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
