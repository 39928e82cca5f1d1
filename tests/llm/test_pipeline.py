"""The registered queries with SQL, and the pipeline's stages against what they should keep."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from driftmark.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(map(tuple, want))


def test_names_and_contracts(spark):
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    found = queries.QUERIES["op3_language_id"](spark, SF_DIR)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and found.count() == 200
    found = queries.QUERIES["op8_toxicity"](spark, SF_DIR)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and found.count() == 200


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before, text = docs, {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF_DIR)
        assert after.columns == docs.columns
        rows = after.collect()
        assert all(r["text"] == text[r["doc_id"]] for r in rows)
        kept.append(Counter(r["doc_id"] for r in rows))
        before = spark.createDataFrame(rows, docs.schema)
    assert set(text) >= set(kept[0]) >= set(kept[1]) >= set(kept[2]) >= set(kept[3])
    assert all(len(text[i].encode().split()) >= 50 for i in kept[0])
    assert max(kept[3].values()) <= 2 and max(kept[2].values()) == 1
    words = lambda c: sum(len(text[i].encode().split()) * n for i, n in c.items())
    assert words(kept[3]) == pytest.approx(1.5 * words(kept[2]), rel=0.02)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF_DIR).collect()
    assert sum(r["size"] for r in packed) == words(kept[3])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 100
