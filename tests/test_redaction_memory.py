"""What a task of redaction holds at a time is bounded by bytes, not by rows."""

import pyarrow as pa

from driftmark.operators import redact
from driftmark.plans import rules as R

CLEAN, DIRTY = "only words here " * 70_000, "write to robin@mail.example " + "and more words " * 70_000


def test_batches_are_cut_by_bytes():
    sizes = [0, 3, 4, 9, None, 30, 1, 1, 1, None, 10, 1]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(sizes))), "t": [None if n is None else "x" * n for n in sizes]})
    found = [p.column("t").to_pylist() for p in redact.pieces([batch, batch.slice(0, 0), batch.slice(5)], "t", 10)]
    assert all(sum(len(t or "") for t in p) <= 10 or sum(1 for t in p if t) == 1 for p in found) and len(found) > 6
    assert [None if t is None else len(t) for p in found for t in p] == sizes + sizes[5:]


def test_long_lines_are_redacted_piece_by_piece(spark, monkeypatch):
    texts = [CLEAN, DIRTY, None, CLEAN, "", DIRTY, "robin@mail.example", *[CLEAN] * 6]
    rows = spark.createDataFrame([], "doc_id long, body string, family string, jsonl boolean")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: run)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "body": texts, "family": [""] * len(texts), "jsonl": [False] * len(texts)})
    out = list(redact.redact_lines(rows, keep_body=False)(iter([batch])))
    assert len(out) > 2 and all(sum(b.column("bytes_total").to_pylist()) <= redact.PIECE_BYTES for b in out)
    got = [r for b in out for r in b.to_pylist()]
    assert [r["doc_id"] for r in got] == list(range(len(texts)))
    assert [r["redacted"] for r in got] == [t and t.replace("robin@mail.example", R.sentinel("email")) for t in texts]
    assert [r["rule_hits"] for r in got] == [[("email", 1)] if t and "@" in t else [] for t in texts]


def test_hits_don_t_depend_on_pieces(spark):
    texts = [DIRTY, None, "robin@mail.example", *[CLEAN] * 6, DIRTY + DIRTY]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert [tuple(r) for r in redact.hits_by_rule(df, [R.BY_ID["email"]]).collect()] == [("email", 3, 4)]
