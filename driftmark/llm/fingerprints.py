"""Document fingerprints: the exact digest of a canonical form of the whole text.

Canonical form: NFKC, case folding, NFKC again (folding can undo it), each run of
Unicode white space as one blank, none at the ends. Its 128-bit xxhash groups documents;
within equal digests the canonical bytes themselves are compared, so a collision never
merges two texts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import key_join, materialize

#: Bytes of the texts of a range of ids that one task walks, and documents of one, about.
RANGE_BYTES, RANGE_DOCS = 16 << 20, 50_000
#: Ranges, at most.
MOST_RANGES = 4_000


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(unicodedata.normalize("NFKC", folded).split())


def digest(canon: str) -> str:
    """128-bit xxhash of a canonical text, as 32 hex digits."""
    return xxhash.xxh3_128_hexdigest(canon.encode())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        marks = [digest(canonical(t or "")) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(marks, pa.string())], ["doc_id", "digest"])


def _canonical_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        canon = [canonical(t or "") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(digest, canon), pa.string()), pa.array(canon, pa.string())], ["doc_id", "digest", "canon"])


def _typed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def _with_equal_buckets(docs: DataFrame, marks: DataFrame) -> DataFrame | None:
    """(doc_id, digest, n): n numbers the different canonical texts of one digest; None if no digest has two.

    Only documents whose digest occurs again, and those without an id, are read once more; equal texts meet as one
    row for each task before they are shuffled, so a group of any size costs a row a task.
    """
    again = materialize(marks.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "fp-again")
    ids = materialize(key_join(marks, again, "digest", "left_semi").select("doc_id").distinct(), "fp-ids")
    texts = key_join(docs, ids, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
    texts = texts.mapInArrow(_canonical_texts, "doc_id long, digest string, canon string")
    kinds = texts.groupBy("digest", "canon").agg(F.count(F.lit(1)).alias("n"))
    clash = materialize(kinds.groupBy("digest").agg(F.count(F.lit(1)).alias("kinds"), F.array_sort(F.collect_list("canon")).alias("canons")).where("kinds > 1"), "fp-clash")
    if not clash.limit(1).count():
        return None
    numbered = clash.select("digest", F.posexplode("canons").alias("k", "canon"))
    return texts.join(numbered, ["digest", "canon"]).where("k > 0 AND doc_id IS NOT NULL").select("doc_id", "digest", "k").distinct()


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, fingerprint, group (smallest id of equal canonical text), kept.

    Null and empty texts are equal to each other. Rows without an id are grouped too, where digests of different texts are equal
    by the digest alone, but never name a group: group is null if none of it has an id. kept is true for the
    row of the smallest id, and for each of its repeated rows. An empty table gives an empty result.
    """
    docs = _typed(docs, doc_id, text)
    marks = materialize(docs.mapInArrow(_digests, "doc_id long, digest string"), "fp-marks")
    clash = _with_equal_buckets(docs, marks)
    mark = F.col("digest")
    if clash is not None:
        marks = marks.join(clash, ["doc_id", "digest"], "left")
        mark = F.when(F.col("k").isNull(), mark).otherwise(F.concat_ws("-", "digest", "k"))
    marks = marks.select("doc_id", mark.alias("fingerprint"))
    groups = materialize(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("group"), F.count(F.lit(1)).alias("n")).where("n > 1"), "fp-groups")
    out = key_join(marks, groups, "fingerprint", "left")
    group = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("group"))
    return out.select("doc_id", "fingerprint", group.alias("group"), F.coalesce(F.col("doc_id") == group, F.lit(False)).alias("kept"))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
#: What a walk yields besides finished rows: the first and the last text of its range.
_ENDS = [("part", pa.int32()), ("end", pa.string()), ("text", pa.string())]


def _seen(doc_id: int | None, text: str | None) -> tuple:
    canon = canonical(text or "")
    return doc_id, text or "", canon, digest(canon)


def _against(now: tuple, after: tuple) -> tuple:
    """A row of SCHEMA: a document compared with its edited text and with its successor."""
    doc_id, text, canon, mark = now
    cut = len(text) // 4
    other = text[: len(text) - cut] + after[1][:cut]
    other_canon = canon if other == text else canonical(other)
    other_mark = mark if other_canon == canon else digest(other_canon)
    return doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), mark, other_mark, float(canon == other_canon), float(canon == after[2])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each document of a sorted range with its successor; the range's first text and last document come out as they are."""
    part, schema = TaskContext.get().partitionId(), pa.schema([*_ARROW, *_ENDS])
    blank = (None,) * (len(_ARROW) - 1)
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    held, rows = None, []
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            now = _seen(doc_id, text)
            if held is None:
                rows.append((None, *blank, part, "first", text or ""))
            else:
                rows.append((*_against(held, now), part, None, None))
            held = now
            if len(rows) >= 1_000:
                yield out(rows)
                rows = []
    if held is not None:
        rows.append((held[0], *blank, part, "last", held[1]))
    if rows:
        yield out(rows)


def _join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_against(_seen(i, t), _seen(None, after)) for i, t, after in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "after")), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint each document, its edited text, and say how alike they and the next document are.

    The edited text has its last quarter (rounded down) replaced by as many first characters of the next
    document by ascending id (null ids first, equal ids by a hash of their texts, equal rows in any order; after the last comes
    the first). An exact digest is alike (1.0, once the bytes agree) or not (0.0). Null text counts as empty.
    Texts move once, to ranges of ids of about RANGE_BYTES, or to MOST_RANGES larger ones, as a range is sorted on disk and walked; a recurring id is split by its texts and row numbers.
    Where ranges meet, their last and first texts are compared afterwards. An empty table gives an empty result.
    """
    docs = _typed(docs, doc_id, text)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    parts = min(MOST_RANGES, max(1, -(-size[0] // RANGE_BYTES), -(-size[1] // RANGE_DOCS)))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_no"))
    order = [F.col("doc_id").asc_nulls_first(), "_h", "_no"]
    ranges = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    walked = materialize(ranges.mapInArrow(_walk, SCHEMA + ", part int, end string, text string"), "fp-walked")
    names = [f.name for f in _ARROW]
    # a row or two for each range: which follows which is a list of numbers
    held = [r["part"] for r in walked.where("end = 'first'").select("part").orderBy("part").collect()]
    follows = docs.sparkSession.createDataFrame(list(zip(held, held[1:] + held[:1], strict=True)), "part int, next int")
    first = walked.where("end = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    last = walked.where("end = 'last'").select("doc_id", "text", "part").join(F.broadcast(follows), "part").join(first, "next")
    return walked.where("end IS NULL").select(*names).unionByName(last.select("doc_id", "text", "after").mapInArrow(_join_ends, SCHEMA))


def fingerprint_query(docs: DataFrame) -> DataFrame:
    """compare_with_next with the byte comparison of equal digests applied to ``fingerprint``."""
    rows = materialize(compare_with_next(docs), "fp-rows")
    marks = rows.select("doc_id", F.col("fingerprint").alias("digest"))
    clash = _with_equal_buckets(_typed(docs, "doc_id", "text"), marks)
    if clash is None:
        return rows
    named = rows.join(clash.withColumnRenamed("digest", "fingerprint"), ["doc_id", "fingerprint"], "left")
    return named.withColumn("fingerprint", F.concat_ws("-", "fingerprint", "k")).drop("k")
