"""Queries of the training-data operators over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontamination, fingerprints, language_id, mixing, near_dedup, packing, quality_rules, sharding, spelling, token_counts, toxicity, warc
from ._common import held_out, read_table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in bins: doc_id, source, piece, start, size, bin, bin_room.

    Null or empty texts give one piece of size 0; a null source conflicts with nothing; repeated rows and rows without an id
    are packed as documents of their own, copies of one text never into one bin. An empty table gives no rows.
    """
    packed = packing.pack(packing.document_items(read_table(spark, sf_dir, "documents")))
    return packed.withColumnRenamed("item", "doc_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document: doc_id, the counts, base_failed, kept, rule (which of the list rejects; 0: none).

    Null and empty texts have no words, so base_failed is true; repeated rows are judged row by row; columns of the table
    other than doc_id and text don't matter. An empty table, or one without labels, gives rows judged by the base rules alone.
    """
    docs = read_table(spark, sf_dir, "documents")
    rules = quality_rules.learn_from_labels(docs, read_table(spark, sf_dir, "labels"))
    out = quality_rules.judge(docs.select("doc_id", "text"), rules)
    base = [F.col("_q")[c].alias(c) for c in quality_rules.BASE]
    return out.select("doc_id", *base, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_rule").alias("rule"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score.

    Texts that are null or have no letter are 'und' with score 0.0; a null doc_id is not held out, and teaches nothing;
    repeated rows are judged row by row; without any usable language all are 'und'. An empty table gives no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, chunks.

    Null html is an empty payload; pages without an id, and all equal pages of the smallest id, are responses. An empty table
    gives no rows.
    """
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness: the columns of fingerprints.compare_with_next.

    Null texts count as empty; null ids come first, equal ids are ordered by a hash of their texts; one document is its
    own next. An empty table gives no rows.
    """
    return fingerprints.fingerprint_query(read_table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates: doc_id, n_shingles, component_id, kept.

    Null, empty and wordless texts have no shingles and no links; rows without an id have no component and are kept; rows of
    one id share one component. An empty table gives no rows.
    """
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text: doc_id, n_tokens, n_bytes. Null and empty texts have none; repeated rows are counted row by row; an empty table gives no rows."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text: doc_id, held_out, score, predicted, n_passages.

    Null and empty texts score as texts without any segment; a null doc_id is not held out, and teaches nothing; without
    labels of both kinds all score 0.0. Repeated rows are scored row by row. An empty table gives no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken, copies, rate.

    Null texts have size 0 and taken 0; the null source is a source of its own, last; repeated rows and rows without
    an id are documents of their own. An empty table gives no rows.
    """
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document: doc_id, bytes, shard, shard_depth, shard_bytes, shard_docs.

    Null texts have 0 bytes; rows of one id, rows without one and equal rows are spread like any other. An empty table gives no rows.
    """
    return sharding.shard(read_table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; repeated rows and rows without an id are judged row by row; an item without an id
    hits words, but isn't counted. An empty table of documents gives no rows, an empty benchmark no hits.
    """
    found = decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every whole vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length or not finite have no row; repeated rows are vectors of their own; one without an
    id is clustered, but is no first centroid. An empty table gives no rows.
    """
    return clustering.cluster(read_table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their frequent variants: word, form, root, n, n_near, form_n.

    Null and empty texts have no words; a document without an id goes by an empty one; repeated rows count each. An empty
    table gives no rows.
    """
    return spelling.variants(read_table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.page_id > f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > f.first_id THEN f.first_id END AS refers_to,
       CASE WHEN p.page_id > f.first_id THEN 1 ELSE greatest(1, CAST(ceil(p.payload_bytes / 262144.0) AS BIGINT)) END AS chunks
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""

OP10_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, bytes, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || mark || '/' || copy), 1, 15))::BIGINT AS h
  FROM (
    SELECT doc_id, coalesce(strlen(text), 0) AS bytes, md5(coalesce(text, '')) AS mark,
           row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) - 1 AS copy
    FROM documents)),
buckets AS (
  SELECT doc_id, bytes, h, 0 AS depth, sum(bytes) OVER () AS total, count(*) OVER () AS docs FROM sized
  UNION ALL
  SELECT doc_id, bytes, h, depth + 1,
         sum(bytes) OVER (PARTITION BY h >> (59 - depth)), count(*) OVER (PARTITION BY h >> (59 - depth))
  FROM buckets WHERE total > {sharding.SHARD_BYTES} AND docs > 1 AND depth < 60)
SELECT doc_id, bytes, depth AS shard_depth, CAST(total AS BIGINT) AS shard_bytes, docs AS shard_docs,
       CASE WHEN depth = 0 THEN '' ELSE substr(lpad(bin(h), 60, '0'), 1, depth) END AS shard
FROM buckets WHERE total <= {sharding.SHARD_BYTES} OR docs = 1 OR depth = 60
"""

_SMALL = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAK_WORDS = rf"list_filter(regexp_split_to_array({_SMALL.format('text')}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LEAK_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_LEAK_WORDS} AS ws FROM benchmark),
spans AS (SELECT item_id, ws, least(len(ws), {decontamination.WINDOW}) AS span FROM i WHERE len(ws) > 0),
windows AS (
  SELECT item_id, span, ws[s:s + span - 1] AS phrase
  FROM (SELECT item_id, span, ws, unnest(range(1, len(ws) - span + 2)) AS s FROM spans)),
t AS (SELECT r, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM d),
g AS (
  SELECT r, pos, list_filter([w, {', '.join(f'lead(w, {k}) OVER p' for k in range(1, decontamination.WINDOW))}], lambda x: x IS NOT NULL) AS ahead
  FROM t WINDOW p AS (PARTITION BY r ORDER BY pos)),
found AS (
  SELECT DISTINCT g.r, g.pos, windows.span, windows.item_id
  FROM g JOIN (SELECT DISTINCT span FROM windows) AS s ON len(g.ahead) >= s.span
  JOIN windows ON windows.span = s.span AND windows.phrase = g.ahead[1:s.span]),
hits AS (
  SELECT r, count(*) AS n_hit
  FROM (SELECT DISTINCT r, unnest(range(pos, pos + span)) AS at FROM found) GROUP BY r),
listed AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN listed USING (r)
"""


def _clustering_sql() -> str:
    """Lloyd's rounds one after the other, over a table of components."""
    least = "arg_min(c, struct_pack(d := d, c := c))"
    apart = "SELECT r, c, CAST(sum((v.x - k.x) * (v.x - k.x)) AS BIGINT) AS d FROM v JOIN {} AS k USING (dim) GROUP BY r, c"
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({clustering.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS xs
  FROM embeddings
  WHERE len(embedding) = {clustering.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {clustering.DIMENSIONS})""",
        "v AS MATERIALIZED (SELECT r, generate_subscripts(xs, 1) AS dim, unnest(xs) AS x FROM kept)",
        f"""first AS (
  SELECT r, row_number() OVER (ORDER BY sha256('{clustering.SEED}:' || vec_id), xs) - 1 AS c
  FROM kept WHERE vec_id IS NOT NULL ORDER BY c LIMIT {clustering.CENTROIDS})""",
        "c0 AS MATERIALIZED (SELECT c, dim, x FROM first JOIN v USING (r))",
    ]
    for k in range(clustering.ROUNDS):
        parts.append(f"a{k} AS MATERIALIZED (SELECT r, {least} AS c FROM ({apart.format(f'c{k}')}) GROUP BY r)")
        parts.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT o.c, o.dim, coalesce(m.x, o.x) AS x
  FROM c{k} AS o LEFT JOIN (
    SELECT c, dim, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x
    FROM (SELECT c, dim, sum(v.x) AS s, count(*) AS n FROM a{k} JOIN v USING (r) GROUP BY c, dim)) AS m USING (c, dim))""")
    last = f"c{clustering.ROUNDS}"
    parts.append(f"found AS MATERIALIZED (SELECT r, {least} AS c, min(d) AS d FROM ({apart.format(last)}) GROUP BY r)")
    parts.append(f"names AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM {last} GROUP BY c)")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM found JOIN kept USING (r) JOIN names USING (c)
"""


OP12_SQL = _clustering_sql()

#: crc32 of a text of bytes is the exclusive or of what each byte gives at its distance from the end, and of what the length gives;
#: near words are found by all their words less a letter.
OP13_SQL = f"""
WITH RECURSIVE steps(b, k, v) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
bytes AS (SELECT b, v FROM steps WHERE k = 8),
runs AS MATERIALIZED (
  SELECT doc, run, count(*) AS n
  FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
           translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents)
  WHERE length(run) >= {spelling.LEAST_LENGTH} GROUP BY doc, run),
longest AS (SELECT max(strlen(doc || ':' || run)) AS n FROM runs),
given(off, b, v) AS (
  SELECT CAST(0 AS BIGINT), b, v FROM bytes
  UNION ALL SELECT g.off + 1, g.b, xor(g.v >> 8, t.v) FROM given AS g JOIN bytes AS t ON t.b = g.v & 255 WHERE g.off + 1 < (SELECT n FROM longest)),
ones(n, v) AS (
  SELECT CAST(0 AS BIGINT), CAST(4294967295 AS BIGINT)
  UNION ALL SELECT o.n + 1, xor(o.v >> 8, t.v) FROM ones AS o JOIN bytes AS t ON t.b = o.v & 255 WHERE o.n < (SELECT n FROM longest)),
coded AS (SELECT doc, run, n, strlen(doc || ':' || run) AS size, unnest(range(strlen(doc || ':' || run))) AS i, hex(encode(doc || ':' || run)) AS h FROM runs),
hashed AS (
  SELECT doc, run, any_value(c.n) AS n, xor(xor(bit_xor(g.v), any_value(o.v)), 4294967295) AS h
  FROM coded AS c JOIN given AS g ON g.off = c.size - 1 - c.i AND g.b = ('0x' || substr(c.h, 2 * c.i + 1, 2))::BIGINT
  JOIN ones AS o ON o.n = c.size GROUP BY doc, run),
spelt AS (
  SELECT CASE WHEN h % {spelling.DROP_EVERY} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
less AS MATERIALIZED (
  SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS part FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
pairs AS (
  SELECT a.word AS word, b.word AS other, b.n AS other_n FROM less AS a JOIN less AS b ON a.k = b.k AND a.part = b.part AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less AS l JOIN words AS w ON l.part = w.word
  UNION SELECT w.word, l.word, l.n FROM less AS l JOIN words AS w ON l.part = w.word),
near AS (SELECT word, count(*) AS n_near, arg_min(other, struct_pack(m := -other_n, o := other)) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
named AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {spelling.TIMES} * w.n THEN other END AS form, CASE WHEN other_n >= {spelling.TIMES} * w.n THEN other_n END AS form_n
  FROM words AS w LEFT JOIN near USING (word)),
chain AS (
  SELECT word, word AS root, form AS next FROM named
  UNION ALL SELECT c.word, n.word, n.form FROM chain AS c JOIN named AS n ON c.next = n.word)
SELECT n.word, n.form, c.root, n.n, n.n_near, n.form_n FROM named AS n JOIN chain AS c ON c.word = n.word AND c.next IS NULL
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_warc": op4_warc,
    "op5_fingerprints": op5_fingerprints,
    "op6_near_dedup": op6_near_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
    "op11_decontamination": op11_decontamination,
    "op12_clustering": op12_clustering,
    "op13_spelling": op13_spelling,
}
ORACLE_SQL: dict[str, str] = {"op4_warc": OP4_SQL, "op10_sharding": OP10_SQL, "op11_decontamination": OP11_SQL, "op12_clustering": OP12_SQL, "op13_spelling": OP13_SQL}
