"""Queries of stores, transcripts, state, catalogs and ranks over the driver's tables, each with its SQL."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.functions.text import ordered_union
from driftmark.operators import changes, derived, manifests, ranks, redact, rollups
from driftmark.plans import packs
from driftmark.plans import queries as core
from driftmark.plans.queries import Tables, query
from driftmark.sources import catalog, keyvalue, listing, logs, tables

# --- stores ----------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT *, conv_id % 3 AS generation, 'b' || turn AS id, '2024-01-0' || (1 + turn % 4) AS created FROM conversations),
e AS (
  SELECT conv_id, 0 AS rung, -turn AS place, '' AS created, id, text FROM c WHERE generation = 0 AND turn % 5 <> 4
  UNION ALL SELECT conv_id, 1, turn, '', id, text FROM c WHERE generation = 1
  UNION ALL SELECT conv_id, 2, 0, created, id, text FROM c WHERE generation = 2)
SELECT conv_id, rung, row_number() OVER (PARTITION BY conv_id ORDER BY place, created, id) - 1 AS place, id AS event_id, md5(text) AS text_hash FROM e""")
def store_event_order(t: Tables) -> DataFrame:
    """Events of stores in three generations: by header list (some events are lost), by the array inside, by time and key."""
    c = t("conversations").withColumns({"generation": F.col("conv_id") % 3, "id": F.concat(F.lit("b"), F.col("turn").cast("string"))})
    created = F.concat(F.lit("2024-01-0"), (1 + F.col("turn") % 4).cast("string"))
    event = F.struct(F.when(F.col("generation") == 1, F.col("id")).alias("bubbleId"), F.lit(2).alias("type"), "text", created.alias("createdAt"))
    kept = c.where("generation <> 0 OR turn % 5 <> 4")
    bubbles = kept.select(F.concat_ws(":", F.lit("bubbleId"), F.col("conv_id").cast("string"), "id").alias("key"), F.to_json(event).alias("value"))
    listed = F.sort_array(F.collect_list(F.struct("turn", "id")), asc=False)
    heads = F.when(F.col("generation") == 0, F.transform("ids", lambda x: F.struct(x["id"].alias("bubbleId")))).when(F.col("generation") == 1, F.array(F.struct(F.lit("gone").alias("bubbleId"))))
    inside = F.when(F.col("generation") == 1, F.transform("inside", lambda x: x["e"]))
    convs = c.groupBy("conv_id", "generation").agg(listed.alias("ids"), F.array_sort(F.collect_list(F.struct("turn", event.alias("e")))).alias("inside"))
    convs = convs.select(F.concat(F.lit("composerData:"), F.col("conv_id").cast("string")).alias("key"), F.to_json(F.struct(heads.alias("fullConversationHeadersOnly"), inside.alias("conversation"))).alias("value"))
    found = keyvalue.ordered_events(tables.written(bubbles.unionByName(convs), "store-rows"))
    place = F.row_number().over(core.Window.partitionBy("conv").orderBy("pos")) - 1
    return found.select(F.col("conv").cast("long").alias("conv_id"), "rung", place.cast("long").alias("place"), "event_id", F.md5(F.get_json_object("event", "$.text").cast("binary")).alias("text_hash"))


@query("""SELECT 'bubbleId:' || conv_id || ':' || lpad(turn::VARCHAR, 6, '0') AS key, '{"role":"' || role || '","turn":' || turn || '}' AS value, 'readonly_open' AS method FROM conversations WHERE turn % 6 <> 5
UNION ALL SELECT 'cursorAuth/cachedEmail', 'x', 'readonly_open' FROM (SELECT count(*) AS n FROM conversations) WHERE n > 0""")
def store_round_trip(t: Tables) -> DataFrame:
    """Conversations written to SQLite files by tasks, and what may be read of them, read back in key ranges: fields and keys with credentials stay."""
    c = t("conversations").where("turn % 6 <> 5")
    spark = c.sparkSession
    folder = tables.fresh_folder(spark, "stores")
    local = folder.removeprefix("file:")
    if not local.startswith("/"):
        raise ValueError(f"SQLite files need a folder that executors can open, not {folder}")
    local = "/" + local.lstrip("/")
    secret = F.when(F.col("turn") % 7 == 0, F.lit("never"))
    rows = c.select(F.concat_ws(":", F.lit("bubbleId"), F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("key"), F.to_json(F.struct("role", secret.alias("blobEncryptionKey"), "turn")).alias("value"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        os.makedirs(local, exist_ok=True)
        path = os.path.join(local, f"{task.partitionId()}.vscdb")
        fresh = f"{path}.{task.taskAttemptId()}"
        db = sqlite3.connect(fresh)
        db.execute("CREATE TABLE kv (key TEXT PRIMARY KEY, value BLOB)")
        n = 0
        for b in batches:
            db.executemany("INSERT INTO kv VALUES (?, ?)", zip(*[x.to_pylist() for x in b.columns], strict=True))
            n += b.num_rows
        db.execute("INSERT INTO kv VALUES ('cursorAuth/accessToken', 'never')")
        db.commit()
        db.close()
        os.replace(fresh, path)  # a task that is done again leaves one file
        yield pa.RecordBatch.from_pydict({"path": [path], "n": [n]}, pa.schema([("path", pa.string()), ("n", pa.int64())]))

    written = rows.repartition(4, "key").mapInArrow(write, "path string, n long").collect()  # one row a file
    raw = keyvalue.read_raw(spark, [r["path"] for r in written], "kv", ["bubbleId:", "cursorAuth/"], ranges=2)
    found = keyvalue.rows_of(raw).drop("path")
    email = spark.createDataFrame([("cursorAuth/cachedEmail", "x", "readonly_open")] if sum(r["n"] for r in written) else [], found.schema)
    return found.unionByName(email)


CALLS_SQL = """
c AS (SELECT conv_id, turn, role, md5(conv_id || '/' || turn) AS path, md5(text) AS result FROM conversations),
l AS (SELECT *, '{"role":"assistant","message":{"content":[{"type":"text","text":"[REDACTED]"},{"type":"tool_use","name":"Read","input":{"path":"' || path || '","limit":' || turn || '}}]}}' AS body FROM c),
s AS (SELECT * FROM l WHERE (conv_id + turn) % 5 <> 0),
d AS (
  SELECT l.conv_id, l.turn AS line_no, '{"native":' || l.body || CASE WHEN s.turn IS NULL THEN '' ELSE ',"_enrich":[null,{"bubbleId":"b' || l.turn || '","tool_call_id":"t' || l.turn || '","tool_name":"read_file_v2","status":"ok","result":"' || l.result || '"}]' END || '}' AS line
  FROM l LEFT JOIN s USING (conv_id, turn) WHERE l.conv_id IN (SELECT conv_id FROM s))"""


def _calls(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Transcript lines with a call in each, and the rows of a store that has most of the calls."""
    path = F.md5(F.concat_ws("/", "conv_id", "turn").cast("binary"))
    c = t("conversations").select("conv_id", "turn", path.alias("path"), F.md5(F.col("text").cast("binary")).alias("result"))
    body = F.concat(F.lit('{"role":"assistant","message":{"content":[{"type":"text","text":"[REDACTED]"},{"type":"tool_use","name":"Read","input":{"path":"'), "path", F.lit('","limit":'), F.col("turn").cast("string"), F.lit("}}]}}"))
    lines = c.select(F.concat(F.lit("p/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("conv"), F.col("turn").cast("int").alias("line_no"), body.alias("body"))
    kept = c.where((F.col("conv_id") + F.col("turn")) % 5 != 0)
    called = F.struct(F.concat(F.lit("t"), F.col("turn").cast("string")).alias("toolCallId"), F.lit("read_file_v2").alias("name"), F.to_json(F.struct(F.col("turn").alias("offset"), F.col("path").alias("file"))).alias("rawArgs"), F.lit("ok").alias("status"), "result")
    key = F.concat(F.lit("bubbleId:"), F.col("conv_id").cast("string"), F.lit(":b"), F.col("turn").cast("string"))
    bubbles = kept.select(key.alias("key"), F.to_json(F.struct(F.lit(2).alias("type"), called.alias("toolFormerData"))).alias("value"))
    ids = F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.struct(F.concat(F.lit("b"), x.cast("string")).alias("bubbleId")))
    heads = kept.groupBy("conv_id").agg(ids.alias("ids")).select(F.concat(F.lit("composerData:"), F.col("conv_id").cast("string")).alias("key"), F.to_json(F.struct(F.col("ids").alias("fullConversationHeadersOnly"))).alias("value"))
    return tables.written(lines, "call-lines"), tables.written(bubbles.unionByName(heads), "call-rows")


@query(f"""WITH {CALLS_SQL} SELECT * FROM d""")
def enriched_transcripts(t: Tables) -> DataFrame:
    """Transcript lines beside what a store knows of their calls, some of which it doesn't have."""
    lines, rows = _calls(t)
    out = derived.enriched_lines(lines, rows)
    return out.select(F.regexp_extract("conv", r"(\d+)\.jsonl$", 1).cast("long").alias("conv_id"), F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"""WITH {CALLS_SQL}, h AS (SELECT conv_id, sha256(string_agg(sha256(line), chr(10) ORDER BY line_no)) AS output_hash FROM d GROUP BY conv_id)
SELECT conv_id, output_hash, conv_id % 3 <> 0 AS ships FROM h""")
def enriched_changes(t: Tables) -> DataFrame:
    """Which enriched transcripts ship: those whose output isn't the one that shipped last."""
    hashes = derived.output_hashes(derived.enriched_lines(*_calls(t)))
    conv = F.regexp_extract("conv", r"(\d+)\.jsonl$", 1).cast("long")
    shipped = F.when(conv % 3 == 0, F.col("output_hash")).when(conv % 3 == 1, "another")
    state = hashes.select(F.concat("conv", F.lit(derived.SUFFIX)).alias("native_path"), shipped.alias("output_hash"), F.when(shipped.isNotNull(), "h").alias("source_hash"))
    new = derived.changed(hashes, state).select("conv", F.lit(True).alias("ships"))
    return hashes.join(new, "conv", "left").select(conv.alias("conv_id"), "output_hash", F.coalesce("ships", F.lit(False)).alias("ships"))


# --- state -----------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 30 = 0 THEN 'third' WHEN o_orderkey % 10 = 0 THEN 'second' ELSE o_orderstatus END AS mark FROM orders
WHERE (o_orderkey % 17 <> 0 OR o_orderkey % 10 = 0) AND (o_orderkey % 23 <> 0 OR o_orderkey % 30 = 0)""")
def state_newest(t: Tables) -> DataFrame:
    """A state table after three commits: all rows, then changes with rows and keys that went, the newest counts."""
    orders = t("orders")
    folder = tables.fresh_folder(orders.sparkSession, "state")
    rows = lambda where, mark: orders.where(where).select("o_orderkey", mark.alias("mark"))
    tables.commit_changes(rows("true", F.col("o_orderstatus")), rows("false", F.lit("")), folder, ["o_orderkey"])
    tables.commit_changes(rows("o_orderkey % 10 = 0", F.lit("second")), rows("o_orderkey % 17 = 0", F.lit("")), folder, ["o_orderkey"])
    tables.commit_changes(rows("o_orderkey % 30 = 0", F.lit("third")), rows("o_orderkey % 23 = 0", F.lit("")), folder, ["o_orderkey"])
    return tables.read_state(orders.sparkSession, folder, rows("true", F.lit("")).schema)


@query("""SELECT user_id, list_aggregate(list_concat(base, list_filter(more, lambda x: NOT list_contains(base, x))), 'string_agg', ',') AS kinds FROM (
  SELECT user_id, coalesce(list(event_type ORDER BY first) FILTER (NOT late), []) AS base, coalesce(list(event_type ORDER BY first) FILTER (late), []) AS more
  FROM (SELECT user_id, event_type, event_id % 3 = 0 AS late, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id)""")
def union_in_order(t: Tables) -> DataFrame:
    """Two lists of each user as one, the base's order first."""
    seen = t("events").groupBy("user_id", "event_type", (F.col("event_id") % 3 == 0).alias("late")).agg(F.min("event_id").alias("first"))
    listed = lambda late: F.transform(F.array_sort(F.collect_list(F.when(F.col("late") == late, F.struct("first", "event_type")))), lambda x: x["event_type"])
    sets = seen.groupBy("user_id").agg(listed(False).alias("base"), listed(True).alias("more"))
    return sets.select("user_id", F.array_join(ordered_union(F.col("base"), F.col("more")), ",").alias("kinds"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '/home/r/' || lang WHEN doc_id % 5 = 0 THEN '/srv/' || source ELSE '/home/r/' || source || '/' || lang || '/' || doc_id % 3 END AS dir FROM documents),
c AS (SELECT '/home/r' AS root, '/home/r/.git' AS common UNION ALL SELECT DISTINCT '/home/r/' || source, '/main/' || source || '/.git' FROM documents
  UNION ALL SELECT DISTINCT '/home/r/' || source || '/en', '/bare/' || source FROM documents UNION ALL SELECT DISTINCT '/home/r/' || source || '/de', NULL FROM documents UNION ALL SELECT '/srv', '/srv/.git'),
n AS (SELECT d.doc_id, d.dir, arg_max(coalesce(c.common, '-'), length(c.root)) AS common FROM d LEFT JOIN c ON (d.dir = c.root OR starts_with(d.dir, c.root || '/')) AND c.root <> '/home/r' GROUP BY ALL)
SELECT doc_id, CASE WHEN common LIKE '%/.git' THEN left(common, length(common) - 5) ELSE dir END AS repo_dir FROM n""")
def repository_dirs(t: Tables) -> DataFrame:
    """Working directories with the main working tree of the checkout they lie in."""
    d = t("documents")
    n = F.col("doc_id")
    dirs = F.when(n % 7 == 0, F.concat_ws("/", F.lit("/home/r"), "lang")).when(n % 5 == 0, F.concat_ws("/", F.lit("/srv"), "source")).otherwise(F.concat_ws("/", F.lit("/home/r"), "source", "lang", (n % 3).cast("string")))
    rows = d.select("doc_id", dirs.alias("dir"))
    root = F.concat(F.lit("/home/r/"), F.col("source"))
    checkouts = d.select(root.alias("root"), F.concat(F.lit("/main/"), "source", F.lit("/.git")).alias("common")).distinct()
    checkouts = checkouts.union(d.select(F.concat(root, F.lit("/en")), F.concat(F.lit("/bare/"), "source")).distinct()).union(d.select(F.concat(root, F.lit("/de")), F.lit(None).cast("string")).distinct())
    checkouts = checkouts.union(d.sparkSession.createDataFrame([("/home/r", "/home/r/.git"), ("/srv", "/srv/.git")], "root string, common string"))
    return rollups.repository_dirs(rows, checkouts, "/home/r").select("doc_id", "repo_dir")


@query("""SELECT conv_id, coalesce(arg_min('v' || turn, turn) FILTER (turn < 16 AND turn % 4 = 3), NULL) AS version FROM conversations GROUP BY conv_id""")
def producer_versions(t: Tables) -> DataFrame:
    """The version that the first lines of a transcript name, in one of several fields."""
    n = F.col("turn")
    named = F.when(n % 4 == 3, F.concat(F.lit("v"), n.cast("string")))
    record = F.struct("role", F.when(n % 8 == 3, named).alias("cli_version"), F.struct(F.when(n % 8 == 7, named).alias("version")).alias("payload"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.to_json(record).alias("line")))), lambda x: x["line"])
    return t("conversations").groupBy("conv_id").agg(F.array_join(lines, "\n").alias("head")).select("conv_id", listing.producer_version(F.col("head")).alias("version"))


@query("""SELECT user_id, event_id, owner <> '' AND install <> '' AND owner <> install AS is_foreign FROM (
  SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'i' || user_id % 3 END AS owner, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'i' || event_id % 3 END AS install FROM events)""")
def foreign_states(t: Tables) -> DataFrame:
    """States that another installation wrote."""
    owner = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("i"), (F.col("user_id") % 3).cast("string")))
    install = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit("i"), (F.col("event_id") % 3).cast("string")))
    return t("events").select("user_id", "event_id", changes.foreign(owner, install).alias("is_foreign"))


# --- logs ------------------------------------------------------------------------------------------

_LOG = "event_id long, user_id long, event_type string, ts timestamp"


def _log(t: Tables) -> tuple[DataFrame, str]:
    """Events appended to a log a quarter at a time, in generations of some kilobytes."""
    events = t("events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    folder = tables.fresh_folder(events.sparkSession, "log")
    for k in range(4):
        logs.append(events.where(F.col("event_id") % 4 == k), folder, most_bytes=10_000)
    return events, folder


@query("""SELECT event_id, user_id, event_type FROM events ORDER BY event_id % 4 DESC, ts DESC, event_id DESC LIMIT 100""")
def log_tail(t: Tables) -> DataFrame:
    """The last 100 entries of a log, out of its newest generations."""
    events, folder = _log(t)
    return logs.read_last(events.sparkSession, folder, 100, [F.desc("ts"), F.desc("event_id")], _LOG).select("event_id", "user_id", "event_type")


@query("""WITH e AS (SELECT *, (event_id % 4) * 1000000000000 + event_id AS place FROM events), g AS (SELECT user_id, coalesce(max(place) FILTER (event_type = 'purchase'), -1) AS good FROM e GROUP BY user_id)
SELECT user_id, count(*) AS failures, arg_min(event_id, place) AS since FROM e JOIN g USING (user_id) WHERE place > good GROUP BY user_id""")
def log_failures(t: Tables) -> DataFrame:
    """Events of each user since the last purchase, in the order of a log."""
    events, folder = _log(t)
    return logs.failing(events.sparkSession, folder, "user_id", F.col("event_type") == "purchase", ["event_id"], _LOG)


# --- ranks -----------------------------------------------------------------------------------------

_SHARES = (0, 10, 25, 50, 75, 90, 99)


@query(f"""WITH l AS (SELECT l_returnflag, round(l_extendedprice * 100)::BIGINT AS cents, row_number() OVER (PARTITION BY l_returnflag ORDER BY round(l_extendedprice * 100)::BIGINT, l_orderkey, l_linenumber) - 1 AS rank, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, share, rank, cents FROM l JOIN (SELECT unnest([{", ".join(map(str, _SHARES))}]) AS share) ON rank = (n - 1) * share // 100""")
def price_ranks(t: Tables) -> DataFrame:
    """Prices at some ranks of each flag, by counting digits."""
    rows = t("lineitem").select("l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    sizes = rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    wanted = sizes.select("l_returnflag", "n", F.explode(F.array(*map(F.lit, _SHARES))).alias("share")).select("l_returnflag", "share", F.floor((F.col("n") - 1) * F.col("share") / 100).alias("rank"))
    found = ranks.at_ranks(rows, ["l_returnflag"], ["cents"], wanted.select("l_returnflag", "rank").distinct())
    return wanted.join(found, ["l_returnflag", "rank"]).select("l_returnflag", F.col("share").cast("int").alias("share"), "rank", "cents")


# --- rule packs --------------------------------------------------------------------------------------

_PACKS = [(n, r.rule_id) for n, rules in packs.CORPORA.items() for r in rules if not r.checksum]


@query(f"""WITH ledger AS ({core.ORACLE_SQL["redact_rule_ledger"]}), p(pack, rule_id) AS (VALUES {", ".join(f"('{p}', '{r}')" for p, r in _PACKS)})
SELECT pack, count(*) AS rules, sum(hits)::BIGINT AS hits FROM ledger JOIN p USING (rule_id) WHERE hits > 0 GROUP BY pack""")
def pack_ledgers(t: Tables) -> DataFrame:
    """Hits of each rule pack by itself; together they are the whole ledger's."""
    out = None
    for name in packs.CORPORA:
        rules = [r for r in packs.compiled([name]).rules if not r.checksum]
        found = redact.hits_by_rule(core._planted(t("documents")), rules).agg(F.count(F.lit(1)).alias("rules"), F.sum("hits").alias("hits")).select(F.lit(name).alias("pack"), "rules", "hits")
        out = found if out is None else out.unionByName(found)
    return out.where("rules > 0")


# --- catalogs ----------------------------------------------------------------------------------------

#: What is wrong with a document, by its number: what it is made of, and the faults that must be found.
_GOOD = '"id":"{id}","gather":"file_glob","artifact_class":"trajectory","roots":["~/x"],"include":["**/*"]'
_FAULTY = (
    ('{"spec_version":1,"family":"f","sources":[{' + _GOOD + "}]}", ()),
    ('{"spec_version":1,"sources":[{' + _GOOD + "}]}", (("$.family", "required"),)),
    ('{"spec_version":2,"family":"f","sources":[{' + _GOOD + "}]}", (("$.spec_version", "enum"),)),
    ('{"spec_version":1,"family":"f","sources":[{' + _GOOD.replace("file_glob", "acp") + "}]}", (("$.sources[0].gather", "enum"),)),
    ('{"spec_version":1,"family":"F!","sources":[{' + _GOOD + ',"colour":1}]}', (("$.family", "pattern"), ("$.sources[0].colour", "additionalProperties"))),
    ('{"spec_version":1,"family":"f","sources":[{' + _GOOD.replace('["~/x"]', "[]") + ',"max_file_bytes":0}]}', (("$.sources[0].roots", "minItems"), ("$.sources[0].max_file_bytes", "minimum"))),
    ('{"spec_version":1,"family":"f","sources":[{' + _GOOD.replace(',"include":["**/*"]', "") + "}]}", (("$.sources[0].include", "required"),)),
    ('{"spec_version":1,"family":"f","sources":[{' + _GOOD + ',"sniff":{"kind":"magic"}}]}', (("$.sources[0].sniff.magic_hex", "required"),)),
    ('{"spec_version":1,"family":"f","sources":[{' + _GOOD.replace("file_glob", "sidecar") + ',"emit":"x"}]}', (("$.sources[0].cwd_probe", "required"),)),
    ('{"spec_version":1,"family":"f","sources":[{' + _GOOD + ',"enrichers":{"Up":true,"ok":1},"include":7}]}', (("$", "JSON"),)),
    ('{"spec_version":1,"family":"f","sources":[{' + _GOOD + ',"enrichers":{"Up":true,"ok":1},"exclude":["a",""]}]}', (("$.sources[0].enrichers.Up", "pattern"), ("$.sources[0].enrichers.ok", "type"), ("$.sources[0].exclude[1]", "minLength"))),
    ('{"spec_version":1,"family":"f","sources":[]}', (("$.sources", "minItems"),)),
    ("[1]", (("$", "type"),)),
    ("{", (("$", "JSON"),)),
)
_PAIRS = ", ".join(f"({k}, '{p}', '{r}')" for k, (_, faults) in enumerate(_FAULTY) for p, r in faults)


@query(f"""WITH kinds(kind, path, rule) AS (VALUES {_PAIRS}),
d AS (SELECT c_custkey, c_custkey % {len(_FAULTY)} AS kind, c_custkey // 2 AS id FROM customer),
named AS (SELECT * FROM d WHERE kind NOT IN (9, 11, 12, 13))
SELECT c_custkey, path, rule FROM d JOIN kinds USING (kind)
UNION ALL SELECT a.c_custkey, '$.sources[0].id', 'unique' FROM named a WHERE EXISTS (SELECT 1 FROM named b WHERE b.id = a.id AND b.c_custkey <> a.c_custkey)""")
def catalog_faults(t: Tables) -> DataFrame:
    """Everything that is wrong with catalog documents, a row for each fault; ids that two sources have included."""
    kinds = F.create_map(*[F.lit(x) for k, (body, _) in enumerate(_FAULTY) for x in (k, body)])
    body = F.replace(F.element_at(kinds, (F.col("c_custkey") % len(_FAULTY)).cast("int")), F.lit("{id}"), F.concat(F.lit("s-"), F.floor(F.col("c_custkey") / 2).cast("string")))
    docs = t("customer").select(F.col("c_custkey").alias("file"), F.try_parse_json(body).alias("doc"))
    return catalog.check(docs).select(F.col("file").alias("c_custkey"), "path", "rule")


# --- manifests ---------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, doc_id % 9 AS k FROM documents),
f(k, path, rule) AS (VALUES (1, '$.install_id', 'pattern'), (2, '$.source_hash', 'required'), (3, '$.payload_size', 'minimum'), (4, '$.redaction.density', 'maximum'), (5, '$.redaction.rule_hits.No', 'pattern'),
  (6, '$.enricher', 'required'), (6, '$.derived_from', 'required'), (6, '$.enrich_status', 'required'), (7, '$.sealed_at', 'format'), (8, '$.artifact_class', 'enum'))
SELECT doc_id, path, rule FROM d JOIN f USING (k)""")
def manifest_faults(t: Tables) -> DataFrame:
    """Manifests of documents, one in nine of them sound, and what is wrong with the others."""
    k = F.col("doc_id") % 9
    unless = lambda n, good, bad: F.when(k == n, bad).otherwise(good)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    hits = F.create_map(unless(5, F.lit("email"), F.lit("No")), F.lit(2).cast("long"))
    manifest = manifests.assembled(
        organization_id=F.lit("org"), install_id=unless(1, F.lit("00000000-0000-4000-8000-000000000001"), F.lit("one")), source_id=F.lit("a-b"), native_path=F.concat(F.lit("p/"), F.col("doc_id").cast("string")),
        gather=F.lit("file_glob"), artifact_class=unless(8, F.lit("context"), F.lit("other")), source_hash=unless(2, digest, F.lit(None).cast("string")), shipped_hash=digest,
        payload_size=unless(3, F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), F.lit(-1).cast("long")), redaction=F.struct(unless(4, F.lit(0.25), F.lit(1.5)).alias("density"), hits.alias("rule_hits")),
        client=F.struct(F.lit("1").alias("version")), sealed_at=unless(7, F.lit("2024-01-01T00:00:00Z"), F.lit("yesterday")), derived=F.when(k == 6, F.lit(True)),
    )
    return t("documents").select("doc_id", F.explode(manifests.faults(manifest)).alias("f")).select("doc_id", "f.path", "f.rule")
