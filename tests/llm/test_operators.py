"""Operators on small tables with awkward rows: nulls, empty and long texts, ties, repeats, odd columns."""

import hashlib
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.llm import _common, fingerprints, language_id, mixing, near_dedup, packing, quality_rules, queries, sharding, token_counts, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
#: Columns that operators use inside, here as columns of the input.
ODD = ["bucket", "same", "rep", "item", "size", "h", "_s", "_q", "key", "look", "copies", "score", "digest", "kept", "piece", "component"]


def words(rng, n, stock=400):
    return " ".join(rng.choice([f"w{k}" for k in range(stock)]) for _ in range(n))


def awkward(seed=1):
    """Rows with every oddity at once."""
    rng = random.Random(seed)
    base = words(rng, 120)
    rows = [(k, words(rng, rng.randint(1, 150)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), 0) for k in range(40)]
    rows += [(100, None, "en", "a", 0), (101, "", "en", "a", 0), (102, " \n\t", None, None, 0), (103, "one", "en", "b", 0), (104, "é" * 5 + " " + "日本 語", "ja", "c", 0)]
    rows += [(110 + k, base, "en", "a", 0) for k in range(5)] + [(120, base + " tail", "en", "b", 0), (130, words(rng, 30_000), "en", "a", 0)]
    rows += [rows[0], rows[0], (None, "no id at all here", "en", "a", 0), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(awkward(), DOCS)
    for c in ODD:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def ids(df, column="doc_id"):
    return Counter(r[column] for r in df.collect())


def test_every_row_comes_back(docs):
    want = ids(docs)
    for found in (near_dedup.near_duplicates(docs), fingerprints.exact_duplicates(docs), fingerprints.compare_with_next(docs), token_counts.count_tokens(docs), mixing.mix(docs), sharding.shard(docs, 4_000), language_id.identify(docs, None), toxicity.score(docs, None)):
        assert ids(found) == want
    assert quality_rules.judge(docs.select("doc_id", "text"), quality_rules.DecisionList()).count() == sum(want.values())


def test_empty_tables(spark, none):
    for found in (near_dedup.near_duplicates(none), fingerprints.exact_duplicates(none), fingerprints.fingerprint_query(none), token_counts.count_tokens(none), mixing.mix(none), sharding.shard(none), packing.pack(packing.document_items(none)), quality_rules.judge(none, quality_rules.DecisionList())):
        assert found.count() == 0
    labels = spark.createDataFrame([], LABELS)
    assert language_id.fit(none) is None and toxicity.fit(none, labels) is None
    assert quality_rules.learn_from_labels(none, labels).rules == []
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- near duplicates ---


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows, i = [], 0
    for _ in range(12):  # loose families: many pairs lie close to the limit
        base = words(rng, rng.choice([6, 8, 40, 150]), 5_000)
        for _ in range(rng.randint(2, 14)):
            rows.append((i := i + 1, edited(rng, base, rng.randint(0, 5))))
    passage = words(rng, 60, 5_000)
    rows += [((i := i + 1), passage + " " + words(rng, 30, 5_000)) for _ in range(25)]
    rows += [((i := i + 1), t) for t in ("", None, "A b", "a B", "a b c", "A  B\tc", rows[0][1].upper())]
    rng.shuffle(rows)
    want = brute_components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for limits in ((1_000_000, 1_024), (300, 3), (60, 1)):  # whole components, several blocks, bucket by bucket
        monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", limits[0])
        monkeypatch.setattr(near_dedup, "BLOCK_DOCS", limits[1])
        got = near_dedup.near_duplicates(df).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_intersections_and_roots():
    rng = random.Random(1)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randint(1, 50))], np.uint64)) for _ in range(40)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = near_dedup.intersections(sets)
    np.fill_diagonal(want, 0), np.fill_diagonal(got, 0)
    assert (got == want).all()
    link = np.zeros((5, 5), bool)
    for a, b in ((0, 3), (3, 4), (1, 2)):
        link[a, b] = link[b, a] = True
    assert near_dedup.roots(link).tolist() == [0, 1, 1, 0, 0]


def test_components_of_long_paths(spark):
    rng = random.Random(2)
    path = list(range(60))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(100, 101), (5, 5)]
    got = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 60)} | {101: 100}


def test_minhash_bands_follow_similarity():
    rng = np.random.default_rng(4)
    hits = 0
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**64, 37, dtype=np.uint64))
        b = np.unique(np.append(a[3:], rng.integers(0, 2**64, 3, dtype=np.uint64)))  # similarity 34 / 40
        hits += bool((near_dedup.band_hashes(a) == near_dedup.band_hashes(b)).any())
    assert hits == 200
    assert (near_dedup.band_hashes(np.array([7], np.uint64)) == near_dedup.band_hashes(np.array([7], np.uint64))).all()


# --- fingerprints ---


def canon(t):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold()).split())


def test_fingerprints_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_DOCS", 7)  # many ranges, some of them empty
    rng = random.Random(5)
    texts = [rng.choice(["", None, "Straße  ﬁx", "STRASSE fix", "abcd", "abcd", words(rng, 40), "é" * 9]) for _ in range(60)]
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    got = fingerprints.fingerprint_query(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).orderBy("doc_id").collect()
    for k, r in enumerate(got):
        t, nxt = texts[k] or "", texts[(k + 1) % len(texts)] or ""
        e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (rows[k][0], len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r["near_next"], r["near_edited"]) == (float(canon(t) == canon(nxt)), float(canon(t) == canon(e)))
        assert r["edited_fingerprint"] == fingerprints.digest(canon(e))
    by = defaultdict(set)
    for k, r in enumerate(got):
        by[r["fingerprint"]].add(canon(texts[k]))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({canon(t) for t in texts})


def test_one_document_is_its_own_next(spark):
    row = fingerprints.compare_with_next(spark.createDataFrame([(9, "abcdefgh")], "doc_id long, text string")).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_equal_buckets_are_told_apart_by_bytes(spark, monkeypatch):
    rows = [(1, "a"), (2, "b"), (3, "A "), (4, "b"), (5, "c")]
    monkeypatch.setattr(fingerprints, "digest", lambda c: "same" if c in "ab" else "other")
    got = {r["doc_id"]: r for r in fingerprints.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["group"] for i, r in got.items()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}
    assert [i for i, r in sorted(got.items()) if r["kept"]] == [1, 2, 5]


# --- packing ---


def brute_best_fit(pieces, capacity):
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [b for b, (room, s, c) in enumerate(bins) if room >= size and not (s & source or c & cluster)]
        if fits:
            room = min(bins[b][0] for b in fits)
            out.append(room)
            b = next(b for b in fits if bins[b][0] == room)
            bins[b] = (room - size, bins[b][1] | source, bins[b][2] | cluster)
        else:
            out.append(None)
            bins.append((capacity - size, source, cluster))
    return out, len(bins)


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(6)
    for _ in range(30):
        pieces = sorted(((rng.randint(0, 50), 1 << rng.randrange(4), rng.choice([0, 0, 1, 2])) for _ in range(60)), reverse=True)
        got, rooms, seen = packing.best_fit(pieces, 50), {}, {}
        tight, n = brute_best_fit(pieces, 50)
        for (size, s, c), b, want in zip(pieces, got, tight, strict=True):
            assert (rooms.get(b) if b in rooms else None) == want
            assert not (seen.get(b, (0, 0))[0] & s or seen.get(b, (0, 0))[1] & c)
            rooms[b] = rooms.get(b, 50) - size
            seen[b] = (seen.get(b, (0, 0))[0] | s, seen.get(b, (0, 0))[1] | c)
        assert len(rooms) == n and min(rooms.values()) >= 0


def test_packing_keeps_everything(docs):
    packed = packing.pack(packing.document_items(docs), capacity=100, group_pieces=16).collect()
    sizes, held = Counter(), defaultdict(list)
    for r in packed:
        sizes[r["item"]] += r["size"]
        held[r["bin"]].append(r)
    want = Counter()
    for i, t, *_ in awkward():
        want[i] += len((t or "").encode().split())
    assert sizes == want
    for rows in held.values():
        named = [r["source"] for r in rows if r["source"]]
        assert sum(r["size"] for r in rows) == 100 - rows[0]["bin_room"] <= 100 and len(named) == len(set(named))


@pytest.mark.parametrize("item", [None, 7])
def test_packing_spreads_one_id_over_groups(spark, item):
    rows = [(item, 20, None, None)] * 6_000
    packed = packing.pack(spark.createDataFrame(rows, "item long, size long, source string, cluster long").repartition(3), capacity=100, group_pieces=500)
    groups = [r["count"] for r in packed.groupBy((F.col("bin") / (1 << 24)).cast("long")).count().collect()]
    assert sum(groups) == 6_000 and len(groups) == 12 and max(groups) < 1_000


def test_packing_keeps_clusters_apart(spark):
    rng = random.Random(15)
    rows = [(k, rng.randint(1, 60), rng.choice(["a", "b", "c", None]), rng.choice([None, 1, 2, 3, 4])) for k in range(400)]
    packed = packing.pack(spark.createDataFrame(rows, "item long, size long, source string, cluster long"), capacity=100, group_pieces=64).collect()
    seen, cluster = Counter(), {i: c for i, _, _, c in rows}
    for r in packed:
        if cluster[r["item"]]:
            seen[(r["bin"], cluster[r["item"]])] += 1
    assert max(seen.values()) == 1 and sum(r["size"] for r in packed) == sum(n for _, n, _, _ in rows)


# --- mixing ---


def fill(sizes, weights, share, cap):
    """Targets by resharing the excess again and again."""
    total, target, open_ = share * sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        left = total - sum(target[s] for s in sizes if s not in open_)
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > cap * sizes[s] + 1e-9}
        for s in over or open_:
            target[s] = min(cap * sizes[s], weights[s] * level)
        if not over:
            break
        open_ -= over
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(7)
    names = ["b", "a", "é", "z", None, "A", "zero"]
    rows = [(k, " ".join("w" * (0 if s == "zero" else rng.choice([1, 3, 20, 20, 60]))) , s) for k, s in enumerate(rng.choices(names, [30, 1, 3, 3, 2, 2, 1], k=1500))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df.repartition(4)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}, 1.5, 2.0)
    taken = Counter()
    for r in got:
        assert r["size"] == len(dict((i, t) for i, t, _ in rows[r["doc_id"] : r["doc_id"] + 1])[r["doc_id"]].split())
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-6)
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s])
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_dual_solution_is_an_exponential_tilt(spark):
    sized = spark.createDataFrame([(k, "s", 1 + k % 50) for k in range(400)] + [(1000 + k, "t", 5) for k in range(100)], "doc_id long, source string, size long")
    sized = sized.withColumn("_key", F.xxhash64("doc_id")).withColumn("_no", F.col("doc_id"))
    rows = [r for r in mixing.mix_sized(sized).collect() if r["source"] == "s"]
    got = sum(r["rate"] * r["size"] for r in rows)
    assert got == pytest.approx(rows[0]["target"], rel=1e-6)
    free = sorted((r["size"], np.log(r["rate"])) for r in rows if r["rate"] < 2)
    slopes = {round(v / z, 9) for z, v in free}
    assert len(slopes) == 1  # log of the rate is proportional to the size


# --- sharding ---


def brute_shards(rows, limit):
    """(id, bytes, shard, bytes and rows of the shard) of every row, by splitting buckets that are too large."""
    marks = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    copies, todo, out = Counter(), [], []
    for i, t in rows:
        copy, copies[i, t or ""] = copies[i, t or ""], copies[i, t or ""] + 1
        whole = f"{'null' if i is None else i}/{marks(t)}/{copy}"
        todo.append((bin(int(hashlib.md5(whole.encode()).hexdigest()[:15], 16))[2:].zfill(60), i, len((t or "").encode())))
    buckets = [("", todo)] if todo else []
    while buckets:
        prefix, held = buckets.pop()
        size = sum(n for _, _, n in held)
        if size <= limit or len(held) == 1 or len(prefix) == 60:
            out += [(i, n, prefix, size, len(held)) for _, i, n in held]
        else:
            parts = [(prefix + bit, [x for x in held if x[0][len(prefix)] == bit]) for bit in "01"]
            buckets += [p for p in parts if p[1]]
    return Counter(out)


def test_shards_are_the_least_prefixes_that_fit(spark):
    rng = random.Random(8)
    rows = [(k, "x" * rng.choice([0, 10, 100, 5_000])) for k in range(500)] + [(7, "y" * 900)] * 60
    rows += [(None, "n" * k) for k in range(100)] + [(None, None), (8, None), (8, "")] + [(9, f"text {k}" * 30) for k in range(50)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 2_000).collect()
    found = Counter((r["doc_id"], r["bytes"], r["shard"], r["shard_bytes"], r["shard_docs"]) for r in got)
    assert found == brute_shards(rows, 2_000)
    assert all(size <= 2_000 or n == 1 for _, _, _, size, n in found)  # a hot id, rows without one and equal rows are split, too
    one = sharding.shard(spark.createDataFrame(rows[:3], "doc_id long, text string"), 10**9).collect()
    assert {r["shard"] for r in one} == {""}


def test_equal_rows_are_numbered_where_they_lie(spark):
    rows = [("a", 1)] * 40 + [(None, 2)] * 25 + [("b", k) for k in range(10)]
    got = _common.numbered(spark.createDataFrame(rows, "k string, v long").repartition(6), ["k", "v"], "numbered").collect()
    want = Counter((k, v, n) for (k, v), count in Counter(rows).items() for n in range(count))
    assert Counter((r["k"], r["v"], r["_copy"]) for r in got) == want
    dealt = _common.with_copies(spark.createDataFrame(rows, "k string, v long"), "copies", 7).collect()
    assert Counter((r["k"], r["v"], r["_copy"]) for r in dealt) == want


def test_written_shards_read_back(spark, tmp_path):
    df = spark.createDataFrame([(k, "x" * 50, "clash", "clash", "clash") for k in range(60)], "doc_id long, text string, bytes string, shard string, _id string")
    sharding.write_shards(df, str(tmp_path / "shards"), 500)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert ids(back) == ids(df) and back.select("shard").distinct().count() > 1
    odd = spark.createDataFrame([(None, "same", k) for k in range(90)] + [(4, None, 0)], "doc_id long, text string, more long")
    sharding.write_shards(odd.repartition(3), str(tmp_path / "odd"), 40)
    back = spark.read.schema("more long, shard string").parquet(str(tmp_path / "odd"))
    assert sorted(r["more"] for r in back.collect()) == sorted(r["more"] for r in odd.collect()) and back.groupBy("shard").count().agg(F.max("count")).first()[0] <= 11


# --- WARC ---


def test_warc_round_trip(spark):
    big = "é" * 300_000
    rows = [(5, "http://x/a", "p" * 100), (3, "http://x/\r\nb", "p" * 100), (9, None, "p" * 100), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", big), (2, "u", big), (2, "u", big), (None, "u", "p" * 100), (11, "u", "p" * 99), (12, "u", "p" * 99)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit("clash"))
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df.repartition(3)).collect())
    want = Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        first = min(p for p, _, x in rows if x == h and p is not None) if len(body) >= 100 else None
        again = i is not None and first is not None and i > first
        want[(i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    assert got == want


def test_chunks_carry_running_digests(spark):
    path = _common.fresh_path(spark, "warc-test")
    df = spark.createDataFrame([(1, "u", "abc" * 1_000)], "page_id long, url string, html string")
    rows = warc.read_chunks(warc.write_archives(warc.chunk_table(warc.mark_revisits(df)), path), path, chunk_bytes=1_024).orderBy("chunk_no").collect()
    assert [r["chunk_bytes"] for r in rows] == [1_024, 1_024, 952] and [r["last"] for r in rows] == [False, False, True]
    for k, r in enumerate(rows):
        assert r["digest_so_far"] == hashlib.sha256(("abc" * 1_000).encode()[: 1_024 * (k + 1)]).hexdigest()
    assert b"".join(r["chunk"] for r in rows) == b"abc" * 1_000


def test_foreign_archives_are_read(spark, tmp_path):
    import gzip

    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    page = b"WARC/1.0\r\nwarc-type:response\r\nWARC-Target-URI: http://x/\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(page))
    (tmp_path / "b.warc").write_bytes(info + page)
    manifest = spark.createDataFrame([("a.warc.gz",), ("b.warc",)], "archive string")
    for archive in ("a.warc.gz", "b.warc"):
        one, two = warc.read_chunks(manifest, str(tmp_path)).where(F.col("archive") == archive).orderBy("record_no").collect()
        assert (one["record_type"], bytes(one["chunk"]), one["page_id"], one["payload_digest"], one["payload_bytes"]) == ("warcinfo", b"hello", None, None, None)
        assert (two["record_type"], two["url"], two["payload_digest"], two["chunk_bytes"], two["last"]) == ("response", "http://x/", "sha1:ABC", 0, True)


def test_large_payloads_stream_in_little_memory(spark):
    import resource

    path = _common.fresh_path(spark, "warc-large")
    df = spark.range(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.expr("repeat('0123456789abcdef', 4194304)").alias("html"))
    chunks = warc.read_chunks(warc.write_archives(warc.chunk_table(warc.mark_revisits(df)), path), path)

    def peak(batches):
        before, most = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0
        for b in batches:
            most = max(most, b.nbytes)
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"kb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before], "batch": [most]})

    with _common.bounded_batches(spark):
        row = chunks.select("chunk").mapInArrow(peak, "kb long, batch long").first()
    assert row["kb"] < 40_000 and row["batch"] < 10 << 20  # of 64 MB
    assert chunks.where("last").select("digest_so_far").first()[0] == hashlib.sha256(b"0123456789abcdef" * 4194304).hexdigest()


def test_revisits_name_the_record_of_their_response(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(1, "u", "p" * 200), (2, "v", "p" * 200)], "page_id long, url string, html string")
    warc.write_archives(warc.chunk_table(warc.mark_revisits(df.repartition(2))), str(tmp_path / "w"))
    heads = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz")).decode()
    field = lambda name, kind: [line.split(": ")[1] for block in heads.split("WARC/1.1") if f"WARC-Type: {kind}" in block for line in block.split("\r\n") if line.startswith(name + ":")]
    assert field("WARC-Refers-To", "revisit") == field("WARC-Record-ID", "response") != []


# --- token counts ---


def test_token_counts_equal_a_unigram_tokenizer():
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    rng = random.Random(9)
    pieces = [("▁", -3.0), ("▁▁", -4.0)] + [(c, -5.0) for c in "abc"] + [(p, float(-rng.randint(4, 9))) for p in ("ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "▁▁a")]
    spare = [(f"<0x{k:02X}>", -1e9) for k in range(256)]
    theirs = Tokenizer(Unigram([("<unk>", -1e9), *pieces, *spare], 0, True))
    ours = token_counts.Counter(pieces)
    for _ in range(400):
        text = "".join(rng.choice("abcé \n☃") for _ in range(rng.randint(1, 30)))
        assert ours.tokens(text) == len(theirs.encode("▁" + text.replace(" ", "▁")).ids), repr(text)
    assert ours.tokens("") == 0
    with pytest.raises(ValueError):
        token_counts.Counter([("a▁b", -1.0)])


def test_token_counts_of_a_table_equal_the_tokenizers(spark):
    """The production vocabulary, every text of the table, against the Unigram model of the library."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.VOCABULARY)
    pieces = token_counts.load_pieces()
    spare = [(f"<0x{k:02X}>", -1e9) for k in range(256)]
    assert model.get_piece_size() >= len(pieces)
    theirs = Tokenizer(Unigram([("<unk>", -1e9), *pieces, *spare], 0, True))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs).collect()}
    for r in docs.collect():
        want = len(theirs.encode("▁" + r["text"].replace(" ", "▁")).ids) if r["text"] else 0
        assert got[r["doc_id"]] == want


def test_long_words_take_little_memory():
    import tracemalloc

    counter = token_counts.Counter([("a", -1.0), ("ab", -1.5), ("▁", -2.0)])
    word = "abé" * 100_000
    tracemalloc.start()
    assert counter.pieces_of(word) == 300_000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2_000_000  # seven bytes a character at most


# --- language, toxicity, quality ---


def corpus(seed=10, n=600):
    """Four invented languages in two families, toxic words and bad documents among them."""
    rng = random.Random(seed)
    stock = {g: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(150)] for g, letters in (("en", "abcdeht"), ("de", "abcdehü"), ("fr", "éoiulrs"), ("es", "ñoiulrs"))}
    docs, labels = [], []
    for k in range(n):
        lang = rng.choice(list(stock))
        w = [rng.choice(stock[lang]) for _ in range(rng.randint(60, 120))]
        toxic, low = rng.random() < 0.3, rng.random() < 0.2
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vilezz", "nastyzz"]) + rng.choice(["", "x", "yy"])
        if low:
            w = [x + "###" for x in w]
        docs.append((k, " ".join(w), lang, "s", 0))
        labels.append((k, int(not low), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)


def test_language_of_held_out_documents(learned):
    docs, _ = learned
    model = language_id.fit(docs)
    assert model.families.names == ["germanic", "romance"] and model.members["romance"].names == ["es", "fr"]
    rows = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(_common.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 100 and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_needs_letters(spark, learned):
    model = language_id.fit(learned[0])
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "a"), (5, "²"), (6, "½ ① ٣")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd, model).collect()}
    assert all(got[k] == "und" for k in (1, 2, 3, 5, 6)) and got[4] != "und"
    assert {r["doc_id"] for r in language_id.keep_identified(odd, model, 0.0).collect()} == {4}


def test_held_out_rows_teach_nothing(spark, learned):
    docs, labels = learned
    out = _common.held_out(F.col("doc_id"))
    rest = docs.where(~out).unionByName(docs.where(out).withColumn("lang", F.lit("xx")))
    assert language_id.fit(rest).families.names == ["germanic", "romance"]
    wrong = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels).weights == toxicity.fit(docs, wrong).weights


def test_language_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(_common.held_out(F.col("doc_id"))).collect()
    right = sum(r["lang_pred"] == r["lang"] for r in rows)
    assert len(rows) > 200 and right >= 0.98 * len(rows)


def test_many_languages_share_one_sample(spark):
    rows = spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("q"), (F.col("id") % 40).cast("string")).alias("lang"), F.concat_ws(" ", *[F.concat(F.chr((97 + F.col("id") % 40 % 26)), F.lit(x), (F.col("id") % 40).cast("string")) for x in "ab"]).alias("text"))
    model = language_id.fit(rows, sample_rows=400)
    assert len(model.families.names) <= 40 and sum(len(c.names) for c in model.members.values()) <= 40


def test_toxicity_of_held_out_documents(spark, learned):
    docs, labels = learned
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(_common.held_out(F.col("doc_id"))).collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.97 * len(rows)
    found = toxicity.passages(docs, model).limit(5).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert found and all("zz" in r["passage"] and text[r["doc_id"]][r["first_char"] : r["last_char"]] == r["passage"] for r in found)
    odd = toxicity.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), model).collect()
    assert odd[0]["score"] == odd[1]["score"] < 0.3 and {r["predicted"] for r in odd} == {0}


def brute_segments(scores):
    """Maximal scoring segments by definition: the best segment, then those left and right of it."""

    def split(a, b):
        best = max(((sum(scores[i:j]), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 1e-9:
            return []
        _, _, _, i, j = best
        return [*split(a, i), (i, j - 1), *split(j, b)]

    return split(0, len(scores))


def test_segments_are_all_maximal_ones():
    rng = random.Random(11)
    for _ in range(200):
        scores = [rng.choice([toxicity.NEUTRAL, -1.13, 0.71, 1.57, 2.93]) for _ in range(rng.randint(1, 14))]
        at = [k for k, s in enumerate(scores) if s != toxicity.NEUTRAL]
        got = toxicity.segments([scores[k] for k in at], at)
        assert [(a, b) for a, b, _ in got] == brute_segments(scores)
        for a, b, s in got:
            assert s == pytest.approx(sum(scores[a : b + 1]))


def test_toxic_scores_against_their_definition(spark, learned):
    """Score, passages, lambda and K, worked out anew from segments by definition."""
    docs, labels = learned
    model = toxicity.fit(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.limit(60).collect()}
    got = {r["doc_id"]: r for r in toxicity.score(docs.where(F.col("doc_id").isin(list(text))), model).collect()}
    for i, t in text.items():
        found = toxicity._WORD.findall(t.lower())
        scores = [model.word_score(w) for w in found]
        floor = np.log(max(model.k * len(found), 1e-6))
        high = [max(0.0, model.decay * sum(scores[a : b + 1]) - floor) for a, b in brute_segments_fast(scores)]
        x = model.shift + model.slope * np.log1p(sum(high))
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-x))) and got[i]["n_passages"] == sum(h > 0 for h in high)
    values = Counter({1.0: 3, -2.0: 2})
    s, p = np.array([1.0, -2.0, toxicity.NEUTRAL]), np.array([3, 2, 15]) / 20
    assert p @ np.exp(toxicity._decay(values, 20) * s) == pytest.approx(1.0)


def brute_segments_fast(scores):
    """As brute_segments, by the largest rise of the running sum."""

    def split(a, b):
        low, best = (0.0, a), (0.0, 0, 0, 0)
        total = 0.0
        for k in range(a, b):
            total += scores[k]
            if total - low[0] > best[0] + 1e-9:
                best = (total - low[0], low[1], k + 1, 1)
            if total < low[0]:
                low = (total, k + 1)
        return [*split(a, best[1]), (best[1], best[2] - 1), *split(best[2], b)] if best[3] else []

    return split(0, len(scores))


def test_model_takes_every_token_that_stands_out(spark):
    n = 400
    toxic = [(k, " ".join(f"bad{j}" for j in range(25_000)) if k % 4 else "plain words only", k) for k in range(8)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in toxic], "doc_id long, text string")
    counts = spark.range(30_000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("token"), F.lit(300).alias("toxic"), F.lit(0).alias("clean"))
    assert docs.count() == 8 and len(toxicity._log_odds(counts, n, n)) == 30_000


def test_rules_are_learned_and_readable(learned):
    docs, labels = learned
    rules = quality_rules.learn_from_labels(docs, labels)
    assert 1 <= len(rules.rules) <= 3 and "symbol_rate" in rules.describe()[0]
    rows = quality_rules.judge(docs, rules).join(labels, "doc_id").collect()
    assert all(r["_kept"] == (r["quality"] == 1) for r in rows)


def test_statistics_are_taken_of_labelled_rows_only(learned):
    """The filter on statistics isn't pushed to every document, and no plan holds them more than once."""
    docs, labels = learned
    plan = quality_rules.judge(docs.select("doc_id", "text"), quality_rules.learn_from_labels(docs, labels))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("n_dup_lines, ") <= 1 and plan.count("regexp_replace(") == 1


def test_text_statistics_against_brute_force(spark):
    import re

    rng = random.Random(12)
    pool = ["a", "b", "c", "A1!", "#x", "é|"]
    texts = [None, "", "\n \n", "a", "a a a a", "x y z x y z q", "l\nl\n \nl", "a\x85b c d"] + ["".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts.append(" ".join(f"u{k} u{k + 1} u{k + 2}" for k in range(300)) * 2)  # more repeated windows than are looked up one by one
    df = quality_rules.with_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    for r in df.collect():
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        cover = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = tuple(r["_q"][c] for c in quality_rules.BASE)
        assert got == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)), repr(t[:80])


@pytest.mark.parametrize(("sf", "recall", "alarms"), [("sf0.01", 0.6, 0.02), ("sf0.1", 0.9, 0.02)])
def test_held_out_toxicity(spark, sf, recall, alarms):
    """Of documents that taught nothing; at sf0.01 only 37 toxic ones teach, and half their words are in four languages."""
    folder = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = queries.QUERIES["op8_toxicity"](spark, folder).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("flagged")).collect()
    found = {r["toxic"]: r["flagged"] for r in rows}
    assert found[1] >= recall and found[0] <= alarms


def test_near_duplicates_of_a_whole_table_against_all_pairs(spark):
    """Every pair of documents of sf0.01 at 85 % or more shares a component, and components hold no other links: recall 1."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r["doc_id"]: r["component_id"] for r in queries.QUERIES["op6_near_dedup"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: component for i, (_, component) in brute_components(docs, 85).items()}
    assert sum(i != c for i, c in got.items()) > 50
