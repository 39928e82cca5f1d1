"""Decontamination, clustering and spelling against brute force, on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_operators import DOCS

from driftmark.llm import clustering, decontamination, queries, spelling

ITEMS = "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOW))


def brute_hits(docs, items, window=10):
    """For each document text: words, hit words, ids of the items with a window in it."""
    places = defaultdict(set)
    for item_id, text in items:
        ws = split(text)
        n = min(window, len(ws))
        for s in range(len(ws) - n + 1 if ws else 0):
            places[tuple(ws[s : s + n])].add(item_id)
    sizes, out = {len(w) for w in places}, []
    for text in docs:
        ws, hit, ids = split(text), set(), set()
        for n in sizes:
            for s in range(len(ws) - n + 1):
                if (found := places.get(tuple(ws[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    ids |= found
        out.append((len(ws), len(hit), sorted(str(i) for i in ids if i is not None)))
    return out


def leaky(seed, stock=12):
    """Few different words, so that windows recur in parts and in full; items nest, repeat and overlap."""
    rng = random.Random(seed)
    word = lambda: rng.choice([f"w{k}" for k in range(stock)] + ["É", "é", "日本", "x1"])
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    items = [(k, text(rng.randint(1, 30))) for k in range(25)]
    items += [(100, None), (101, ""), (102, " .,-"), (103, items[3][1]), (3, items[3][1]), (None, items[4][1]), (104, "É"), (105, items[5][1].upper() + "!")]
    docs = [text(rng.randint(0, 60)) for _ in range(60)]
    docs += [f"{text(5)} {items[k % 25][1].title()} {text(4)} {items[(k * 7) % 25][1]}" for k in range(40)]
    docs += [None, "", "...", items[0][1], " ".join(i[1] or "" for i in items), text(4_000)]
    return docs, items


def documents(spark, texts):
    rows = [(None if k % 9 == 8 else k // 2, t, "en", "a", 0) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("row", "term", "pos", "word", "item", "n", "span"):
        df = df.withColumn(c, F.lit("clash"))
    return rows, df.repartition(4)


@pytest.mark.parametrize(("seed", "stock"), [(1, 12), (2, 3), (3, 400)])
def test_hits_against_brute_force(spark, seed, stock):
    texts, items = leaky(seed, stock)
    rows, df = documents(spark, texts)
    got = decontamination.contaminated(df, spark.createDataFrame(items, ITEMS).withColumn("term", F.lit("clash")))
    want = Counter((r[0], n, hit, len(ids), tuple(ids), hit > 0) for r, (n, hit, ids) in zip(rows, brute_hits(texts, items), strict=True))
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"]), r["contaminated"]) for r in got.collect()) == want
    assert sum(h > 0 for _, _, h, *_ in want) > 20


def test_phrases_and_proximity_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 14)))) for k in range(12)]
    texts = []
    for k in range(40):  # items with words put in between
        ws = items[k % 12][1].split()
        for _ in range(k % 4):
            ws.insert(rng.randrange(len(ws)), rng.choice(vocabulary))
        texts.append(" ".join([*rng.choices(vocabulary, k=5), *ws, *rng.choices(vocabulary, k=5)]))
    df = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in enumerate(texts)], DOCS).repartition(4)
    text_of = {k: t.split() for k, t in enumerate(texts)}
    known = decontamination.read_items(spark.createDataFrame(items, ITEMS), window=6)
    ix = decontamination.index(df, known.vocabulary)
    row_of = {r["row"]: r["doc_id"] for r in decontamination.documents(ix).collect()}
    item_words = defaultdict(dict)
    for r in known.terms.collect():
        item_words[r["item"]][r["p"]] = r["word"]
    count = Counter(w for ws in text_of.values() for w in ws)
    for slop in (0, 1, 2):
        want = set()
        for item, by_place in item_words.items():
            n = len(by_place)
            span = min(6, n)
            for s in range(n - span + 1):
                window = [(p, by_place[p]) for p in range(s, s + span)]
                if min(count[w] for _, w in window) == 0:
                    continue
                anchor, rare = min(window, key=lambda x: (count[x[1]], x[0]))
                for doc, ws in text_of.items():
                    for at in (k for k, w in enumerate(ws) if w == rare):
                        near = lambda p, w: w in ws[max(0, at + p - anchor - slop) : max(0, at + p - anchor + slop + 1)]  # noqa: B023, E731
                        if all(near(p, w) for p, w in window):
                            want.add((doc, item, s, at + s - anchor))
        got = {(row_of[r["row"]], r["item"], r["item_start"], r["start"]) for r in decontamination.proximity_matches(ix, known, slop).collect()}
        assert got == want and want
    runs = decontamination.phrase_matches(ix, known).collect()
    windows = {(row_of[r["row"]], r["item"], r["item_start"] + k, r["start"] + k) for r in runs for k in range(r["words"] - min(6, len(item_words[r["item"]])) + 1)}
    assert windows == {(row_of[r["row"]], r["item"], r["item_start"], r["start"]) for r in decontamination.proximity_matches(ix, known, 0).collect()}


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "en", "s", 0)], DOCS), spark.createDataFrame([], ITEMS)
    assert [tuple(r) for r in decontamination.contaminated(docs, items).collect()] == [(1, 2, 0, 0, [], False)]
    assert decontamination.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b")], ITEMS)).count() == 0


# --- clustering ------------------------------------------------------------------------------------


def brute_lloyd(rows, k, rounds, scale, seed, dimensions):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(scale * float(x)) for x in v]))
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)].append(v)
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else centroids[c] for c in range(len(centroids))]
    found = [(i, nearest(v), far(v, centroids[nearest(v)])) for i, v in kept]
    each = Counter()
    for _, c, d in found:
        each[c] += d
    name = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return Counter((i, c, d, each[c], sum(each.values()), name(c)) for i, c, d in found)


def vectors(seed, dimensions, n):
    rng = random.Random(seed)
    middles = [[rng.uniform(-2, 2) for _ in range(dimensions)] for _ in range(5)]
    rows = [(k, [x + rng.gauss(0, 0.3) for x in rng.choice(middles)]) for k in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * (dimensions - 1)), (n + 3, [float("nan")] * dimensions), (n + 4, [float("inf")] * dimensions), (n + 5, [None] * dimensions), (n + 6, [0.0] * dimensions), (None, [-0.5] * dimensions)]
    return rows + rows[:7] + [(k, rows[0][1]) for k in range(n + 10, n + 60)] + [(0, [1.0] * dimensions)]


@pytest.mark.parametrize(("dimensions", "n", "k"), [(3, 900, 8), (64, 300, 8), (1, 400, 3), (2, 3, 8)])
def test_clusters_against_brute_force(spark, dimensions, n, k, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 128)
    rows = vectors(dimensions, dimensions, n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("v", "ids", "points", "cluster", "distance", "part", "total")})
    got = clustering.cluster(df.repartition(5), k=k, rounds=6, dimensions=dimensions)
    assert Counter(map(tuple, got.collect())) == brute_lloyd(rows, k, 6, 1024, "3", dimensions)


def test_whole_nodes_are_assigned_and_leaves_are_exact():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.integers(-5, 5, (256, 4)) + c for c in (0, 1_000, 5_000, 9_000)]).astype(np.int64)
    tree = clustering.Tree(points)
    centroids = np.array([[0] * 4, [1_000] * 4, [5_000] * 4, [9_000] * 4, [0] * 4], np.int64)
    whole = [(level, len(nodes)) for level, nodes, _ in tree.filtered(centroids[:4])]
    assert -1 not in [level for level, _ in whole] and sum(n for _, n in whole) < 40  # no vector was looked at
    far = ((tree.points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (tree.assigned(centroids) == far.argmin(axis=1)).all()  # of equal centroids the first
    counts, sums = tree.totals(centroids)
    assert counts.tolist() == np.bincount(far.argmin(axis=1), minlength=5).tolist() and (sums.sum(axis=0) == points.sum(axis=0)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-4, 4)] * 2), min_size=1, max_size=120), st.lists(st.tuples(*[st.integers(-4, 4)] * 2), min_size=1, max_size=6))
def test_filtering_breaks_ties_as_brute_force(points, centroids):
    points, centroids = np.array(points, np.int64), np.array(centroids, np.int64)
    tree = clustering.Tree(points)
    assert (tree.assigned(centroids) == ((tree.points[:, None] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_clustering_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert clustering.cluster(spark.createDataFrame([], schema)).count() == 0
    assert clustering.cluster(spark.createDataFrame([(None, [0.0] * 64)], schema)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        clustering.cluster(spark.createDataFrame([(1, [1e9] * 64)], schema)).count()


# --- spelling --------------------------------------------------------------------------------------

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_counts(rows, least=7, count=2, every=31):
    found = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= count}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= 10 * counts[w]}
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None)
    return out


def misspelt(seed):
    rng = random.Random(seed)
    stems = ["internation", "spelling", "Ähnliche", "ñandúes", "aaaaaaa", "abababab"]
    words_ = [s + e for s in stems for e in ("", "al", "als", "ally", "é")]

    def typo(w):
        k, c = rng.randrange(len(w)), rng.choice("aeénx")
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])

    weights = [1 + 400 // (k + 1) ** 2 for k in range(len(words_))]
    text = lambda: " ".join(w if rng.random() < 0.9 else typo(w) for w in rng.choices(words_, weights, k=80))
    rows = [(rng.choice([k, k, None]), rng.choice([text(), text().upper(), text().replace(" ", "_1")])) for k in range(150)]
    return rows + [(1, None), (2, ""), (3, "short x"), (4, "y" * 3_000 + " " + "y" * 2_999), (5, "y" * 3_000), (6, "y" * 2_999)] + rows[:3]


def test_variants_against_brute_force(spark):
    rows = misspelt(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "key", "rest", "form", "root")})
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df.repartition(4)).collect()}
    want = brute_variants(brute_counts(rows))
    assert got == want and sum(v[0] is not None for v in want.values()) > 20 and any(v[1] != (v[0] or w) for w, v in want.items() if v[0])


@pytest.mark.parametrize("few", [1, 4, 32])
def test_near_words_in_large_buckets(spark, few):
    """Words with one long common half: their bucket is cut until it is small, and no pair is lost."""
    rng = random.Random(few)
    words_ = {"commonprefix" + "".join(rng.choice("abc") for _ in range(rng.randint(4, 7))) for _ in range(400)} | {"".join(rng.choice("ab") for _ in range(rng.randint(4, 6))) + "commonending" for _ in range(200)}
    words_ |= {"commonpre" + c + "fix" for c in "abcdefghé"}
    df = spark.createDataFrame([(w,) for w in words_], "word string").repartition(3)
    got = sorted(tuple(sorted((r["a"], r["b"]))) for r in spelling.near_words(df, few).collect())
    ordered = sorted(words_)
    assert got == sorted((a, b) for k, a in enumerate(ordered) for b in ordered[k + 1 :] if one_apart(a, b))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.text("abzé", min_size=7, max_size=12))
def test_dropped_letters(doc_id, run):
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    assert spelling.dropped(str(doc_id), run, 31) == (run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :])


def test_spelling_of_odd_tables_and_long_texts(spark, monkeypatch):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    monkeypatch.setattr(spelling, "PIECE", 50)  # a text is searched in pieces, runs stay whole
    monkeypatch.setattr(spelling, "HELD", 3)
    rows = [(1, "abcdefghij " * 40 + "z" * 200 + " klmnopqrst" * 30), (2, "z" * 200)]
    got = {r["word"]: r["n"] for r in spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_counts(rows)


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_clustering", "op13_spelling"])
def test_queries_against_sql(spark, name):
    db, folder = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "benchmark", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, folder), db.sql(queries.ORACLE_SQL[name])
    got = Counter(tuple(r[c] for c in want.columns) for r in df.collect())
    assert sorted(df.columns) == sorted(want.columns) and got == Counter(want.fetchall()) and got
