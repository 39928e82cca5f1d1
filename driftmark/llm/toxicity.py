"""Toxicity by maximum-scoring segments over token log-odds.

Tokens are a text's words and their beginnings, so that unseen endings of a known word count too.
Log-odds of toxic against clean documents are shrunk by a Dirichlet prior. Along a text, words score their
log-odds, neutral words a little below zero; one linear scan finds every maximal scoring
segment. Under the clean texts' score distribution such maxima follow an extreme-value law with parameters
lambda and K; a document's significant segments add up to a statistic that a logistic curve turns into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_out, materialize

#: Labelled documents that are learned from, at most: toxic, clean.
TOXIC_ROWS, CLEAN_ROWS = 4_000, 8_000
#: Pseudo-documents of the prior, as a share of the sample; a token has its part of them by how often it occurs.
PRIOR = 0.1
NEUTRAL, LOWEST = -0.35, -1.5
#: Least cautious log-odds of a toxic token: seven times as likely in toxic texts.
CLEAR = 2.0
#: Log-odds in standard deviations from which a token counts; what stands out by chance is mostly below CLEAR anyway.
LEAST_Z = 2.2
PREFIXES = (4, 5)
THRESHOLD = 0.3
REMEMBERED = 500_000
_WORD = re.compile(r"[^\W\d_]+")


def tokens_of(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]


def segments(scores: list[float], positions: list[int]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last position, score) of a sequence given by its non-neutral scores.

    Words between the given positions score NEUTRAL. Ruzzo and Tompa's scan: each new run joins
    earlier ones as long as the whole scores more than its parts; every run is joined once.
    """
    runs: list[list] = []  # first, last, sum before, sum after
    total, last = 0.0, -1
    for s, at in zip(scores, positions, strict=True):
        total += NEUTRAL * (at - last - 1)
        before, total, last = total, total + s, at
        if s <= 0:
            continue
        new = [at, at, before, total]
        while True:
            k = len(runs) - 1
            while k >= 0 and runs[k][2] >= new[2]:
                k = runs[k][4]  # the nearest run further left that begins lower
            if k < 0 or runs[k][3] >= new[3]:
                runs.append([*new, k])
                break
            new = [runs[k][0], new[1], runs[k][2], new[3]]
            del runs[k:]
    return [(a, b, high - low) for a, b, low, high, _ in runs]


@dataclass
class Model:
    weights: dict[str, float]  # score of each token of the model
    certainty: dict[str, float]
    decay: float = 1.0  # lambda
    k: float = 0.1
    slope: float = 1.0
    shift: float = -3.0

    def word_score(self, word: str) -> float:
        known = [t for t in tokens_of(word) if t in self.weights]
        return self.weights[max(known, key=lambda t: (self.certainty[t], t))] if known else NEUTRAL

    def scan(self, text: str | None, memo: dict) -> tuple[int, list[tuple[int, int, float]], Counter]:
        """Words, maximal segments and a count of the scores of a whole text."""
        words = _WORD.findall((text or "").lower())
        found = [memo[w] for w in words]
        at = [k for k, s in enumerate(found) if s != NEUTRAL]
        some = [found[k] for k in at]
        return len(words), segments(some, at), Counter(some)

    def statistic(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Sum of the normalised scores of the segments that fewer than one of would be expected in a clean text of n words."""
        floor = math.log(max(self.k * n, 1e-6))
        return sum(max(0.0, self.decay * s - floor) for _, _, s in found)

    def probability(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.shift + self.slope * math.log1p(x)))))


class _Scores(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        s = self[word] = self.model.word_score(word)
        return s


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each token, by label."""
    toxic, clean = Counter(), Counter()
    flush = lambda: pa.RecordBatch.from_pydict({"token": list(both := toxic.keys() | clean.keys()), "toxic": [toxic[t] for t in both], "clean": [clean[t] for t in both]}, pa.schema([("token", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]))
    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            (toxic if label else clean).update({t for w in set(_WORD.findall(text.lower())) for t in tokens_of(w)})
            if len(toxic) + len(clean) > 500_000:
                yield flush()
                toxic.clear(), clean.clear()
    yield flush()


def _log_odds(counts: DataFrame, n_toxic: int, n_clean: int) -> dict[str, tuple[float, float]]:
    """Score and certainty of the tokens that stand out, computed in Spark; the bounded sample bounds how many there are."""
    prior, all_prior = PRIOR * (F.col("toxic") + F.col("clean")), PRIOR * (n_toxic + n_clean)
    odds = lambda y, n: F.log((F.col(y) + prior) / (F.lit(n + all_prior + 1.0) - F.col(y) - prior))
    spread = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    scored = counts.select("token", (odds("toxic", n_toxic) - odds("clean", n_clean)).alias("d"), spread.alias("sd")).withColumn("z", F.abs(F.col("d") / F.col("sd")))
    rows = scored.where((F.col("z") >= LEAST_Z) & ((F.col("d") < 0) | (F.col("d") - F.col("sd") >= CLEAR))).orderBy("token").collect()
    # the cautious end of the interval for what is toxic; what is clean counts against, but not without bound
    return {r["token"]: (r["d"] - r["sd"] if r["d"] > 0 else max(LOWEST, r["d"]), r["z"]) for r in rows}


def _decay(scores: Counter, n: int) -> float:
    """The positive root of E[exp(lambda * s)] = 1 under the clean scores; n counts all words, the rest being neutral."""
    scores = scores + Counter()
    s = np.array([*scores, NEUTRAL])
    p = np.array([*scores.values(), max(1, n - sum(scores.values()))], float)
    p /= p.sum()
    if s @ p >= 0 or not (s > 0).any():
        return 0.5
    low, high = 0.0, 1.0
    while p @ np.exp(np.minimum(high * s, 500)) < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(mid * s) < 1 else (low, mid)
    return high


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model | None:
    """Learn from at most ``toxic_rows`` and ``clean_rows`` labelled documents, none held out; None without both kinds.

    Equal texts, and texts that share the least three-word hashes under two seeds (most near copies do), teach once:
    else the chance words of a copied document would look like its label. Of repeated labels of an id the largest
    counts, of several texts of an id the one of the smallest hash. Rows without an id, a text or a label teach nothing.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda kind, n: usable.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, toxic_rows).unionByName(pick(0, clean_rows)).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            keys = []
            for t in b.column("text").to_pylist():
                w = t.encode().lower().split()
                grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
                keys.append(b"".join(min(xxhash.xxh3_64_digest(g, seed) for g in grams) for seed in (1, 2)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), b.column("toxic"), pa.array(keys, pa.binary())], ["doc_id", "text", "toxic", "key"])

    sample = texts.select("doc_id", "text", F.col("_toxic").cast("int").alias("toxic")).mapInArrow(keyed, "doc_id long, text string, toxic int, key binary")
    one = F.min_by(F.struct("key", "text", "toxic"), F.xxhash64("text"))
    sample = sample.groupBy("doc_id").agg(one.alias("r")).select("r.*")
    sample = sample.groupBy("key", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = materialize(sample.select("text", "toxic"), "toxic-sample")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return None
    counts = sample.mapInArrow(_presence, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = _log_odds(counts, n[1], n[0])
    model = Model({t: s for t, (s, _) in odds.items()}, {t: z for t, (_, z) in odds.items()})
    _calibrate(model, sample)
    return model


def _calibrate(model: Model, sample: DataFrame) -> None:
    """lambda and K from the clean texts of the sample, then the logistic curve from all of them."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Scores(model)
        for b in batches:
            out = []
            for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                n, found, seen = model.scan(text, memo)
                out.append({"toxic": label, "n": n, "found": [s for _, _, s in found], "scores": list(seen), "times": list(seen.values())})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("found", pa.list_(pa.float64())), ("scores", pa.list_(pa.float64())), ("times", pa.list_(pa.int64()))]))

    rows = sample.mapInArrow(scanned, "toxic int, n long, found array<double>, scores array<double>, times array<long>").collect()
    clean = [r for r in rows if not r["toxic"]]
    seen: Counter = Counter()
    for r in clean:
        seen.update(dict(zip(r["scores"], r["times"], strict=True)))
    words = sum(r["n"] for r in clean)
    model.decay = _decay(seen, words)
    high = sorted((s for r in clean for s in r["found"]), reverse=True)
    level = high[min(len(high) - 1, len(high) // 10)] if high else 1.0
    many = sum(s >= level for s in high) + 1
    model.k = min(1.0, max(1e-6, many / max(1, words) * math.exp(min(50.0, model.decay * level))))
    x = np.array([math.log1p(model.statistic(r["n"], [(0, 0, s) for s in r["found"]])) for r in rows])
    y = np.array([float(r["toxic"]) for r in rows])
    w = np.zeros(2)
    a = np.stack([np.ones_like(x), x], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        curve = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 0.05])
        w = w - np.linalg.solve(curve, a.T @ (p - y) + np.array([1e-3, 0.05]) * w)
    model.shift, model.slope = float(w[0]), float(max(0.0, w[1]))


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, score (0 to 1), predicted (1 from THRESHOLD on), n_passages, from the text alone.

    Null and empty texts score what a text without any segment does; without a model all score 0.0. Repeated rows and ids
    are scored row by row; an empty table gives an empty result.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Scores(model) if model else {}
        for b in batches:
            out, many = [], []
            for t in b.column("text").to_pylist():
                n, found, _ = model.scan(t, memo) if model else (0, [], None)
                out.append(model.probability(model.statistic(n, found)) if model else 0.0)
                many.append(sum(model.statistic(n, [f]) > 0 for f in found) if model else 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64()), pa.array([int(s >= THRESHOLD) for s in out], pa.int32()), pa.array(many, pa.int32())], ["doc_id", "score", "predicted", "n_passages"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scored, "doc_id long, score double, predicted int, n_passages int")


def passages(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every significant passage: doc_id, first_char, last_char (code points, end exclusive), passage, score, e_value.

    Null and empty texts have none. Repeated rows give their passages again.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Scores(model)
        for b in batches:
            out = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                n, found, _ = model.scan(t, memo)
                keep = [f for f in found if model.statistic(n, [f]) > 0]
                low = (t or "").lower()
                spans = [m.span() for m in _WORD.finditer(low)] if keep else []
                same = len(low) == len(t or "")  # lower case can be longer; then the passage is cut from it
                for first, last, s in keep:
                    a, z = spans[first][0], spans[last][1]
                    out.append({"doc_id": i, "first_char": a, "last_char": z, "passage": (t if same else low)[a:z], "score": s, "e_value": model.k * n * math.exp(-model.decay * s)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("first_char", pa.int64()), ("last_char", pa.int64()), ("passage", pa.string()), ("score", pa.float64()), ("e_value", pa.float64())]))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, "doc_id long, first_char long, last_char long, passage string, score double, e_value double")
