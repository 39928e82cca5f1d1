"""Language identification in two levels: first the family, then one language of it.

Both levels are one-versus-one linear support vector machines over hashed byte trigrams of the
lower-cased letters of the whole text. Margins become probabilities by Platt scaling
on documents apart from those that set the weights, and pairs of them by coupling.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, held_out, materialize

#: Hashed features; documents of each language, and of all languages together, that are learned from, about.
DIMENSIONS, PER_LANGUAGE, SAMPLE_ROWS = 4_096, 600, 12_000
#: Languages that are learned, at most: those of most documents.
LANGUAGES = 200
UNDETERMINED = "und"
#: Least score of a document that a filtering stage keeps.
LEAST_SCORE = 0.3
#: Families by language code; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tt",
    "indo-aryan": "hi ur bn pa mr gu ne",
    "semitic": "ar he am mt",
    "celtic": "ga gd cy br",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_NO_LETTERS = re.compile(r"[\W\d_]+")


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0], lang)


def features(text: str | None) -> np.ndarray | None:
    """Square roots of trigram counts, of length 1; None if the text has no letter."""
    letters = _NO_LETTERS.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, letters)):  # superscripts, fractions and circled numbers pass the pattern but are no letters
        return None
    b = np.frombuffer(f"  {letters}  ".encode(), np.uint8).astype(np.uint32)
    codes = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    slots = (codes * np.uint32(2654435761)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
    x = np.sqrt(np.bincount(slots, minlength=DIMENSIONS).astype(np.float32))
    return x / np.linalg.norm(x)


@dataclass
class Machine:
    """A linear machine that is positive for ``a``, with its Platt scaling."""

    a: str
    b: str
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


@dataclass
class Choice:
    """Machines for all pairs of ``names``."""

    names: list[str]
    machines: list[Machine] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each name, for each row of x: products of the pairs' probabilities, normalised."""
        logs = np.zeros((len(x), len(self.names)))
        every = np.stack([m.weights for m in self.machines], axis=1) if self.machines else np.zeros((x.shape[1] + 1, 0), np.float32)
        # a product for each row: what it gives doesn't depend on the rows beside it
        margins = np.array([row @ every[:-1] for row in x]).reshape(len(x), -1) + every[-1]
        for m, margin in zip(self.machines, margins.T, strict=True):
            margin = m.slope * margin + m.shift
            logs[:, self.names.index(m.a)] -= np.logaddexp(0, -margin)
            logs[:, self.names.index(m.b)] -= np.logaddexp(0, margin)
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


@dataclass
class Model:
    families: Choice
    members: dict[str, Choice]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        top = self.families.probabilities(x)
        best, score = top.argmax(axis=1), top.max(axis=1)
        names = [""] * len(x)
        for k, family in enumerate(self.families.names):
            rows = np.flatnonzero(best == k)
            if not len(rows):
                continue
            inner = self.members[family].probabilities(x[rows])
            score[rows] *= inner.max(axis=1)
            for row, j in zip(rows, inner.argmax(axis=1), strict=True):
                names[row] = self.members[family].names[j]
        return names, score


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, steps: int = 150) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine: squared hinge loss, accelerated gradient steps, classes weighing the same."""
    up, down = y > 0, y < 0
    share = (cost * (up * 0.5 / max(1, up.sum()) + down * 0.5 / max(1, down.sum()))).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = np.float32(1.0 / (1.0 + 2.0 * cost * 2.0))  # rows have length sqrt(2) at most
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (v - 2 * ((share * y * slack) @ x))
        v, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w


def _platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve of y over the margin, by Newton steps with smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, w = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (p - goal) + 1e-3 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(curve, slope)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def _choice(x: np.ndarray, names: np.ndarray) -> Choice:
    """Machines for all pairs of the names; rows named None belong to none. The last column of x is 1."""
    out = Choice(sorted({v for v in names if v is not None}))
    of = {v: np.flatnonzero(names == v) for v in out.names}
    for a, b in itertools.combinations(out.names, 2):
        mine = np.sort(np.concatenate([of[a], of[b]]))  # only the rows of the pair are copied
        y = np.where(names[mine] == a, 1, -1).astype(np.float32)
        rest = np.zeros(len(y), bool)
        rest[3::4] = True
        learn = ~rest
        if len(set(y[learn])) < 2 or len(set(y[rest])) < 2:
            learn = rest = np.ones(len(y), bool)
        w = _svm(x[mine[learn]], y[learn])
        out.machines.append(Machine(a, b, w, *_platt(x[mine[rest]] @ w, y[rest])))
    return out


def train(x: np.ndarray, langs: np.ndarray) -> Model:
    """Both levels, from rows of features, with a last column of 1, and their languages."""
    families = np.array([family_of(v) for v in langs], dtype=object)
    return Model(_choice(x, families), {f: _choice(x, np.where(families == f, langs, None)) for f in sorted(set(families))})


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [features(t) for t in b.column("text").to_pylist()]
        kept = [k for k, x in enumerate(found) if x is not None]
        yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(kept, pa.int64())), pa.array([found[k].astype(np.float16).tobytes() for k in kept], pa.binary())], ["lang", "x"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS, languages: int = LANGUAGES) -> Model | None:
    """Learn from about ``per_language`` documents of each language, none of them held out; None if there are none.

    The ``languages`` of most documents are learned (ties: by code), and all together give about ``sample_rows`` documents:
    that bounds what the driver holds (16 KB a document), whatever the size of ``docs`` and however many codes it has. The
    sample is that of small hashes of id and text; equal rows teach once. So the model depends on the rows alone, not on
    how they are partitioned. Rows without a language, a text or an id teach nothing.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return None
    grain, each = 1 << 30, max(1, min(per_language, sample_rows // len(counts)))
    limit = F.element_at(F.create_map(*itertools.chain(*((F.lit(k), F.lit(min(grain, -(-grain * each // n)))) for k, n in sorted(counts.items())))), F.col("lang"))
    mark = [F.xxhash64("doc_id", "text").alias("_h"), F.xxhash64(F.lit(1), "text", "doc_id").alias("_g")]
    chosen = known.select("lang", "text", *mark).where(F.pmod("_h", F.lit(grain)) < limit).groupBy("lang", "_h", "_g").agg(F.first("text").alias("text"))
    with bounded_batches(docs.sparkSession):
        sample = materialize(chosen.select("lang", "text").mapInArrow(_vectors, "lang string, x binary"), "lang-sample")
    rows = sample.orderBy("lang", F.xxhash64("x")).collect()
    if not rows:
        return None
    x = np.ones((len(rows), DIMENSIONS + 1), np.float32)
    for k, r in enumerate(rows):
        x[k, :-1] = np.frombuffer(r["x"], np.float16)
    langs = np.array([r["lang"] for r in rows], dtype=object)
    del rows
    return train(x, langs)


def _predict_all(texts: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray]:
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    for at in range(0, len(texts) if model else 0, 256):
        found = [features(t) for t in texts.slice(at, 256).to_pylist()]
        rows = [k for k, x in enumerate(found) if x is not None]
        if rows:
            some, score = model.predict(np.stack([found[k] for k in rows]))
            for k, name, s in zip(rows, some, score, strict=True):
                names[at + k], scores[at + k] = name, s
    return names, scores


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, lang_pred, score (0 to 1), from the text alone.

    Null texts and texts without a letter (of Unicode's categories L) are ``und`` with score 0.0, as is all without a
    model. Repeated rows and ids are judged row by row; an empty table gives an empty result.
    """

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = _predict_all(b.column("text"), model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(predicted, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None, least: float = LEAST_SCORE, text: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a learned language with a score of ``least`` or more.

    Rows are judged where they are; nothing is shuffled. Without a model all rows go.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = _predict_all(b.column(text), model)
            yield b.filter(pa.array([name != UNDETERMINED and s >= least for name, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
