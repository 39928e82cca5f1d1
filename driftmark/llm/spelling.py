"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

1. Runs of letters are counted by word in the tasks and added up by Spark.
2. Each word is indexed under its two halves, with its length. Of a word and another of the same length that are one
   replacement apart, one half is equal at its place; of a word and one that is one longer, one half is equal at its place
   or moved by one. So every word probes with its own halves and with those that a word one shorter would have in it.
3. What shares a segment and is a bucket of few is compared. A larger bucket is cut again: all of it agree in the segment,
   so the one edit lies in the rest, one half of which is equal once more. No bucket is compared as a whole before its rest
   is down to one letter, when no more words than letters can share it.
4. Pairs that are one edit apart count once, whatever segments they share.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, key_join, materialize

LEAST_LENGTH, LEAST_COUNT, TIMES, DROP_EVERY = 7, 2, 10, 31
#: Words that share a segment and are compared without another cut.
FEW = 32
#: Words that a task counts before it hands them on, and characters of a text that are searched at a time.
HELD, PIECE = 200_000, 1 << 20

_LETTERS = "A-Za-zÀ-ÿ"
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def dropped(doc_id: str, run: str, every: int) -> str:
    """The run, or for one in ``every`` (document, run) the run without a letter that their hash names."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counted(least: int, every: int):
    runs, gap = re.compile(f"[{_LETTERS}]{{{least},}}"), re.compile(f"[^{_LETTERS}]")

    def spelt(text: str) -> Counter:
        found, at = Counter(), 0
        while at < len(text):
            cut = gap.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            found.update(runs.findall(text, at, end))
            at = end
        return found

    def batch(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for run, n in spelt(text).items():
                    word = dropped(doc_id, run.lower() if run.isascii() else run.translate(_LOWER), every)
                    if len(word) >= least:
                        found[word] += n
                if len(found) > HELD:
                    yield batch(found)
                    found = Counter()
        yield batch(found)

    return counted


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, count: int = LEAST_COUNT, every: int = DROP_EVERY) -> DataFrame:
    """(word, n): words of at least so many letters that occur so often, over the whole texts.

    Only A-Z are lower-cased. A document without an id goes by an empty one; null texts have no words.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    with bounded_batches(docs.sparkSession):
        found = rows.mapInArrow(_counted(least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)
        return materialize(found, "spelling-words")


def _cuts(key: Column, part: Column, longer: bool) -> Column:
    """The two ways to go on with a part: (key, rest) by its first half, and by its second half.

    For a part one letter longer than the one it is compared with, halves are those of the shorter: the second one
    begins a letter later.
    """
    size = F.length(part) - (1 if longer else 0)
    half = F.floor(size / 2).cast("int")
    second = half + (1 if longer else 0)
    head, tail = F.substring(part, F.lit(1), half), F.substring(part, second + 1, size - half)
    cut = lambda side, same, rest: F.struct(F.xxhash64(key, size, F.lit(side), same).alias("key"), rest.alias("rest"))
    return F.array(cut(0, head, F.substring(part, half + 1, F.length(part) - half)), cut(1, tail, F.substring(part, F.lit(1), second)))


def _entries(words: DataFrame) -> DataFrame:
    """(key, rest, longer, word): the segments of each word as indexed, and those it probes words one shorter with."""
    cut = lambda longer: F.struct(F.lit(longer).alias("longer"), _cuts(F.lit(0).cast("long"), F.col("word"), longer).alias("cuts"))
    ways = words.select("word", F.explode(F.array(cut(False), cut(True))).alias("w"))
    return ways.select("word", "w.longer", F.explode("w.cuts").alias("e")).select("e.key", "e.rest", "longer", "word")


def _again(entries: DataFrame) -> DataFrame:
    """The entries of large buckets under the next two segments."""
    way = lambda longer: _cuts(F.col("key"), F.col("rest"), longer)
    cut = entries.select("longer", "word", F.explode(F.when(F.col("longer"), way(True)).otherwise(way(False))).alias("e"))
    return cut.select("e.key", "e.rest", "longer", "word")


def near_words(words: DataFrame, few: int = FEW) -> DataFrame:
    """(a, b): all pairs of words that are exactly one inserted, deleted or replaced letter apart, each once.

    words: word, distinct. At every size all pairs are found; ``few`` only says when a bucket is cut again.
    """
    rest, done = materialize(_entries(words), "spelling-entries"), None
    while True:
        left = F.length("rest") - F.col("longer").cast("int")
        size = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_or(~F.col("longer")).alias("indexed"), F.max(left).alias("left"))
        size = materialize(size.where("indexed AND n > 1").select("key", ((F.col("n") > few) & (F.col("left") > 1)).alias("large")), "spelling-buckets")
        sized = materialize(key_join(rest, size, "key", "inner"), "spelling-sized")
        small = sized.where("NOT large").drop("large")
        done = small if done is None else done.unionByName(small)
        if not size.where("large").limit(1).count():
            break
        rest = materialize(_again(sized.where("large")), "spelling-cut")
    a, b = done.where("NOT longer").select("key", F.col("word").alias("a")), done.select("key", F.col("word").alias("b"), "longer")
    pairs = a.join(b, "key").where("longer OR a < b")
    return materialize(pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct(), "spelling-pairs")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of (word, form); counts rise along a chain, so it has one. Each pass doubles the steps."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(key_join(now, materialize(ahead, "spelling-ahead"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-moved")
        if not moved.where("moved").limit(1).count():
            return now
        now = moved.drop("moved")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", times: int = TIMES) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    form is the most frequent word one edit away (ties: the smallest by code points) if it occurs at least ``times`` as
    often, root the end of the chain of forms (the word itself without one). Null and empty texts have no words; a document
    without an id goes by an empty one; repeated rows count each; other columns don't matter. An empty table gives no rows.
    """
    words = word_counts(docs, doc_id, text)
    pairs = near_words(words.select("word"))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    both = key_join(both, words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other", "inner")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    named = words.join(near, "word", "left").withColumn("found", F.coalesce(-F.col("best.less") >= times * F.col("n"), F.lit(False)))
    named = named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("found"), F.col("best.other")).alias("form"), F.when(F.col("found"), -F.col("best.less")).alias("form_n"))
    named = materialize(named, "spelling-forms")
    ends = roots(named.where("form IS NOT NULL"))
    return key_join(named, ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
