"""Benchmark decontamination: a positional inverted index, met from the rarest words of the test items.

1. Words of the items form a vocabulary. The index holds a posting (row, term, pos) for each word of a document that is
   in it, and one posting of the term END at the end of each document, which carries its id and its number of words.
2. Every window of an item names its two rarest terms, by the postings that the index has. The lists of these two are
   intersected by position, the second's moved by the gap between them. What is left are alignments of an item with a
   document.
3. Along these alignments all other terms are looked up in the index; runs of them that fill a window are phrase
   matches. With a slop, each term may stand that far from its place: proximity matches.

Two windows that need the same pair of terms at the same gap share the intersection; equal items are matched once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import key_join, materialize

WINDOW = 10
#: What stands between words: ASCII characters other than letters and digits.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The term of the posting that ends each document.
END = -1


def _parts(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def _low(word: Column) -> Column:
    """Only A-Z fall; ``lower`` does just that to a word of ASCII and is the faster."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _UPPER.lower()))


@dataclass(frozen=True)
class Items:
    """Test items as tables: names (item, item_id), terms (item, n, span, p, word, term), vocabulary (term, word).

    An item here is a distinct text; span is the length of its windows.
    """

    names: DataFrame
    terms: DataFrame
    vocabulary: DataFrame


def read_items(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> Items:
    """Texts that are null or have no word are in no table; rows without an id are matched, but have no name."""
    split = items.select(F.col(item_id).alias("item_id"), F.transform(_parts(F.col(text)), _low).alias("words")).where(F.size("words") > 0)
    split = materialize(split, "leak-items")
    texts = materialize(split.select("words").distinct().select(F.monotonically_increasing_id().alias("item"), "words"), "leak-texts")
    names = materialize(split.join(texts, "words").select("item", "item_id").where("item_id IS NOT NULL").distinct(), "leak-names")
    words = texts.select("item", F.size("words").alias("n"), F.least(F.size("words"), F.lit(window)).alias("span"), F.posexplode("words").alias("p", "word"))
    vocabulary = materialize(words.select("word").distinct().select(F.monotonically_increasing_id().alias("term"), "word"), "leak-vocabulary")
    return Items(names, materialize(words.join(vocabulary, "word"), "leak-terms"), vocabulary)


def index(docs: DataFrame, vocabulary: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (row, term, pos, doc_id) of the vocabulary's words, and END for each document (pos: its number of words).

    row numbers the rows of ``docs``; only END carries doc_id. The table is written, so that all readers see one numbering.
    """
    ends = vocabulary.sparkSession.range(1).select(F.lit(END).cast("long").alias("term"), F.lit("").alias("word"))
    vocabulary = materialize(vocabulary.union(ends), "leak-words")
    # rows are numbered in a step of their own: beside posexplode, its rows would be numbered
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), _parts(F.col(text)).alias("parts"))
    tokens = rows.select("row", "doc_id", F.posexplode(F.array_append("parts", F.lit(""))).alias("pos", "word"))
    found = key_join(tokens.withColumn("word", _low(F.col("word"))), vocabulary, "word", "inner")
    return materialize(found.select("row", "term", "pos", F.when(F.col("term") == END, F.col("doc_id")).alias("doc_id")), "leak-index")


def _rarest(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(item, s, span, first, second): of each window that the corpus can hold, its two rarest terms as (n, p, term).

    In a window of one word the second is the first. Ties go to the earlier place.
    """
    counts = materialize(postings.groupBy("term").agg(F.count(F.lit(1)).alias("n_found")), "leak-counts")
    starts = F.sequence(F.greatest(F.lit(0), F.col("p") - F.col("span") + 1), F.least("p", F.col("n") - F.col("span")))
    places = terms.join(counts, "term", "left").select("item", "span", "p", "term", F.coalesce("n_found", F.lit(0)).alias("found"), F.explode(starts).alias("s"))
    ranked = places.groupBy("item", "s", "span").agg(F.array_sort(F.collect_list(F.struct("found", "p", "term"))).alias("by"))
    return ranked.select("item", "s", "span", F.get("by", F.lit(0)).alias("first"), F.coalesce(F.get("by", F.lit(1)), F.get("by", F.lit(0))).alias("second")).where("first.found > 0")


def alignments(index: DataFrame, items: Items, slop: int = 0) -> DataFrame:
    """(row, item, diagonal, lo, hi, span): where the two rarest terms of a window stand at their distance, give or take slop.

    The word p of the item would stand at diagonal + p; lo and hi are the first and last word of the windows concerned.
    """
    postings = index.where(F.col("term") != END).select("row", "term", "pos")
    pairs = _rarest(postings, items.terms).select("item", "s", "span", F.col("first.p").alias("p"), F.col("first.term").alias("term"), (F.col("second.p") - F.col("first.p")).alias("gap"), F.col("second.term").alias("other"))
    key = ["term", "gap", "other"]
    pairs = materialize(pairs.groupBy("item", "p", "span", *key).agg(F.min("s").alias("lo"), (F.max("s") + F.col("span") - 1).alias("hi")), "leak-pairs")
    rules = materialize(pairs.select(*key).distinct(), "leak-rules")
    others = materialize(rules.select(F.col("other").alias("term")).distinct(), "leak-others")
    firsts = key_join(postings, rules, "term", "inner").select("row", F.col("pos").alias("at"), F.col("term").alias("first"), "gap", F.col("other").alias("term"), (F.col("pos") + F.col("gap")).alias("pos"))
    if slop:
        firsts = firsts.withColumn("pos", F.explode(F.sequence(F.col("pos") - slop, F.col("pos") + slop)))
    seconds = key_join(postings, others, "term", "left_semi")
    met = firsts.join(seconds, ["row", "pos", "term"]).select("row", "at", F.col("first").alias("term"), "gap", F.col("term").alias("other"))
    found = key_join(met.distinct() if slop else met, pairs, key, "inner").select("row", "item", (F.col("at") - F.col("p")).alias("diagonal"), "lo", "hi", "span")
    return materialize(found.distinct(), "leak-alignments")


def _looked_up(index: DataFrame, items: Items, aligned: DataFrame, by: list[str], slop: int = 0) -> DataFrame:
    """(row, item, diagonal, span, p, …): words of the items that stand at their place of an alignment, give or take slop."""
    rows = materialize(aligned.select("row").distinct(), "leak-rows")
    postings = key_join(index.where(F.col("term") != END).select("row", "term", "pos"), rows, "row", "left_semi")
    wanted = aligned.select(*by, F.explode(F.sequence("lo", "hi")).alias("p")).distinct()
    wanted = key_join(wanted, items.terms.select("item", "p", "term"), ["item", "p"], "inner").withColumn("pos", F.col("diagonal") + F.col("p"))
    if slop:
        wanted = wanted.withColumn("pos", F.explode(F.sequence(F.col("pos") - slop, F.col("pos") + slop)))
    found = wanted.join(postings, ["row", "pos", "term"]).select(*by, "p", "pos")
    return found.drop("pos").distinct() if slop else found


def phrase_matches(index: DataFrame, items: Items) -> DataFrame:
    """(row, item, start, words, item_start): maximal runs of words that an item and a document share, of a window at least."""
    by = ["row", "item", "diagonal", "span"]
    found = _looked_up(index, items, alignments(index, items), by)
    run = F.col("p") - F.row_number().over(Window.partitionBy(*by).orderBy("p"))
    runs = found.withColumn("run", run).groupBy(*by, "run").agg(F.min("p").alias("item_start"), F.count(F.lit(1)).alias("words")).where(F.col("words") >= F.col("span"))
    return runs.select("row", "item", (F.col("diagonal") + F.col("item_start")).alias("start"), "words", "item_start")


def proximity_matches(index: DataFrame, items: Items, slop: int) -> DataFrame:
    """(row, item, item_start, start): windows of items whose words all stand within ``slop`` words of their places.

    Places are counted from the window's rarest word (ties: the earliest), wherever the document has it; start is where
    the window would begin. A slop of 0 gives each window of the phrase matches.
    """
    aligned = alignments(index, items, slop).withColumn("s", F.explode(F.sequence("lo", F.col("hi") - F.col("span") + 1)))
    windows = aligned.select("row", "item", "diagonal", "span", "s", F.col("s").alias("lo"), (F.col("s") + F.col("span") - 1).alias("hi"))
    by = ["row", "item", "diagonal", "span", "s"]
    full = _looked_up(index, items, windows, by, slop).groupBy(*by).agg(F.count(F.lit(1)).alias("words")).where(F.col("words") == F.col("span"))
    rarest = _rarest(index.where(F.col("term") != END), items.terms).select("item", "s", F.col("first.p").alias("p"), F.col("first.term").alias("term"))
    # the rarest word itself stands where the alignment has it
    anchored = full.join(rarest, ["item", "s"]).withColumn("pos", F.col("diagonal") + F.col("p")).join(index.select("row", "term", "pos"), ["row", "term", "pos"], "left_semi")
    return anchored.select("row", "item", F.col("s").alias("item_start"), (F.col("diagonal") + F.col("s")).alias("start"))


def documents(index: DataFrame) -> DataFrame:
    """(row, doc_id, n_words): the documents of an index."""
    return index.where(F.col("term") == END).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items (ids as strings, sorted), contaminated.

    docs: doc_id, text; items: item_id, text; other columns don't matter. A word is hit if it lies in any occurrence of
    ``window`` consecutive words of an item, or of the whole of a shorter one. Null, empty and wordless texts have no
    words and no windows. Items of one id count once; one without an id hits words, but isn't counted or listed. Repeated
    documents and those without an id are judged row by row; an empty table of documents gives no rows, one of items no hits.
    """
    known = read_items(items, window=window)
    postings = index(docs, known.vocabulary)
    found = materialize(phrase_matches(postings, known), "leak-matches")
    hit = found.select("row", F.explode(F.sequence("start", (F.col("start") + F.col("words") - 1).cast("int"))).alias("pos")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    named = key_join(found.select("row", "item").distinct(), known.names, "item", "inner").select("row", F.col("item_id").cast("string").alias("item_id"))
    listed = named.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hit = materialize(hit.join(listed, "row", "left"), "leak-hits")
    out = key_join(documents(postings), hit, "row", "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("items"), (n_hit > 0).alias("contaminated"))
