"""The corpus pipeline: quality rules, language ID, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on every document that the one before kept.
All but the last return the columns of ``documents``; each result is written as Parquet and read
again before the next, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm import language_id, mixing, near_dedup, packing, quality_rules
from driftmark.llm._common import key_join, materialize, read_table


#: Limit of the near-duplicate stage; op6's is 85.
NEAR_PERCENT = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list rejects, all columns.

    Null and empty texts go; repeated rows and rows without an id are judged row by row. Without labels the base rules
    decide alone. An empty table gives an empty result.
    """
    rules = quality_rules.learn_from_labels(docs, read_table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs.select(F.struct("*").alias("_row"), "text"), rules)
    return judged.where("_kept").select("_row.*")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, all columns; learned from those of ``docs`` that aren't held out.

    Texts that are null or have no letter go, and those of a score below 0.3. Repeated rows and rows without an id are
    judged row by row. Where nothing can be learned from, all go; an empty table gives an empty result.
    """
    return language_id.keep_identified(docs, language_id.fit(docs))


def with_row_keys(docs: DataFrame, label: str) -> DataFrame:
    """(_doc, _row): each row as a struct with a number of its own, which stays as both are written once."""
    return materialize(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")), label)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, linked from a similarity of 0.8 on, one row: of the smallest id, null last.

    Rows are documents, so repeated rows, rows of one id and rows without an id are linked by their texts like any other.
    Of rows of one id, that of the smallest hash of all columns stays. Null and wordless texts are linked with nothing and
    stay. An empty table gives an empty result.
    """
    rows = with_row_keys(docs, "stage-rows")
    found = near_dedup.near_duplicates(rows.select("_row", "_doc.text"), "_row", percent=NEAR_PERCENT, bands=near_dedup.LOOSE_BANDS)
    others = materialize(found.where("NOT kept").select(F.col("doc_id").alias("_row"), "component_id"), "stage-linked")
    linked = others.union(others.select("component_id", "component_id").distinct())
    linked = materialize(linked, "stage-groups")
    order = F.struct(F.col("_doc.doc_id").isNull(), F.col("_doc.doc_id"), F.xxhash64("_doc"), F.col("_row"))
    named = key_join(rows, linked, "_row", "inner").select("_row", "component_id", order.alias("order"))
    kept = materialize(named.groupBy("component_id").agg(F.min_by("_row", "order").alias("_row")).select("_row"), "stage-kept")
    dropped = materialize(key_join(linked.select("_row"), kept, "_row", "left_anti"), "stage-dropped")
    return key_join(rows, dropped, "_row", "left_anti").select("_doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, each by its own copies; one without an id goes by a hash of its columns.

    Null and empty texts have no words and go. The null source is one of its own, last. Repeated rows share the copies of
    their text among them. An empty table gives an empty result.
    """
    rows = with_row_keys(docs, "stage-rows")
    own = F.coalesce(F.col("_doc.doc_id").cast("string"), F.concat(F.lit("row "), F.xxhash64("_doc").cast("string")))
    sized = rows.select("_row", own.alias("doc_id"), F.col("_doc.text").alias("text"), F.col("_doc.source").alias("source"))
    copies = materialize(mixing.mix(sized, carry=["_row"]).where("copies > 0").select("_row", F.col("copies").alias("_copies")), "stage-copies")
    taken = key_join(rows, copies, "_row", "inner")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select("_doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in bins: doc_id, source, piece, start, size, bin, bin_room; copies of a text never share one.

    Null and empty texts give one piece of size 0; rows without an id are packed as rows of their own. An empty table
    gives an empty result.
    """
    return packing.pack(packing.document_items(docs)).withColumnRenamed("item", "doc_id")


STAGES = [
    ("quality rules", keep_good),
    ("language ID", keep_identified),
    ("near-duplicate removal", keep_one_of_each),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: Learned rules, hashing and bin packing are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
