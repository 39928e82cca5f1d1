"""Rows at given ranks of large groups, without sorting or holding a group.

A rank is found digit by digit: rows are counted by group and leading 16 bits, the digit that holds the rank is kept, and
the next round counts the next 16 bits of what begins with it. A task hands on counts, 65 536 for a group at most, so
a group of any size costs four rounds of counting for each order column, and nothing is ever sorted or shuffled but counts:
what each round looks for is a table of its own, which goes to the rows where it is small, and meets their counts otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.functions.checks import upper_median
from driftmark.operators import rollups
from driftmark.sources import tables

#: Ranks that are broadcast, at most.
BROADCAST_RANKS = 200_000
#: Rows, or different values, of a group that one task may hold.
FEW = 1_000_000
_DIGIT, _PER_COLUMN = 16, 4
#: A first digit below all others.
_NULL = -(1 << _DIGIT)


def _digits(column: str) -> list[Column]:
    """A long as four digits that order as it does; null comes first."""
    v = F.col(column).cast("long")
    low = [F.shiftright(v, _DIGIT * k).bitwiseAND(F.lit((1 << _DIGIT) - 1)) for k in reversed(range(_PER_COLUMN - 1))]
    return [F.coalesce(F.shiftright(v, _DIGIT * (_PER_COLUMN - 1)), F.lit(_NULL).cast("long")), *(F.coalesce(d, F.lit(0).cast("long")) for d in low)]


def _number(digits: list[Column]) -> Column:
    value = digits[0]
    for d in digits[1:]:
        value = F.shiftleft(value, _DIGIT).bitwiseOR(d)
    return F.when(digits[0] != _NULL, value)


def at_ranks(rows: DataFrame, key: list[str], order: list[str], ranks: DataFrame) -> DataFrame:
    """(key, rank, order columns, tie): the values at each rank (from 0) of its group, and the rank among rows of equal values.

    order: columns that cast to long; nulls come first. ranks: key, rank; ranks outside their group have no row. key columns
    aren't null.
    """
    names = [f"_d{k}" for k in range(_PER_COLUMN * len(order))]
    data = rows.select(*key, *[d.alias(n) for d, n in zip((d for c in order for d in _digits(c)), names, strict=True)])
    targets = tables.written(ranks.select(*key, "rank", F.col("rank").cast("long").alias("_left")), "ranks")
    small = targets.count() <= BROADCAST_RANKS
    for n, digit in enumerate(names):
        known = [*key, *names[:n]]
        held = data.select(*known, digit)
        if small:
            held = held.join(F.broadcast(targets.select(*known).distinct()), known, "left_semi")
        counts = held.groupBy(*known, digit).agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*known).orderBy(digit)))
        found = counts.join(F.broadcast(targets) if small else targets, known).where((F.col("_left") >= F.col("_upto") - F.col("_n")) & (F.col("_left") < F.col("_upto")))
        targets = tables.written(found.select(*known, digit, "rank", (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left")), "ranks")
    values = [_number([F.col(n) for n in names[_PER_COLUMN * k : _PER_COLUMN * (k + 1)]]).alias(c) for k, c in enumerate(order)]
    return targets.select(*key, "rank", *values, F.col("_left").alias("tie"))


def upper_medians(rows: DataFrame, key: str, value: str, few: int = FEW) -> DataFrame:
    """(key, median): sorted[n / 2] of a value that casts to long; nulls don't count, a group without any has 0.

    Where every group has about ``few`` different values at most, which is asked first, Spark's percentile counts them in one pass.
    """
    if _at_most(rows.groupBy(key).agg(F.approx_count_distinct(value).alias("n")), few):
        return rows.groupBy(key).agg(upper_median(value).alias("median"))
    sizes = rows.groupBy(key).agg(F.count(value).alias("n"))
    found = at_ranks(rows.where(F.col(value).isNotNull()), [key], [value], sizes.select(key, F.floor(F.col("n") / 2).alias("rank")))
    return sizes.join(found, key, "left").select(key, F.coalesce(value, F.lit(0).cast("long")).alias("median"))


def run_totals(outcomes: DataFrame, few: int = FEW) -> DataFrame:
    """Bytes in and out, and the upper median input of shipped files; emitted sources and derived files don't count."""
    own = outcomes.where(~F.col("emitted") & ~F.col("derived"))
    shipped = own.where("decision = 'shipped'").select(F.lit(1).alias("run"), "bytes_in", "bytes_out")
    zero = F.lit(0).cast("long")
    sums = shipped.agg(F.lit(1).alias("run"), *[F.coalesce(F.sum(c), zero).alias(c) for c in ("bytes_in", "bytes_out")])
    found = sums.join(upper_medians(shipped, "run", "bytes_in", few), "run", "left")
    return found.select("bytes_in", "bytes_out", F.coalesce("median", zero).alias("median_in"))


def spread(rows: DataFrame, key: str, order: list[str], n: int = 5, few: int = FEW) -> DataFrame:
    """Up to ``n`` rows of each group, evenly spread along the order, both ends kept; order columns cast to long.

    Rows of equal order are told apart by a hash of all their columns, equal ones by nothing. Groups of ``few`` rows at most
    are numbered as they are.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if _at_most(sizes, few):
        return rollups.spread_sample(rows, key, order, n)
    sizes = sizes.withColumnRenamed("n", "_n")
    place = lambda i: F.when(F.col("_n") <= n, i.cast("long")).otherwise(F.floor(i * (F.col("_n") - 1) / max(1, n - 1)))
    ranks = sizes.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(n), F.col("_n").cast("int")) - 1), place)).alias("rank"))
    found = at_ranks(rows, [key], order, ranks).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_v{k}") for k, c in enumerate(order)], "tie")
    same = rows[key] == F.col("_key")
    for k, c in enumerate(order):
        same = same & rows[c].cast("long").eqNullSafe(F.col(f"_v{k}"))
    ties = found.groupBy("_key", *[f"_v{k}" for k in range(len(order))]).agg(F.collect_set("tie").alias("_ties"))
    # only rows that are equal in key and order meet here
    among = Window.partitionBy(key, *order).orderBy(F.xxhash64(*rows.columns))
    some = rows.join(ties, same).withColumn("_tie", (F.row_number().over(among) - 1).cast("long"))
    return some.where(F.array_contains("_ties", F.col("_tie"))).select(*rows.columns)


def _at_most(sizes: DataFrame, few: int) -> bool:
    return (sizes.agg(F.max("n")).first()[0] or 0) <= few
