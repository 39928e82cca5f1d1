"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document gets a rate r = min(cap, exp(lambda * z)), z being its size over its source's
mean size; lambda solves the convex dual of "stay as near as possible to one
copy in relative entropy, yet meet the source's words": sum(size * r) = target. Newton
steps are one aggregate each over the sizes. Rates become whole copies by systematic
rounding along documents ordered by size, so that rounding errors cancel, and a second
pass spends what is left on documents small enough to fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import key_join, materialize, word_count

#: Weights of the sources in code-point order, repeating; null comes last.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
#: Newton steps, the safeguarded ones included, after which a search that hasn't ended is an error.
STEPS = 200
#: Hash parts of each size class of a source: at least so many, and one for so many documents of the table.
PARTS, PART_DOCS = 16, 100_000


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row for each source: its number by code point (null last), words, target.

    Water-filling in closed form: sources in order of cap * words / weight fill up first,
    and the rest share what is left by weight. sized: columns source, size.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("source_no", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", F.lit(cap) * F.col("source_size")).withColumn("fill", F.col("limit") / F.col("weight"))
    every = Window.partitionBy(F.lit(0))
    order = Window.orderBy("fill", "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", left / weight)
    # the first source whose own limit is above the level sets the level for it and all after it
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "source_no", "level"))).over(every)["level"])
    target = F.least(F.col("limit"), F.col("weight") * F.coalesce(F.col("level"), F.lit(float("inf"))))
    return per.select("source", "source_no", "source_size", "source_docs", target.alias("target"))


def solve_duals(sized: DataFrame, targets: DataFrame, cap: float = CAP, steps: int = STEPS, tolerance: float = 1e-9) -> DataFrame:
    """targets with lam, mean and at_cap: safeguarded Newton on the dual, one aggregate over sizes for each step.

    sized: source_no, size. The state of the search, one row for each source, is a table too; the driver sees only how many
    sources are open. A source at its cap, or without words, needs no step. A step that leaves the bracket of
    known signs is replaced by its middle, so the search ends; if it hasn't after ``steps``, that is an error.
    """
    sources = targets.count()
    whole, goal = F.col("source_size"), F.col("target")
    state = targets.withColumn("mean", F.coalesce(F.try_divide(whole, F.col("source_docs")), F.lit(0.0)))
    state = state.withColumn("mean", F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)).withColumn("at_cap", goal >= cap * whole * (1 - tolerance))
    none = F.lit(None).cast("double")
    state = state.withColumns({"open": ~F.col("at_cap") & (goal > 0), "lam": F.lit(0.0), "low": none, "high": none})
    state = materialize(state, "mix-state")
    # documents of one size behave alike: distinct sizes of a source are the sufficient statistic
    sizes = materialize(sized.where("size > 0").groupBy("source_no", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    z, lam, low, high = F.col("size") / F.col("mean"), F.col("lam"), F.col("low"), F.col("high")
    free, words = F.exp(F.least(lam * z, F.lit(60.0))), F.col("n") * F.col("size")
    for _ in range(steps):
        if not (n := state.where("open").count()):
            return state.drop("open", "low", "high")
        now = key_join(sizes, state.where("open").select("source_no", "lam", "mean"), "source_no", "inner", n)
        sums = now.groupBy("source_no").agg(F.sum(words * F.least(F.lit(cap), free)).alias("got"), F.sum(F.when(free < cap, words * z * free).otherwise(0.0)).alias("slope"))
        sums = materialize(sums, "mix-sums")
        miss = F.col("got") - goal
        new = key_join(state, sums, "source_no", "left", sources).withColumn("open", F.col("open") & (F.abs(miss) > tolerance * goal))
        new = new.withColumns({"low": F.when(miss <= 0, lam).otherwise(low), "high": F.when(miss > 0, lam).otherwise(high)})
        newton = lam - F.try_divide(miss, F.col("slope"))
        inside = F.coalesce((newton > low) | low.isNull(), F.lit(False)) & F.coalesce((newton < high) | high.isNull(), F.lit(False)) & newton.isNotNull()
        other = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).when(miss < 0, lam * 2 + 1).otherwise(lam * 2 - 1)
        # sizes add up in no set order: a bracket as narrow as a double can tell is solved
        narrow = low.isNotNull() & high.isNotNull() & (high - low <= 1e-14 * F.greatest(F.abs(low), F.abs(high)))
        new = new.withColumn("lam", F.when(F.col("open"), F.when(inside, newton).otherwise(other)).otherwise(lam)).withColumn("open", F.col("open") & ~narrow)
        state = materialize(new.drop("got", "slope"), "mix-state")
    raise ArithmeticError(f"the rates of {state.where('open').count()} sources haven't converged after {steps} steps")


def _before(cells: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Exclusive running sums of ``value`` along the cells of each source, in the order of ``keys``."""
    w = Window.partitionBy("source_no").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))


def _running(df: DataFrame, value: Column) -> DataFrame:
    """Add ``cum``: the inclusive running sum of ``value`` in each source, by size class, part, size and id.

    Rows are dealt by (source, size class, part), sums within a cell are windows, and sums
    before a cell come from one row for each cell.
    """
    df = df.withColumn("_v", value)
    keys = ["source_no", "cls", "part"]
    cells = _before(df.groupBy(*keys).agg(F.sum("_v").alias("v")), "v", [F.desc("cls"), F.col("part")]).drop("v")
    inside = Window.partitionBy(*keys).orderBy(F.desc("size"), "_key").rowsBetween(Window.unboundedPreceding, 0)
    # cells are looked up by what the windows are dealt by already
    out = df.withColumn("_in", F.sum("_v").over(inside)).join(cells, keys)
    return out.withColumn("cum", F.col("_in") + F.col("before")).drop("_v", "_in", "before")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each document: id, source, size, source_size, target, rate, copies, taken, and the columns ``carry``.

    Null text: size 0, taken 0. Null source: a source of its own, last. Repeated rows, repeated ids and rows without
    an id are documents of their own. An empty table gives an empty result. Rows of different ids or texts get the same
    copies in any order of the table; equal rows share theirs out among them.
    """
    key = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col(text))
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("_key"), F.monotonically_increasing_id().alias("_no"), *carry)
    return mix_sized(materialize(sized, "mix-sized"), weights, share, cap, carry)


def _apart(sized: DataFrame) -> DataFrame:
    """Keys that recur more often than a part should have documents are told apart by row number; they are few."""
    often = materialize(sized.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > PART_DOCS).select("_key", F.lit(True).alias("_often")), "mix-often")
    out = key_join(sized, often, "_key", "left")
    return out.withColumn("_key", F.when(F.col("_often"), F.xxhash64("_key", "_no")).otherwise(F.col("_key"))).drop("_often", "_no")


def mix_sized(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, carry: Sequence[str] = ()) -> DataFrame:
    """As mix, from a materialized table of doc_id, source, size, _key, _no and the columns ``carry``.

    _key is a hash that orders documents of one size, _no a number of the row.
    """
    targets = materialize(source_targets(sized, weights, share, cap), "mix-targets")
    parts = max(PARTS, sized.count() // PART_DOCS)
    small = targets.select(F.col("source").alias("_source"), "source_no", "source_size", "target")
    sources = small.count()  # one row each: broadcast unless there are very many
    tagged = key_join(_apart(sized), small, F.col("source").eqNullSafe(F.col("_source")), "inner", sources).drop("_source")
    duals = solve_duals(tagged.select("source_no", "size"), targets, cap)
    rates = key_join(tagged, duals.select("source_no", "lam", "mean", "at_cap"), "source_no", "inner", sources)
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("at_cap"), F.lit(float(cap))).when(F.col("target") <= 0, 0.0)
    rate = rate.otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(60.0)))))
    rates = rates.withColumn("rate", rate).withColumn("cls", F.floor(8 * F.log2(F.col("size") + 1.0)).cast("int"))
    rates = rates.withColumn("part", F.pmod(F.col("_key"), F.lit(parts)).cast("int")).drop("lam", "mean", "at_cap")
    whole, rest = F.floor(F.col("rate") + 1e-9), F.col("rate") - F.floor(F.col("rate") + 1e-9)
    # billionths as whole numbers: sums don't depend on their order
    unit = F.when(F.col("size") > 0, F.round(F.greatest(rest, F.lit(0.0)) * 1e9)).otherwise(0.0).cast("long")
    first = _running(rates, unit)
    step = F.floor((F.col("cum") + 5e8) / 1e9) - F.floor((F.col("cum") - unit + 5e8) / 1e9)
    first = first.withColumn("copies", (whole + step).cast("int")).drop("cum")
    return _spend_rest(materialize(first, "mix-first"), int(cap), sources, carry)


def _spend_rest(first: DataFrame, cap: int, sources: int, carry: Sequence[str] = ()) -> DataFrame:
    """Bring each source nearer its target: along falling sizes, flip one copy of documents that still fit, until nothing moves."""
    before = None
    while True:
        over = first.groupBy("source_no").agg((F.sum(F.col("copies") * F.col("size")) - F.round(F.max("target")).cast("long")).alias("over"))
        over = materialize(over, "mix-over")
        left = over.agg(F.coalesce(F.sum(F.abs("over")), F.lit(0))).first()[0]
        if not left or left == before:
            break
        before = left
        df = key_join(first, over, "source_no", "inner", sources)
        can = F.when(F.col("over") > 0, F.col("copies") > 0).otherwise(F.col("copies") < cap) & (F.col("size") > 0) & (F.col("size") <= F.abs("over"))
        df = _running(df.withColumn("_can", can), F.when(F.col("_can"), F.col("size")).otherwise(0).cast("long"))
        flip = F.col("_can") & (F.col("cum") <= F.abs("over"))
        first = df.withColumn("copies", (F.col("copies") + F.when(flip, -F.signum("over")).otherwise(0)).cast("int")).drop("cum", "_can", "over")
        first = materialize(first, "mix-rest")
    return first.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *carry)
