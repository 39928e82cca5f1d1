"""Quality rules: a decision list learned by sequential covering, emitted as one Spark conditional.

Everything runs as DataFrame expressions and aggregates. Text statistics are native
columns; learning looks only at counts that Spark aggregates from labelled rows; the
learned list becomes ``CASE WHEN ... THEN`` over the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CHARS, SPACE_CLASS, let, materialize, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "later_window_rate", "upper_rate", "digit_rate", "bang_rate", "words_per_line"]
#: Labelled rows that a list is learned from, at most.
LABELLED_ROWS = 20_000


#: So many different repeated windows are looked up one by one; more are found by sorting.
FEW = 64


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _span(starts: Column) -> Column:
    """Words covered by three-word windows with these ascending starts."""
    gaps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def _starts_by_sorting(grams: Column) -> Column:
    def dups(by_hash: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(by_hash, a)["h"] == F.get(by_hash, b)["h"], F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(by_hash) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return F.sort_array(F.transform(at, lambda k: F.get(by_hash, k)["i"]))

    return let(F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), dups)


def _windows(words: Column) -> Column:
    """Struct of the number of three-word windows, of later copies of windows, and of words that repeated windows cover."""

    def of(grams: Column) -> Column:
        later = let(F.sort_array(grams), lambda s: F.filter(s, lambda h, i: h == F.get(s, i - 1)))
        return let(later, lambda d: result(grams, d))

    def result(grams: Column, later: Column) -> Column:
        def starts(again: Column) -> Column:
            one_by_one = F.filter(F.transform(grams, lambda h, i: F.when(F.array_contains(again, h), i)), lambda i: i.isNotNull())
            return F.when(F.size(again) <= FEW, one_by_one).otherwise(_starts_by_sorting(grams))

        covered = F.when(F.size(later) == 0, F.lit(0)).otherwise(let(let(F.array_distinct(later), starts), _span))
        return F.struct(F.size(grams).alias("n"), F.size(later).alias("later"), covered.cast("long").alias("covered"))

    some = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return let(F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(some), of)


def text_statistics(text: Column) -> Column:
    """Struct of the base counts and of what the rates need, of the whole text (null: as empty)."""
    text = F.coalesce(text, F.lit(""))
    marks = F.regexp_replace(text, f"[^{SYMBOLS}A-Z0-9!]+", "")  # one pass leaves the few characters that are counted

    def of_words(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE_CLASS.replace("[", "[^")))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _windows(w).alias("windows"),
            let(marks, lambda m: F.struct(*[_count_of(m, chars).alias(name) for name, chars in (("symbols", SYMBOLS), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digits", "0123456789"), ("bangs", "!"))])).alias("marks"),
        )

    return let(words_of(text), of_words)


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``df`` and a struct column ``_q`` with base counts and rates."""
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    s = F.col("_s")
    n = s["n_words"]
    rates = {
        "words": n.cast("double"), "mean_word": rate(s["word_chars"], n), "symbol_rate": rate(s["marks"]["symbols"], n),
        "dup_line_rate": rate(s["lines"]["dup"], s["lines"]["n"]), "repeat_rate": rate(s["windows"]["covered"], n),
        "later_window_rate": rate(s["windows"]["later"], s["windows"]["n"]), "upper_rate": rate(s["marks"]["upper"], s["word_chars"]),
        "digit_rate": rate(s["marks"]["digits"], s["word_chars"]), "bang_rate": rate(s["marks"]["bangs"], n), "words_per_line": rate(n, s["lines"]["n"]),
    }
    counts = {"n_words": n, "word_chars": s["word_chars"], "n_symbols": s["marks"]["symbols"], "n_dup_lines": s["lines"]["dup"], "n_repeat_words": s["windows"]["covered"]}
    return df.withColumn("_s", text_statistics(F.col(text))).withColumn("_q", F.struct(*[c.alias(k) for k, c in (counts | rates).items()])).drop("_s")


def base_failed(q: Column) -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self, of: Column) -> Column:
        value = of[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; the first whose conditions all hold rejects, else the document is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    @staticmethod
    def _all(rule: list[Condition], of: Column) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & c.column(of)
        return out

    def rule_number(self, of: Column) -> Column:
        """Number of the rule that fires, from 1; 0 if none does."""
        out = F.lit(0)
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(self._all(rule, of), F.lit(k)).otherwise(out)
        return out

    def describe(self) -> list[str]:
        return [" AND ".join(map(str, rule)) + " -> reject" for rule in self.rules] + ["otherwise -> keep"]


def _cuts(stats: DataFrame, bins: int) -> dict[str, list[tuple[float, float]]]:
    """Thresholds to try: half-way between neighbouring quantiles, so that they keep off both sides, and the gap as a share of the range."""
    at = [i / bins for i in range(bins + 1)]
    row = stats.agg(*[F.percentile_approx(F.col("_q")[f], at, 10_000).alias(f) for f in FEATURES]).first()
    known = {f: sorted(set(row[f] or [])) for f in FEATURES}
    return {f: [((a + b) / 2, (b - a) / (v[-1] - v[0])) for a, b in zip(v, v[1:], strict=False)] for f, v in known.items()}


def _below(edges: Column, value: Column) -> Column:
    return F.size(F.filter(edges, lambda c: c < value))


def _histogram(rows: DataFrame, cuts: dict[str, list[tuple[float, float]]]) -> list:
    """Counts of good and bad rows by feature and number of cuts below the value."""
    cells = []
    for f in FEATURES:
        value, edges = F.col("_q")[f], F.array(*[F.lit(float(c)) for c, _ in cuts[f]]).cast("array<double>")
        cells.append(F.struct(F.lit(f).alias("f"), _below(edges, value).alias("k")))
    one = rows.select("_bad", F.explode(F.array(*cells)).alias("c")).groupBy("c.f", "c.k")
    return one.agg(F.sum(F.col("_bad")).alias("bad"), F.sum(1 - F.col("_bad")).alias("good")).collect()


def _best(rows: DataFrame, cuts: dict[str, list[tuple[float, float]]], bad: float, good: float, least: int) -> Condition | None:
    """The condition of the largest FOIL gain over what the rule so far covers; among equals, that of the widest gap around its cut."""
    tally: dict[str, dict[int, tuple[int, int]]] = {}
    for r in _histogram(rows, cuts):
        tally.setdefault(r["f"], {})[r["k"]] = (r["bad"], r["good"])
    before, best, most = math.log2(bad / (bad + good)), None, (1e-6, 0.0)
    for f in FEATURES:
        low_bad = low_good = 0
        for k, (cut, gap) in enumerate(cuts[f]):
            b, g = tally.get(f, {}).get(k, (0, 0))
            low_bad, low_good = low_bad + b, low_good + g
            for above, p, n in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                if p >= least and (x := (round(p * (math.log2(p / (p + n)) - before), 6), gap)) > most:
                    best, most = Condition(f, above, cut), x
    return best


def learn(stats: DataFrame, bad: Column, max_rules: int = 12, max_conditions: int = 4, bins: int = 64, least: int = 8, precision: float = 0.9) -> DecisionList:
    """Learn a list from rows with a ``_q`` column, by sequential covering with reduced-error pruning.

    Two thirds of the rows (by a hash of their statistics) grow each rule one condition at a time; the
    remaining third prunes its tail. A rule stays only if it is right at least
    ``precision`` of the time where it fires; rows that it covers leave both sets.
    Empty input, or labels of one kind only, gives the empty list (keep all).
    """
    part = F.pmod(F.xxhash64(F.col("_q")), F.lit(3)) == 0
    rows = stats.select("_q", bad.cast("int").alias("_bad"), part.alias("_prune")).where("_bad IS NOT NULL")
    cuts, out = _cuts(rows, bins), DecisionList()
    tallies = [F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum(1 - F.col("_bad")), F.lit(0)).alias("good")]
    for _ in range(max_rules):
        left = rows.where(out.rule_number(F.col("_q")) == 0)
        grow, rule = left.where(~F.col("_prune")), []
        while len(rule) < max_conditions:
            seen = grow.agg(*tallies).first()
            if seen["bad"] < least or not seen["good"] or not (c := _best(grow, cuts, seen["bad"], seen["good"], least)):
                break
            rule.append(c)
            grow = grow.where(c.column(F.col("_q")))
        if not rule:
            break
        shorter = [DecisionList._all(rule[: k + 1], F.col("_q")) for k in range(len(rule))]
        held = left.where(F.col("_prune")).agg(*[F.count_if(x & (F.col("_bad") == b)).alias(f"{k}_{b}") for k, x in enumerate(shorter) for b in (0, 1)]).first()
        worth = [(held[f"{k}_1"] - held[f"{k}_0"]) / max(1, held[f"{k}_1"] + held[f"{k}_0"]) for k in range(len(rule))]
        cut = max(range(len(rule)), key=lambda k: (worth[k], -k))
        fired = left.where(shorter[cut]).agg(*tallies).first()
        if fired["bad"] < least or fired["bad"] < precision * (fired["bad"] + fired["good"]):
            break
        out.rules.append(rule[: cut + 1])
    return out


def learn_from_labels(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS) -> DecisionList:
    """Learn from at most ``limit`` labelled documents, those of the smallest hashes of their ids.

    Documents that the base rules reject teach nothing: the list is for the others. The bound makes the broadcast of
    their ids safe at any size of ``docs``; rows without an id, a text or a quality label teach nothing. Of repeated
    labels of an id the smallest counts, of several documents of an id the one of the smallest statistics.
    """
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select(F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("_low"))
    known = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # written before it is filtered: a filter on statistics would be pushed below the join, to every document
    stats = with_statistics(known).groupBy("_id").agg(F.min("_q").alias("_q"), F.first("_low").alias("_low"))
    stats = materialize(stats.select("_q", "_low"), "quality-sample")
    return learn(stats.where(~base_failed(F.col("_q"))), F.col("_low"))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Add ``_q``, ``_base_failed``, ``_rule`` (0: none) and ``_kept`` to each row of ``docs``; rows stay as many.

    Null and empty texts have no words, so the base rules reject them. Columns of these names, and ``_s``, are replaced:
    wrap rows in a struct where such columns must stay. An empty table gives an empty result.
    """
    q = F.col("_q")
    out = with_statistics(docs).withColumn("_base_failed", base_failed(q)).withColumn("_rule", rules.rule_number(q))
    return out.withColumn("_kept", ~F.col("_base_failed") & (F.col("_rule") == 0))
