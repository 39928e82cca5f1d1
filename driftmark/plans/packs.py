"""Rule packs: which rules there are, chosen by name and checked before any task runs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from driftmark.plans import rules as R

# Names of the packs, and the checks and guards that a rule may name.
CORPORA = {"gitleaks-core": R.PROVIDER_KEYS, "extra": R.MORE_PROVIDER_KEYS, "cloud-keys": R.KEY_MATERIAL, "pii-core": R.PERSONAL_DATA}
HEURISTICS = ("generic-entropy",)
CHECKSUMS, GUARDS = ("iban", "pan", "pesel"), ("no-decimal-neighbor",)


@dataclass(frozen=True)
class Chosen:
    """Rules that run, in order, and the heuristics beside them."""

    rules: tuple[R.Rule, ...]
    heuristics: tuple[str, ...]


def available(corpora: dict[str, tuple[R.Rule, ...]] = CORPORA) -> list[str]:
    return sorted({*corpora, *HEURISTICS})


def faults(pack: str, rules: Iterable[R.Rule]) -> list[str]:
    """What is wrong with the rules of a pack: patterns, captures, keywords, checks, guards and ids."""
    rules, out = list(rules), []
    for r in rules:
        name = f"{pack}, {r.rule_id}"
        try:
            groups = R.python(r.pattern).groups
        except re.error as e:
            out.append(f"{name}: {e}")
            continue
        if not 0 <= r.capture <= groups:
            out.append(f"{name}: no group {r.capture}")
        out += [f"{name}: keyword {k!r} is empty or not ASCII" for k in r.keywords if not k or not k.isascii()]
        out += [f"{name}: unknown check {r.checksum!r}"] * bool(r.checksum and r.checksum not in CHECKSUMS)
        out += [f"{name}: unknown guard {r.guard!r}"] * bool(r.guard and r.guard not in GUARDS)
    return out + [f"{pack}: rule {k} is there {n} times" for k, n in Counter(r.rule_id for r in rules).items() if n > 1]


def compiled(names: Iterable[str], corpora: dict[str, tuple[R.Rule, ...]] = CORPORA) -> Chosen:
    """The chosen packs' rules in order; unknown packs, faulty rules and ids in two of them are an error, all told at once."""
    names = list(dict.fromkeys(names))
    wrong = [f"{n!r} is no rule pack; there are {available(corpora)}" for n in names if n not in available(corpora)]
    chosen = [(n, r) for n in names if n in corpora for r in corpora[n]]
    wrong += [f for n in names if n in corpora for f in faults(n, corpora[n])]
    twice = [k for k, n in Counter(r.rule_id for n, r in dict.fromkeys((n, r) for n, r in chosen)).items() if n > 1]
    wrong += [f"rule {k} is in more than one pack" for k in twice if not any(f"rule {k} is there" in w for w in wrong)]
    if wrong:
        raise ValueError("; ".join(wrong))
    return Chosen(tuple(r for _, r in chosen), tuple(n for n in names if n in HEURISTICS))


def relation(spark: SparkSession, corpora: dict[str, tuple[R.Rule, ...]] = CORPORA) -> DataFrame:
    """(pack, place, rule_id, pattern, keywords, capture, checksum, guard): every rule there is, a few dozen rows."""
    rows = [(n, k, r.rule_id, r.pattern, list(r.keywords), r.capture, r.checksum, r.guard) for n, rules in corpora.items() for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, "pack string, place int, rule_id string, pattern string, keywords array<string>, capture int, checksum string, guard string")
