"""Hashes, checksums and numbers."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftmark.plans.rules import CARD_GROUPS, ENTROPY_BITS, ENTROPY_BITS_HEX, PESEL_WEIGHTS


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _digit(text: Column, k: int) -> Column:
    return F.substring(text, k, 1).cast("int")


def pesel_valid(text: Column) -> Column:
    """Eleven digits, check digit and month."""
    d = digits(text)
    total = F.lit(0)
    for k, w in enumerate(PESEL_WEIGHTS, 1):
        total = total + F.lit(w) * _digit(d, k)
    month = F.pmod(F.substring(d, 3, 2).cast("int"), F.lit(20))
    return F.coalesce((F.length(d) == 11) & (F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)) == _digit(d, 11)) & month.between(1, 12), F.lit(False))


def iban_valid(text: Column) -> Column:
    """Length and remainder 1 modulo 97 with the first four characters last and letters as 10 to 35."""
    moved = F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    fold = F.aggregate(F.split(moved, ""), F.lit(0).cast("int"), lambda a, c: F.when(c == "", a).when(value(c) > 9, F.pmod(a * 100 + value(c), F.lit(97))).otherwise(F.pmod(a * 10 + value(c), F.lit(97))).cast("int"))
    return F.coalesce(text.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (fold == 1), F.lit(False))


def card_valid(text: Column) -> Column:
    """A card number by grouping, length, issuer and Luhn digit; separators are blanks or hyphens, not both."""
    d = digits(text)
    groups = F.array_join(F.transform(F.split(text, "[ -]"), lambda g: F.length(g).cast("string")), "-")
    plain = ~text.rlike("[ -]")
    one_kind = ~(text.contains(" ") & text.contains("-"))
    first = F.substring(d, 1, 1)
    issuer = first.isin("4", "5", "6") | ((first == "3") & F.substring(d, 2, 1).isin("0", "4", "6", "7", "8")) | ((first == "2") & F.substring(d, 1, 4).cast("int").between(2221, 2720))
    return F.coalesce((plain | (one_kind & groups.isin(*CARD_GROUPS))) & F.length(d).isin(13, 14, 15, 16, 19) & issuer & F.call_function("luhn_check", d), F.lit(False))


def entropy_bits(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; terms are summed by ascending character."""
    chars = F.split(text, "")
    terms = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
    return F.aggregate(terms, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def clears_entropy(text: Column) -> Column:
    return entropy_bits(text) >= F.when(text.rlike("^[0-9a-fA-F]+$"), ENTROPY_BITS_HEX).otherwise(ENTROPY_BITS)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in lower-case hex, from built-in digests."""
    block = key.ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in block)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), inner), 256)


def mirror_name(key: bytes, canonical: Column) -> Column:
    return hmac_sha256(key, F.concat(F.lit("mirror:"), canonical))


def object_key(org: str, install: str, source_id: Column, key: bytes, canonical: Column) -> Column:
    return F.concat(F.lit(f"v1/organization={org}/install={install}/source="), source_id, F.lit("/"), mirror_name(key, canonical))


def backoff_seconds(attempt: Column, spread: Column) -> Column:
    """60 * 2^attempt up to an hour, less a deterministic jitter of up to an eighth."""
    base = F.least(F.lit(60.0) * F.pow(F.lit(2.0), F.least(attempt, F.lit(8))), F.lit(3600.0))
    return base - F.pmod(spread, F.lit(9)) * base / 64.0


def upper_median(value: str) -> Column:
    """Aggregate over the named column: sorted[n / 2], 0 if there is none; nulls don't count.

    The discrete percentile takes the lower of two middle values; taken from the top it is the upper one.
    """
    return F.coalesce(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)"), F.lit(0)).cast("long")


def completeness(shipped: Column, remaining: Column) -> Column:
    return F.when(shipped + remaining == 0, 100.0).otherwise(100.0 * shipped / (shipped + remaining))


def sample_indexes(length: int, n: int) -> list[int]:
    """Positions of ``n`` of ``length`` evenly spread, both ends kept."""
    if n >= length:
        return list(range(length))
    return [0] if n == 1 else [math.floor(i * (length - 1) / (n - 1)) for i in range(n)]


def spec_hash(fields: dict[str, list[str]]) -> str:
    """SHA-256 of a source's fields, each with its label and count and each value with its length, so that no two settings read alike."""
    text = "".join(f"{label}:{len(values)}:" + "".join(f"{len(v.encode())}:{v}" for v in values) for label, values in fields.items())
    return hashlib.sha256(text.encode()).hexdigest()
