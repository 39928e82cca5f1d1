"""Durations, instants, counts and sizes as people read them, and schedules as they write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds a unit, the tick where none is given, the shortest tick.
UNIT_SECONDS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}
DEFAULT_TICK = 900.0
SHORTEST_TICK = 60.0
PAUSE_SECONDS = {"15m": 900, "1h": 3600, "6h": 21600, "12h": 43200, "24h": 86400}
TOMORROW_HOUR = 9

_AMOUNT = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
_UNIT = "(?:ns|us|µs|μs|ms|s|m|h)"


def count_text(n: Column) -> Column:
    """A count with commas between thousands; below zero without."""
    return F.when(n < 0, n.cast("string")).otherwise(F.format_number(n, 0))


def counted(n: Column, noun: str) -> Column:
    return F.when(n == 1, F.lit(f"1 {noun}")).otherwise(F.concat(count_text(n), F.lit(f" {noun}s")))


def size_text(n: Column) -> Column:
    """Bytes, or KB and MB of 1 024 with one decimal, a half to the even digit; null stays null."""
    part = lambda power, unit: F.format_string(f"%.1f {unit}", F.bround(n.cast("double") / float(1024**power), 1))
    return F.when(n >= 1 << 20, part(2, "MB")).when(n >= 1 << 10, part(1, "KB")).when(n.isNotNull(), F.format_string("%d B", n))


def duration_text(ms: Column) -> Column:
    """Whole milliseconds as 12ms, 1.5s, 3m07s or 2h05m; null stays null."""
    seconds = F.floor(ms / 1000)
    minutes = F.floor(seconds / 60)
    return (
        F.when(ms < 1000, F.format_string("%dms", ms)).when(ms < 60_000, F.format_string("%.1fs", F.bround(ms / 1000.0, 1)))
        .when(ms < 3_600_000, F.format_string("%dm%02ds", minutes, seconds % 60)).when(ms.isNotNull(), F.format_string("%dh%02dm", F.floor(minutes / 60), minutes % 60))
    )


def ago_text(seconds: Column) -> Column:
    """How long ago, in the largest unit up to months of 30 days (from 60 days on); null is never."""
    hours = F.floor(seconds / 3600)
    days = F.floor(hours / 24)
    ago = lambda n, noun: F.concat(counted(n, noun), F.lit(" ago"))
    return (
        F.when(seconds.isNull(), "never").when(seconds < 60, "just now").when(seconds < 3600, F.format_string("%d min ago", F.floor(seconds / 60)))
        .when(seconds < 86400, ago(hours, "hour")).when(seconds < 60 * 86400, ago(days, "day")).otherwise(ago(F.floor(days / 30), "month"))
    )


def duration_seconds(text: Column) -> Column:
    """Seconds of a duration such as 1h30m or -1.5s; null if it isn't one. Zero needs no unit."""
    whole = F.regexp_replace(text, "[µμ]s", "us")
    amounts, units = F.regexp_extract_all(whole, F.lit(f"({_AMOUNT}){_UNIT}"), 1), F.regexp_extract_all(whole, F.lit(f"{_AMOUNT}({_UNIT})"), 1)
    scale = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])
    total = F.aggregate(F.zip_with(amounts, units, lambda a, u: a.cast("double") * F.try_element_at(scale, u)), F.lit(0.0), lambda acc, x: acc + x)
    signed = F.when(F.startswith(text, F.lit("-")), -total).otherwise(total)
    return F.when(text.rlike("^[+-]?0$"), F.lit(0.0)).when(text.rlike(f"^[+-]?(?:{_AMOUNT}{_UNIT})+$"), signed)


def tick_seconds(schedule: Column) -> Column:
    """Struct of ``seconds`` between ticks and ``warned``.

    Empty or null is the default. What is no positive duration is the default with a warning, what is too short the shortest tick with one.
    """
    s = F.btrim(F.coalesce(schedule, F.lit("")), F.lit(" \t\n\r"))
    d = duration_seconds(s)
    seconds = F.when((s == "") | d.isNull() | (d <= 0), F.lit(DEFAULT_TICK)).otherwise(F.greatest(d, F.lit(SHORTEST_TICK)))
    return F.struct(seconds.alias("seconds"), ((s != "") & (d.isNull() | (d < SHORTEST_TICK))).alias("warned"))


def pause_end(choice: Column, now: Column) -> Column:
    """When a pause by a choice (15m, 1h, 6h, 12h, 24h, tomorrow: nine o'clock) ends; null for any other."""
    seconds = F.create_map(*[F.lit(x) for kv in PAUSE_SECONDS.items() for x in kv])
    morning = F.to_timestamp(F.concat(F.date_add(F.to_date(now), 1).cast("string"), F.lit(f" {TOMORROW_HOUR:02d}:00:00")))
    return F.when(choice == "tomorrow", morning).otherwise(now + F.make_dt_interval(secs=F.try_element_at(seconds, choice)))


def until_text(end: Column, now: Column) -> Column:
    """An end as 15:04 today, 15:04 tomorrow or Mon 2 Jan 15:04, in the session's zone; null is resumed."""
    days = F.datediff(end, now)
    clock = F.date_format(end, "HH:mm")
    return F.when(end.isNull(), "resumed").when(days == 0, F.concat(clock, F.lit(" today"))).when(days == 1, F.concat(clock, F.lit(" tomorrow"))).otherwise(F.date_format(end, "EEE d MMM HH:mm"))
