"""Redaction of transcripts: secrets and personal data become fixed sentinels.

Two ways, both Spark jobs. ``hits_by_rule`` counts and ``replace_rule`` replaces what rules match one at a time.
``redact_lines`` applies the whole ladder to JSON lines, which must keep every byte that isn't
redacted (key order, repeated keys, escapes), so a small helper walks each line inside an
Arrow map; lines are rows, so a payload of any size is spread over tasks.
"""

from __future__ import annotations

import base64
import binascii
import heapq
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

try:
    import ahocorasick
except ImportError:  # keywords are then looked up one by one
    ahocorasick = None
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.plans import packs
from driftmark.plans import rules as R

#: Bytes of texts that a task looks at together.
PIECE_BYTES = 4 << 20


def gate(text: Column, rule: R.Rule) -> Column:
    """Can the rule match at all: is one of its keywords in the text, ASCII case aside?"""
    found = F.lit(not rule.keywords)
    for k in rule.keywords:
        found = found | F.lower(text).contains(k.lower())
    return found


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches in slices whose texts hold ``most`` bytes together, or of one row: what a task makes of a batch is a few times its texts."""
    for b in batches:
        begin = held = 0
        for k, size in enumerate(pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()):
            if held and held + size > most:
                yield b.slice(begin, k - begin)
                begin, held = k, 0
            held += size
        if begin < b.num_rows:
            yield b.slice(begin)


def hits_by_rule(docs: DataFrame, rules: list[R.Rule], text: str = "text") -> DataFrame:
    """(rule_id, docs, hits) of the rules that hit in any text, checksums and overlaps aside; null texts hold nothing.

    RE2, the rules' own dialect, runs over Arrow batches: one pattern picks the texts that any rule could touch, and only
    those are counted rule by rule. A task hands on a row of counts for each rule.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate, seen, hits = line_gate(), Counter(), Counter()
        known = [(r, R.python(r.pattern)) for r in rules]
        for b in pieces(batches, text):
            some = b.column(0).filter(pc.fill_null(pc.match_substring_regex(b.column(0), gate + "|" + NUMBER_GATE), False))
            for rule, pattern in known if len(some) else ():
                held = some.filter(pc.match_substring_regex(some, rule.pattern)).to_pylist()
                seen[rule.rule_id] += len(held)
                hits[rule.rule_id] += sum(sum(1 for _ in pattern.finditer(t)) for t in held)
        found = [k for k, n in hits.items() if n]
        yield pa.RecordBatch.from_pydict({"rule_id": found, "docs": [seen[k] for k in found], "hits": [hits[k] for k in found]}, pa.schema([("rule_id", pa.string()), ("docs", pa.int64()), ("hits", pa.int64())]))

    partial = docs.select(text).mapInArrow(count, "rule_id string, docs long, hits long")
    return partial.groupBy("rule_id").agg(F.sum("docs").alias("docs"), F.sum("hits").alias("hits"))


def replace_rule(text: Column, rule: R.Rule) -> Column:
    """Text with a rule's whole matches as its sentinel; for rules without capture and checksum."""
    return F.when(gate(text, rule), F.regexp_replace(text, R.java(rule.pattern), R.sentinel(rule.rule_id))).otherwise(text)


def candidates(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(R.java(pattern)), F.lit(0))


def split_lines(payloads: DataFrame, content: str = "content") -> DataFrame:
    """One row for each line, its LF or CRLF kept apart (``ending``), numbered from 0 (``line_no``)."""
    parts = payloads.withColumn("_lines", F.split(content, "\n")).drop(content)
    out = parts.select("*", (F.size("_lines") - 1).alias("_last")).select(*[c for c in parts.columns if c != "_lines"], "_last", F.posexplode("_lines").alias("line_no", "body"))
    last = F.col("line_no") == F.col("_last")
    cr = ~last & F.endswith("body", F.lit("\r"))
    out = out.where(~last | (F.col("body") != "")).withColumn("ending", F.when(last, "").when(cr, "\r\n").otherwise("\n"))
    return out.withColumn("body", F.when(cr, F.expr("left(body, length(body) - 1)")).otherwise(F.col("body"))).drop("_last")


_CARD, _DECIMAL = re.compile("[ -]"), re.compile(r"\.[0-9]")


def _luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def _card(s: str) -> bool:
    groups, d = _CARD.split(s), re.sub("[^0-9]", "", s)
    if len(groups) > 1 and (" " in s and "-" in s or "-".join(str(len(g)) for g in groups) not in R.CARD_GROUPS):
        return False
    issuer = d[0] in "456" or (d[0] == "3" and d[1] in "04678") or (d[0] == "2" and 2221 <= int(d[:4]) <= 2720)
    return len(d) in (13, 14, 15, 16, 19) and issuer and _luhn(d)


def _iban(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _pesel(s: str) -> bool:
    return (-sum(w * int(c) for w, c in zip(R.PESEL_WEIGHTS, s, strict=False))) % 10 == int(s[10]) and 1 <= int(s[2:4]) % 20 <= 12


_CHECKS = {"pan": _card, "iban": _iban, "pesel": _pesel}
#: Without this no number of the personal rules can be in a text.
_DIGITS = re.compile("[0-9][ -]?[0-9]")
_RUN = re.compile(rf"(?<![A-Za-z0-9+=_-])[A-Za-z0-9+=_-]{{{R.ENTROPY_LENGTH},}}")
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\]:,]')
_BASE64 = re.compile(r"[A-Za-z0-9+/=_\r-]+")
_GAP = r"(?:\s|\\[a-z])"
_ENCODED = re.compile(rf'"{_GAP}*([A-Za-z0-9+/=_-]{{{R.ENTROPY_LENGTH},}}){_GAP}*"')
#: Hex digits, with the letter of an escape before them at most (the digits of one are hex, too).
_HEX = re.compile("[A-Za-z]?[0-9a-fA-F]+")
#: What redaction leaves in a text.
_SENTINEL = re.compile(rf"(__REDACTED:[a-z0-9-]+__|{re.escape(R.USER_PLACEHOLDER)})")
#: Key names that a task remembers.
_ASKED = 20_000
#: Deeper lines are looked at one by one.
_DEEP = 256


class Ladder:
    """The detectors of chosen packs (none named: all), for one value or one line; made once for each task."""

    def __init__(self, username: str = "", chosen: packs.Chosen | None = None):
        self.username = username if len(username) >= 2 else ""
        chosen = chosen or packs.compiled(packs.available())
        self.asked: dict[str, bool] = {}
        pem = "private-key-block"
        self.blocks = any(r.rule_id == pem for r in chosen.rules)
        self.heuristics = "generic-entropy" in chosen.heuristics
        self.rules = [(r, R.python(r.pattern), [k.lower() for k in r.keywords]) for r in chosen.rules if r.rule_id != pem]
        names = R.Rule("key-name", R.assignment_pattern(), tuple(n.lstrip("*") for n in R.SECRET_NAMES), 1)
        self.rules.append((names, R.python(names.pattern), [k.lower() for k in names.keywords]))
        self.free = [k for k, (_, _, keywords) in enumerate(self.rules) if not keywords]
        self.keywords = None
        if ahocorasick:
            self.keywords = ahocorasick.Automaton()
            by_word: dict[str, list[int]] = {"private key": []}
            for k, (_, _, keywords) in enumerate(self.rules):
                for w in keywords:
                    by_word.setdefault(w, []).append(k)
            for w, which in by_word.items():
                self.keywords.add_word(w, tuple(which))
            self.keywords.make_automaton()
        self.pem = R.python(r"-----(BEGIN|END)[A-Z ]*PRIVATE KEY(?: BLOCK)?-----")
        self.exempt = {(family, path) for family, paths in R.EXEMPT.items() for path in paths}
        skip = [R.USER_PLACEHOLDER, "__REDACTED"] + [self.username] * bool(self.username)
        self.skip = re.compile("|".join(rf"(?<![A-Za-z0-9]){re.escape(s)}(?![A-Za-z0-9])" for s in skip))
        self.user = re.compile(rf"(?<![A-Za-z0-9]){re.escape(self.username)}(?![A-Za-z0-9])") if self.username else None

    def patterns(self, value: str) -> list[tuple[int, int, str]]:
        """Spans (start, end, rule) of all pattern rules; what a check refuses is passed over whole."""
        low, out = value.lower(), []
        if self.keywords:
            found = {k for _, which in self.keywords.iter(low) for k in which}
        else:
            found = {k for k, (_, _, keywords) in enumerate(self.rules) if any(w in low for w in keywords)}
        if _DIGITS.search(value):
            found.update(self.free)
        for rule, pattern, _ in (self.rules[k] for k in sorted(found)):
            for m in pattern.finditer(value):
                a, b = m.span(rule.capture)
                if rule.guard and (value[a - 1 : a] == "." or _DECIMAL.match(value, b)):
                    continue
                if rule.checksum and not _CHECKS[rule.checksum](m[0]):
                    continue
                out.append((a, b, rule.rule_id))
        if self.blocks and "private key" in low:  # the block's own pattern takes quadratic time where ends are missing
            begin = None
            for m in self.pem.finditer(value):
                if m[1] == "BEGIN":
                    begin = m.start() if begin is None else begin
                elif begin is not None:
                    out.append((begin, m.end(), "private-key-block"))
                    begin = None
        return out

    def entropy(self, value: str) -> list[tuple[int, int, str]]:
        out = []
        for m in _RUN.finditer(value) if len(value) >= R.ENTROPY_LENGTH else ():
            count, n = Counter(m[0]), len(m[0])
            bits = -sum(c / n * math.log2(c / n) for _, c in sorted(count.items()))
            least = R.ENTROPY_BITS_HEX if set(count) <= set("0123456789abcdefABCDEF") else R.ENTROPY_BITS
            if bits >= least and not self.skip.search(m[0]):
                out.append((m.start(), m.end(), "generic-entropy"))
        return out

    def encoded(self, value: str) -> str | None:
        """The first rule that matches inside a value that is base64 as a whole, one level deep."""
        text = value.strip()
        if len(value) < R.BASE64_LENGTH or not _BASE64.fullmatch(text):
            return None
        text = text.replace("\r", "").replace("-", "+").replace("_", "/")
        try:
            inner = base64.b64decode(text + "=" * (-len(text) % 4), validate=True).decode("utf-8", "replace")
        except (binascii.Error, ValueError):
            return None
        found = self.patterns(inner)
        return found[0][2] if found else None

    @staticmethod
    def resolve(spans: list[tuple[int, int, str]], doubtful: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """The spans that are replaced: from the left, of one start the longest, none inside another.

        A doubtful span (they don't overlap each other) that meets sure ones is never replaced itself; the first sure one
        that it meets reaches as far as it does, unless that one begins later.
        """
        sure = sorted(spans, key=lambda s: (s[0], -s[1], s[2]))
        reach, alone = [end for _, end, _ in sure], []
        for begin, end, rule in doubtful:
            owner = next((k for k, (a, b, _) in enumerate(sure) if a < end and begin < b), None)
            if owner is None:
                alone.append((begin, end, rule))
            elif sure[owner][0] <= begin:
                reach[owner] = max(reach[owner], end)
        wide = [(a, b, rule) for (a, _, rule), b in zip(sure, reach, strict=True)]
        out: list[tuple[int, int, str]] = []
        for a, b, rule in heapq.merge(wide, sorted(alone), key=lambda s: s[0]):
            if a < b and (not out or out[-1][1] <= a):
                out.append((a, b, rule))
        return out

    def may_hold(self, body: str) -> bool:
        """For a line that passes the gate but for its long runs: could one of them be redacted?"""
        for m in _RUN.finditer(body):
            run = m[0]
            kinds = len(set(run))
            # so few different characters can't have the bits that are asked for
            if 2.0**R.ENTROPY_BITS <= kinds or (2.0**R.ENTROPY_BITS_HEX <= kinds and _HEX.fullmatch(run)):
                return True
        return any(self.encoded(m[1].ljust(R.BASE64_LENGTH)) for m in _ENCODED.finditer(body)) or bool(_BASE64.fullmatch(body.strip()) and self.encoded(body))

    def value(self, value: str, key: str = "", doubtful: bool = False) -> tuple[str, Counter, int]:
        """A value redacted, hits by rule, and how many of its bytes went."""
        if key and value and self.secret(key):
            return R.sentinel("key-name"), Counter({"key-name": 1}), len(value.encode())
        spans = self.patterns(value)
        unsure = self.entropy(value) if doubtful and self.heuristics else []
        if not spans and not unsure:
            if inner := self.encoded(value):
                return R.sentinel(inner), Counter({inner: 1}), len(value.encode())
            if not self.user or self.username not in value:
                return value, Counter(), 0
        out, at, gone, hits, users = [], 0, 0, Counter(), 0

        def named(text: str) -> str:
            """What no rule took, with the username replaced; sentinels put in beside it are never looked at."""
            nonlocal users
            if not self.user or self.username not in text:
                return text
            parts = _SENTINEL.split(text)  # a sentinel that is in the text already stays
            for k in range(0, len(parts), 2):
                parts[k], n = self.user.subn(R.USER_PLACEHOLDER, parts[k])
                users += n
            return "".join(parts)

        for a, b, r in self.resolve(spans, unsure):
            out += [named(value[at:a]), R.sentinel(r)]
            gone += len(value[a:b].encode())
            hits[r] += 1
            at = b
        done = "".join([*out, named(value[at:])])
        if users:
            hits["path-user"] += 1
            gone += users * len(self.username.encode())
        return done, hits, gone

    def secret(self, key: str) -> bool:
        """Is a key name that of a credential? Names recur in every line, so answers are kept."""
        if key not in self.asked:
            if len(self.asked) >= _ASKED:
                self.asked.clear()
            self.asked[key] = secret_key(key)
        return self.asked[key]

    def line(self, body: str, family: str) -> tuple[str, Counter, int, bool]:
        """A JSON line with its dirty strings redacted and every other byte kept, or else raw text; last: was it JSON?"""
        try:
            json.loads(body, parse_constant=_refuse)
        except (ValueError, RecursionError):
            return *self.value(body), False
        out, at, hits, gone = [], 0, Counter(), 0
        stack: list[list] = []  # [is object, path, key of the coming value, its field path]
        for m in _TOKEN.finditer(body):
            t, top = m[0], stack[-1] if stack else None
            if t in "{[":
                path = top[3] if top else ""
                stack.append([t == "{", path, None, path if t == "{" else path + "[]"])
                if len(stack) > _DEEP:
                    return *self.value(body), False
            elif t in "}]":
                stack.pop()
            elif t == "," and top[0]:
                top[2] = None
            elif t[0] == '"':
                text = json.loads(t, strict=False) if "\\" in t else t[1:-1]
                is_key = bool(top) and top[0] and top[2] is None
                path = (f"{top[1]}.{text}" if top[1] else text) if is_key else top[3] if top else ""
                free = (family, path) in self.exempt or ("*", path) in self.exempt
                new, found, n = self.value(text, "" if is_key or not top or not top[0] else top[2], not free)
                if is_key:
                    top[2], top[3] = text, (f"{top[1]}.{new}" if top[1] else new)
                if found:
                    out += [body[at : m.start()], json.dumps(new, ensure_ascii=False)]
                    at = m.end()
                    hits += found
                    gone += n
        return "".join([*out, body[at:]]), hits, gone, True


def _refuse(name: str):
    raise ValueError(name)


def line_gate(username: str = "", rules: tuple[R.Rule, ...] = R.RULES) -> str:
    """One RE2 pattern that every line matches which a pattern rule, a key name or the username could touch.

    It is asked of lines as they are, JSON escapes and all, so it may only be wider than the rules: word edges are left out,
    and what an escape could hide lets a line through. For rules of numbers NUMBER_GATE is asked beside it.
    """
    gap, tail, coded = _GAP + "*", "[A-Za-z0-9_+/=.%~-]{8}", "[A-Za-z0-9+/=_-]+"
    spelled = sorted({re.escape(n.lstrip("*").lower()) for n in R.SECRET_NAMES})
    parts = [f"(?:{'|'.join(re.escape(k) for r in rules if r.rule_id not in R.LOOSE_GATES for k in r.keywords)}){tail}"]
    parts = parts if any(r.rule_id not in R.LOOSE_GATES and r.keywords for r in rules) else []
    parts += [g for gates in R.LOOSE_GATES.values() for g in gates]
    parts += [f"(?i:token{gap}:)", f"(?i:(?:{'|'.join(spelled)}){gap}[:=])"]
    parts += [f'(?i:(?:{"|".join([*R.SECRET_WORDS, "key", *spelled])})[-_. :/]*"\\s*:)']
    parts += [f'[\u0131\u017f\u00df\ufb00-\ufb06][^"]*"\\s*:']  # letters whose upper case is in ASCII
    parts += [f'(?:^|"){_GAP}{{5,}}{coded}{gap}(?:$|")', f'(?:^|"){gap}{coded}{_GAP}{{5,}}(?:$|")']  # short base64 made long by blanks
    parts += [r"\\[r/]", r"\r"]
    parts += [r"\\u(?:00[0-7]|00[dD][fF]|0131|017[fF]|212[aA]|[fF][bB]0)"]  # ASCII, or a letter with a case in it
    return "|".join(parts + [re.escape(username)] * (len(username) >= 2))


#: What the rules of numbers could touch.
NUMBER_GATE = r"[0-9](?:[ -]?[0-9]){10}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"
#: A run that the entropy detector or the base64 test could look at.
RUN_GATE = f"[A-Za-z0-9+/=_-]{{{R.ENTROPY_LENGTH}}}"
#: A string that is a lower-case UUID is clean: 17 kinds of characters have too few bits, and read as base64 it gives
#: bytes over 0x7F at three places, between which no rule has room. Its groups have no length of a number that a rule looks for.
UUID_VALUE = '"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"'


def _is_json(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False
    return True


_HUMP = re.compile("(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def secret_key(key: str) -> bool:
    words = [w for w in re.split("[-_. :/]+", _HUMP.sub("_", key).lower()) if w]
    if words and (words[-1] in R.SECRET_WORDS or (words[-1] == "key" and len(words) > 1 and words[-2] in R.KEY_QUALIFIERS)):
        return True
    return any(key.upper().endswith(n[1:]) if n[0] == "*" else key.upper() == n for n in R.SECRET_NAMES)


def redact_lines(lines: DataFrame, username: str = "", body: str = "body", family: str = "family", jsonl: str = "jsonl", names: list[str] | None = None, keep_body: bool = True) -> DataFrame:
    """Rows of ``lines`` with redacted, rule_hits (map), bytes_redacted, bytes_total and parsed (was the line JSON).

    names: rule packs (none given: all); an unknown or faulty one is an error here, before any task. Key names, base64 and
    the username belong to no pack.

    A row is one line (see split_lines); with ``keep_body`` false its text goes no further than this; ``family`` picks the exempt fields, ``jsonl`` false or null means raw text.
    Null bodies stay null without hits; blank lines pass through and parsed is null. A line that a detector fails on is null
    with its ``error`` (null otherwise): nothing of it may leave.
    """
    extra = [("redacted", "string"), ("rule_hits", "map<string,long>"), ("bytes_redacted", "long"), ("bytes_total", "long"), ("parsed", "boolean"), ("error", "string")]
    names_kept = [f.name for f in lines.schema if keep_body or f.name != body]
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema if f.name in names_kept]
    chosen = packs.compiled(packs.available() if names is None else names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ladder, gate = Ladder(username, chosen), line_gate(username, chosen.rules)
        for b in pieces(batches, body):
            bodies = b.column(body)
            # RE2 over many lines at once tells which need a look at all; the others stay as they are, in Arrow
            bare = pc.replace_substring_regex(bodies, UUID_VALUE, '""')
            rules = pc.or_(pc.match_substring_regex(bodies, gate), pc.match_substring_regex(bare, NUMBER_GATE)).to_pylist()
            runs = pc.match_substring_regex(bare, RUN_GATE).to_pylist()
            size = pc.fill_null(pc.binary_length(bodies), 0).cast(pa.int64())
            n = len(bodies)
            new, hits, gone, parsed, errors = {}, [[]] * n, [0] * n, [None] * n, [None] * n
            for k, (text, fam, is_json) in enumerate(zip(bodies.to_pylist(), b.column(family).to_pylist(), b.column(jsonl).to_pylist(), strict=True)):
                if text is None or not text.strip():
                    continue
                try:
                    if not rules[k] and not (runs[k] and ladder.may_hold(text)) and text.count("[") + text.count("{") <= _DEEP:
                        parsed[k] = bool(is_json) and _is_json(text)
                        continue
                    done, found, gone[k], parsed[k] = ladder.line(text, fam or "") if is_json else (*ladder.value(text), False)
                except Exception as e:  # whatever it is: the line doesn't go out, the task goes on
                    new[k], errors[k] = None, f"{type(e).__name__}: {e}"[:200]
                    continue
                if found:
                    new[k], hits[k] = done, sorted(found.items())
            redacted = bodies if not new else pa.array([new.get(k, t) for k, t in enumerate(bodies.to_pylist())], pa.string())
            arrays = [redacted, pa.array(hits, pa.map_(pa.string(), pa.int64())), pa.array(gone, pa.int64()), size, pa.array(parsed, pa.bool_()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names_kept), *arrays], [*names_kept, *(n for n, _ in extra)])

    return lines.mapInArrow(run, ", ".join([*kept, *(f"{n} {t}" for n, t in extra)]))


def dealt(table: DataFrame) -> DataFrame:
    """A table as it is read, over all cores: one of fewer partitions than that is dealt out, any other stays as it lies.

    For plain tables only: of a plan with shuffles, asking for its partitions would run them.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def rebuild(redacted: DataFrame, keys: list[str]) -> DataFrame:
    """Payloads from their redacted lines: content, bytes, density, scan_mode, rule_hits, lines, lines_parsed, lines_raw, error (of any line, else null).

    A payload is one row again, so its size must be bounded before (the collector's limit is 256 MiB); where objects
    may be rows of lines, write the lines themselves.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.concat("redacted", "ending").alias("t")))), lambda x: x["t"]), "")
    parsed, raw = F.count_if("parsed"), F.count_if(~F.col("parsed"))
    out = redacted.groupBy(*keys).agg(text.alias("content"), F.sum("bytes_redacted").alias("bytes_redacted"), F.sum(F.col("bytes_total") + F.length("ending")).alias("bytes_total"), parsed.alias("lines_parsed"), raw.alias("lines_raw"), F.max("error").alias("error"), F.count(F.lit(1)).alias("lines"), summed(F.collect_list(F.when(F.size("rule_hits") > 0, F.col("rule_hits")))).alias("rule_hits"))
    mode = F.when(F.col("lines_raw") == 0, "decoded_json_values").when(F.col("lines_parsed") == 0, "raw_text").otherwise("mixed")
    return out.withColumn("scan_mode", mode).withColumn("density", F.coalesce(F.try_divide(F.col("bytes_redacted").cast("double"), F.col("bytes_total")), F.lit(0.0)))


def summed(maps: Column) -> Column:
    """Maps of counts as one: each key with the sum of its counts."""
    entries = F.flatten(F.transform(maps, F.map_entries))
    keys = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
    total = lambda k: F.aggregate(F.filter(entries, lambda e: e["key"] == k), F.lit(0).cast("long"), lambda a, e: a + e["value"])
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), total(k).alias("value"))))


def rule_ledger(redacted: DataFrame, keys: list[str]) -> DataFrame:
    """Hits by rule: one row for each of ``keys`` and rule."""
    return redacted.select(*keys, F.explode("rule_hits").alias("rule_id", "hits")).groupBy(*keys, "rule_id").agg(F.sum("hits").alias("hits"))
