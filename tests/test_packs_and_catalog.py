"""Rule packs checked before any task; catalogs and layers as data; sentinels and the line gate as properties."""

import json
import random
import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftmark.operators import redact
from driftmark.plans import packs, queries
from driftmark.plans import rules as R
from driftmark.sources import catalog

KEY = "AKIA" + "QWERTYUIOP234567"
SENTINEL = re.compile("__REDACTED:[a-z0-9-]+__|__USER__")


def test_packs_and_their_faults(spark):
    assert packs.available() == sorted([*packs.CORPORA, "generic-entropy"])
    every = packs.compiled(packs.available())
    assert len(every.rules) == len(R.RULES) and every.heuristics == ("generic-entropy",)
    assert packs.compiled(["pii-core"]).rules == R.PERSONAL_DATA and packs.relation(spark).count() == len(R.RULES)
    bad = {"a": (R.Rule("x", "(open", ("x",)), R.Rule("y", "y", ("ü", ""), capture=2, checksum="luhn", guard="none")), "b": (R.Rule("z", "z"), R.Rule("z", "zz")), "c": (R.Rule("q", "q"),), "d": (R.Rule("q", "q"),)}
    with pytest.raises(ValueError) as e:
        packs.compiled(["a", "b", "c", "d", "nowhere"], bad)
    for part in ("'nowhere' is no rule pack", "a, x:", "no group 2", "'ü'", "''", "unknown check 'luhn'", "unknown guard 'none'", "rule z is there 2 times", "rule q is in more than one pack"):
        assert part in str(e.value)


def test_lines_under_chosen_packs(spark):
    body = json.dumps({"a": f"{KEY} of jane@example.org", "note": "see tQ3nZk8vLmXw2Rf5uJhPd0aYc6eBn1", "password": "plain"})
    df = spark.createDataFrame([(0, "\n", body, "claude-code", True)], "line_no int, ending string, body string, family string, jsonl boolean")
    hits = lambda names: redact.redact_lines(df, names=names).first()["rule_hits"]
    assert hits(["pii-core"]) == {"email": 1, "key-name": 1} and hits(["gitleaks-core"]) == {"aws-access-key-id": 1, "key-name": 1}
    assert hits(["generic-entropy"]) == {"generic-entropy": 1, "key-name": 1} or "generic-entropy" in hits(["generic-entropy"])
    assert hits([]) == {"key-name": 1} and hits(None) == {"aws-access-key-id": 1, "email": 1, "generic-entropy": 1, "key-name": 1}
    with pytest.raises(ValueError):
        redact.redact_lines(df, names=["nothing"])


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["email", "REDACTED", "key", "pan", "USER", "aws-access-key-id", "__", "a", "robin"]), st.lists(st.sampled_from(["jane@example.org", KEY, "__REDACTED:email__", "__USER__", "__REDACTED:key-name__", "email", "REDACTED", "key", "robin", "USER", "/home/", " ", "_", "x"]), max_size=8))
def test_sentinels_stay_whole(name, parts):
    text = "".join(parts).replace("jane@", " jane@")  # else an address could begin in a sentinel
    plain, _, _ = redact.Ladder().value(text)
    done, hits, _ = redact.Ladder(name).value(text)
    rules = lambda t: [s for s in SENTINEL.findall(t) if s != "__USER__"]
    assert rules(done) == rules(plain)  # none is broken, none is new
    rest = SENTINEL.sub("\0", done)
    assert "__REDACTED:" not in rest
    if len(name) >= 2 and name.isalnum():
        assert not re.search(rf"(?<![A-Za-z0-9]){re.escape(name)}(?![A-Za-z0-9])", rest) and (hits["path-user"] > 0) == (done != plain)


def test_the_gate_is_never_narrower_than_the_ladder(spark):
    """Lines with values of every rule's shape, as they are, in JSON and escaped: what the ladder changes passes the gate."""
    rng = random.Random(9)
    docs = spark.createDataFrame([(k, "") for k in range(400)], "doc_id long, text string")
    planted = [r["text"] for r in queries._planted(docs).collect()]
    keys = [*R.SECRET_NAMES, *R.SECRET_WORDS, "apiKey", "x-api-key", "note"]
    lines = []
    for t in planted:
        lines += [t, json.dumps({rng.choice(keys).strip("*_").lower(): t}), json.dumps({"t": t}, ensure_ascii=True).replace("/", "\\/"), json.dumps([t.upper()]), f"{rng.choice(keys).lstrip('*')}={t.strip()}"]
        lines.append("".join(f"\\u{ord(c):04x}" if rng.random() < 0.1 and c.isalnum() else c for c in json.dumps({"t": t})))
    ladder, gate, runs = redact.Ladder("robin"), redact.line_gate("robin"), re.compile(redact.RUN_GATE)
    import pyarrow as pa
    import pyarrow.compute as pc

    lines += [json.dumps({"id": f"{rng.getrandbits(128):032x}"}) for _ in range(200)]
    lines += [json.dumps({"id": str(uuid.UUID(int=int("".join(rng.choice("0123456789") for _ in range(32)), 16)))}) for _ in range(3_000)]
    bare = pc.replace_substring_regex(pa.array(lines), redact.UUID_VALUE, '""')
    passed, hit = pc.or_(pc.match_substring_regex(pa.array(lines), gate), pc.match_substring_regex(bare, redact.NUMBER_GATE)).to_pylist(), 0
    for line, ok in zip(lines, passed, strict=True):
        new, found, _, _ = ladder.line(line, "claude-code")
        hit += bool(found)
        assert not found or ok or (runs.search(line) and ladder.may_hold(line)), line
    assert hit > len(planted) * 2


def documents(spark, *bodies):
    return spark.createDataFrame([(f"f{k}", b) for k, b in enumerate(bodies)], "file string, body string").select("file", F.try_parse_json("body").alias("doc"))


GOOD = {"spec_version": 1, "family": "f", "sources": [{"id": "b", "gather": "file_glob", "artifact_class": "context", "roots": ["~/x", "$Y"], "include": ["**"]}, {"id": "a", "gather": "account", "artifact_class": "context", "enabled": False}]}


def test_catalogs(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(GOOD))
    (tmp_path / "two.json").write_text(json.dumps(GOOD | {"sources": [GOOD["sources"][0] | {"id": "c"}]}))
    found = catalog.compiled(catalog.read_documents(spark, str(tmp_path)))
    assert [(r["id"], r["enabled"], r["roots"]) for r in found.collect()] == [("a", False, []), ("b", True, ["~/x", "$Y"]), ("c", True, ["~/x", "$Y"])]
    with pytest.raises(ValueError, match="unique"):
        catalog.compiled(documents(spark, json.dumps(GOOD), json.dumps(GOOD)))
    with pytest.raises(ValueError, match="required"):
        catalog.compiled(documents(spark, "{}"))


def test_violations_of_types_and_bounds(spark):
    source = GOOD["sources"][0]
    cases = {
        "id": ({"id": "X" * 65}, {("$.sources[0].id", "pattern"), ("$.sources[0].id", "maxLength")}),
        "type": ({"max_file_bytes": "1"}, {("$.sources[0].max_file_bytes", "type")}),
        "null": ({"include": None}, {("$.sources[0].include", "type")}),
        "item": ({"exclude": ["a", "", 3]}, {("$.sources[0].exclude[1]", "minLength"), ("$.sources[0].exclude[2]", "type")}),
        "probe": ({"cwd_probe": {"from": [], "fields": ["x"], "more": 1}}, {("$.sources[0].cwd_probe.scan_bytes", "required"), ("$.sources[0].cwd_probe.from", "minItems"), ("$.sources[0].cwd_probe.more", "additionalProperties")}),
        "flag": ({"enabled": "yes", "scrub": 1}, {("$.sources[0].enabled", "type"), ("$.sources[0].scrub", "type")}),
        "good": ({"sniff": {"kind": "magic", "magic_hex": "28b5"}, "enrichers": {"a-b": True}, "git_read": {"take": ["x"]}}, set()),
    }
    docs = documents(spark, *[json.dumps(GOOD | {"sources": [source | {"id": f"s{k}"} | more]}) for k, (more, _) in enumerate(cases.values())])
    got = {}
    for r in catalog.check(docs).collect():
        got.setdefault(r["file"], set()).add((r["path"], r["rule"]))
    assert [got.get(f"f{k}", set()) for k in range(len(cases))] == [want for _, want in cases.values()]


def test_layers(spark):
    sources = catalog.sources_of(documents(spark, json.dumps(GOOD))).drop("file", "place")
    rows = [("user", 1, "b", False, None), ("remote", 2, "b", True, ["~/x"]), ("remote", 2, "a", True, None), ("user", 1, "nobody", True, None), ("remote", 2, "b", None, ["/etc"])]
    out, refused = catalog.layered(sources, spark.createDataFrame(rows, "layer string, rank int, id string, enabled boolean, roots array<string>"))
    assert {r["id"]: (r["enabled"], r["set_by"]) for r in out.collect()} == {"b": (False, "user"), "a": (True, "remote")}
    assert sorted((r["layer"], r["id"], r["rule"]) for r in refused.collect()) == [("remote", "b", "a root beyond the catalog's"), ("user", "nobody", "no such source")]
