"""Catalogs of sources as data: documents as variants, a schema as column expressions, faults as rows.

A document is a JSON file for one family of sources. ``violations`` turns a JSON Schema into expressions that Spark
evaluates for all documents at once; each fault is a row (path, rule), so a catalog is refused with everything that is
wrong with it. Users' layers may switch sources off and on, and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TYPES = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")}

# How a catalog document is written.
_ID = {"type": "string", "pattern": "^[a-z0-9][a-z0-9-]*$", "maxLength": 64}
_TEXT, _COUNT, _FLAG = {"type": "string", "minLength": 1}, {"type": "integer", "minimum": 1}, {"type": "boolean"}
PRIMITIVES = ("account", "file_glob", "sidecar", "compressed_file")
SOURCE = {
    "type": "object",
    "required": ["id", "gather", "artifact_class"],
    "additionalProperties": False,
    "properties": {
        "id": _ID,
        "description": {"type": "string"},
        "enabled": _FLAG,
        "gather": {"enum": list(PRIMITIVES)},
        "artifact_class": {"enum": ["trajectory", "context"]},
        "roots": {"type": "array", "minItems": 1, "items": _TEXT},
        "require_subdir": _TEXT,
        "include": {"type": "array", "items": _TEXT},
        "exclude": {"type": "array", "items": _TEXT},
        "max_file_bytes": _COUNT,
        "sniff": {
            "type": "object",
            "required": ["kind"],
            "additionalProperties": False,
            "properties": {"kind": {"enum": ["jsonl", "json", "magic", "text", "none"]}, "magic_hex": {"type": "string", "pattern": "^([0-9a-f]{2})+$"}, "max_scan_bytes": _COUNT},
            "allOf": [{"if": {"kind": ["magic"]}, "then": {"required": ["magic_hex"]}}],
        },
        "scrub": _FLAG,
        "enrichers": {"type": "object", "propertyNames": _ID, "additionalProperties": _FLAG},
        "emit": _TEXT,
        "cwd_probe": {
            "type": "object",
            "required": ["from", "fields", "scan_bytes"],
            "additionalProperties": False,
            "properties": {"from": {"type": "array", "minItems": 1, "items": _ID}, "fields": {"type": "array", "minItems": 1, "items": _TEXT}, "scan_bytes": _COUNT},
        },
        "git_read": {"type": "object", "additionalProperties": False, "properties": {"walk_up": _FLAG, "follow_gitdir_file": _FLAG, "take": {"type": "array", "items": _TEXT}}},
    },
    "allOf": [{"if": {"gather": ["file_glob", "compressed_file"]}, "then": {"required": ["roots", "include"]}}, {"if": {"gather": ["sidecar"]}, "then": {"required": ["emit", "cwd_probe"]}}],
}
DOCUMENT = {
    "type": "object",
    "required": ["spec_version", "family", "sources"],
    "additionalProperties": False,
    "properties": {"spec_version": {"enum": [1]}, "family": _ID, "display_name": _TEXT, "sources": {"type": "array", "minItems": 1, "items": SOURCE}},
}
# End of the fixed values.


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _fault(path: Column, rule: str) -> Column:
    return F.struct(path.alias("path"), F.lit(rule).alias("rule"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def violations(value: Column, schema: dict, path: Column | None = None) -> Column:
    """Array of (path, rule): where a variant breaks a schema, and by which of its words.

    Of JSON Schema: type, enum, required, properties, additionalProperties, propertyNames, items, minItems, minLength,
    maxLength, pattern, format (date-time), minimum, maximum, and allOf with ``if`` given as values of properties. A null value breaks nothing.
    """
    path = F.lit("$") if path is None else path
    node = F.struct(value.alias("value"), _kind(value).alias("kind"))
    return F.coalesce(F.when(value.isNotNull(), _bound(node, lambda n: _faults(n["value"], n["kind"], schema, path))), _nothing())


def _nothing() -> Column:
    return F.array().cast("array<struct<path:string,rule:string>>")


def _faults(value: Column, kind: Column, schema: dict, path: Column) -> Column:
    """What a value of a known kind breaks by itself, and what its parts do."""
    found = []

    def test(broken: Column, rule: str, at: Column | None = None) -> None:
        found.append(F.when(F.coalesce(broken, F.lit(False)), F.array(_fault(path if at is None else at, rule))).otherwise(_nothing()))

    if "type" in schema:
        test(~kind.isin(*_TYPES[schema["type"]]), "type")
    if "enum" in schema:
        text = F.try_variant_get(value, "$", "string")
        test(~text.isin(*[str(v) for v in schema["enum"]]) | ~kind.isin(*{"STRING" if isinstance(v, str) else "BIGINT" for v in schema["enum"]}), "enum")
    text, number = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")), F.when(kind.isin(*_TYPES["number"]), F.try_variant_get(value, "$", "double"))
    for word, broken in (("minLength", lambda n: F.length(text) < n), ("maxLength", lambda n: F.length(text) > n), ("pattern", lambda p: ~text.rlike(p)), ("minimum", lambda n: number < n), ("maximum", lambda n: number > n)):
        if word in schema:
            test(broken(schema[word]), word)
    if schema.get("format") == "date-time":
        test(text.isNotNull() & (~text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9:.]+([Zz]|[+-][0-9]{2}:[0-9]{2})$") | F.try_to_timestamp(text).isNull()), "format")
    if {"required", "properties", "additionalProperties", "propertyNames", "allOf"} & set(schema):
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        found.append(F.when(kind == "OBJECT", _bound(fields, lambda f: _field_faults(f, schema, path))).otherwise(_nothing()))
    items = F.when(kind == "ARRAY", F.try_variant_get(value, "$", "array<variant>"))
    if "minItems" in schema:
        test(F.size(items) < schema["minItems"], "minItems")
    if "items" in schema:
        each = F.transform(items, lambda x, k: violations(x, schema["items"], F.concat(path, F.lit("["), k.cast("string"), F.lit("]"))))
        found.append(F.coalesce(F.flatten(each), _nothing()))
    return F.concat(*found) if found else _nothing()


def _field_faults(fields: Column, schema: dict, path: Column) -> Column:
    """What the fields of an object break."""
    keys, found = F.map_keys(fields), [_nothing()]
    under = lambda k: F.concat(path, F.lit("."), k)
    one = lambda name: F.try_element_at(fields, F.lit(name))
    for name in schema.get("required", ()):
        found.append(F.when(one(name).isNull(), F.array(_fault(under(F.lit(name)), "required"))).otherwise(_nothing()))
    known = schema.get("properties", {})
    found += [violations(one(name), inner, under(F.lit(name))) for name, inner in known.items()]
    more = schema.get("additionalProperties")
    if more is False:
        extra = F.filter(keys, lambda k: ~k.isin(*known)) if known else keys
        found.append(F.transform(extra, lambda k: _fault(under(k), "additionalProperties")))
    elif more:
        found.append(F.flatten(F.transform(F.map_entries(fields), lambda e: violations(e["value"], more, under(e["key"])))))
    if "propertyNames" in schema:
        found.append(F.flatten(F.transform(keys, lambda k: violations(F.try_variant_get(F.parse_json(F.to_json(F.array(k))), "$[0]", "variant"), schema["propertyNames"], under(k)))))
    for rule in schema.get("allOf", ()):
        holds = F.lit(True)
        for name, values in rule["if"].items():
            holds = holds & F.coalesce(F.try_variant_get(one(name), "$", "string").isin(*values), F.lit(False))
        found.append(F.when(holds, _field_faults(fields, rule["then"], path)).otherwise(_nothing()))
    return F.concat(*found)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc): each file below the path as one variant; null where it isn't JSON."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    return files.select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("doc"))


def sources_of(documents: DataFrame) -> DataFrame:
    """(file, family, place, id, gather, artifact_class, enabled, roots, include, exclude, max_file_bytes, spec) of each source of (file, doc)."""
    each = documents.select("file", F.try_variant_get("doc", "$.family", "string").alias("family"), F.posexplode(F.try_variant_get("doc", "$.sources", "array<variant>")).alias("place", "spec"))
    texts = lambda n: F.coalesce(F.try_variant_get("spec", f"$.{n}", "array<string>"), F.array().cast("array<string>")).alias(n)
    get = lambda n, t: F.try_variant_get("spec", f"$.{n}", t)
    return each.select("file", "family", "place", get("id", "string").alias("id"), get("gather", "string").alias("gather"), get("artifact_class", "string").alias("artifact_class"), F.coalesce(get("enabled", "boolean"), F.lit(True)).alias("enabled"), texts("roots"), texts("include"), texts("exclude"), get("max_file_bytes", "long").alias("max_file_bytes"), "spec")


def check(documents: DataFrame) -> DataFrame:
    """(file, path, rule): everything that is wrong with the documents (file, doc), ids that two sources have included."""
    broken = documents.where("doc IS NULL").select("file", F.lit("$").alias("path"), F.lit("JSON").alias("rule"))
    faults = documents.select("file", F.explode(violations(F.col("doc"), DOCUMENT)).alias("v")).select("file", "v.path", "v.rule")
    named = sources_of(documents).where("id IS NOT NULL").select("file", "place", "id")
    twice = named.join(named.groupBy("id").count().where("count > 1").select("id"), "id")
    return broken.unionByName(faults).unionByName(twice.select("file", F.format_string("$.sources[%d].id", "place").alias("path"), F.lit("unique").alias("rule")))


def compiled(documents: DataFrame) -> DataFrame:
    """The sources of sound documents by id; a ValueError tells the first faults of others."""
    wrong = check(documents).orderBy("file", "path", "rule").limit(20).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['file']}: {r['path']}: {r['rule']}" for r in wrong))
    return sources_of(documents).drop("file", "place").orderBy("id")


def layered(sources: DataFrame, layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources with enabled and set_by, refused rows) under users' layers (layer, rank, id, enabled, roots).

    The highest rank that says something decides; but off at any layer stays off, and a layer that names a source or a root
    that the catalog doesn't have is refused.
    """
    known = sources.select("id", F.col("roots").alias("_roots"))
    said = layers.join(known, "id", "left")
    rules = F.when(F.col("_roots").isNull(), "no such source").when(F.size(F.array_except(F.coalesce("roots", F.array().cast("array<string>")), F.coalesce("_roots", F.array().cast("array<string>")))) > 0, "a root beyond the catalog's")
    said = said.withColumn("rule", rules)
    spoken = said.where("rule IS NULL AND enabled IS NOT NULL")
    top = F.max_by("layer", F.struct((~F.col("enabled")).alias("off"), "rank"))
    verdict = spoken.groupBy("id").agg(F.bool_and("enabled").alias("_enabled"), top.alias("set_by"))
    out = sources.join(verdict, "id", "left").withColumn("enabled", F.coalesce("_enabled", "enabled")).withColumn("set_by", F.coalesce("set_by", F.lit("catalog"))).drop("_enabled")
    return out, said.where("rule IS NOT NULL").select("layer", "id", "rule")
