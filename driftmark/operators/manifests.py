"""Manifests of sealed objects: assembled from columns, checked against their schema before anything ships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.sources import catalog

# How a manifest is written.
_ID = {"type": "string", "pattern": "^[a-z0-9][a-z0-9-]*$", "maxLength": 64}
_TEXT, _SIZE, _TIME = {"type": "string", "minLength": 1}, {"type": "integer", "minimum": 0}, {"type": "string", "format": "date-time"}
_HASH = {"type": "string", "pattern": "^[0-9a-f]{64}$"}
SCHEMA = {
    "type": "object",
    "required": ["manifest_version", "organization_id", "install_id", "source_id", "native_path", "gather", "source_hash", "shipped_hash", "payload_size", "artifact_class", "sealed_at", "client"],
    "additionalProperties": False,
    "properties": {
        "manifest_version": {"enum": [1]},
        "organization_id": _TEXT,
        "install_id": {"type": "string", "pattern": "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"},
        "source_id": _ID,
        "source_family": _ID,
        "native_path": _TEXT,
        "gather": {"enum": ["account", "file_glob", "dir_tree", "snapshot_dir", "sidecar", "compressed_file", "hook_spool_dir", "metadata_only"]},
        "artifact_class": {"enum": ["trajectory", "context"]},
        "source_hash": _HASH,
        "shipped_hash": _HASH,
        "payload_size": _SIZE,
        "payload_mtime": _TIME,
        "agent_version": {"type": "string"},
        "shape_sniff": {"enum": ["ok", "empty", "unexpected_shape", "unreadable"]},
        "redaction": {
            "type": "object",
            "required": ["density"],
            "additionalProperties": False,
            "properties": {
                "density": {"type": "number", "minimum": 0, "maximum": 1},
                "rule_hits": {"type": "object", "propertyNames": _ID, "additionalProperties": {"type": "integer", "minimum": 1}},
                "scan_mode": {"enum": ["decoded_json_values", "raw_text", "mixed"]},
            },
        },
        "client": {"type": "object", "required": ["version"], "additionalProperties": False, "properties": {"version": _TEXT, "commit": {"type": "string"}, "os": {"type": "string"}, "arch": {"type": "string"}}},
        "config_version": {"type": "integer", "minimum": 1},
        "sealed_at": _TIME,
        "run_id": {"type": "string", "pattern": "^[0-9a-f]{16}$"},
        "derived": {"type": "boolean"},
        "enricher": {"type": "object", "required": ["id", "version"], "additionalProperties": False, "properties": {"id": _ID, "version": {"type": "integer", "minimum": 1}}},
        "derived_from": {"type": "array", "items": _HASH},
        "enrich_status": {"enum": ["ok", "skipped", "mismatch", "error"]},
        "enrich_mismatches": _SIZE,
        "enrich_repeats": _SIZE,
        "enrich_tail": _SIZE,
        "enrich_ambiguous": _SIZE,
        "db_provenance": {
            "type": "object",
            "additionalProperties": False,
            "properties": {"db_path": {"type": "string"}, "read_method": {"enum": ["readonly_open", "scratch_snapshot", "cold_copy"]}, "keyspaces": {"type": "array", "items": {"type": "string"}}, "rows_read": _SIZE},
        },
    },
    "allOf": [{"if": {"derived": ["true"]}, "then": {"required": ["enricher", "derived_from", "enrich_status"]}}],
}
# End of the fixed values.


def assembled(**fields: Column) -> Column:
    """A manifest (JSON) of named columns, in the schema's order; what is null is left out. Fields that the schema doesn't know are an error."""
    unknown = set(fields) - set(SCHEMA["properties"])
    if unknown:
        raise ValueError(f"no fields of a manifest: {sorted(unknown)}")
    named = {"manifest_version": F.lit(1), **fields}
    return F.to_json(F.struct(*[named[k].alias(k) for k in SCHEMA["properties"] if k in named]))


def instant(at: Column) -> Column:
    """A time as manifests have it, in UTC."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def faults(manifest: Column) -> Column:
    """Array of (path, rule): what is wrong with a manifest; one that isn't JSON breaks the rule of that name."""
    parsed = F.try_parse_json(manifest)
    broken = F.array(F.struct(F.lit("$").alias("path"), F.lit("JSON").alias("rule")))
    return F.when(parsed.isNull(), broken).otherwise(catalog.violations(parsed, SCHEMA))


def refused(objects: DataFrame, manifest: str = "manifest") -> Column:
    """Why an object may not ship: its manifest's faults as one text, null if it has none."""
    found = F.transform(faults(objects[manifest]), lambda x: F.concat_ws(": ", x["path"], x["rule"]))
    return F.when(F.size(found) > 0, F.concat(F.lit("manifest: "), F.array_join(found, ", ")))

