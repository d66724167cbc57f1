"""Canonical fact tables: schemas, keys, value domains and the checks that ingestion runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Version written beside stored tables; a store of another version is refused.
FORMAT_VERSION = 1
PROTOCOL_VERSION = 3

_PROVENANCE = "provenance STRUCT<backend:STRING,backend_version:STRING,protocol_version:INT,analysis_options:STRING>"
_QUALITY = f"freshness STRING, completeness STRING, {_PROVENANCE}"
_OCCURRENCE = "source_unit_id STRING, start_byte BIGINT, end_byte BIGINT, kind STRING, enclosing_symbol STRING, target STRING, type_id STRING, precision STRING"

DDL: dict[str, str] = {
    "source_units": f"source_unit_id STRING, component_id STRING, workspace_path STRING, language STRING, origin STRING, content_fp STRING, context_fp STRING, public_api_fp STRING, {_PROVENANCE}, completeness STRING",
    "symbols": f"symbol_id STRING, source_unit_id STRING, component_id STRING, language STRING, kind STRING, name STRING, qualified_name STRING, signature STRING, owner STRING, modifiers ARRAY<STRING>, applied_symbols ARRAY<STRING>, decl_start BIGINT, decl_end BIGINT, name_start BIGINT, name_end BIGINT, backend_key STRUCT<backend:STRING,schema_version:INT,value:STRING>, {_QUALITY}",
    "occurrences": f"{_OCCURRENCE}, {_QUALITY}",
    "reference_edges": f"{_OCCURRENCE}, {_QUALITY}",
    "call_edges": f"{_OCCURRENCE}, caller STRING, {_QUALITY}",
    "hierarchy_edges": f"source_unit_id STRING, subtype STRING, supertype STRING, precision STRING, {_PROVENANCE}",
    "applications": f"application_id STRING, source_unit_id STRING, subject STRING, target STRING, start_byte BIGINT, end_byte BIGINT, precision STRING, {_QUALITY}",
    "application_arguments": "application_id STRING, name STRING, position INT, value_kind STRING, value_text STRING",
    "types": f"source_unit_id STRING, type_id STRING, language STRING, display STRING, backend_key STRUCT<backend:STRING,schema_version:INT,value:STRING>, {_QUALITY}",
    "diagnostics": f"source_unit_id STRING, start_byte BIGINT, end_byte BIGINT, severity STRING, code STRING, message STRING, {_QUALITY}",
    "text_documents": "workspace_path STRING, content_fp STRING, content STRING",
    "text_terms": "workspace_path STRING, term STRING, start_byte BIGINT, end_byte BIGINT",
    "artifacts": "source_unit_id STRING, component_id STRING, locator STRING, content_fp STRING, context_fp STRING, identity STRING",
    "symbol_locators": "source_unit_id STRING, qualified_name STRING, symbol_id STRING",
    "blob_catalog": "blob_key STRING, identity STRING, byte_length BIGINT, created_at TIMESTAMP, accessed_at TIMESTAMP",
    "blob_refs": "source_unit_id STRING, blob_key STRING",
    "configuration_inputs": "workspace_path STRING, fingerprint STRING, components ARRAY<STRING>",
    "source_file_metadata": "path STRING, byte_size BIGINT, modified_nanos DECIMAL(38,0), content_fp STRING",
    "components": "component_id STRING, root STRING, build_system STRING, configuration_fp STRING",
    "dependency_edges": "from_component STRING, scope STRING, target_kind STRING, target_component STRING, target_content STRING",
    "manifests": "workspace_id STRING, manifest_fp STRING, components ARRAY<STRUCT<component_id:STRING,root:STRING>>",
    "checkpoints": "workspace_id STRING, manifest_fp STRING, configuration_fp STRING, source_fp STRING, artifact_catalog_fp STRING, committed BOOLEAN",
}

#: Columns whose values are unique together; nullable members do not collide.
KEYS: dict[str, list[str]] = {
    "source_units": ["source_unit_id"],
    "symbols": ["symbol_id"],
    "occurrences": ["source_unit_id", "start_byte", "end_byte", "kind"],
    "reference_edges": ["source_unit_id", "start_byte", "end_byte", "target"],
    "call_edges": ["source_unit_id", "start_byte", "end_byte", "target"],
    "hierarchy_edges": ["source_unit_id", "subtype", "supertype"],
    "applications": ["application_id"],
    "application_arguments": ["application_id", "position"],
    "types": ["source_unit_id", "type_id"],
    "diagnostics": ["source_unit_id", "start_byte", "end_byte", "severity", "code", "message"],
    "text_documents": ["workspace_path"],
    "text_terms": ["workspace_path", "term", "start_byte"],
    "artifacts": ["source_unit_id"],
    "symbol_locators": ["source_unit_id", "qualified_name", "symbol_id"],
    "blob_catalog": ["blob_key"],
    "blob_refs": ["source_unit_id"],
    "configuration_inputs": ["workspace_path"],
    "source_file_metadata": ["path"],
    "components": ["component_id"],
    "manifests": ["workspace_id"],
    "checkpoints": ["workspace_id"],
}

#: Columns that a stored table is sorted by: files then hold disjoint ranges of the usual lookup's key, and statistics
#: skip all but a few. The later columns part the rows of a hot key over files.
LOOKUP: dict[str, list[str]] = {
    "symbols": ["name", "symbol_id"],
    "occurrences": ["source_unit_id", "start_byte", "end_byte"],
    "reference_edges": ["target", "source_unit_id", "start_byte"],
    "call_edges": ["target", "source_unit_id", "start_byte"],
    "hierarchy_edges": ["supertype", "subtype"],
    "applications": ["target", "subject", "application_id"],
    "application_arguments": ["name", "value_text", "application_id"],
    "text_terms": ["term", "workspace_path", "start_byte"],
    "symbol_locators": ["qualified_name", "symbol_id"],
    "source_units": ["workspace_path", "source_unit_id"],
}

#: Closed value sets.
DOMAINS: dict[str, frozenset[str]] = {
    "origin": frozenset({"source", "generated", "dependency"}),
    "freshness": frozenset({"fresh", "stale", "unknown"}),
    "completeness": frozenset({"complete", "partial"}),
    "severity": frozenset({"error", "warning", "information", "hint"}),
    "value_kind": frozenset({"string", "string_list", "boolean", "integer"}),
}


class FactError(ValueError):
    """Facts that may not be stored."""


def struct(table: str) -> T.StructType:
    return T._parse_datatype_string(DDL[table])  # type: ignore[return-value]


def conform(df: DataFrame, table: str) -> DataFrame:
    """df's columns in the table's order and types; columns it lacks are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(table).fields))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur twice or more, with their count; a key with a null member never collides."""
    whole = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    return df.where(whole).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: list[str], what: str = "rows") -> None:
    if found := duplicates(df, keys).limit(1).collect():
        raise FactError(f"{what}: duplicate key {found[0].asDict()}")


def out_of_domain(df: DataFrame) -> DataFrame:
    """Rows with a value outside its closed set."""
    wrong = [~F.col(c).isin(*sorted(v)) for c, v in DOMAINS.items() if c in df.columns]
    return df.where(reduce(Column.__or__, wrong)) if wrong else df.limit(0)
