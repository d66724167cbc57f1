"""DuckDB texts of the fact tables, written apart from mapping.py so that each checks the other."""

from __future__ import annotations

import re

_FP = "'sha256:' || sha256({})"
_Q = "CASE WHEN {0} % 7 = 0 THEN 'stale' ELSE 'fresh' END AS freshness, CASE WHEN {0} % 5 = 0 THEN 'partial' ELSE 'complete' END AS completeness"


def _symbol(table: str, key: str, unit: str, component: str, language: str, kind: str, name: str, qualified: str, owner: str, applied: str) -> str:
    k = f"{key}::BIGINT"
    return (
        f"SELECT '{table}:' || {key} AS symbol_id, {unit} AS source_unit_id, {component} AS component_id, {language} AS language, {kind} AS kind, {name} AS name, {qualified} AS qualified_name, "
        f"{owner} AS owner, CASE WHEN {key} % 6 = 0 THEN ['private'] ELSE []::VARCHAR[] END AS modifiers, {applied} AS applied_symbols, {k} * 100 AS decl_start, {k} * 100 + 100 + {k} % 3 * 100 AS decl_end, "
        f"{k} * 100 + 10 AS name_start, {k} * 100 + 20 AS name_end, {_Q.format(key)}, 'backend-' || ({key} % 3) AS backend FROM {table}"
    )


def _k2(key: str) -> str:
    return f"CASE WHEN {key} % 2 = 0 THEN 'kotlin' ELSE 'java' END"


_NONE = "[]::VARCHAR[]"
_SYMBOLS = " UNION ALL ".join(
    [
        _symbol("region", "r_regionkey", "'unit:region'", "'geo'", "'kotlin'", "'interface'", "r_name", "'geo.' || r_name", "NULL::VARCHAR", _NONE),
        _symbol("nation", "n_nationkey", "'unit:nation'", "'geo'", _k2("n_nationkey"), "'class'", "n_name", "'geo.' || n_name", "'region:' || n_regionkey", _NONE),
        _symbol("customer", "c_custkey", "'unit:customer:' || c_nationkey", "c_mktsegment", _k2("c_custkey"), "CASE c_custkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'method' ELSE 'function' END", "c_name", "'customer.' || c_mktsegment || '.' || c_name", "'nation:' || c_nationkey", "['type:' || lower(c_mktsegment)]"),
        _symbol("supplier", "s_suppkey", "'unit:supplier:' || s_nationkey", "'supply'", "'java'", "CASE WHEN s_suppkey % 2 = 0 THEN 'constructor' ELSE 'class' END", "s_name", "'supplier.' || s_name", "'nation:' || s_nationkey", _NONE),
        _symbol("part", "p_partkey", "'unit:' || p_brand", "p_brand", "'java'", "'class'", "p_name", "CASE WHEN p_partkey % 9 <> 0 THEN 'part.' || p_brand || '.' || p_name END", "NULL::VARCHAR", "['type:size' || (p_size % 5), 'type:part']"),
    ]
)

FACTS: dict[str, str] = {
    "f_units": f"SELECT 'doc:' || doc_id AS source_unit_id, source AS component_id, source || '/' || doc_id || '.txt' AS workspace_path, lang AS language, CASE WHEN doc_id % 10 = 0 THEN 'generated' ELSE 'source' END AS origin, {_FP.format('text')} AS content_fp, {_FP.format('source')} AS context_fp, {_FP.format('left(text, 100)')} AS public_api_fp, 'backend-' || (doc_id % 3) AS backend, CASE WHEN doc_id % 5 = 0 THEN 'partial' ELSE 'complete' END AS completeness, doc_id, text FROM documents",
    "f_old": f"SELECT 'doc:' || doc_id AS source_unit_id, {_FP.format('text')} || CASE WHEN doc_id % 7 = 0 THEN '-old' ELSE '' END AS content_fp, {_FP.format('source')} || CASE WHEN doc_id % 17 = 0 THEN '-old' ELSE '' END AS context_fp, CASE WHEN doc_id % 19 = 0 THEN 'b0' ELSE 'b1' END AS backend, CASE WHEN doc_id % 23 = 0 THEN 'x' ELSE 'y' END AS options FROM documents WHERE doc_id % 11 <> 2",
    "f_now": f"SELECT 'doc:' || doc_id AS source_unit_id, {_FP.format('text')} AS content_fp, {_FP.format('source')} AS context_fp, 'b1' AS backend, 'y' AS options FROM documents WHERE doc_id % 13 <> 3",
    "f_symbols": _SYMBOLS,
    "f_hier": "SELECT 'unit:nation' AS source_unit_id, 'nation:' || n_nationkey AS subtype, 'region:' || n_regionkey AS supertype FROM nation UNION ALL SELECT 'unit:customer', 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'unit:supplier', 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'unit:cycle', 'region:0', 'nation:0' UNION ALL SELECT 'unit:twice', 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation WHERE n_nationkey < 5",
    "f_refs": "SELECT DISTINCT 'order:' || l_orderkey AS source_unit_id, l_linenumber::BIGINT AS start_byte, l_linenumber::BIGINT + 1 AS end_byte, 'reference' AS kind, 'part:' || l_partkey AS target FROM lineitem",
    "f_calls": "SELECT DISTINCT 'order:' || l_orderkey AS source_unit_id, l_linenumber::BIGINT AS start_byte, l_linenumber::BIGINT + 1 AS end_byte, 'call' AS kind, 'supplier:' || l_suppkey AS target, 'customer:' || o_custkey AS caller FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "f_apps": "SELECT 'app:' || event_id AS application_id, 'customer:' || user_id AS subject, 'type:' || event_type AS target FROM events UNION ALL SELECT 'outer:' || s_suppkey, 'nation:' || s_nationkey, 'type:outer' FROM supplier",
    "f_args": "SELECT 'app:' || event_id AS application_id, 'k' AS name, 'integer' AS value_kind, json_extract_string(props, '$.k') AS value_text FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL UNION ALL SELECT 'outer:' || s_suppkey, 'rank', 'integer', (s_suppkey % 5)::VARCHAR FROM supplier",
    "f_pieces": r"SELECT doc_id, text, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, text, regexp_extract_all(text, '([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)') AS p FROM documents)",
    "f_terms": r"SELECT doc_id, text, piece AS term, stop - strlen(piece) AS start_byte, stop AS end_byte FROM (SELECT doc_id, text, piece, sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS stop FROM f_pieces) WHERE regexp_matches(piece, '^[\p{L}\p{N}_]+$')",
    "f_occ": "SELECT 'doc:' || doc_id AS source_unit_id, start_byte, end_byte, 'reference' AS kind, 'word:' || lower(term) AS target, CASE WHEN strlen(term) >= 6 THEN 'type:' || strlen(term) END AS type_id FROM f_terms UNION ALL SELECT 'doc:' || doc_id, 0, strlen(text)::BIGINT, 'declaration', NULL, 'type:text' FROM documents",
    "f_diag": "SELECT 'doc:' || doc_id AS source_unit_id, 'error' AS severity, 'text.toxic' AS code FROM labels WHERE toxic = 1 UNION ALL SELECT 'doc:' || doc_id, 'warning', 'text.quality' FROM labels WHERE quality = 0",
    "f_types": "SELECT DISTINCT 'unit:' || p_brand AS source_unit_id, 'type:' || p_type AS type_id, p_type AS display FROM part",
    "f_loc": "SELECT 'artifact:' || (p_partkey % 50) AS source_unit_id, 'part.' || p_brand || '.' || p_name AS qualified_name, 'part:' || p_partkey AS symbol_id FROM part WHERE p_partkey % 9 <> 0",
    "f_art": "SELECT 'artifact:' || (s_suppkey - 1) AS source_unit_id, s_name AS locator, CASE WHEN s_suppkey % 4 = 0 THEN 'id-' || s_name || '-old' ELSE 'id-' || s_name END AS identity FROM supplier WHERE s_suppkey <= 60",
    "f_art_now": "SELECT 'artifact:' || (s_suppkey - 1) AS source_unit_id, 'id-' || s_name AS identity FROM supplier WHERE s_suppkey > 5 AND s_suppkey <= 70",
    "f_cat": "SELECT DISTINCT sha256(text) AS blob_key, strlen(text)::BIGINT AS byte_length FROM documents WHERE doc_id % 10 <> 4",
    "f_blob_refs": "SELECT 'doc:' || doc_id AS source_unit_id, sha256(text) AS blob_key FROM documents",
    "f_files": "SELECT blob_key, CASE WHEN m % 8 = 0 THEN n + 1 ELSE n END AS file_length FROM (SELECT sha256(text) AS blob_key, min(doc_id) AS m, max(strlen(text))::BIGINT AS n FROM documents GROUP BY 1) WHERE m % 6 <> 1",
    "f_in_old": f"SELECT page_id || '#' || url AS workspace_path, {_FP.format('html')} || CASE WHEN page_id % 7 = 0 THEN '-old' ELSE '' END AS fingerprint, regexp_extract(url, 'https?://([^/]+)', 1) AS component_id FROM pages WHERE page_id % 11 <> 2",
    "f_in_now": f"SELECT page_id || '#' || url AS workspace_path, {_FP.format('html')} AS fingerprint, regexp_extract(url, 'https?://([^/]+)', 1) AS component_id FROM pages WHERE page_id % 13 <> 3",
    "f_states": "SELECT coalesce(n.workspace_path, o.workspace_path) AS workspace_path, CASE WHEN o.workspace_path IS NULL THEN 'added' WHEN n.workspace_path IS NULL THEN 'missing' WHEN o.fingerprint <> n.fingerprint THEN 'changed' ELSE 'current' END AS state, o.fingerprint AS persisted_fp, n.fingerprint AS current_fp, coalesce(n.component_id, o.component_id) AS component_id FROM f_in_now n FULL JOIN f_in_old o ON n.workspace_path = o.workspace_path",
}


def sql(body: str) -> str:
    """body with the fact tables it names, and those they name, before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in FACTS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(FACTS[name])
                needed.append(name)

    need(body)
    if not needed:
        return body
    ctes = ", ".join(f"{name} AS ({FACTS[name]})" for name in needed)
    recursive = "WITH RECURSIVE" if "WITH RECURSIVE" in body else "WITH"
    body = body.removeprefix("WITH RECURSIVE ").removeprefix("WITH ")
    joined = f"{ctes}, {body}" if re.match(r"\w+(\([^)]*\))? AS \(", body) else f"{ctes} {body}"
    return f"{recursive} {joined}"
