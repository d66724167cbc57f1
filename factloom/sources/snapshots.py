"""Snapshots as JSON lines: one object a source unit with its facts, provenance by index, edges by occurrence position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.schema import FactError

_PROV = "STRUCT<backend:STRING,backend_version:STRING,protocol_version:INT,analysis_options:STRING>"
_RANGE = "STRUCT<start:BIGINT,end:BIGINT>"
_STATE = "freshness:STRING,completeness:STRING,provenance:INT"
SCHEMA = (
    "source_unit STRUCT<id:STRING,component:STRING,path:STRING,language:STRING,origin:STRING,content:STRING,context:STRING>,"
    f" public_api_fingerprint STRING, completeness STRING, provenances ARRAY<{_PROV}>,"
    f" symbols ARRAY<STRUCT<id:STRING,language:STRING,kind:STRING,name:STRING,qualified_name:STRING,signature:STRING,owner:STRING,modifiers:ARRAY<STRING>,applied_symbols:ARRAY<STRING>,declaration:{_RANGE},name_range:{_RANGE},{_STATE}>>,"
    f" occurrences ARRAY<STRUCT<range:{_RANGE},kind:STRING,enclosing_symbol:STRING,target:STRING,type_id:STRING,precision:STRING,{_STATE}>>,"
    " references ARRAY<STRUCT<occurrence:INT,target:STRING,precision:STRING>>,"
    " calls ARRAY<STRUCT<occurrence:INT,target:STRING,caller:STRING,precision:STRING>>,"
    " hierarchy ARRAY<STRUCT<subtype:STRING,supertype:STRING,precision:STRING,provenance:INT>>,"
    f" applications ARRAY<STRUCT<id:STRING,subject:STRING,target:STRING,range:{_RANGE},arguments:ARRAY<STRUCT<name:STRING,position:INT,value_kind:STRING,value_text:STRING>>,precision:STRING,{_STATE}>>,"
    f" types ARRAY<STRUCT<id:STRING,language:STRING,display:STRING,{_STATE}>>,"
    f" diagnostics ARRAY<STRUCT<range:{_RANGE},severity:STRING,code:STRING,message:STRING,{_STATE}>>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def _prov(i: Column) -> Column:
    """Provenance by index from 0; without one the snapshot's own, which is the first."""
    return F.get(F.col("provenances"), F.coalesce(i, F.lit(0)))


def _exploded(snapshots: DataFrame, name: str) -> DataFrame:
    return snapshots.select(F.col("source_unit.id").alias("source_unit_id"), F.col("source_unit.component").alias("component_id"), "provenances", "occurrences", F.explode(name).alias("x"))


def _state() -> list[Column]:
    return [F.col("x.freshness").alias("freshness"), F.col("x.completeness").alias("completeness"), _prov(F.col("x.provenance")).alias("provenance")]


def _occurrence(o: Column) -> list[Column]:
    names = {"start_byte": o["range"]["start"], "end_byte": o["range"]["end"], "kind": o["kind"], "enclosing_symbol": o["enclosing_symbol"], "type_id": o["type_id"]}
    state = {"freshness": o["freshness"], "completeness": o["completeness"], "provenance": _prov(o["provenance"])}
    return [c.alias(n) for n, c in (names | state).items()]


def decode(snapshots: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(source units, fact tables) of snapshots; an edge whose occurrence is not listed is an error."""
    lost = lambda name: F.exists(name, lambda e: (e["occurrence"] < 0) | (e["occurrence"] >= F.size("occurrences")))
    if bad := snapshots.where(lost("references") | lost("calls")).select("source_unit.id").limit(1).collect():
        raise FactError(f"{bad[0].id}: an edge names an occurrence that is not there")
    s = F.col("source_unit")
    units = snapshots.select(
        s["id"].alias("source_unit_id"), s["component"].alias("component_id"), s["path"].alias("workspace_path"), s["language"].alias("language"), s["origin"].alias("origin"),
        s["content"].alias("content_fp"), s["context"].alias("context_fp"), F.col("public_api_fingerprint").alias("public_api_fp"), _prov(F.lit(0)).alias("provenance"), "completeness",
    )
    x = F.col("x")
    symbols = _exploded(snapshots, "symbols").select(
        x["id"].alias("symbol_id"), "source_unit_id", "component_id", *(x[n].alias(n) for n in ("language", "kind", "name", "qualified_name", "signature", "owner", "modifiers", "applied_symbols")),
        x["declaration"]["start"].alias("decl_start"), x["declaration"]["end"].alias("decl_end"), x["name_range"]["start"].alias("name_start"), x["name_range"]["end"].alias("name_end"), *_state(),
    )
    occurrences = _exploded(snapshots, "occurrences").select("source_unit_id", *_occurrence(x), x["target"].alias("target"), x["precision"].alias("precision"))
    edge = lambda name, *more: _exploded(snapshots, name).select("source_unit_id", *_occurrence(F.get("occurrences", x["occurrence"])), x["target"].alias("target"), x["precision"].alias("precision"), *more)
    applications = _exploded(snapshots, "applications")
    tables = {
        "symbols": symbols,
        "occurrences": occurrences,
        "reference_edges": edge("references"),
        "call_edges": edge("calls", x["caller"].alias("caller")),
        "hierarchy_edges": _exploded(snapshots, "hierarchy").select("source_unit_id", x["subtype"].alias("subtype"), x["supertype"].alias("supertype"), x["precision"].alias("precision"), _prov(x["provenance"]).alias("provenance")),
        "applications": applications.select(x["id"].alias("application_id"), "source_unit_id", x["subject"].alias("subject"), x["target"].alias("target"), x["range"]["start"].alias("start_byte"), x["range"]["end"].alias("end_byte"), x["precision"].alias("precision"), *_state()),
        "application_arguments": applications.select(x["id"].alias("application_id"), F.explode(x["arguments"]).alias("a")).select("application_id", "a.*"),
        "types": _exploded(snapshots, "types").select("source_unit_id", x["id"].alias("type_id"), x["language"].alias("language"), x["display"].alias("display"), *_state()),
        "diagnostics": _exploded(snapshots, "diagnostics").select("source_unit_id", x["range"]["start"].alias("start_byte"), x["range"]["end"].alias("end_byte"), x["severity"].alias("severity"), x["code"].alias("code"), x["message"].alias("message"), *_state()),
    }
    return units, tables


def _span(a: str, b: str) -> Column:
    return F.when(F.col(a).isNotNull(), F.struct(F.col(a).alias("start"), F.col(b).alias("end")))


def _named(*names: str, **other: Column | str) -> list[Column]:
    return [*(F.col(n) for n in names), *((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in other.items())]


#: Fact tables beside occurrences and edges: (field, its values but for the provenance, their order).
_PARTS = {
    "symbols": ("symbols", lambda: _named(
        "language", "kind", "name", "qualified_name", "signature", "owner", "modifiers", "applied_symbols", "freshness", "completeness",
        id="symbol_id", declaration=_span("decl_start", "decl_end"), name_range=_span("name_start", "name_end")), ["name_start", "symbol_id"]),
    "hierarchy_edges": ("hierarchy", lambda: _named("subtype", "supertype", "precision"), ["subtype", "supertype"]),
    "applications": ("applications", lambda: _named("subject", "target", "arguments", "precision", "freshness", "completeness", id="application_id", range=_span("start_byte", "end_byte")), ["start_byte", "application_id"]),
    "types": ("types", lambda: _named("language", "display", "freshness", "completeness", id="type_id"), ["type_id"]),
    "diagnostics": ("diagnostics", lambda: _named("severity", "code", "message", "freshness", "completeness", range=_span("start_byte", "end_byte")), ["start_byte", "message"]),
}


def encode(units: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Snapshots in the shape that read() takes: one row a unit, the provenance dictionary and occurrence positions.

    The dictionary is the unit's own provenance and then the others' in order; an edge names its occurrence's place. All
    tables that decode() gives go in: tables that are not given are left out.
    """
    prov = "STRUCT<backend:STRING,backend_version:STRING,protocol_version:INT,analysis_options:STRING>"
    state = lambda: [F.col("freshness").alias("freshness"), F.col("completeness").alias("completeness")]
    span = lambda a, b: F.struct(F.col(a).alias("start"), F.col(b).alias("end"))
    place = F.struct("start_byte", "end_byte", "kind", F.coalesce("target", F.lit("")).alias("t"))
    occ = facts["occurrences"]
    used = units.select("source_unit_id", "provenance")
    for name in ("occurrences", *_PARTS):
        used = used.unionByName(facts[name].select("source_unit_id", "provenance")) if name in facts else used
    used = used.where("provenance is not null")
    others = used.groupBy("source_unit_id").agg(F.array_sort(F.collect_set("provenance")).alias("all"))
    base = units.join(others, "source_unit_id", "left").withColumn("provenances", F.concat(F.array(F.col("provenance").cast(prov)), F.array_except(F.coalesce("all", F.array().cast(f"array<{prov}>")), F.array("provenance"))))
    listed = occ.groupBy("source_unit_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.struct(span("start_byte", "end_byte").alias("range"), "kind", "enclosing_symbol", "target", "type_id", "precision", *state(), "provenance").alias("o")))).alias("occ"))
    out = base.join(listed, "source_unit_id", "left")
    for name, extra in (("references", ()), ("calls", ("caller",))):
        table = {"references": "reference_edges", "calls": "call_edges"}[name]
        if table in facts:
            grouped = facts[table].groupBy("source_unit_id").agg(F.collect_list(F.struct(place.alias("place"), "target", *extra, "precision")).alias(name))
            out = out.join(grouped, "source_unit_id", "left")
    index = lambda p: (F.array_position("provenances", p) - 1).cast("int")
    places = F.transform("occ", lambda x: x["place"])
    plain = F.transform("occ", lambda x: x["o"].withField("provenance", index(x["o"]["provenance"])))
    edge = lambda name: F.transform(name, lambda e: e.dropFields("place").withField("occurrence", (F.array_position(places, e["place"]) - 1).cast("int")))
    unit = F.struct(F.col("source_unit_id").alias("id"), F.col("component_id").alias("component"), F.col("workspace_path").alias("path"), "language", "origin", F.col("content_fp").alias("content"), F.col("context_fp").alias("context"))
    edges = [edge(n).alias(n) for n in ("references", "calls") if n in out.columns]
    for name, (field, value, order) in _PARTS.items():
        if name in facts:
            rows = facts[name]
            if name == "applications":
                given = F.array_sort(F.collect_list(F.struct("position", "name", "value_kind", "value_text")))
                arguments = F.transform(given, lambda a: F.struct(a["name"].alias("name"), a["position"].alias("position"), a["value_kind"].alias("value_kind"), a["value_text"].alias("value_text")))
                rows = rows.join(facts["application_arguments"].groupBy("application_id").agg(arguments.alias("arguments")), "application_id", "left")
            parts = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*value(), F.col("provenance")).alias("v"))))
            out = out.join(rows.groupBy("source_unit_id").agg(parts.alias(field)), "source_unit_id", "left")
            edges.append(F.transform(field, lambda x: x["v"].withField("provenance", index(x["v"]["provenance"]))).alias(field))
    return out.select(unit.alias("source_unit"), F.col("public_api_fp").alias("public_api_fingerprint"), "completeness", "provenances", plain.alias("occurrences"), *edges)


def page(rows: DataFrame, key: str, after: str | None, most: int) -> tuple[DataFrame, str | None]:
    """(rows of a page, the cursor of the next or null), by key; 1 to 64 rows."""
    if not 1 <= most <= 64:
        raise ValueError("a page is 1 to 64 rows")
    rest = rows.where(F.col(key) > after) if after is not None else rows
    found = rest.orderBy(key).limit(most)
    keys = [r[0] for r in found.select(key).collect()]
    return found, keys[-1] if len(keys) == most else None
