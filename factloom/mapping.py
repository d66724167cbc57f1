"""Fact tables made from the driver's tables, so that every operator has rows and an oracle."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.digest import fingerprint
from factloom.functions.text import terms


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def _quality(key: str) -> list[Column]:
    k = F.col(key)
    return [F.when(k % 7 == 0, "stale").otherwise("fresh").alias("freshness"), F.when(k % 5 == 0, "partial").otherwise("complete").alias("completeness")]


def _provenance(key: Column) -> Column:
    return F.struct(
        F.concat(F.lit("backend-"), (key % 3).cast("string")).alias("backend"), F.lit("1.0").alias("backend_version"), F.lit(3).alias("protocol_version"), F.lit("opts").alias("analysis_options")
    )


class Facts(Mapping[str, DataFrame]):
    """Fact tables by name, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = _MAKERS[name](self)
        return self._made[name]

    def __contains__(self, name: object) -> bool:
        return name in _MAKERS

    def __iter__(self):  # noqa: ANN204
        return iter(_MAKERS)

    def __len__(self) -> int:
        return len(_MAKERS)


def _units(f: Facts) -> DataFrame:
    d, k = f.raw("documents"), F.col("doc_id")
    return d.select(
        _id("doc", "doc_id").alias("source_unit_id"), F.col("source").alias("component_id"), F.concat_ws("/", "source", F.concat(k.cast("string"), F.lit(".txt"))).alias("workspace_path"),
        F.col("lang").alias("language"), F.when(k % 10 == 0, "generated").otherwise("source").alias("origin"), fingerprint(F.col("text")).alias("content_fp"), fingerprint(F.col("source")).alias("context_fp"),
        fingerprint(F.substring("text", 1, 100)).alias("public_api_fp"), _provenance(k).alias("provenance"), F.when(k % 5 == 0, "partial").otherwise("complete").alias("completeness"),
    )


def _persisted_units(f: Facts) -> DataFrame:
    d, k = f.raw("documents").where("doc_id % 11 <> 2"), F.col("doc_id")
    return d.select(
        _id("doc", "doc_id").alias("source_unit_id"), F.concat(fingerprint(F.col("text")), F.when(k % 7 == 0, "-old").otherwise("")).alias("content_fp"),
        F.concat(fingerprint(F.col("source")), F.when(k % 17 == 0, "-old").otherwise("")).alias("context_fp"), F.when(k % 19 == 0, "b0").otherwise("b1").alias("backend"),
        F.lit("1").alias("backend_version"), F.lit(3).alias("protocol_version"), F.when(k % 23 == 0, "x").otherwise("y").alias("analysis_options"),
        F.concat(fingerprint(F.substring("text", 1, 100)), F.when(k % 29 == 0, "-old").otherwise("")).alias("public_api_fp"),
    )


def _current_units(f: Facts) -> DataFrame:
    d = f.raw("documents").where("doc_id % 13 <> 3")
    return d.select(
        _id("doc", "doc_id").alias("source_unit_id"), fingerprint(F.col("text")).alias("content_fp"), fingerprint(F.col("source")).alias("context_fp"), F.lit("b1").alias("backend"),
        F.lit("1").alias("backend_version"), F.lit(3).alias("protocol_version"), F.lit("y").alias("analysis_options"), fingerprint(F.substring("text", 1, 100)).alias("public_api_fp"),
    )


def _symbols(f: Facts) -> DataFrame:
    none, no = F.array().cast("array<string>"), F.lit(None).cast("string")

    def rows(table: str, key: str, unit: Column, component: Column, language: Column, kind: Column, name: str, qualified: Column, owner: Column, applied: Column) -> DataFrame:
        k = F.col(key).cast("long")
        return f.raw(table).select(
            _id(table, key).alias("symbol_id"), unit.alias("source_unit_id"), component.alias("component_id"), language.alias("language"), kind.alias("kind"), F.col(name).alias("name"),
            qualified.alias("qualified_name"), owner.alias("owner"), F.when(k % 6 == 0, F.array(F.lit("private"))).otherwise(none).alias("modifiers"), applied.alias("applied_symbols"),
            (k * 100).alias("decl_start"), (k * 100 + 100 + k % 3 * 100).alias("decl_end"), (k * 100 + 10).alias("name_start"), (k * 100 + 20).alias("name_end"), *_quality(key), _provenance(k).alias("provenance"),
        )

    k2 = lambda c: F.when(F.col(c) % 2 == 0, "kotlin").otherwise("java")
    kinds = F.when(F.col("c_custkey") % 4 == 0, "class").when(F.col("c_custkey") % 4 == 1, "interface").when(F.col("c_custkey") % 4 == 2, "method").otherwise("function")
    parts = [
        rows("region", "r_regionkey", F.lit("unit:region"), F.lit("geo"), F.lit("kotlin"), F.lit("interface"), "r_name", F.concat(F.lit("geo."), F.col("r_name")), no, none),
        rows("nation", "n_nationkey", F.lit("unit:nation"), F.lit("geo"), k2("n_nationkey"), F.lit("class"), "n_name", F.concat(F.lit("geo."), F.col("n_name")), _id("region", "n_regionkey"), none),
        rows("customer", "c_custkey", _id("unit:customer", "c_nationkey"), F.col("c_mktsegment"), k2("c_custkey"), kinds, "c_name", F.concat_ws(".", F.lit("customer"), "c_mktsegment", "c_name"), _id("nation", "c_nationkey"), F.array(F.concat(F.lit("type:"), F.lower("c_mktsegment")))),
        rows("supplier", "s_suppkey", _id("unit:supplier", "s_nationkey"), F.lit("supply"), F.lit("java"), F.when(F.col("s_suppkey") % 2 == 0, "constructor").otherwise("class"), "s_name", F.concat_ws(".", F.lit("supplier"), "s_name"), _id("nation", "s_nationkey"), none),
        rows("part", "p_partkey", F.concat(F.lit("unit:"), F.col("p_brand")), F.col("p_brand"), F.lit("java"), F.lit("class"), "p_name", F.when(F.col("p_partkey") % 9 != 0, F.concat_ws(".", F.lit("part"), "p_brand", "p_name")), no, F.array(F.concat(F.lit("type:size"), (F.col("p_size") % 5).cast("string")), F.lit("type:part"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def _hierarchy(f: Facts) -> DataFrame:
    edge = lambda table, key, parent, to: f.raw(table).select(F.lit(f"unit:{table}").alias("source_unit_id"), _id(table, key).alias("subtype"), _id(parent, to).alias("supertype"), F.lit("exact").alias("precision"))
    back = f.spark.range(1).select(F.lit("unit:cycle").alias("source_unit_id"), F.lit("region:0").alias("subtype"), F.lit("nation:0").alias("supertype"), F.lit("exact").alias("precision"))
    twice = f.raw("nation").where("n_nationkey < 5").select(F.lit("unit:twice").alias("source_unit_id"), _id("nation", "n_nationkey").alias("subtype"), _id("region", "n_regionkey").alias("supertype"), F.lit("exact").alias("precision"))
    return reduce(DataFrame.unionByName, [edge("nation", "n_nationkey", "region", "n_regionkey"), edge("customer", "c_custkey", "nation", "c_nationkey"), edge("supplier", "s_suppkey", "nation", "s_nationkey"), back, twice])


def _references(f: Facts) -> DataFrame:
    return f.raw("lineitem").select(_id("order", "l_orderkey").alias("source_unit_id"), F.col("l_linenumber").cast("long").alias("start_byte"), (F.col("l_linenumber") + 1).cast("long").alias("end_byte"), F.lit("reference").alias("kind"), _id("part", "l_partkey").alias("target")).distinct()


def _calls(f: Facts) -> DataFrame:
    joined = f.raw("lineitem").join(f.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(_id("order", "l_orderkey").alias("source_unit_id"), F.col("l_linenumber").cast("long").alias("start_byte"), (F.col("l_linenumber") + 1).cast("long").alias("end_byte"), F.lit("call").alias("kind"), _id("supplier", "l_suppkey").alias("target"), _id("customer", "o_custkey").alias("caller")).distinct()


def _applications(f: Facts) -> DataFrame:
    inner = f.raw("events").select(_id("app", "event_id").alias("application_id"), F.lit("unit:events").alias("source_unit_id"), _id("customer", "user_id").alias("subject"), F.concat(F.lit("type:"), F.col("event_type")).alias("target"), (F.col("event_id") * 10).alias("start_byte"), (F.col("event_id") * 10 + 9).alias("end_byte"))
    outer = f.raw("supplier").select(_id("outer", "s_suppkey").alias("application_id"), F.lit("unit:suppliers").alias("source_unit_id"), _id("nation", "s_nationkey").alias("subject"), F.lit("type:outer").alias("target"), (F.col("s_suppkey") * 10).alias("start_byte"), (F.col("s_suppkey") * 10 + 9).alias("end_byte"))
    return inner.unionByName(outer)


def _arguments(f: Facts) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    inner = f.raw("events").where(k.isNotNull()).select(_id("app", "event_id").alias("application_id"), F.lit("k").alias("name"), F.lit(0).alias("position"), F.lit("integer").alias("value_kind"), k.alias("value_text"))
    outer = f.raw("supplier").select(_id("outer", "s_suppkey").alias("application_id"), F.lit("rank").alias("name"), F.lit(0).alias("position"), F.lit("integer").alias("value_kind"), (F.col("s_suppkey") % 5).cast("string").alias("value_text"))
    return inner.unionByName(outer)


def _texts(f: Facts) -> DataFrame:
    return f.raw("documents").select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("workspace_path"), fingerprint(F.col("text")).alias("content_fp"), F.col("text").alias("content"))


def _occurrences(f: Facts) -> DataFrame:
    """Terms of documents, and each line around them as a declaration; long terms have a type."""
    texts = f.raw("documents").select(_id("doc", "doc_id").alias("source_unit_id"), F.col("text").alias("content"))
    words = terms(texts, "source_unit_id").select(
        "source_unit_id", "start_byte", "end_byte", F.lit("reference").alias("kind"), F.concat(F.lit("word:"), F.lower("term")).alias("target"),
        F.when(F.octet_length("term") >= 6, F.concat(F.lit("type:"), F.octet_length("term").cast("string"))).alias("type_id"),
    )
    whole = texts.select("source_unit_id", F.lit(0).cast("long").alias("start_byte"), F.octet_length("content").cast("long").alias("end_byte"), F.lit("declaration").alias("kind"), F.lit(None).cast("string").alias("target"), F.lit("type:text").alias("type_id"))
    return words.unionByName(whole)


def _diagnostics(f: Facts) -> DataFrame:
    labels = f.raw("labels").withColumn("n", F.lit(None).cast("long"))
    one = lambda where, severity, code: labels.where(where).select(_id("doc", "doc_id").alias("source_unit_id"), F.col("n").alias("start_byte"), F.col("n").alias("end_byte"), F.lit(severity).alias("severity"), F.lit(code).alias("code"))
    return one("toxic = 1", "error", "text.toxic").unionByName(one("quality = 0", "warning", "text.quality"))


def _types(f: Facts) -> DataFrame:
    return f.raw("part").select(F.concat(F.lit("unit:"), F.col("p_brand")).alias("source_unit_id"), F.concat(F.lit("type:"), F.col("p_type")).alias("type_id"), F.lit("java").alias("language"), F.col("p_type").alias("display")).distinct()


def _locators(f: Facts) -> DataFrame:
    return f.raw("part").where("p_partkey % 9 <> 0").select(F.concat(F.lit("artifact:"), (F.col("p_partkey") % 50).cast("string")).alias("source_unit_id"), F.concat_ws(".", F.lit("part"), "p_brand", "p_name").alias("qualified_name"), _id("part", "p_partkey").alias("symbol_id"))


def _artifacts(f: Facts) -> DataFrame:
    return f.raw("supplier").where("s_suppkey <= 60").select(F.concat(F.lit("artifact:"), (F.col("s_suppkey") - 1).cast("string")).alias("source_unit_id"), F.lit("supply").alias("component_id"), F.col("s_name").alias("locator"), F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("id-"), F.col("s_name"), F.lit("-old"))).otherwise(F.concat(F.lit("id-"), F.col("s_name"))).alias("identity"))


def _artifacts_now(f: Facts) -> DataFrame:
    return f.raw("supplier").where("s_suppkey > 5 and s_suppkey <= 70").select(F.concat(F.lit("artifact:"), (F.col("s_suppkey") - 1).cast("string")).alias("source_unit_id"), F.concat(F.lit("id-"), F.col("s_name")).alias("identity"))


def _catalog(f: Facts) -> DataFrame:
    return f.raw("documents").where("doc_id % 10 <> 4").select(F.sha2("text", 256).alias("blob_key"), F.octet_length("text").cast("long").alias("byte_length")).distinct()


def _refs(f: Facts) -> DataFrame:
    return f.raw("documents").select(_id("doc", "doc_id").alias("source_unit_id"), F.sha2("text", 256).alias("blob_key"))


def _readable(f: Facts) -> DataFrame:
    d = f.raw("documents")
    return d.groupBy(F.sha2("text", 256).alias("blob_key")).agg(F.min("doc_id").alias("m"), F.max(F.octet_length("text").cast("long")).alias("length")).where("m % 6 <> 1").select("blob_key", F.when(F.col("m") % 8 == 0, F.col("length") + 1).otherwise(F.col("length")).alias("length"))


def _inputs(f: Facts, where: str, old: bool) -> DataFrame:
    fp = fingerprint(F.col("html"))
    fp = F.when(F.col("page_id") % 7 == 0, F.concat(fp, F.lit("-old"))).otherwise(fp) if old else fp
    host = F.regexp_extract("url", "https?://([^/]+)", 1)
    return f.raw("pages").where(where).select(F.concat_ws("#", F.col("page_id").cast("string"), "url").alias("workspace_path"), fp.alias("fingerprint"), F.array(host).alias("components"))


_MAKERS: dict[str, Callable[[Facts], DataFrame]] = {
    "source_units": _units,
    "persisted_units": _persisted_units,
    "current_units": _current_units,
    "symbols": _symbols,
    "hierarchy_edges": _hierarchy,
    "reference_edges": _references,
    "call_edges": _calls,
    "applications": _applications,
    "application_arguments": _arguments,
    "occurrences": _occurrences,
    "diagnostics": _diagnostics,
    "types": _types,
    "text_documents": _texts,
    "text_terms": lambda f: terms(_texts(f), "workspace_path"),
    "symbol_locators": _locators,
    "artifacts": _artifacts,
    "current_artifacts": _artifacts_now,
    "blob_catalog": _catalog,
    "blob_refs": _refs,
    "readable_blobs": _readable,
    "persisted_inputs": lambda f: _inputs(f, "page_id % 11 <> 2", True),
    "current_inputs": lambda f: _inputs(f, "page_id % 13 <> 3", False),
}
