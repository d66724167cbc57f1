"""Point, prefix, substring and posting lookups, and the joins that complete them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import ascii_lower

UNIT_ORDER = ("source_unit_id", "name_start", "symbol_id")


def named(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name).orderBy(*UNIT_ORDER)


def name_contains(symbols: DataFrame, part: str) -> DataFrame:
    """Names that hold part, A-Z and a-z alike; % and _ in part are wildcards."""
    pattern = ascii_lower(F.lit("%" + part.replace("\\", "\\\\") + "%"))
    return symbols.where(F.call_function("like", ascii_lower(F.col("name")), pattern)).orderBy(*UNIT_ORDER)


def by_id(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(key) == value)


def of_unit(symbols: DataFrame, unit: str) -> DataFrame:
    return symbols.where(F.col("source_unit_id") == unit).orderBy("name_start", "symbol_id")


def qualified(locators: DataFrame, name: str) -> DataFrame:
    """Symbol ids that dependency locators give a qualified name."""
    return locators.where(F.col("qualified_name") == name).select("symbol_id").orderBy("symbol_id")


def at_path(units: DataFrame, path: str) -> DataFrame:
    return units.where(F.col("workspace_path") == path).orderBy("source_unit_id")


def references_to(edges: DataFrame, symbol: str) -> DataFrame:
    return edges.where(F.col("target") == symbol).orderBy("source_unit_id", "start_byte")


def implementations_of(hierarchy: DataFrame, symbol: str) -> DataFrame:
    return hierarchy.where(F.col("supertype") == symbol).orderBy("source_unit_id", "subtype")


def types_of(types: DataFrame, unit: str) -> DataFrame:
    return types.where(F.col("source_unit_id") == unit).orderBy("type_id")


def diagnostics_of(diagnostics: DataFrame, unit: str) -> DataFrame:
    return diagnostics.where(F.col("source_unit_id") == unit).orderBy(F.asc_nulls_first("start_byte"), F.asc_nulls_first("end_byte"), "severity")


# --- predicates ------------------------------------------------------------------------------


def kind(value: str) -> Column:
    return F.col("kind") == value


def applied(symbol: str) -> Column:
    return F.array_contains("applied_symbols", symbol)


def prefix(value: str) -> Column:
    """Qualified names that begin with value; a null name never does."""
    return F.coalesce(F.col("qualified_name").startswith(value), F.lit(False))


def language(value: str) -> Column:
    return F.col("language") == value


def component(value: str) -> Column:
    return F.col("component_id") == value


def backend(value: str) -> Column:
    return F.col("provenance.backend") == value


def class_of(value: str) -> Column:
    """The classes of a language."""
    return language(value) & kind("class")


def every(*predicates: Column) -> Column:
    return reduce(Column.__and__, predicates, F.lit(True))


def no_dependencies(units: DataFrame) -> DataFrame:
    return units.where(F.col("origin") != "dependency")


# --- joins -----------------------------------------------------------------------------------


def rehydrated(symbols: DataFrame, units: DataFrame) -> DataFrame:
    """Symbols with their unit's component and provenance in place of their own."""
    own = units.select("source_unit_id", F.col("component_id").alias("_c"), F.col("provenance").alias("_p"))
    joined = symbols.join(own, "source_unit_id")
    return joined.withColumn("component_id", F.col("_c")).withColumn("provenance", F.col("_p")).drop("_c", "_p")


def subtypes(hierarchy: DataFrame, symbols: DataFrame, supertype: str) -> DataFrame:
    """Stored symbols that a supertype's edges name: an edge to a symbol not stored is dropped, duplicates stay."""
    edges = hierarchy.where(F.col("supertype") == supertype).select("subtype")
    return edges.join(symbols, edges.subtype == symbols.symbol_id).drop("subtype")


def annotation_edges(symbols: DataFrame) -> DataFrame:
    return symbols.select("source_unit_id", "symbol_id", F.explode("applied_symbols").alias("annotation_symbol_id"))


def with_applied(symbols: DataFrame, units: DataFrame, annotation: str) -> DataFrame:
    edges = annotation_edges(symbols).where(F.col("annotation_symbol_id") == annotation).select("symbol_id")
    return rehydrated(symbols.join(edges, "symbol_id"), units)


def with_nested_argument(applications: DataFrame, arguments: DataFrame, symbols: DataFrame, nested: str, outer: str, name: str, value_kind: str, value_text: str) -> DataFrame:
    """Symbols that carry `nested` and whose owner carries `outer` with an argument of this name, kind and text."""
    wanted = arguments.where((F.col("name") == name) & (F.col("value_kind") == value_kind) & (F.col("value_text") == value_text)).select("application_id")
    owners = applications.where(F.col("target") == outer).join(wanted, "application_id", "left_semi").select(F.col("subject").alias("owner"))
    subjects = applications.where(F.col("target") == nested).select(F.col("subject").alias("symbol_id"))
    return symbols.join(subjects, "symbol_id", "left_semi").join(owners, "owner", "left_semi").dropDuplicates(["symbol_id"])


def artifacts_of_name(locators: DataFrame, artifacts: DataFrame, name: str) -> DataFrame:
    """Artifacts that advertise a qualified name, a row for each locator that does."""
    return locators.where(F.col("qualified_name") == name).join(artifacts, "source_unit_id")


def artifacts_of_symbol(locators: DataFrame, artifacts: DataFrame, symbol: str) -> DataFrame:
    return locators.where(F.col("symbol_id") == symbol).join(artifacts, "source_unit_id")


def blob_of_unit(refs: DataFrame, catalog: DataFrame, unit: str) -> DataFrame:
    return refs.where(F.col("source_unit_id") == unit).join(catalog, "blob_key")


def orphans(refs: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    return refs.join(catalog, key, "left_anti")


def retained(candidates: DataFrame, answered: DataFrame, key: str = "symbol_id") -> DataFrame:
    """Candidates that a capability's answer names."""
    return candidates.join(answered.select(key).distinct(), key, "left_semi")


def references_of_class(references: DataFrame, calls: DataFrame, symbols: DataFrame, target: str) -> DataFrame:
    """References of a class and calls of its constructors: those it owns or that stand at its name in its unit.

    Sorted by place, kind and target, with whole rows that repeat once.
    """
    one = symbols.where(F.col("symbol_id") == target).select(
        F.col("source_unit_id").alias("_u"), F.col("name_start").alias("_a"), F.col("name_end").alias("_b"), F.col("kind").alias("_k")
    )
    made = symbols.where(F.col("kind") == "constructor").join(
        F.broadcast(one),  # one row: symbol_id is a key
        (F.col("owner") == target) | ((F.col("source_unit_id") == F.col("_u")) & (F.col("name_start") == F.col("_a")) & (F.col("name_end") == F.col("_b"))),
    )
    made = made.where(F.col("_k").isin("class", "interface", "object", "enum", "record")).select(F.col("symbol_id").alias("target")).distinct()
    columns = ["source_unit_id", "start_byte", "end_byte", "kind", "target"]
    union = references.where(F.col("target") == target).select(*columns).unionByName(calls.join(made, "target", "left_semi").select(*columns))
    return union.distinct().orderBy(*columns)


def unique_keys(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys that have exactly one distinct value."""
    return pairs.groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").select(key, value)


def resolved(targets: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """targets with the one value their key has; keys with none or several stay out."""
    return targets.join(unique_keys(known, key, value), key)


def batch_differences(requested: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """(key, problem): requested but missing, or returned but not requested. Empty for a conforming batch."""
    missing = requested.join(returned, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return missing.unionByName(returned.join(requested, key, "left_anti").select(key, F.lit("unexpected").alias("problem")))


def checked_components(descriptors: DataFrame, components: DataFrame) -> DataFrame:
    """descriptors with problem: null, unknown_component or context_mismatch."""
    known = components.select("component_id", F.col("configuration_fp").alias("_fp"), F.lit(True).alias("_known"))
    joined = descriptors.join(known, "component_id", "left")
    problem = F.when(F.col("_known").isNull(), "unknown_component").when(~F.col("context_fp").eqNullSafe(F.col("_fp")), "context_mismatch")
    return joined.withColumn("problem", problem).drop("_fp", "_known")


def dependency_subtypes(hierarchy: DataFrame, symbols: DataFrame, supertype: str) -> DataFrame:
    """Details of a supertype's subtypes in dependency facts, each once, by id."""
    wanted = hierarchy.where(F.col("supertype") == supertype).select(F.col("subtype").alias("symbol_id"))
    return symbols.join(wanted, "symbol_id", "left_semi").dropDuplicates(["symbol_id"]).orderBy("symbol_id")


# --- ordering and limits -----------------------------------------------------------------------


def limited(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(the first `limit` rows, a row that says whether there were more); rows are ordered."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1 to 1000")
    more = rows.limit(limit + 1).agg((F.count("*") > limit).alias("truncated"))
    return rows.limit(limit), more


def slowest(rows: DataFrame, millis: str, key: str, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc(millis), key).limit(n)


def first_by_id(rows: DataFrame, key: str, n: int = 16) -> DataFrame:
    """The first n by key; 0 is all."""
    return rows.orderBy(key).limit(n) if n else rows.orderBy(key)
