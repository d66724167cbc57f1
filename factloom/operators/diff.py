"""Change planning: keyed full-outer comparisons of what is stored with what is there now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import dependent_units


def _both(current: DataFrame, persisted: DataFrame, key: str) -> DataFrame:
    now = current.select(key, *(F.col(c).alias(f"now_{c}") for c in current.columns if c != key), F.lit(True).alias("in_now"))
    old = persisted.select(key, *(F.col(c).alias(f"old_{c}") for c in persisted.columns if c != key), F.lit(True).alias("in_old"))
    return now.join(old, key, "full")


def _differs(column: str) -> Column:
    return ~F.col(f"now_{column}").eqNullSafe(F.col(f"old_{column}"))


def _planned(both: DataFrame, key: str, reason: Column) -> DataFrame:
    """(key, action, reason, removal): removals come after all others, each part by key."""
    action = F.when(F.col("in_now").isNull(), "remove").when(F.col("reason").isNull(), "reuse").otherwise("reanalyze")
    rows = both.withColumn("reason", F.when(F.col("in_now").isNotNull(), reason))
    return rows.select(key, action.alias("action"), "reason", F.col("in_now").isNull().alias("removal"))


def source_plan(current: DataFrame, persisted: DataFrame) -> DataFrame:
    """Of (source_unit_id, content_fp, context_fp): reanalyze with a reason, reuse or remove; context before content."""
    reason = F.when(F.col("in_old").isNull(), "content_changed").when(_differs("context_fp"), "context_changed").when(_differs("content_fp"), "content_changed")
    return _planned(_both(current, persisted, "source_unit_id"), "source_unit_id", reason)


def analysis_plan(current: DataFrame, persisted: DataFrame) -> DataFrame:
    """source_plan, then backend, backend_version and protocol_version, then analysis_options."""
    backend = _differs("backend") | _differs("backend_version") | _differs("protocol_version")
    reason = (
        F.when(F.col("in_old").isNull(), "content_changed").when(_differs("context_fp"), "context_changed").when(_differs("content_fp"), "content_changed")
        .when(backend, "backend_changed").when(_differs("analysis_options"), "analysis_options_changed")
    )
    return _planned(_both(current, persisted, "source_unit_id"), "source_unit_id", reason)


def dependency_plan(current: DataFrame, persisted: DataFrame, available: DataFrame) -> DataFrame:
    """Of (source_unit_id, identity) and the units with a readable blob: cache_hit, cache_miss or removed."""
    readable = available.select("source_unit_id").distinct().withColumn("readable", F.lit(True))
    both = _both(current, persisted, "source_unit_id").join(readable, "source_unit_id", "left")
    hit = F.col("in_old").isNotNull() & ~_differs("identity") & F.col("readable").isNotNull()
    action = F.when(F.col("in_now").isNull(), "removed").when(hit, "cache_hit").otherwise("cache_miss")
    return both.select("source_unit_id", action.alias("action"))


def configuration_states(current: DataFrame, persisted: DataFrame) -> DataFrame:
    """Of (workspace_path, fingerprint, components): current, added, changed or missing, with both fingerprints."""
    both = _both(current, persisted, "workspace_path")
    state = F.when(F.col("in_old").isNull(), "added").when(F.col("in_now").isNull(), "missing").when(_differs("fingerprint") | _differs("components"), "changed").otherwise("current")
    return both.select(
        "workspace_path", state.alias("state"), F.col("old_fingerprint").alias("persisted_fp"), F.col("now_fingerprint").alias("current_fp"),
        F.when(F.col("in_now").isNotNull(), F.col("now_components")).otherwise(F.col("old_components")).alias("components"),
    )


def affected_components(states: DataFrame) -> DataFrame:
    return states.where("state <> 'current'").select(F.explode("components").alias("component_id")).distinct().orderBy("component_id")


def manifest_reusable(states: DataFrame) -> DataFrame:
    return states.agg(F.coalesce(F.bool_and(F.col("state") == "current"), F.lit(True)).alias("reusable"))


def api_dependents(before: DataFrame, after: DataFrame, symbols: DataFrame, references: DataFrame, calls: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(source_unit_id, dependent) of the units whose public_api_fp changed; null counts as a value."""
    changed = before.select("source_unit_id", F.col("public_api_fp").alias("_o")).join(after.select("source_unit_id", "public_api_fp"), "source_unit_id")
    changed = changed.where(~F.col("_o").eqNullSafe(F.col("public_api_fp"))).select("source_unit_id")
    return dependent_units(symbols, references, calls, hierarchy, changed)


def summary(plan: DataFrame) -> DataFrame:
    """Rows by action, in one row: reuse, analyze, remove."""
    return plan.agg(*(F.count_if(F.col("action") == a).alias(n) for a, n in (("reuse", "reuse"), ("reanalyze", "analyze"), ("remove", "remove"))))


def needs_worker(plan: DataFrame) -> bool:
    return not plan.where("action = 'reanalyze'").isEmpty()


def misses(plan: DataFrame) -> DataFrame:
    return plan.where("action = 'cache_miss'").select("source_unit_id").orderBy("source_unit_id")
