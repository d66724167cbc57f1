"""Counts, roll-ups, digests, batches and negotiations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.answer import freshness_rollup, state_rollup
from factloom.functions.digest import entries, fingerprint
from factloom.operators.graph import positions
from factloom.sources.staging import staged


def unit_states(persisted: DataFrame, current: DataFrame) -> DataFrame:
    """One row fresh, stale, unknown: a stored unit is stale with other content and unknown if it is gone."""
    now = current.select("source_unit_id", F.col("content_fp").alias("now_fp"), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "unknown").when(F.col("content_fp") == F.col("now_fp"), "fresh").otherwise("stale")
    rows = persisted.join(now, "source_unit_id", "left").select(state.alias("s"))
    return rows.agg(*(F.count_if(F.col("s") == x).alias(x) for x in ("fresh", "stale", "unknown")))


def configuration_counts(states: DataFrame) -> DataFrame:
    return states.agg(*(F.count_if(F.col("state") == x).alias(x) for x in ("current", "added", "changed", "missing")))


def blob_coverage(refs: DataFrame, catalog: DataFrame, readable: DataFrame) -> DataFrame:
    """One row cataloged, cached, missing, invalid, bytes.

    A reference without a catalog row is missing; one whose file (blob_key, length) is absent or of another length is
    invalid; the rest are cached.
    """
    files = readable.select("blob_key", F.col("length").alias("file_length"))
    rows = refs.join(catalog.select("blob_key", "byte_length"), "blob_key", "left").join(files, "blob_key", "left")
    state = F.when(F.col("byte_length").isNull(), "missing").when(F.col("file_length").eqNullSafe(F.col("byte_length")), "cached").otherwise("invalid")
    rows = rows.select(state.alias("s"), "byte_length")
    return rows.agg(
        F.count("*").alias("cataloged"), *(F.count_if(F.col("s") == x).alias(x) for x in ("cached", "missing", "invalid")),
        F.coalesce(F.sum(F.when(F.col("s") == "cached", F.col("byte_length"))), F.lit(0)).alias("bytes"),
    )


def phase_sums(metrics: DataFrame, phase: str, value: str) -> DataFrame:
    return metrics.groupBy(phase).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def distinct_provenance(units: DataFrame) -> DataFrame:
    names = ("backend", "backend_version", "protocol_version", "analysis_options")
    return units.select(*(F.col(f"provenance.{n}").alias(n) for n in names)).distinct().orderBy(*names)


def freshness_of(rows: DataFrame) -> DataFrame:
    return rows.agg(freshness_rollup().alias("freshness"))


def state_of(rows: DataFrame) -> DataFrame:
    return rows.agg(state_rollup().alias("state"))


def batches(units: DataFrame, most: int = 128) -> DataFrame:
    """units with batch: chunks of `most` in order of path inside each (component, language), from 0.

    A group of any size is numbered without one task holding it: units are dealt into pieces of their group by
    hash range of the sorted path, each piece is counted, and numbers run on from piece to piece.
    """
    from factloom.sources.staging import staged

    key = ["component_id", "language"]
    ordered = staged(units.sort(*key, "workspace_path", "source_unit_id").withColumn("_part", F.spark_partition_id()), "batches")
    sizes = ordered.groupBy(*key, "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(*key).orderBy("_part")) - F.col("_n")).drop("_n")
    nulls = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    joined = ordered.join(before.withColumnsRenamed({k: f"_{k}" for k in key} | {"_part": "_p"}), [*nulls, F.col("_part") == F.col("_p")])
    row = F.row_number().over(W.partitionBy(*key, "_part").orderBy("workspace_path", "source_unit_id"))
    return joined.withColumn("batch", F.floor((F.col("_before") + row - 1) / most)).select(*units.columns, "batch")


def merged_requirements(requirements: DataFrame) -> DataFrame:
    """(name, version, required): required if any package requires it."""
    return requirements.groupBy("name", "version").agg(F.bool_or("required").alias("required"))


def negotiated(requirements: DataFrame, offers: DataFrame) -> DataFrame:
    """requirements (name, version, required) with status, providers and available versions from offers (provider, name, version)."""
    versions = offers.groupBy("name").agg(F.array_sort(F.collect_set("version")).alias("available"))
    providers = offers.groupBy("name", "version").agg(F.array_sort(F.collect_set("provider")).alias("providers"))
    joined = requirements.join(versions, "name", "left").join(providers, ["name", "version"], "left")
    status = F.when(F.col("providers").isNotNull(), "supported").when(F.col("available").isNull(), "missing").otherwise("incompatible_version")
    return joined.withColumn("status", status)


def source_digest(units: DataFrame) -> DataFrame:
    """One digest of all units' (id, content, context): entries sorted, each followed by NUL.

    Entries are hashed in two levels, so no task gathers all of them: by 256 classes of the id's hash, then the
    classes' digests in order.
    """
    rows = units.select(F.concat_ws("\x00", "source_unit_id", "content_fp", "context_fp").alias("e"))
    per = rows.groupBy(F.pmod(F.xxhash64("e"), F.lit(256)).alias("c")).agg(entries(F.col("e")).alias("d"))
    return per.agg(entries(F.concat(F.lpad(F.col("c").cast("string"), 3, "0"), F.lit(":"), F.col("d"))).alias("digest"))


def group_digest(rows: DataFrame, key: str, entry: str) -> DataFrame:
    """Digest of each group's sorted entries."""
    return rows.groupBy(key).agg(entries(F.col(entry)).alias("digest"))


def public_api(symbols: DataFrame) -> DataFrame:
    """Digest of each unit's visible symbols: neither private nor internal."""
    hidden = F.arrays_overlap("modifiers", F.array(F.lit("private"), F.lit("internal")))
    entry = F.concat_ws("|", "kind", F.coalesce("qualified_name", "name"), F.coalesce("signature", F.lit("")))
    return symbols.where(~F.coalesce(hidden, F.lit(False))).groupBy("source_unit_id").agg(entries(entry).alias("public_api_fp"))


def type_displays(types: DataFrame) -> DataFrame:
    return types.select("display").distinct().orderBy("display")


def symbol_ordinals(symbols: DataFrame, block: int = 256) -> DataFrame:
    """symbols with ordinal, from 0 and running on over all units in order, and the detail block of its unit it falls in.

    Numbers come from a sort whose partitions are counted, so no task holds a unit or all symbols.
    """
    order = ["source_unit_id", "name_start", "symbol_id"]
    ordered = staged(symbols.sort(*order).withColumn("part", F.spark_partition_id()), "symbols")
    placed = positions(ordered, order, -1).withColumnRenamed("position", "ordinal")
    first = placed.groupBy("source_unit_id").agg(F.min("ordinal").alias("_first"))
    return placed.join(first, "source_unit_id").withColumn("block", F.floor((F.col("ordinal") - F.col("_first")) / block)).drop("_first")


def common_values(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, value): a group's value if all its rows have the same, else null; a null is a value of its own."""
    same = (F.count_distinct(column) == 1) & (F.count(column) == F.count("*"))
    return rows.groupBy(key).agg(F.when(same, F.min(column)).alias("value"))


def interned(rows: DataFrame, column: str, least: int = 3, octets: int = 8) -> DataFrame:
    """Values worth a dictionary: seen `least` times or more and of `octets` bytes or more."""
    return rows.where(F.octet_length(column) >= octets).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that come twice or more."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def fanned_out(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Each distinct target with the number of edges that meet it and its status, in one join."""
    found = edges.join(targets.select("target").distinct(), "target", "left_semi").groupBy("target").agg(F.count("*").alias("n"))
    rows = targets.select("target").distinct().join(found, "target", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("status", F.when(F.col("n") > 0, "ok").otherwise("no_result"))


def component_context(inputs: DataFrame) -> DataFrame:
    """(component_id, context_fp): digest of a component's configuration inputs in order of path."""
    rows = inputs.select(F.explode("components").alias("component_id"), "workspace_path", F.concat_ws("\x00", "workspace_path", "fingerprint").alias("e"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("workspace_path", "e"))), lambda x: F.concat(x["e"], F.lit("\x00")))
    return rows.groupBy("component_id").agg(fingerprint(F.array_join(listed, "")).alias("context_fp"))
