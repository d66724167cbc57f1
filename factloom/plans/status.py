"""What an index holds and whether it still fits its workspace; and the plan of the next run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.answer import Answer
from factloom.operators import diff, freshness, summaries
from factloom.sources.store import Store


def _entries(rows: DataFrame, *columns: str) -> str:
    from factloom.functions.digest import entries

    return rows.agg(entries(F.concat_ws("\x00", *columns)).alias("d")).first().d


def digests(units: DataFrame, inputs: DataFrame, artifacts: DataFrame) -> dict[str, str]:
    return {
        "source_fp": summaries.source_digest(units).first().digest,
        "configuration_fp": _entries(inputs, "workspace_path", "fingerprint"),
        "artifact_catalog_fp": _entries(artifacts, "source_unit_id", "identity"),
    }


def status(store: Store, units: DataFrame, inputs: DataFrame, readable: DataFrame, drift: bool = False) -> Answer:
    """Counts and the verdict for the current units (source_unit_id, content_fp, context_fp) and inputs."""
    states = diff.configuration_states(inputs, store.table("configuration_inputs"))
    configuration = summaries.configuration_counts(states).first().asDict()
    now = digests(units, inputs, store.table("artifacts"))
    row = store.checkpoint().collect()
    saved = row[0].asDict() if row else None
    held = store.table("source_units")
    if saved and saved["committed"] and all(saved.get(k) == v for k, v in now.items()):
        counts = {"fresh": held.count(), "stale": 0, "unknown": 0}  # nothing moved: no comparison by unit
    else:
        counts = summaries.unit_states(held, units).first().asDict()
    moved = any(configuration[k] for k in ("added", "changed", "missing"))
    verdict = freshness.checkpoint_verdict(saved, now, counts, drift or moved)
    coverage = summaries.blob_coverage(store.table("blob_refs"), store.table("blob_catalog"), readable).first().asDict()
    metadata = {"freshness": verdict, "units": counts, "configuration": configuration, "blobs": coverage}
    return Answer("ok", summaries.distinct_provenance(held), metadata)


def preview(store: Store, units: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One row: reuse, analyze, remove of units; hits, misses and bytes of blobs. Starts nothing."""
    plan = diff.summary(diff.source_plan(units, store.table("source_units").select("source_unit_id", "content_fp", "context_fp")))
    blobs = store.table("blob_refs").join(store.table("blob_catalog"), "blob_key").select("source_unit_id", "byte_length")
    actions = diff.dependency_plan(dependencies, store.table("artifacts").select("source_unit_id", "identity"), blobs).join(blobs, "source_unit_id", "left")
    sums = actions.agg(
        F.count_if(F.col("action") == "cache_hit").alias("hits"), F.count_if(F.col("action") == "cache_miss").alias("misses"),
        F.coalesce(F.sum(F.when(F.col("action") == "cache_hit", F.col("byte_length"))), F.lit(0)).alias("bytes"),
    )
    return plan.crossJoin(F.broadcast(sums))  # one row each
