"""An index run: plan, take the new snapshots, commit once, drop stale dependents, checkpoint last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from factloom.operators import diff, postings, summaries
from factloom.plans.status import digests
from factloom.schema import FactError
from factloom.sources.blobs import BlobCache, Promotion
from factloom.sources.staging import staged
from factloom.sources.store import Store

#: Gives (units, fact tables) of the units to analyse: the front end that reads sources.
Analyse = Callable[[DataFrame], tuple[DataFrame, dict[str, DataFrame]]]


def index(store: Store, units: DataFrame, analyse: Analyse, inputs: DataFrame, texts: DataFrame, workspace: str, propagate: bool = True) -> dict[str, int]:
    """Bring the store to units (all columns of source_units); counts of what was done.

    The analysed batch must be exactly what was asked for. If a unit's public API changed, the units that use it and
    were not in this batch are removed, to be analysed by the next run (propagate). Nothing is stored if a step
    before the commit fails; the checkpoint is written after all else.
    """
    counts, asked, removed = _planned(store, units)
    dependents = 0
    if counts["remove"]:
        store.remove_units(removed)
    if counts["analyze"]:
        before = store.table("source_units").select("source_unit_id", "public_api_fp")
        lost = _take(store, asked, analyse, before, asked.select("source_unit_id") if propagate else None)
        dependents = _drop(store, lost)
    _finish(store, units, inputs, texts, workspace)
    return counts | {"dependents_removed": dependents}


def index_batches(store: Store, units: DataFrame, analyse: Analyse, inputs: DataFrame, texts: DataFrame, workspace: str, most: int = 128, propagate: bool = True) -> dict[str, int]:
    """index in batches of up to `most` units of a component and language, under one plan made before the first.

    Each batch is a commit, so a run that breaks off keeps the batches before and the next run asks for the rest. A unit
    that is in any batch is never removed as a dependent; the others leave after the last batch. The driver holds
    the list of batches, not of units.
    """
    counts, asked, removed = _planned(store, units)
    if counts["remove"]:
        store.remove_units(removed)
    dealt = staged(summaries.batches(asked, most), "dealt")
    key = ["component_id", "language", "batch"]
    before = staged(store.table("source_units").select("source_unit_id", "public_api_fp"), "before")
    lost, number = None, 0
    for b in dealt.select(*key).distinct().orderBy(*key).toLocalIterator():
        chosen = dealt.where(F.col("component_id").eqNullSafe(b.component_id) & F.col("language").eqNullSafe(b.language) & (F.col("batch") == b.batch))
        found = _take(store, chosen.select(*units.columns), analyse, before, dealt.select("source_unit_id") if propagate else None)
        lost = found if lost is None or found is None else lost.unionByName(found)
        number += 1
    dependents = _drop(store, None if lost is None else lost.distinct())
    _finish(store, units, inputs, texts, workspace)
    return counts | {"batches": number, "dependents_removed": dependents}


def _planned(store: Store, units: DataFrame) -> tuple[dict[str, int], DataFrame, DataFrame]:
    """Counts of the plan, the units to analyse, and the ids that left; the lists are written, as the store changes."""
    own = postings.no_dependencies(units)
    held = postings.no_dependencies(store.table("source_units"))
    plan = staged(diff.source_plan(own.select("source_unit_id", "content_fp", "context_fp"), held.select("source_unit_id", "content_fp", "context_fp")), "plan")
    asked = own.join(plan.where("action = 'reanalyze'").select("source_unit_id"), "source_unit_id", "left_semi")
    return diff.summary(plan).first().asDict(), asked, plan.where("action = 'remove'").select("source_unit_id")


def _take(store: Store, asked: DataFrame, analyse: Analyse, before: DataFrame, spared: DataFrame | None) -> DataFrame | None:
    """Analyse and commit a batch; (source_unit_id) of the users of changed public APIs but those spared, if asked for."""
    returned, facts = analyse(asked)
    if bad := postings.batch_differences(asked.select("source_unit_id"), returned.select("source_unit_id"), "source_unit_id").limit(1).collect():
        raise FactError(f"{bad[0].source_unit_id}: {bad[0].problem} in the batch")
    lost = None
    if spared is not None:
        stale = diff.api_dependents(before, returned, store.table("symbols"), store.table("reference_edges"), store.table("call_edges"), store.table("hierarchy_edges"))
        lost = staged(stale.select(F.col("dependent").alias("source_unit_id")).join(spared, "source_unit_id", "left_anti").distinct(), "dependents")
    store.replace_snapshots(asked, returned, facts)
    return lost


def _drop(store: Store, lost: DataFrame | None) -> int:
    n = 0 if lost is None else lost.count()
    if n:
        store.remove_units(lost)
    return n


def _finish(store: Store, units: DataFrame, inputs: DataFrame, texts: DataFrame, workspace: str) -> None:
    """Texts and inputs, and the checkpoint after all else."""
    store.sync_texts(texts)
    store.replace("configuration_inputs", inputs)
    now = digests(units, inputs, store.table("artifacts"))
    row = store.spark.range(1).select(F.lit(workspace).alias("workspace_id"), *(F.lit(v).alias(k) for k, v in now.items()), F.lit(True).alias("committed"))
    store.upsert("checkpoints", row)


def materialise(misses: DataFrame, budget: int) -> DataFrame:
    """The first `budget` dependencies to fetch, by id; 0 is all."""
    return postings.first_by_id(misses, "source_unit_id", budget)


#: Gives an artifact's symbols, from its row of the catalog.
Fetch = Callable[[Row], DataFrame]


def cache_artifact(store: Store, cache: BlobCache, unit: str, fetch: Fetch, left: int) -> tuple[str, Promotion | None]:
    """Bring an artifact's facts into the blob cache only: (outcome, what publishing did).

    Outcomes: not_cataloged; already_materialized, if a valid blob is there (an invalid one is deleted first);
    budget_exhausted, if `left` is 0; materialized. Only the last calls fetch, unless another run publishes meanwhile.
    """
    found = store.table("artifacts").where(F.col("source_unit_id") == unit).limit(1).collect()
    if not found:
        return "not_cataloged", None
    key = found[0].identity
    cache.remove_invalid(key)
    if cache.readable(key):
        return "already_materialized", None
    if left < 1:
        return "budget_exhausted", None
    told = cache.promote(key, key, fetch(found[0]))
    store.record_blob(unit, key, key, sum(f["length"] for f in cache.open(key)["files"]))
    return "materialized" if told.promoted else "already_materialized", told


def cache_artifacts(store: Store, cache: BlobCache, misses: DataFrame, fetch: Fetch, budget: int) -> dict[str, int]:
    """cache_artifact for the first `budget` misses by id: outcomes counted, with rows, bytes and milliseconds of all.

    One artifact at a time, as each is published by itself; the budget (1 or more) bounds the list.
    """
    if budget < 1:
        raise ValueError("budget must be 1 or more")
    out = dict.fromkeys(("materialized", "already_materialized", "not_cataloged", "rows", "octets", "write_millis", "verify_millis"), 0)
    for row in materialise(misses, budget).collect():
        outcome, told = cache_artifact(store, cache, row.source_unit_id, fetch, 1)
        out[outcome] += 1
        for name in ("rows", "octets", "write_millis", "verify_millis"):
            out[name] += getattr(told, name) if told else 0
    return out


def store_dependencies(store: Store, misses: DataFrame, units: DataFrame, analyse: Analyse, budget: int) -> dict[str, int]:
    """Store the facts of the first `budget` misses by id (0 is all) under their units, in one commit.

    units has the dependencies' source units; a miss without one is not cataloged and stays out. The batch must be
    exactly what was asked for.
    """
    chosen = staged(materialise(misses, budget), "chosen")
    asked = units.where("origin = 'dependency'").join(chosen, "source_unit_id", "left_semi")
    wanted, n = chosen.count(), asked.count()
    if n:
        _take(store, asked, analyse, asked.limit(0), None)
    return {"materialized": n, "not_cataloged": wanted - n}
