"""Whether answers still hold: checkpoint verdicts, the gate on an answer, re-verified matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.answer import Answer, Problem
from factloom.functions.digest import fingerprint


def checkpoint_verdict(checkpoint: dict[str, object] | None, digests: dict[str, str], counts: dict[str, int], drift: bool) -> str:
    """unknown without a checkpoint; stale on stale units, drift or any other digest; unknown on lost units; else fresh."""
    if checkpoint is None:
        return "unknown"
    if not checkpoint.get("committed", False) or counts.get("stale", 0) or drift or any(checkpoint.get(k) != v for k, v in digests.items()):
        return "stale"
    return "unknown" if counts.get("unknown", 0) else "fresh"


def stale_owners(rows: DataFrame, units: DataFrame, current: DataFrame) -> DataFrame:
    """Owners of rows (source_unit_id) whose file's content is no longer the indexed one; dependencies never are."""
    owners = units.join(rows.select("source_unit_id").distinct(), "source_unit_id", "left_semi").where("origin <> 'dependency'")
    now = current.select("workspace_path", F.col("content_fp").alias("now_fp"))
    return owners.join(now, "workspace_path", "left").where(~F.col("content_fp").eqNullSafe(F.col("now_fp"))).select("source_unit_id", "workspace_path")


def gate(answer: Answer, units: DataFrame, current: DataFrame, states: DataFrame | None = None, strategy: str = "fresh_only") -> Answer:
    """answer, or a stale one without rows: configuration first, then the owners; the first failure by path wins."""
    if strategy != "fresh_only" or answer.rows is None:
        return answer
    if states is not None and (bad := states.where("state <> 'current'").orderBy("workspace_path").limit(1).collect()):
        return Answer("stale", problems=[Problem("stale_configuration_input", f"{bad[0].workspace_path} is {bad[0].state}")])
    if bad := stale_owners(answer.rows, units, current).orderBy("workspace_path").limit(1).collect():
        return Answer("stale", problems=[Problem("stale_source_snapshot", f"{bad[0].workspace_path} has changed")])
    return answer


def verified(matches: DataFrame, current: DataFrame) -> DataFrame:
    """Matches (workspace_path, content_fp, ...) whose document has not changed since it was indexed."""
    return matches.join(current.select("workspace_path", "content_fp"), ["workspace_path", "content_fp"], "left_semi")


def hashed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (path, byte_size, modified_nanos, content) with content_fp: the known one if size and time agree, else hashed."""
    cached = known.select("path", "byte_size", "modified_nanos", F.col("content_fp").alias("_fp"))
    joined = files.join(cached, ["path", "byte_size", "modified_nanos"], "left")
    return joined.withColumn("content_fp", F.coalesce("_fp", fingerprint(F.col("content")))).drop("_fp")
