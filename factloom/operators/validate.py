"""Checks on facts before they are stored, and on answers of packages before they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.values import CODE
from factloom.schema import KEYS, PROTOCOL_VERSION, FactError, assert_unique, conform


def snapshot_problems(expected: DataFrame, units: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """(source_unit_id, problem) of new snapshots, against the expected units; empty if all may be stored."""
    want = expected.select("source_unit_id", F.col("content_fp").alias("_content"), F.col("context_fp").alias("_context"), F.lit(True).alias("_known"))
    joined = units.join(want, "source_unit_id", "left")
    problem = (
        F.when(F.col("_known").isNull(), "unknown_unit").when(~F.col("content_fp").eqNullSafe(F.col("_content")), "content_mismatch")
        .when(~F.col("context_fp").eqNullSafe(F.col("_context")), "context_mismatch")
        .when(~F.col("provenance.protocol_version").eqNullSafe(F.lit(PROTOCOL_VERSION)), "protocol_mismatch")
    )
    found = joined.select("source_unit_id", problem.alias("problem")).where("problem is not null")
    owned = units.select("source_unit_id")
    for name, rows in facts.items():
        if "source_unit_id" not in rows.columns:
            continue
        found = found.unionByName(rows.join(owned, "source_unit_id", "left_anti").select("source_unit_id", F.lit(f"{name}: foreign unit").alias("problem")))
        for a, b in (("start_byte", "end_byte"), ("decl_start", "decl_end"), ("name_start", "name_end")):
            if a in rows.columns:
                found = found.unionByName(rows.where(F.col(a) > F.col(b)).select("source_unit_id", F.lit(f"{name}: {a} after {b}").alias("problem")))
    return found


def require_valid(expected: DataFrame, units: DataFrame, facts: dict[str, DataFrame]) -> None:
    if bad := snapshot_problems(expected, units, facts).limit(1).collect():
        raise FactError(f"{bad[0].source_unit_id}: {bad[0].problem}")
    assert_unique(units, KEYS["source_units"], "source_units")
    for name, rows in facts.items():
        assert_unique(conform(rows, name), KEYS[name], name)


def _bad_code(code: Column) -> Column:
    return ~F.coalesce(code.rlike(CODE), F.lit(False))


def framework_problems(candidates: DataFrame, boundaries: DataFrame, state: str) -> DataFrame:
    """(subject, problem) of a framework result: candidates (symbol_id, disposition, reasons, evidence array of
    struct(code, target, backend, version, options)) and boundaries (code, message)."""
    evidence = F.transform("evidence", lambda e: e["code"])
    problem = (
        F.when(F.size("reasons") <= 0, "missing_reasons").when(F.exists("reasons", _bad_code), "invalid_code")
        .when(F.size("evidence") <= 0, "missing_evidence").when(F.exists(evidence, _bad_code), "invalid_code")
    )
    found = candidates.select(F.col("symbol_id").alias("subject"), problem.alias("problem")).where("problem is not null")
    twice = candidates.groupBy("symbol_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("symbol_id").alias("subject"), F.lit("duplicate_candidate").alias("problem"))
    codes = boundaries.where(_bad_code(F.col("code"))).select(F.col("code").alias("subject"), F.lit("invalid_code").alias("problem"))
    counts = candidates.agg(F.count("*").alias("n"), F.count_if(F.col("disposition") == "unresolved").alias("open")).crossJoin(boundaries.agg(F.count("*").alias("b")))
    wrong = {
        "complete": F.when((F.col("b") > 0) | (F.col("open") > 0), "invalid_complete_state"),
        "partial": F.when(F.col("b") == 0, "missing_partial_boundary"),
        "unsupported": F.when((F.col("b") == 0) | (F.col("n") > 0), "invalid_unsupported_state"),
    }[state]
    whole = counts.select(F.lit("result").alias("subject"), wrong.alias("problem")).where("problem is not null")
    return found.unionByName(twice).unionByName(codes).unionByName(whole)


def normalised_candidates(candidates: DataFrame) -> DataFrame:
    """candidates with reasons sorted and distinct, evidence sorted by its key and distinct by it."""
    key = lambda e: F.concat_ws("|", e["code"], e["target"], e["backend"], e["version"], e["options"])
    keyed = F.array_sort(F.transform("evidence", lambda e: F.struct(key(e).alias("k"), e.alias("e"))))
    first = F.filter(keyed, lambda x, i: (i == 0) | (F.get(F.transform(keyed, lambda y: y["k"]), i - 1) != x["k"]))
    return candidates.withColumn("reasons", F.array_sort(F.array_distinct("reasons"))).withColumn("evidence", F.transform(first, lambda x: x["e"])).orderBy("symbol_id")


def normalised_boundaries(boundaries: DataFrame) -> DataFrame:
    return boundaries.orderBy("code", "message")
