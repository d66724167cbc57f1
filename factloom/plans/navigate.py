"""Navigation: symbols, definitions, references, callers, implementations and types, by name, id or location."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.answer import Answer, any_ok, by_count, refused
from factloom.functions import text
from factloom.operators import graph, postings, ranges

ID_PREFIXES = ("jvm:sha256:", "kotlin:", "java:")
Facts = Mapping[str, DataFrame]


def symbols(facts: Facts, name: str) -> Answer:
    """The first tier with results: exact name, qualified locator, dependency facts, part of a name."""
    own, locators = facts["symbols"], facts["symbol_locators"]
    ids = postings.qualified(locators, name).select("symbol_id")
    tiers = [postings.named(own, name), own.join(ids, "symbol_id", "left_semi").orderBy(*postings.UNIT_ORDER)]
    if "dependency_symbols" in facts:
        tiers.append(facts["dependency_symbols"].where(F.col("qualified_name") == name).orderBy("symbol_id"))
    tiers.append(postings.name_contains(own, name))
    for rows in tiers:
        if (answer := by_count(rows, "ambiguous")).status != "no_result":
            return answer
    return Answer("no_result", tiers[-1])


def select_applied(facts: Facts, name: str) -> Answer:
    """Symbols that carry an annotation; a name no locator knows is taken as an id."""
    found = [r.symbol_id for r in postings.qualified(facts["symbol_locators"], name).limit(2).collect()]
    if len(found) > 1:
        return refused("ambiguous_symbol_query", f"{name} names several symbols", "ambiguous")
    return by_count(postings.with_applied(facts["symbols"], facts["source_units"], found[0] if found else name))


def located(facts: Facts, points: DataFrame) -> DataFrame:
    """(cursor, symbol_id) of points (cursor, source_unit_id, byte): all distinct targets of what covers them, else
    the narrowest declarations. One join for any number of points."""
    cover = ranges.covering(points, facts["occurrences"].where(F.col("target").isNotNull()).select("source_unit_id", "start_byte", "end_byte", "target"))
    targets = cover.select("cursor", F.col("target").alias("symbol_id")).distinct()
    rest = points.join(targets.select("cursor").distinct(), "cursor", "left_anti")
    return targets.unionByName(ranges.narrowest_declarations(rest, facts["symbols"]).select("cursor", "symbol_id"))


@dataclass(frozen=True)
class Target:
    symbol: str | None
    answer: Answer | None = None


def resolve(facts: Facts, target: str) -> Target:
    """An id by its prefix, a PATH:LINE:COLUMN, or an exact name."""
    if target.startswith(ID_PREFIXES):
        return Target(target)
    path, _, column = target.rpartition(":")
    path, _, line = path.rpartition(":")
    if path and line.isdigit() and column.isdigit():
        return _at(facts, path, int(line), int(column))
    found = [r.symbol_id for r in postings.named(facts["symbols"], target).select("symbol_id").limit(2).collect()]
    if len(found) == 1:
        return Target(found[0])
    return Target(None, refused("ambiguous_target", f"{target} names several symbols", "ambiguous") if found else Answer("no_result"))


def _at(facts: Facts, path: str, line: int, column: int) -> Target:
    units = postings.at_path(facts["source_units"], path)
    documents = facts["text_documents"].where(F.col("workspace_path") == path)
    if not units.join(documents, ["workspace_path", "content_fp"], "left_semi").limit(1).count():
        gone = not units.limit(1).count()
        return Target(None, Answer("no_result") if gone else refused("stale_source_snapshot", f"{path} has changed", "stale"))
    byte = documents.select(text.offset(F.col("content"), F.lit(line), F.lit(column)).alias("byte")).first().byte
    if byte is None:
        return Target(None, refused("invalid_location", f"{path}:{line}:{column} is not in the file"))
    points = units.select(F.lit("0").alias("cursor"), "source_unit_id", F.lit(byte).cast("long").alias("byte"))
    found = [r.symbol_id for r in located(facts, points).select("symbol_id").distinct().limit(2).collect()]
    if len(found) == 1:
        return Target(found[0])
    return Target(None, refused("ambiguous_location", f"several symbols at {path}:{line}:{column}", "ambiguous") if found else Answer("no_result"))


def _of(facts: Facts, target: str, rows) -> Answer:  # noqa: ANN001
    found = resolve(facts, target)
    return found.answer or by_count(rows(found.symbol))


def definition(facts: Facts, target: str) -> Answer:
    found = resolve(facts, target)
    if found.answer:
        return found.answer
    answer = by_count(postings.by_id(facts["symbols"], "symbol_id", found.symbol or ""))
    return answer if answer.status == "ok" else refused("resolved_symbol_missing", f"{found.symbol} has no declaration", "no_result")


def references(facts: Facts, target: str) -> Answer:
    return _of(facts, target, lambda s: postings.references_of_class(facts["reference_edges"], facts["call_edges"], facts["symbols"], s))


def callers(facts: Facts, target: str) -> Answer:
    return _of(facts, target, lambda s: postings.references_to(facts["call_edges"], s))


def implementations(facts: Facts, target: str, transitive: bool = False) -> Answer:
    """Subtypes in the workspace; if there are none and only direct ones are asked, those of dependencies."""

    def rows(symbol: str) -> DataFrame:
        own = facts["symbols"]
        if transitive:
            reached = graph.transitive_subtypes(facts["hierarchy_edges"], symbol).select("rank", F.col("subtype").alias("symbol_id"))
            return own.join(reached, "symbol_id").orderBy("rank")
        near = postings.subtypes(facts["hierarchy_edges"], own, symbol)
        if "dependency_symbols" in facts and not near.limit(1).count():
            return postings.dependency_subtypes(facts["dependency_hierarchy"], facts["dependency_symbols"], symbol)
        return near

    return _of(facts, target, rows)


def type_at(facts: Facts, path: str, line: int, column: int) -> Answer:
    documents = facts["text_documents"].where(F.col("workspace_path") == path)
    at = documents.select("workspace_path", text.offset(F.col("content"), F.lit(line), F.lit(column)).alias("byte")).where("byte is not null")
    points = facts["source_units"].join(at, "workspace_path").select(F.lit("0").alias("cursor"), "source_unit_id", "byte")
    typed = ranges.first_typed(points, facts["occurrences"]).join(points.select("cursor", "source_unit_id"), "cursor")
    return by_count(typed.join(facts["types"], ["source_unit_id", "type_id"]))


def fan_out(facts: Facts, command, targets: list[str]) -> tuple[str, dict[str, Answer]]:  # noqa: ANN001
    """Answers of distinct sorted targets, and ok if any is."""
    answers = {t: command(facts, t) for t in sorted(set(targets))}
    return any_ok([a.status for a in answers.values()]), answers
