"""Answers and records out as JSON lines or short text, and targets in from lines."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.answer import Answer
from factloom.schema import FactError
from factloom.sources.staging import staged


def records(rows: DataFrame, status: str = "ok") -> DataFrame:
    """(line): a compact JSON object a row, with the status of the whole; nulls are left out."""
    return rows.select(F.to_json(F.struct(F.lit(status).alias("status"), *(F.col(f"`{c}`") for c in rows.columns))).alias("line"))


def write_records(rows: DataFrame, path: str, status: str = "ok") -> None:
    """JSON lines in a folder of the store, written by the tasks that have the rows."""
    records(rows, status).write.mode("errorifexists").text(path)


def short(rows: DataFrame, *columns: str) -> DataFrame:
    """(line): the columns' values parted by tabs, for people."""
    return rows.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns)).alias("line"))


def print_answer(answer: Answer, out: Callable[[str], object] = print) -> int:
    """The answer's envelope as one JSON line; gives its exit code."""
    out(json.dumps(answer.envelope(), sort_keys=True, default=str, ensure_ascii=False))
    return answer.exit_code


def targets(lines: Iterable[str], argument: str | None = None) -> list[str]:
    """Distinct sorted targets: the argument, or of lines their symbol ids.

    A line is an id, a record with symbol_id, or an answer whose result holds such records.
    """
    if argument is not None:
        return [argument]
    found: set[str] = set()
    for line in map(str.strip, lines):
        if line.startswith("{"):
            data = json.loads(line)
            rows = data["result"] if isinstance(data.get("result"), list) else [data]
            found |= {r["symbol_id"] for r in rows if isinstance(r, dict) and r.get("symbol_id")}
        elif line:
            found.add(line)
    return sorted(found)


def paged(fetch: Callable[[str | None], tuple[list[tuple], str | None]], spark: SparkSession, schema: str, key: str, most_pages: int = 100_000, held: int = 50_000) -> DataFrame:
    """All rows of a paged catalog; of rows with the same key the last page's counts.

    fetch(cursor) gives (rows, next cursor or null) in the schema's columns. A cursor that comes again is an error.
    The driver holds up to `held` rows and a page; beyond that they are written to the shared folder.
    """
    rows, written = [], []

    def frame() -> DataFrame:
        return spark.createDataFrame(rows, f"page long, {schema}")

    cursor, seen, number = None, set(), 0
    while True:
        page, cursor = fetch(cursor)
        rows += ((number, *r) for r in page)
        number += 1
        if cursor is None:
            break
        if cursor in seen or number >= most_pages:
            raise ValueError(f"cursor {cursor!r} does not advance")
        seen.add(cursor)
        if len(rows) >= held:
            written.append(staged(frame(), "pages"))
            rows = []
    all_rows = reduce(DataFrame.unionByName, written, frame())
    rest = [c for c in all_rows.columns if c not in ("page", key)]
    last = all_rows.groupBy(key).agg(F.max_by(F.struct(*rest), "page").alias("r"))
    return last.select(key, "r.*")


def within_budget(rows: DataFrame, key: str, budget: int) -> DataFrame:
    """The first `budget` rows by key."""
    return rows.orderBy(key).limit(budget)


def shards(units: DataFrame) -> DataFrame:
    """(component_id, n): the units each component's shard takes."""
    return units.groupBy("component_id").agg(F.count("*").alias("n"))


def shard_plan(units: DataFrame, owned: DataFrame) -> DataFrame:
    """units with shard, the component whose compilation takes the unit: each that owns its path, and its own component
    if that is among them. A unit that several own is in each of their shards; a unit that none takes is an error.

    owned: (component_id, workspace_path), with a row and null path for a component that owns no file by name.
    """
    contexts = owned.select(F.col("component_id").alias("shard")).distinct()
    by_path = units.join(owned.where("workspace_path is not null").select(F.col("component_id").alias("shard"), "workspace_path"), "workspace_path")
    by_component = units.join(contexts, F.col("component_id") == F.col("shard"))
    out = by_path.select(*units.columns, "shard").unionByName(by_component.select(*units.columns, "shard"))
    out = out.groupBy("source_unit_id", "shard").agg(F.first(F.struct(*units.columns)).alias("u")).select("u.*", "shard")
    if lost := units.select("source_unit_id").join(out.select("source_unit_id"), "source_unit_id", "left_anti").limit(1).collect():
        raise FactError(f"{lost[0].source_unit_id} belongs to no compilation")
    return out
