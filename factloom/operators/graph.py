"""Traversals over edge tables, level by level, each level staged in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.staging import staged


def transitive_subtypes(hierarchy: DataFrame, start: str, most: int | None = None) -> DataFrame:
    """(rank, depth, source_unit_id, subtype, supertype): the edges by which each subtype of start is first reached.

    A level's edges are taken in order of their supertype's rank, then (source_unit_id, subtype); start itself is
    never reached again, so cycles end. One join a level, whatever the level's size.
    """
    edges = hierarchy.select("source_unit_id", "subtype", "supertype")
    spark = edges.sparkSession
    frontier = spark.range(1).select(F.lit(start).alias("node"), F.lit(0).cast("long").alias("rank"))
    visited, levels, depth, base = frontier.select("node"), [], 0, 0
    while most is None or depth < most:
        depth += 1
        near = edges.join(frontier.withColumnRenamed("node", "supertype"), "supertype").join(visited.withColumnRenamed("node", "subtype"), "subtype", "left_anti")
        first = near.groupBy("subtype").agg(F.min(F.struct("rank", "source_unit_id", "supertype")).alias("m")).select("subtype", "m.*")
        # Positions inside a level come from a sort whose partitions are numbered, not from one task's window.
        ordered = staged(first.sort("rank", "source_unit_id", "subtype").withColumn("part", F.spark_partition_id()), "level")
        placed = staged(positions(ordered, ["rank", "source_unit_id", "subtype"], base), "level")
        n = placed.count()
        if not n:
            break
        levels.append(placed.select(F.col("position").alias("rank"), F.lit(depth).cast("long").alias("depth"), "source_unit_id", "subtype", "supertype"))
        frontier = placed.select(F.col("subtype").alias("node"), F.col("position").alias("rank"))
        visited = visited.union(frontier.select("node"))
        base += n
    empty = edges.limit(0).select(F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("depth"), "source_unit_id", "subtype", "supertype")
    out = levels[0] if levels else empty
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def positions(ordered: DataFrame, order: list[str], base: int) -> DataFrame:
    """ordered (with part, the number of its sorted partition) with position: 1-based over all, plus base."""
    from pyspark.sql.window import Window as W

    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n")).select("part", "before")
    inside = F.row_number().over(W.partitionBy("part").orderBy(*order))
    return ordered.join(before, "part").withColumn("position", F.col("before") + inside + base).drop("before", "part")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, depth): every node that edges (src, dst) reach from start (node), with the fewest steps."""
    frontier = staged(start.select("node").distinct().withColumn("depth", F.lit(0).cast("long")), "reach")
    seen, depth = frontier, 0
    while True:
        depth += 1
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = staged(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth).cast("long")), "reach")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def tree_edges(tree: DataFrame) -> DataFrame:
    """Distinct parent>scope>child texts of a resolver's tree rows (parent, children array of struct(scope, child))."""
    rows = tree.select("parent", F.explode("children").alias("c"))
    return rows.select(F.concat_ws(">", "parent", "c.scope", "c.child").alias("edge")).distinct().orderBy("edge")


def dependent_units(symbols: DataFrame, references: DataFrame, calls: DataFrame, hierarchy: DataFrame, changed: DataFrame) -> DataFrame:
    """(source_unit_id, dependent): units that reference, call or subtype a symbol declared in a changed unit, not itself."""
    declared = symbols.select("symbol_id", F.col("source_unit_id").alias("declared_in")).join(changed.select(F.col("source_unit_id").alias("declared_in")).distinct(), "declared_in", "left_semi")
    use = references.select("source_unit_id", "target").unionByName(calls.select("source_unit_id", "target"))
    # A subtype's unit is where its symbol is declared.
    under = hierarchy.select(F.col("subtype").alias("symbol_id"), F.col("supertype").alias("target")).join(symbols.select("symbol_id", "source_unit_id"), "symbol_id").select("source_unit_id", "target")
    met = use.unionByName(under).join(declared, F.col("target") == F.col("symbol_id"))
    return met.where(F.col("source_unit_id") != F.col("declared_in")).select(F.col("declared_in").alias("source_unit_id"), F.col("source_unit_id").alias("dependent")).distinct()
