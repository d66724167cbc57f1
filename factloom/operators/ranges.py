"""Interval stabbing, containment and longest-prefix joins.

Interval joins meet on the unit and on buckets of BUCKET bytes, so a long unit is many keys and no pair is
looked at that shares no bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKET = 4096


def stabbed(occurrences: DataFrame, unit: str, byte: int) -> DataFrame:
    """Occurrences of a unit that cover a byte, narrowest first."""
    inside = (F.col("source_unit_id") == unit) & (F.col("start_byte") <= byte) & (F.col("end_byte") > byte)
    return occurrences.where(inside).orderBy(F.desc("start_byte"), "end_byte")


def _buckets(start: Column, end: Column) -> Column:
    return F.sequence(F.floor(start / BUCKET), F.floor(F.greatest(end - 1, start) / BUCKET))


def covering(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """points (source_unit_id, byte, ...) with every interval (source_unit_id, start_byte, end_byte, ...) that covers them."""
    spread = intervals.withColumn("_b", F.explode(_buckets(F.col("start_byte"), F.col("end_byte"))))
    return (
        points.withColumn("_b", F.floor(F.col("byte") / BUCKET)).join(spread, ["source_unit_id", "_b"])
        .where((F.col("start_byte") <= F.col("byte")) & (F.col("end_byte") > F.col("byte"))).drop("_b")
    )


def nearest_enclosing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner (id, source_unit_id, start_byte, end_byte) with the narrowest outer interval around each, another than itself.

    A covering interval shares the bucket of what it covers' first byte. Ties by the lowest outer id.
    """
    o = outer.select("source_unit_id", F.col("id").alias("outer_id"), F.col("start_byte").alias("_s"), F.col("end_byte").alias("_e"))
    o = o.withColumn("_b", F.explode(_buckets(F.col("_s"), F.col("_e"))))
    met = inner.withColumn("_b", F.floor(F.col("start_byte") / BUCKET)).join(o, ["source_unit_id", "_b"])
    around = (F.col("_s") <= F.col("start_byte")) & (F.col("end_byte") <= F.col("_e")) & ~((F.col("_s") == F.col("start_byte")) & (F.col("_e") == F.col("end_byte")))
    best = met.where(around).groupBy("id").agg(F.min(F.struct((F.col("_e") - F.col("_s")).alias("w"), "outer_id")).alias("m"))
    return best.select("id", F.col("m.outer_id").alias("enclosing"))


def narrowest_declarations(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each point (cursor, source_unit_id, byte) the narrowest declarations that cover it, all ties.

    Among them those that are no constructors, if there are any; each symbol once.
    """
    declared = symbols.select("source_unit_id", "symbol_id", "kind", F.col("decl_start").alias("start_byte"), F.col("decl_end").alias("end_byte"))
    found = covering(points, declared).withColumn("width", F.col("end_byte") - F.col("start_byte"))
    tied = found.withColumn("r", F.rank().over(W.partitionBy("cursor").orderBy("width"))).where("r = 1")
    plain = F.max((F.col("kind") != "constructor").cast("int")).over(W.partitionBy("cursor"))
    return tied.withColumn("p", plain).where((F.col("p") == 0) | (F.col("kind") != "constructor")).select("cursor", "symbol_id", "kind", "width").distinct()


def first_typed(points: DataFrame, occurrences: DataFrame) -> DataFrame:
    """For each point the narrowest covering occurrence that has a type."""
    found = covering(points, occurrences.where(F.col("type_id").isNotNull()))
    best = F.min(F.struct((-F.col("start_byte")).alias("a"), F.col("end_byte").alias("b"), "type_id"))
    return found.groupBy("cursor").agg(best.alias("m")).select("cursor", F.col("m.type_id").alias("type_id"), (-F.col("m.a")).alias("start_byte"), F.col("m.b").alias("end_byte"))


def widest_context(references: DataFrame, contexts: DataFrame) -> DataFrame:
    """references (id, source_unit_id, start_byte, end_byte) with the widest context that holds them; the last of equals."""
    c = contexts.select("source_unit_id", F.col("start_byte").alias("_s"), F.col("end_byte").alias("_e")).withColumn("_b", F.explode(_buckets(F.col("_s"), F.col("_e"))))
    met = references.withColumn("_b", F.floor(F.col("start_byte") / BUCKET)).join(c, ["source_unit_id", "_b"])
    held = met.where((F.col("_s") <= F.col("start_byte")) & (F.col("end_byte") <= F.col("_e")))
    best = held.groupBy("id").agg(F.max(F.struct((F.col("_e") - F.col("_s")).alias("w"), F.col("_s").alias("s"))).alias("m"))
    return best.select("id", F.col("m.s").alias("start_byte"), (F.col("m.s") + F.col("m.w")).alias("end_byte"))


def _ancestors(path: Column) -> Column:
    """path and every folder above it, up to '.'."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.concat(F.array(F.lit(".")), above)


def deepest_component(paths: DataFrame, components: DataFrame, path: str = "workspace_path", fallback: str = ".") -> DataFrame:
    """paths with component_id of the deepest component root that holds them, else the fallback root's.

    Each path meets its own folders by equality, so this is a hash join, not a comparison with every root.
    """
    folders = paths.select(path, F.explode(_ancestors(F.col(path))).alias("root"))
    best = folders.join(components.select("root", "component_id"), "root").groupBy(path).agg(F.max_by("component_id", F.when(F.col("root") == fallback, -1).otherwise(F.length("root"))).alias("component_id"))
    return paths.join(best, path, "left")


def configuration_scope(inputs: DataFrame, components: DataFrame, always: tuple[str, ...] = ()) -> DataFrame:
    """inputs (workspace_path) with components: those of the deepest root that holds it, ties kept; of all for root files."""
    everyone = components.agg(F.array_sort(F.collect_set("component_id")).alias("everyone"))
    folders = inputs.select("workspace_path", F.explode(_ancestors(F.col("workspace_path"))).alias("root"))
    met = folders.join(components.select("root", "component_id"), "root").withColumn("depth", F.when(F.col("root") == ".", 0).otherwise(F.length("root")))
    deepest = met.withColumn("r", F.rank().over(W.partitionBy("workspace_path").orderBy(F.desc("depth")))).where("r = 1")
    own = deepest.groupBy("workspace_path").agg(F.array_sort(F.collect_set("component_id")).alias("own"))
    at_root = ~F.col("workspace_path").contains("/") | F.col("workspace_path").isin(*always)
    scoped = F.when(at_root, F.col("everyone")).otherwise(F.coalesce("own", F.array().cast("array<string>")))
    return inputs.join(own, "workspace_path", "left").crossJoin(F.broadcast(everyone)).select("workspace_path", scoped.alias("components"))
