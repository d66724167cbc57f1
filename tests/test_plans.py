"""The physical plans that the operators promise."""

import pytest
from pyspark.sql import functions as F

from factloom import schema
from factloom.mapping import Facts
from factloom.operators import diff, postings, ranges
from factloom.sources.store import Store


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    made = Store(spark, f"file://{tmp_path_factory.mktemp('plans')}/s")
    units = spark.createDataFrame([(f"u{i}", "c", f"p{i}", "java", "source", "f", "x", None, ("b", "1", 3, "o"), "complete") for i in range(9)], schema.struct("source_units"))
    edges = spark.createDataFrame([(f"u{i}", f"s{i}", "top", "exact", ("b", "1", 3, "o")) for i in range(9)], schema.struct("hierarchy_edges"))
    made.commit({"source_units": units, "hierarchy_edges": edges, "blob_refs": units.select("source_unit_id", F.col("content_fp").alias("blob_key"))})
    return made


def test_lookups_reach_the_scan(store):
    found = plan(postings.implementations_of(store.table("hierarchy_edges"), "top").select("subtype"))
    assert "PushedFilters: [IsNotNull(supertype), EqualTo(supertype,top)]" in found
    assert "ReadSchema: struct<source_unit_id:string,subtype:string,supertype:string>" in found
    assert "ReadSchema: struct<source_unit_id:string,content_fp:string>" in plan(store.snapshot_inputs())


def test_set_operators_are_semi_and_anti_joins(spark, store):
    refs, units = store.table("blob_refs"), store.table("source_units")
    assert "LeftAnti" in plan(postings.orphans(refs, units.select("source_unit_id"), "source_unit_id"))
    assert "LeftSemi" in plan(postings.retained(refs, units, "source_unit_id"))
    units = units.select("source_unit_id", "content_fp", "context_fp")
    assert "FullOuter" in plan(diff.source_plan(units, units))


def test_interval_joins_meet_by_key(spark):
    points = spark.range(9).select(F.lit("c").alias("cursor"), F.concat(F.lit("u"), "id").alias("source_unit_id"), F.col("id").alias("byte"))
    cover = spark.range(9).select(F.concat(F.lit("u"), "id").alias("source_unit_id"), F.col("id").alias("start_byte"), (F.col("id") + 5).alias("end_byte"))
    found = plan(ranges.covering(points, cover))
    assert "NestedLoop" not in found and "Cartesian" not in found and "_b" in found
    paths = spark.range(3).select(F.concat(F.lit("a/b"), "id").alias("workspace_path"))
    roots = spark.range(2).select(F.concat(F.lit("a"), "id").alias("root"), F.lit("c").alias("component_id"))
    found = plan(ranges.deepest_component(paths, roots))
    assert "NestedLoop" not in found and "Cartesian" not in found


def test_no_python_in_the_fact_operators(spark, tmp_path):
    import re
    from pathlib import Path

    import factloom

    for path in Path(factloom.__file__).parent.rglob("*.py"):
        if "llm" not in path.parts:
            text = path.read_text()
            assert not re.search(r"\b(udf|pandas_udf|mapInPandas|mapInArrow|applyInPandas|applyInArrow|\.rdd\b|localCheckpoint)", text), path


def test_top_k_is_one_pass(spark):
    rows = Facts(spark, "unused")
    assert "symbols" in rows and len(rows) == len(list(rows))
    df = spark.range(100).select(F.col("id").alias("n"), F.col("id").cast("string").alias("k"))
    assert "TakeOrderedAndProject" in plan(postings.slowest(df, "n", "k"))
