"""Queries over all rows and whole texts, on the smallest tables; tests/test_oracle.py holds those with SQL against it."""

import re
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from factloom import queries
from factloom.functions import text
from factloom.mapping import Facts
from factloom.plans import capability, kql

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return queries.REGISTRY[name][0](Facts(spark, SF))


def test_joins_take_all_rows(spark):
    symbols = Facts(spark, SF)["symbols"]
    assert run(spark, "fan_out_all").count() == spark.read.parquet(f"{SF}/part.parquet").count()
    assert run(spark, "widest_context_all").select("id").distinct().count() == symbols.select("symbol_id").distinct().count()
    assert {"customer", "part", "supplier"} <= {r[0] for r in run(spark, "widest_context_all").select(F.split("id", ":")[0]).distinct().collect()}


def test_texts_are_read_whole(spark):
    documents = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    raw = {k: x.encode() for k, x in documents.items()}
    n = run(spark, "tokenize").count()
    found = run(spark, "byte_to_position_all").collect()
    assert len(found) == n and max(r.off for r in found) > 10_000
    for r in found:
        if r.off > 1900 and r.off % 7 == 0:
            head = raw[r.doc_id][: r.off].decode()
            assert (r.line, r.col) == (head.count("\n") + 1, len(head.rsplit("\n", 1)[-1]) + 1)
    found = run(spark, "snippet_all").collect()
    assert len(found) == n and max(r.start_byte for r in found) > 10_000
    for r in found:
        if r.start_byte > 190 and r.start_byte % 7 == 0:
            start, end = raw[r.doc_id].rfind(b"\n", 0, r.start_byte) + 1, raw[r.doc_id].find(b"\n", r.end_byte)
            assert r.line == re.sub(r"^\s+|\s+$", "", raw[r.doc_id][start : end if end >= 0 else None].decode(), flags=re.A)
    for r in run(spark, "range_text_all").collect():
        assert r.t == re.sub(r"\s+", " ", documents[r.doc_id], flags=re.A).strip(" ")
    assert "substring" not in run(spark, "utf16_offsets")._jdf.queryExecution().analyzed().toString()


def test_a_capability_refines_all_rows_of_a_plan(spark, tmp_path):
    """More candidates than a limit or budget allows: 2,400 classes that apply the type, by unit the asked nation's last."""
    for path in Path(SF).iterdir():
        if path.name != "customer.parquet":
            (tmp_path / path.name).symlink_to(path)
    rows = spark.read.parquet(f"{SF}/customer.parquet")
    kind = {c: rows.schema[c].dataType for c in ("c_custkey", "c_nationkey")}
    many = rows.limit(1).crossJoin(spark.range(2400).withColumnRenamed("id", "k")).withColumn("c_custkey", (F.col("k") * 4).cast(kind["c_custkey"]))
    many = many.withColumn("c_nationkey", F.when(F.col("k") < 1200, 1).otherwise(3).cast(kind["c_nationkey"])).withColumn("c_mktsegment", F.lit("BUILDING"))
    many.drop("k").write.parquet(f"{tmp_path}/customer.parquet")
    found = queries.REGISTRY["kql_capability"][0](Facts(spark, str(tmp_path)))
    assert sorted(r.symbol_id for r in found.collect()) == sorted(f"customer:{4 * k}" for k in range(1200, 2400))


def test_responses_over_all_rows_are_checked(spark):
    facts = Facts(spark, SF)
    plan = kql.Plan(facts["symbols"].where("kind = 'class'"), ("applied_symbol", "x"), 1, (kql.Step("x", ()),))

    def told(change, completeness="complete"):
        one = capability.Capability("x", 1, {}, lambda f, c, g: change(c.withColumn("completeness", F.lit(completeness))))
        return capability.Capabilities([one]).refine_all(plan, facts)

    assert told(lambda c: c).rows.count() == plan.rows.count() > 1
    assert told(lambda c: c.where("false")).metadata == {"state": "no_result"} and told(lambda c: c, "partial").status == "stale"
    for change, problem in ((lambda c: c.drop("completeness"), "without"), (lambda c: c.withColumn("symbol_id", F.lit(None).cast("string")), "nulls"), (lambda c: c.withColumn("source_unit_id", F.lit("o")), "outside")):
        with pytest.raises(capability.CapabilityError, match=problem):
            told(change)
    assert capability.Capabilities([]).refine_all(plan, facts, required=("x",)).status == "unsupported"
    assert capability.Capabilities([]).refine_all(plan, facts).rows.count() == plan.rows.count()


def test_snippets_read_a_text_once(spark):
    words = " ".join(f"w{i}" for i in range(300))
    texts = ["", "\n\n", "één\n\n  naïve 𝒳_1 …b\r\nlast\n", f" {words} \n{words}", "\n".join(f"a{i} é" for i in range(400)), None, "x" * 9 + "\t ", "two ids\nsame"]
    rows = [(k % 7, x) for k, x in enumerate(texts)]  # the last shares its id with the first
    found = text.snippets(spark.createDataFrame(rows, "k int, content string"), "k")
    plan = found._jdf.queryExecution().executedPlan().toString() + run(spark, "snippet_all")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan  # no text is met again by its terms
    asked = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(rows)], "i int, k int, content string")
    alone = text.terms(asked, "i").join(asked, "i").select("k", "start_byte", "end_byte", text.snippet(F.col("content"), F.col("start_byte"), F.col("end_byte")).alias("line"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, alone.collect())) and found.count() == 5 + 600 + 800 + 1 + 3
