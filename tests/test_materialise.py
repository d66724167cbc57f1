"""Blobs, dependency facts, batches and shards."""

import json

import pytest
from pyspark.sql import functions as F

from factloom import schema
from factloom.plans import capability, index
from factloom.sources import blobs, sinks
from factloom.sources.store import Store

PROV = {"backend": "b", "backend_version": "1", "protocol_version": 3, "analysis_options": "o"}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def units(spark, *items):
    """(id, component, language, content, api)"""
    out = [(u, c, f"{u}.kt", lang, "dependency" if u.startswith("dep") else "source", fp, "ctx", api, PROV, "complete") for u, c, lang, fp, api in items]
    return spark.createDataFrame(out, schema.struct("source_units"))


def symbols(spark, *items):
    """(id, unit, name, owner)"""
    out = [(i, u, "c", "kotlin", "class", n, f"q.{n}", None, o, [], [], 0, 100, 10, 20, ("b", 1, i), "fresh", "complete", PROV) for i, u, n, o in items]
    return spark.createDataFrame(out, schema.struct("symbols"))


def test_ordinals_follow_the_qualified_name_and_owners_are_linked(spark, tmp_path):
    cache = blobs.BlobCache(spark, f"file://{tmp_path}/b")
    facts = symbols(spark, ("s3", "u", "C", "s1"), ("s1", "u", "A", None), ("s2", "u", "B", "away"), ("s4", "u", "B", "s3"))
    told = cache.promote("sha256:ab", "id", facts, expected_digest=blobs.content_digest(facts), expected_rows=4)
    assert told.promoted and told.rows == 4 and told.octets > 0 and told.files >= 1
    assert rows(cache.between("sha256:ab", 0, 9).select("ordinal", "symbol_id", "owner_ordinal")) == [(0, "s1", None), (1, "s2", None), (2, "s4", 3), (3, "s3", 0)]
    assert cache.ordinals("sha256:ab", "q.B") == (1, 2) and cache.ordinals("sha256:ab", "q.Z") is None
    assert rows(cache.between("sha256:ab", 1, 2).select("symbol_id")) == [("s2",), ("s4",)]
    assert cache.load("sha256:ab").columns == facts.columns and cache.by_name("sha256:ab", "q.B").count() == 2


def test_keys_that_differ_in_signs_do_not_share_a_folder(spark, tmp_path):
    cache = blobs.BlobCache(spark, f"file://{tmp_path}/b")
    for n, key in enumerate(("a:b", "a-b", "a_:b", "a_-b", "a--b")):
        assert cache.publish(key, str(n), symbols(spark, (f"s{n}", "u", "A", None)))
    assert [cache.header(k)["identity"] for k in ("a:b", "a-b", "a_:b", "a_-b", "a--b")] == ["0", "1", "2", "3", "4"]
    with pytest.raises(ValueError):
        cache.readable("a/b")


def test_a_blob_with_changed_files_is_noticed(spark, tmp_path):
    cache = blobs.BlobCache(spark, f"file://{tmp_path}/b")
    facts = symbols(spark, ("s1", "u", "A", None), ("s2", "u", "B", None))
    assert cache.publish("k", "id", facts) and cache.verified("k") and cache.open("k")["rows"] == 2 and cache.open("none") is None
    file = next((tmp_path / "b" / "k" / "facts.parquet").glob("part-*.parquet"))
    whole = file.read_bytes()
    file.write_bytes(whole[:-9] + bytes([whole[-9] ^ 1]) + whole[-8:])
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    assert cache.open("k") is not None and not cache.verified("k")
    file.write_bytes(whole[:-1])
    with pytest.raises(schema.FactError):
        cache.open("k")
    assert cache.remove_invalid("k") and not cache.readable("k")


def test_publishing_a_key_that_is_there_leaves_it_and_nothing_aside(spark, tmp_path):
    cache = blobs.BlobCache(spark, f"file://{tmp_path}/b")
    facts = symbols(spark, ("s1", "u", "A", None))
    assert cache.publish("k", "first", facts)
    assert not cache.promote("k", "second", facts).promoted and cache.header("k")["identity"] == "first"
    with pytest.raises(schema.FactError):
        cache.promote("other", "id", facts, expected_rows=2)
    assert sorted(p.name for p in (tmp_path / "b").iterdir() if not p.name.endswith(".crc")) == ["k"]


def test_content_digest_counts_rows_and_not_their_order(spark):
    one, two = symbols(spark, ("s1", "u", "A", None)), symbols(spark, ("s2", "u", "B", None))
    assert blobs.content_digest(one.union(two)) == blobs.content_digest(two.union(one).repartition(3))
    assert len({blobs.content_digest(d) for d in (one, two, one.union(one), one.union(two), one.limit(0))}) == 5


def test_caching_artifacts(spark, tmp_path):
    store, cache = Store(spark, f"file://{tmp_path}/s"), blobs.BlobCache(spark, f"file://{tmp_path}/b")
    artifacts = spark.createDataFrame([(f"dep{n}", "c", f"{n}.jar", "f", "x", f"sha256:{n}") for n in range(3)], schema.struct("artifacts"))
    store.put_artifacts(artifacts, spark.createDataFrame([], schema.struct("symbol_locators")))
    fetched = []

    def fetch(artifact):
        fetched.append(artifact.source_unit_id)
        return symbols(spark, (f"{artifact.source_unit_id}.s", artifact.source_unit_id, "A", None))

    misses = spark.createDataFrame([("dep1",), ("dep0",), ("dep2",), ("dep9",)], "source_unit_id string")
    told = index.cache_artifacts(store, cache, misses, fetch, 2)
    assert fetched == ["dep0", "dep1"] and told["materialized"] == 2 and told["rows"] == 2 and told["octets"] > 0
    assert index.cache_artifact(store, cache, "dep0", fetch, 0) == ("already_materialized", None)
    assert index.cache_artifact(store, cache, "dep2", fetch, 0) == ("budget_exhausted", None)
    assert index.cache_artifact(store, cache, "dep9", fetch, 1) == ("not_cataloged", None) and len(fetched) == 2
    assert rows(store.table("blob_refs")) == [("dep0", "sha256:0"), ("dep1", "sha256:1")]
    assert store.table("blob_catalog").where("byte_length > 0").count() == 2 and store.table("symbols").count() == 0
    (tmp_path / "b" / "sha256-0" / "blob.json").write_text(json.dumps({"identity": "x"}))
    assert index.cache_artifact(store, cache, "dep0", fetch, 1)[0] == "materialized" and cache.verified("sha256:0")


def test_storing_dependencies_under_a_budget(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    found = units(spark, ("dep0", "c", "kotlin", "f", "a"), ("dep1", "c", "kotlin", "f", "a"), ("own", "c", "kotlin", "f", "a"))
    misses = spark.createDataFrame([("dep1",), ("dep0",), ("dep9",)], "source_unit_id string")

    def analyse(asked):
        return asked, {"symbols": symbols(spark, *((f"{r.source_unit_id}.s", r.source_unit_id, "A", None) for r in asked.collect()))}

    assert index.store_dependencies(store, misses, found, analyse, 1) == {"materialized": 1, "not_cataloged": 0}
    assert rows(store.table("symbols").select("symbol_id")) == [("dep0.s",)]
    assert index.store_dependencies(store, misses, found, analyse, 0) == {"materialized": 2, "not_cataloged": 1}
    assert rows(store.source_units().select("source_unit_id", "origin")) == [("dep0", "dependency"), ("dep1", "dependency")]


def test_batches_under_one_plan(spark, tmp_path):
    store, asked_for = Store(spark, f"file://{tmp_path}/s"), []
    texts, inputs = spark.createDataFrame([], schema.struct("text_documents")), spark.createDataFrame([], schema.struct("configuration_inputs"))
    uses = [("b", "b.s", "a.s"), ("d", "d.s", "a.s"), ("c", "c.s", "b.s")]

    def analyse(asked):
        ids = sorted(r.source_unit_id for r in asked.collect())
        asked_for.append(ids)
        edges = [(u, x, y, "exact", PROV) for u, x, y in uses if u in ids]
        return asked, {"symbols": symbols(spark, *((f"{i}.s", i, i, None) for i in ids)), "hierarchy_edges": spark.createDataFrame(edges, schema.struct("hierarchy_edges"))}

    def state(a, b, api):
        return units(spark, ("a", "c1", "kotlin", a, api), ("b", "c1", "kotlin", b, "x"), ("c", "c1", "java", "f", "x"), ("d", "c2", "kotlin", "f", "x"))

    told = index.index_batches(store, state("f", "f", "x"), analyse, inputs, texts, "w", most=1)
    assert told == {"reuse": 0, "analyze": 4, "remove": 0, "batches": 4, "dependents_removed": 0}
    assert asked_for == [["c"], ["a"], ["b"], ["d"]]
    # a's API and b's content change: b is in a batch and stays, d is in none and leaves.
    told = index.index_batches(store, state("g", "g", "y"), analyse, inputs, texts, "w", most=1)
    assert told == {"reuse": 2, "analyze": 2, "remove": 0, "batches": 2, "dependents_removed": 1}
    assert rows(store.source_units().select("source_unit_id", "content_fp")) == [("a", "g"), ("b", "g"), ("c", "f")]
    assert store.checkpoint().first().committed
    gone = index.index_batches(store, state("g", "g", "y").where("source_unit_id in ('a', 'b')"), analyse, inputs, texts, "w")
    assert gone == {"reuse": 2, "analyze": 0, "remove": 1, "batches": 0, "dependents_removed": 0}


def test_a_batch_that_fails_keeps_those_before(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    texts, inputs = spark.createDataFrame([], schema.struct("text_documents")), spark.createDataFrame([], schema.struct("configuration_inputs"))

    def analyse(asked):
        return (asked.limit(0), {}) if asked.where("source_unit_id = 'b'").count() else (asked, {})

    with pytest.raises(schema.FactError):
        index.index_batches(store, units(spark, ("a", "c", "kotlin", "f", "x"), ("b", "c", "kotlin", "f", "x")), analyse, inputs, texts, "w", most=1)
    assert rows(store.source_units().select("source_unit_id")) == [("a",)] and store.checkpoint().count() == 0


def test_shards_take_owned_files_and_own_components(spark):
    found = units(spark, ("a", "c1", "java", "f", "x"), ("b", "c2", "java", "f", "x"), ("g", "none", "java", "f", "x"))
    owned = spark.createDataFrame([("c1", None), ("c2", "b.kt"), ("c3", "g.kt"), ("c1", "g.kt")], "component_id string, workspace_path string")
    assert rows(sinks.shard_plan(found, owned).select("shard", "source_unit_id")) == [("c1", "a"), ("c1", "g"), ("c2", "b"), ("c3", "g")]
    with pytest.raises(schema.FactError):
        sinks.shard_plan(found, owned.where(F.col("component_id") == "c1"))


def test_pages_beyond_what_the_driver_holds_are_written(spark):
    pages = {None: ([("k1", "old"), ("k2", "x")], "c1"), "c1": ([("k3", "y")], "c2"), "c2": ([("k1", "new")], None)}
    for held in (1, 2, 3, 100):
        assert rows(sinks.paged(pages.__getitem__, spark, "k string, v string", "k", held=held)) == [("k1", "new"), ("k2", "x"), ("k3", "y")]


def test_responses_of_capabilities_are_checked(spark):
    given = symbols(spark, ("s1", "u", "A", None), ("s2", "u", "B", None))
    budget = capability.Budget(millis=30_000)

    def answer(change):
        return capability.execute(capability.Capability("x", 1, {}, lambda f, c, g: change(c)), {}, given, {}, budget)

    assert answer(lambda c: c.select("symbol_id", "completeness", "source_unit_id").union(c.select("symbol_id", "completeness", "source_unit_id"))) == ("complete", ["s1", "s2"])
    for change, told in (
        (lambda c: c.select("symbol_id"), "without completeness"),
        (lambda c: c.withColumn("symbol_id", F.lit(None).cast("string")), "nulls"),
        (lambda c: c.withColumn("source_unit_id", F.lit("other")), "outside"),
    ):
        with pytest.raises(capability.CapabilityError, match=told):
            answer(change)
