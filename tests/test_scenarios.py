"""Small scenarios with exact expected rows."""

import json

import pytest
from pyspark.sql import functions as F

from factloom import answer, schema
from factloom.functions import digest, text, values
from factloom.operators import diff, enrich, freshness, graph, lexical, postings, ranges, summaries, validate
from factloom.plans import capability, index, kql, navigate, packages, status
from factloom.sources import blobs, snapshots, workspace
from factloom.sources.store import Store
from factloom.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


PROV = {"backend": "b", "backend_version": "1", "protocol_version": 3, "analysis_options": "o"}


def unit(spark, *items):
    out = [(u, "c", f"{u}.kt", "kotlin", "source", fp, "ctx", api, PROV, "complete") for u, fp, api in items]
    return spark.createDataFrame(out, schema.struct("source_units"))


def symbol(spark, *items):
    """(id, unit, kind, name, owner, applied)"""
    out = [(i, u, "c", "kotlin", k, n, f"q.{n}", None, o, [], a, 0, 100, 10, 20, ("b", 1, i), "fresh", "complete", PROV) for i, u, k, n, o, a in items]
    return spark.createDataFrame(out, schema.struct("symbols"))


def edges(spark, *items):
    return spark.createDataFrame([(u, a, b, "exact", PROV) for u, a, b in items], schema.struct("hierarchy_edges"))


# --- text -------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("line", "column", "byte"), [(1, 3, 5), (2, 1, 7), (2, 5, 11), (2, 6, None), (0, 1, None), (3, 1, None), (1, 0, None)])
def test_position_to_byte(spark, line, column, byte):
    df = spark.range(1).select(text.offset(F.lit("a😀b\nnext"), F.lit(line), F.lit(column)).alias("x"))
    assert df.first().x == byte


@pytest.mark.parametrize(("byte", "spot"), [(5, (1, 3)), (7, (2, 1)), (2, None), (99, None), (0, (1, 1))])
def test_byte_to_position(spark, byte, spot):
    found = spark.range(1).select(text.position(F.lit("a😀b\nnext"), F.lit(byte)).alias("x")).first().x
    assert (tuple(found) if found else None) == spot


def test_terms_have_byte_offsets(spark):
    df = spark.createDataFrame([("p", "one 😀 needle_2\ntwo é"), ("q", ""), ("r", None)], "k string, content string")
    assert rows(text.terms(df, "k")) == [("p", "needle_2", 9, 17), ("p", "one", 0, 3), ("p", "two", 18, 21), ("p", "é", 22, 24)]


def test_utf16(spark):
    got = [spark.range(1).select(text.utf16_to_utf8(F.lit("a😀é"), F.lit(u)).alias("x")).first().x for u in range(5)]
    assert got == [0, 1, 5, 5, 7]


def test_small_text_functions(spark):
    one = spark.range(1)
    t = F.lit("val x: List<Foo>\n  next  line\n")
    assert one.select(text.generic_context(t, F.lit(12), F.lit(15))).first()[0] == "List<Foo>"
    assert one.select(text.range_text(t, F.lit(16), F.lit(30))).first()[0] == "next line"
    assert one.select(text.location(F.lit("a:b/c.kt:3:14"))).first()[0].asDict() == {"path": "a:b/c.kt", "line": 3, "column": 14}
    assert one.select(text.location(F.lit("a:b"))).first()[0] is None
    assert text.searchable("ab_1é") and not text.searchable("a b") and not text.searchable("")
    assert one.select(values.named_strings(F.lit('@A(name = ["x", "y"], prefix="z")'), "name")).first()[0] == ["x", "y"]
    assert one.select(values.callable_key(F.lit("p"), F.lit("T"), F.lit(None).cast("string"), F.array(F.lit("a/B$C")))).first()[0] == "p.T.<init>(a.B.C)"
    assert one.select(values.package_of(F.lit("// x\npackage a.b.c\n")), values.declared_types(F.lit("class A { interface B }"))).first()[:] == ("a.b.c", ["A", "B"])


def test_digests_frame_entries_with_nul(spark):
    import hashlib

    df = spark.createDataFrame([("b",), ("a",)], "e string")
    assert df.agg(digest.entries(F.col("e"))).first()[0] == "sha256:" + hashlib.sha256(b"a\0b\0").hexdigest()
    assert df.limit(0).agg(digest.entries(F.col("e"))).first()[0] == "sha256:" + hashlib.sha256(b"").hexdigest()
    files = spark.createDataFrame([("p", "é")], "p string, c string")
    assert files.agg(digest.files(F.col("p"), F.col("c"))).first()[0] == "sha256:" + hashlib.sha256(b"p\0" + (2).to_bytes(8, "big") + "é".encode()).hexdigest()


def test_text_sync_and_search(spark):
    def docs(*items):
        return spark.createDataFrame(list(items), "workspace_path string, content string").withColumn("content_fp", digest.fingerprint(F.col("content"))).select("workspace_path", "content_fp", "content")

    none_d, none_t = spark.createDataFrame([], schema.struct("text_documents")), spark.createDataFrame([], schema.struct("text_terms"))
    documents, found = lexical.synchronised(none_d, none_t, docs(("alpha", "one 😀 needle\ntwo"), ("beta", "needle")))
    hits = lexical.search(found, documents, "needle")
    assert hits.status == "ok" and rows(hits.rows) == [("alpha", 9, 15, 1, 7, "one 😀 needle"), ("beta", 0, 6, 1, 1, "needle")]
    documents, found = lexical.synchronised(documents, found, docs(("alpha", "changed")))
    assert rows(lexical.matches(found, documents, "needle")) == [] and rows(documents.select("workspace_path")) == [("alpha",)]
    assert lexical.search(found, documents, "no way").problems[0].code == "invalid_text_query"


# --- graph and ranges -------------------------------------------------------------------------------


def test_transitive_subtypes_with_a_cycle(spark):
    e = edges(spark, ("u", "service", "provider"), ("u", "concrete", "service"), ("u", "provider", "concrete"))
    found = graph.transitive_subtypes(e, "provider").orderBy("rank").collect()
    assert [(r.subtype, r.rank, r.depth) for r in found] == [("service", 1, 1), ("concrete", 2, 2)]
    assert rows(graph.transitive_subtypes(e, "nobody")) == []


def test_breadth_first_order(spark):
    e = edges(spark, ("b", "x", "s"), ("a", "y", "s"), ("a", "z", "x"), ("a", "w", "y"), ("a", "z", "y"))
    found = graph.transitive_subtypes(e, "s").orderBy("rank").collect()
    assert [(r.subtype, r.supertype) for r in found] == [("y", "s"), ("x", "s"), ("w", "y"), ("z", "y")]


def test_narrowest_prefers_what_is_no_constructor(spark):
    s = spark.createDataFrame([("outer", "class", 0, 90), ("made", "constructor", 10, 20), ("inner", "class", 10, 20)], "symbol_id string, kind string, decl_start long, decl_end long").withColumn("source_unit_id", F.lit("u"))
    p = spark.createDataFrame([("c1", "u", 12), ("c2", "u", 50), ("c3", "u", 95)], "cursor string, source_unit_id string, byte long")
    assert rows(ranges.narrowest_declarations(p, s).select("cursor", "symbol_id")) == [("c1", "inner"), ("c2", "outer")]


def test_long_intervals_are_found_across_buckets(spark):
    o = spark.createDataFrame([("u", 0, 100_000, "a"), ("u", 5000, 9000, "b")], "source_unit_id string, start_byte long, end_byte long, t string")
    p = spark.createDataFrame([("p", "u", 8999), ("q", "u", 9000)], "cursor string, source_unit_id string, byte long")
    assert rows(ranges.covering(p, o).select("cursor", "t")) == [("p", "a"), ("p", "b"), ("q", "a")]


def test_deepest_component_and_scope(spark):
    c = spark.createDataFrame([("all", "."), ("app", "app"), ("web", "app/web"), ("twin", "app/web")], "component_id string, root string")
    p = spark.createDataFrame([("app/web/a.kt",), ("app/b.kt",), ("apple/c.kt",), ("d.kt",)], "workspace_path string")
    assert rows(ranges.deepest_component(p, c.where("component_id <> 'twin'"))) == [("app/b.kt", "app"), ("app/web/a.kt", "web"), ("apple/c.kt", "all"), ("d.kt", "all")]
    scope = {r[0]: r[1] for r in rows(ranges.configuration_scope(p, c))}
    assert scope == {"app/web/a.kt": ["twin", "web"], "app/b.kt": ["app"], "apple/c.kt": ["all"], "d.kt": ["all", "app", "twin", "web"]}


# --- plans ------------------------------------------------------------------------------------------


def test_source_plan_order_and_reasons(spark):
    f = lambda *x: spark.createDataFrame(list(x), "source_unit_id string, content_fp string, context_fp string")
    plan = diff.source_plan(f(("a", "1", "c"), ("b", "2", "c"), ("c", "1", "d"), ("e", "1", "c")), f(("a", "1", "c"), ("b", "1", "c"), ("c", "9", "c"), ("d", "1", "c")))
    got = [tuple(r) for r in plan.orderBy("removal", "source_unit_id").collect()]
    assert got == [("a", "reuse", None, False), ("b", "reanalyze", "content_changed", False), ("c", "reanalyze", "context_changed", False), ("e", "reanalyze", "content_changed", False), ("d", "remove", None, True)]
    assert diff.needs_worker(plan) and diff.summary(plan).first().asDict() == {"reuse": 1, "analyze": 3, "remove": 1}


def test_analysis_drift(spark):
    f = lambda *x: spark.createDataFrame([(u, "1", "c", b, v, 3, o) for u, b, v, o in x], "source_unit_id string, content_fp string, context_fp string, backend string, backend_version string, protocol_version int, analysis_options string")
    plan = diff.analysis_plan(f(("a", "k", "1", "x"), ("b", "k", "1", "y"), ("c", "k", "1", "x")), f(("a", "k", "0", "x"), ("b", "k", "1", "x"), ("c", "k", "1", "x")))
    assert rows(plan.select("source_unit_id", "reason")) == [("a", "backend_changed"), ("b", "analysis_options_changed"), ("c", None)]


def test_dependency_plan(spark):
    f = lambda *x: spark.createDataFrame(list(x), "source_unit_id string, identity string")
    plan = diff.dependency_plan(f(("warm", "i"), ("moved", "j"), ("lost", "i")), f(("warm", "i"), ("moved", "i"), ("lost", "i"), ("old", "i")), f(("warm", ""), ("moved", "")))
    assert rows(plan) == [("lost", "cache_miss"), ("moved", "cache_miss"), ("old", "removed"), ("warm", "cache_hit")]


def test_configuration_states(spark):
    f = lambda *x: spark.createDataFrame([(p, h, c) for p, h, c in x], "workspace_path string, fingerprint string, components array<string>")
    states = diff.configuration_states(f(("c", "1", ["c"]), ("same", "1", ["a"])), f(("b", "1", ["b"]), ("same", "1", ["a"])))
    assert rows(states.select("workspace_path", "state")) == [("b", "missing"), ("c", "added"), ("same", "current")]
    assert rows(diff.affected_components(states)) == [("b",), ("c",)]


def test_checkpoint_verdicts():
    v = freshness.checkpoint_verdict
    assert v(None, {}, {}, False) == "unknown"
    saved = {"committed": True, "source_fp": "a"}
    assert v(saved, {"source_fp": "b"}, {}, False) == "stale" and v(saved, {"source_fp": "a"}, {"stale": 1}, False) == "stale" and v(saved, {"source_fp": "a"}, {}, True) == "stale"
    assert v(saved, {"source_fp": "a"}, {"unknown": 1}, False) == "unknown" and v(saved, {"source_fp": "a"}, {}, False) == "fresh"


def test_batches_chunk_each_group(spark):
    df = spark.createDataFrame([(f"u{i:02}", f"p{i:02}", "c" if i < 5 else None, "java") for i in range(8)], "source_unit_id string, workspace_path string, component_id string, language string")
    got = {r.source_unit_id: r.batch for r in summaries.batches(df, 2).collect()}
    assert got == {"u00": 0, "u01": 0, "u02": 1, "u03": 1, "u04": 2, "u05": 0, "u06": 0, "u07": 1}


def test_rollups_and_unique_keys(spark):
    f = spark.createDataFrame([("fresh", "complete"), ("unknown", "complete")], "freshness string, completeness string")
    assert summaries.freshness_of(f).first().freshness == "unknown" and summaries.state_of(f).first().state == "partial"
    assert summaries.state_of(f.limit(0)).first().state == "no_result" and summaries.state_of(f.limit(1)).first().state == "complete"
    pairs = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2")], "k string, v string")
    assert rows(postings.unique_keys(pairs, "k", "v")) == [("a", "1")]


def test_enrichment_replaces_only_the_same_range(spark):
    f = lambda *x: spark.createDataFrame([("u", a, b, "ref", t) for a, b, t in x], "source_unit_id string, start_byte long, end_byte long, kind string, t string")
    assert rows(enrich.enriched(f((0, 1, "approx"), (5, 6, "approx")), f((0, 1, "exact"))).select("start_byte", "t")) == [(0, "exact"), (5, "approx")]


# --- framework results ----------------------------------------------------------------------------------


def test_framework_result_states(spark):
    kind = "symbol_id string, disposition string, reasons array<string>, evidence array<struct<code:string,target:string,backend:string,version:string,options:string>>"
    e = ("x.y", "symbol:a", "b", "1", "o")
    good = spark.createDataFrame([("b", "included", ["r.b", "r.a", "r.b"], [e, e]), ("a", "unresolved", ["r.a"], [e])], kind)
    none = spark.createDataFrame([], "code string, message string")
    edge = spark.createDataFrame([("some.edge", "m")], "code string, message string")
    assert rows(validate.framework_problems(good, none, "complete")) == [("result", "invalid_complete_state")]
    assert rows(validate.framework_problems(good, edge, "partial")) == [] and rows(validate.framework_problems(good, none, "partial")) == [("result", "missing_partial_boundary")]
    assert rows(validate.framework_problems(good, edge, "unsupported")) == [("result", "invalid_unsupported_state")]
    assert rows(validate.framework_problems(good.withColumn("reasons", F.array(F.lit("Bad"))), edge, "partial")) == [("a", "invalid_code"), ("b", "invalid_code")]
    tidy = validate.normalised_candidates(good).collect()
    assert [(r.symbol_id, r.reasons, len(r.evidence)) for r in tidy] == [("a", ["r.a"], 1), ("b", ["r.a", "r.b"], 1)]


# --- the query language -------------------------------------------------------------------------------------

GOOD = 'command a.b(t: symbol-id, n: integer) {\n  # comment\n  from subtype_of($t)\n  where kind == class and component == "c"\n  using capability hierarchy.direct(target=symbol-id("p"))\n  limit 5\n  limit 10\n}'


def test_parse_and_bind():
    p = kql.parse(GOOD)
    assert p.relation == "subtype_of" and p.limit == 10 and p.steps[0].name == "hierarchy.direct" and len(p.where) == 2
    assert kql.bind(p, {"t": "x", "n": "3"})["n"].value == 3
    for values_ in ({"t": "x"}, {"t": "x", "n": "1", "z": "1"}, {"t": "x", "n": "one"}):
        with pytest.raises(kql.QueryError):
            kql.bind(p, values_)


@pytest.mark.parametrize(
    "bad",
    [
        "", "command A() {\n from applies($x)\n limit 1\n}", "command a() {\n limit 1\n}", "command a() {\n from applies($x)\n}", "command a() {\n from applies($x)\n from applies($x)\n limit 1\n}",
        "command a() {\n from applies(x)\n limit 1\n}", "command a() {\n from applies($x)\n where kind == enum\n limit 1\n}", "command a() {\n from applies($x)\n where kind = class\n limit 1\n}",
        "command a() {\n from applies($x)\n use pkg\n limit 1\n}", "command a() {\n from applies($x)\n limit many\n}", "command a() {\n from applies($x)\n limit 1", "command a(x: float) {\n from applies($x)\n limit 1\n}",
    ],
)
def test_refused_programs(bad):
    with pytest.raises(kql.QueryError):
        kql.parse(bad)


def make_facts(spark):
    return {
        "symbols": symbol(spark, ("s1", "u1", "class", "One", None, ["ann"]), ("s2", "u1", "class", "Two", None, []), ("s3", "u2", "interface", "Two", None, ["ann"]), ("mk", "u1", "constructor", "One", "s1", [])),
        "source_units": unit(spark, ("u1", "f1", None), ("u2", "f2", None)),
        "hierarchy_edges": edges(spark, ("u1", "s1", "p"), ("u2", "s1", "p"), ("u1", "s3", "p"), ("u1", "gone", "p"), ("u2", "s2", "s1")),
        "symbol_locators": spark.createDataFrame([("a", "q.One", "s1"), ("a", "q.Twice", "s1"), ("b", "q.Twice", "s2")], schema.struct("symbol_locators")),
        "reference_edges": spark.createDataFrame([("u2", 5, 8, "ref", "s1"), ("u2", 5, 8, "ref", "s1")], "source_unit_id string, start_byte long, end_byte long, kind string, target string"),
        "call_edges": spark.createDataFrame([("u2", 30, 33, "call", "mk", "s3")], "source_unit_id string, start_byte long, end_byte long, kind string, target string, caller string"),
    }


def test_run_keeps_duplicates_and_drops_unknown_subtypes(spark):
    facts = make_facts(spark)
    found = kql.query('command a() {\n from subtype_of(symbol-id("p"))\n limit 10\n}', facts)
    assert [r.symbol_id for r in found.rows.collect()] == ["s1", "s1", "s3"] and found.status == "ok"
    cut = kql.query('command a() {\n from implements(symbol-id("p"))\n limit 2\n}', facts)
    assert cut.status == "stale" and cut.metadata["truncated"] and cut.rows.count() == 2
    assert kql.query('command a() {\n from applies(symbol-id("ann"))\n where kind == interface\n limit 2\n}', facts).rows.first().symbol_id == "s3"
    assert kql.query('command a() {\n from applies(symbol-id("nope"))\n limit 2\n}', facts).status == "no_result"
    with pytest.raises(kql.QueryError):
        kql.query('command a() {\n from applies(symbol-id("ann"))\n limit 1001\n}', facts)
    assert kql.resolve_name(facts["symbol_locators"], "q.One") == "s1" and kql.resolve_name(facts["symbol_locators"], "x.Y") == "jvm:type:x.Y"
    for name in ("q.Twice", "plain"):
        with pytest.raises(kql.QueryError):
            kql.resolve_name(facts["symbol_locators"], name)
    with pytest.raises(kql.QueryError):
        kql.select(facts)
    assert kql.select(facts, subtype_of=["z", "p"], applied=["ann"]).posting == ("hierarchy", "p")


def test_navigation(spark):
    facts = make_facts(spark)
    assert navigate.symbols(facts, "One").status == "ambiguous" and navigate.symbols(facts, "q.One").rows.first().symbol_id == "s1"
    assert navigate.symbols(facts, "tw").status == "ambiguous" and navigate.symbols(facts, "zzz").status == "no_result"
    assert navigate.definition(facts, "Two").problems[0].code == "ambiguous_target"
    assert navigate.definition(facts, "java:none").problems[0].code == "resolved_symbol_missing"
    refs = postings.references_of_class(facts["reference_edges"], facts["call_edges"], facts["symbols"], "s1")
    assert rows(refs) == [("u2", 5, 8, "ref", "s1"), ("u2", 30, 33, "call", "mk")]
    overall, answers = navigate.fan_out(facts, navigate.callers, ["java:b", "java:a", "java:a"])
    assert overall == "no_result" and list(answers) == ["java:a", "java:b"]


def test_capabilities(spark):
    facts = make_facts(spark)
    program = kql.parse('command a() {\n from applies(symbol-id("ann"))\n using capability hierarchy.direct(target=symbol-id("p"))\n limit 10\n}')
    found = capability.Capabilities().refine(kql.compile(program, facts, {}), facts, budget=capability.Budget(millis=30_000))
    assert sorted(r.symbol_id for r in found.rows.collect()) == ["s1", "s3"] and found.status == "ok"
    none = capability.Capabilities(offered=[])
    assert none.refine(kql.compile(program, facts, {}), facts, required=("hierarchy.direct",)).status == "unsupported"
    assert none.refine(kql.compile(program, facts, {}), facts).status == "stale"
    assert capability.Capabilities().negotiate("hierarchy.direct", 2)[0] == "incompatible_version"
    one = capability.BUILTIN[0]
    for given in ([], [("x", kql.Value("string", "a"))], [("target", kql.Value("string", "a"))], [("target", kql.Value("symbol-id", "a"))] * 2):
        with pytest.raises(capability.CapabilityError):
            capability.arguments(one, given)
    with pytest.raises(capability.CapabilityError):
        capability.Budget(candidates=1001).checked()
    two = facts["symbols"].limit(2)
    greedy = capability.Capability("x", 1, {}, lambda f, c, g: c.select("symbol_id", "completeness").union(c.select("symbol_id", "completeness")))
    with pytest.raises(capability.CapabilityError):
        capability.execute(greedy, facts, two, {}, capability.Budget(candidates=2, millis=30_000))


# --- packages and settings ------------------------------------------------------------------------------------


def test_packages(tmp_path):
    root = tmp_path / ".factloom" / "query-packages" / "acme.web"
    (root / "macros").mkdir(parents=True)
    (root / "package.toml").write_text('format = 1\nrequires_core = "^1"\nid = "acme.web"\nversion = "1.0.0"\n[exports]\nmacros = ["beans"]\n[[capabilities]]\nname = "x.y_z"\nversion = 1\nrequired = true\n')
    (root / "macros" / "beans.kql").write_text("from applies($t)\nwhere kind == class\n")
    queries = tmp_path / ".factloom" / "queries"
    queries.mkdir()
    (queries / "mine.kql").write_text("command mine(t: symbol-id) {\n from acme.web.beans()\n limit 3\n}")
    registry = packages.Registry().load(str(tmp_path))
    program, used = packages.load(str(tmp_path), "mine", registry)
    assert used == {"acme.web"} and program.where[0][0] == "kind" and registry.needs(used)[0].required
    assert packages.describe(program, registry.needs(used))["posting"] == "applied_symbol" and [p.stem for p in packages.commands(str(tmp_path))] == ["mine"]
    with pytest.raises(packages.PackageError):
        registry.resolve("acme.web.none", "macros")
    with pytest.raises(packages.PackageError):
        registry.load(str(tmp_path))
    base = {"format": 1, "requires_core": "^1", "id": "a", "version": "1.0.0"}
    for change in ({"format": 2}, {"requires_core": "^2"}, {"id": "A"}, {"version": "1.0"}, {"zzz": 1}, {"exports": {"macros": ["a", "a"]}}, {"capabilities": [{"name": "a", "version": 0}]}, {"capabilities": [{"name": "a", "version": 1}] * 2}):
        with pytest.raises(packages.PackageError):
            packages.manifest(base | change)


def test_settings(tmp_path):
    assert workspace.load_settings(str(tmp_path)) == workspace.Settings()
    workspace.init_settings(str(tmp_path))
    assert workspace.load_settings(str(tmp_path)) == workspace.Settings()
    with pytest.raises(workspace.SettingsError):
        workspace.init_settings(str(tmp_path))
    shared = tmp_path / "shared.toml"
    shared.write_text('freshness_strategy = "allow_stale"\n[workers]\nmax_total = 9\n')
    (tmp_path / ".factloom" / "config.toml").write_text("[workers]\ndependency_workers = 3\n")
    got = workspace.load_settings(str(tmp_path), str(shared))
    assert (got.freshness_strategy, got.max_total, got.dependency_workers) == ("allow_stale", 9, 3)
    for bad in ("x = 1", "schema_version = 2", '[workers]\nmax_total = "1"', "[workers]\nmax_total = 1", "[maven]\nz = 1", "not toml"):
        shared.write_text(bad)
        with pytest.raises(workspace.SettingsError):
            workspace.load_settings(str(tmp_path), str(shared))


def test_workspace_files(spark, tmp_path):
    (tmp_path / "app" / "src" / "generated").mkdir(parents=True)
    (tmp_path / "build").mkdir()
    (tmp_path / "settings.gradle").write_text("rootProject")
    (tmp_path / "app" / "build.gradle").write_text("x")
    (tmp_path / "app" / "src" / "A.kt").write_text("class A")
    (tmp_path / "app" / "src" / "generated" / "B.java").write_text("class B {}")
    (tmp_path / "build" / "C.kt").write_text("class C")
    (tmp_path / "bin").write_bytes(b"\0\1")
    (tmp_path / "bad").write_bytes(b"\xff\xfe")
    (tmp_path / "big").write_bytes(b"a" * (1_048_576 + 1))
    found = workspace.files(spark, str(tmp_path))
    documents, skipped = workspace.texts(spark, str(tmp_path))
    assert rows(skipped.select("workspace_path", "reason")) == [("bad", "invalid_utf8"), ("big", "oversized"), ("bin", "binary")]
    assert [r[0] for r in documents.select("workspace_path").collect()] == ["app/build.gradle", "app/src/A.kt", "app/src/generated/B.java", "settings.gradle"]
    roots = workspace.components(found)
    assert rows(roots.select("component_id")) == [("filesystem:.",), ("gradle:app",)]
    units = workspace.source_units(found, roots)
    assert rows(units.select("workspace_path", "component_id", "origin", "language")) == [("app/src/A.kt", "gradle:app", "source", "kotlin"), ("app/src/generated/B.java", "gradle:app", "generated", "java")]
    assert workspace.workspace_root(str(tmp_path / "app" / "src" / "A.kt")) == tmp_path.resolve()


# --- store, blobs, snapshots, index, stream -----------------------------------------------------------------------


def test_store_is_all_or_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.replace("source_units", unit(spark, ("u1", "f1", None), ("u2", "f2", None)))
    store.commit({"symbols": symbol(spark, ("s1", "u1", "class", "One", None, []), ("s2", "u2", "class", "Two", None, []))})
    before = store.generation["number"]
    for expected, given, facts in (
        (unit(spark, ("u1", "f1", None)), unit(spark, ("u1", "other", None)), {}),
        (unit(spark, ("u1", "f1", None)), unit(spark, ("u1", "f1", None)), {"symbols": symbol(spark, ("x", "u2", "class", "X", None, []))}),
        (unit(spark, ("u1", "f1", None)), unit(spark, ("u1", "f1", None)), {"symbols": symbol(spark, ("x", "u1", "class", "X", None, []), ("x", "u1", "class", "X", None, []))}),
        (unit(spark, ("u1", "f1", None)), unit(spark, ("u1", "f1", None)), {"symbols": symbol(spark, ("s2", "u1", "class", "X", None, []))}),
    ):
        with pytest.raises(schema.FactError):
            store.replace_snapshots(expected, given, facts)
    again = Store(spark, f"file://{tmp_path}/s")
    assert again.generation["number"] == before and rows(again.table("symbols").select("symbol_id")) == [("s1",), ("s2",)]
    one = unit(spark, ("u1", "f9", None))
    again.replace_snapshots(one, one, {"symbols": symbol(spark, ("s9", "u1", "class", "New", None, []))})
    assert rows(again.table("symbols").select("symbol_id")) == [("s2",), ("s9",)] and store.refresh().generation == again.generation
    again.remove_units(one.select("source_unit_id"))
    assert rows(again.source_units().select("source_unit_id")) == [("u2",)] and again.verify()["symbols"] == 1
    again.record_blob("u2", "k", "i", 3)
    with pytest.raises(schema.FactError):
        again.record_blob("u2", "k", "other", 3)


def test_other_format_is_refused(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "CURRENT").write_text(json.dumps({"format": 99, "number": 1, "tables": {}}))
    with pytest.raises(schema.FactError):
        Store(spark, f"file://{tmp_path}/s")


def test_blobs(spark, tmp_path):
    cache = blobs.BlobCache(spark, f"file://{tmp_path}/b")
    facts = symbol(spark, ("s1", "u", "class", "One", None, []), ("s2", "u", "class", "Two", None, []))
    assert cache.publish("sha256:ab", "id", facts) and not cache.publish("sha256:ab", "id", facts)
    assert cache.header("sha256:ab")["rows"] == 2 and cache.verified("sha256:ab") and cache.by_name("sha256:ab", "q.Two").count() == 1
    with pytest.raises(schema.FactError):
        cache.publish("sha256:cd", "id", facts, expected_digest="no")
    assert not cache.readable("sha256:cd") and not cache.remove_invalid("sha256:ab")
    (tmp_path / "b" / "sha256-ab" / "blob.json").write_text(json.dumps({"identity": "id", "rows": 2, "digest": "x"}))
    assert cache.remove_invalid("sha256:ab") and not cache.readable("sha256:ab")


def snapshot(uid="u1", content="f1", edge=0):
    state = {"freshness": "fresh", "completeness": "complete", "provenance": 0}
    return {
        "source_unit": {"id": uid, "component": "c", "path": f"{uid}.kt", "language": "kotlin", "origin": "source", "content": content, "context": "ctx"},
        "completeness": "complete", "provenances": [PROV],
        "symbols": [{"id": f"{uid}.s", "language": "kotlin", "kind": "class", "name": "S", "modifiers": [], "applied_symbols": ["ann"], "declaration": {"start": 0, "end": 9}, "name_range": {"start": 1, "end": 2}} | state],
        "occurrences": [{"range": {"start": 4, "end": 6}, "kind": "reference", "target": "t", "precision": "exact"} | state], "references": [{"occurrence": edge, "target": "t", "precision": "exact"}], "calls": [],
        "hierarchy": [{"subtype": f"{uid}.s", "supertype": "p", "precision": "exact", "provenance": 0}],
        "applications": [{"id": f"{uid}.a", "subject": f"{uid}.s", "target": "ann", "range": {"start": 0, "end": 1}, "arguments": [{"name": "n", "position": 0, "value_kind": "string", "value_text": "v"}], "precision": "exact"} | state],
        "types": [], "diagnostics": [{"severity": "warning", "message": "m"} | state],
    }


def write(path, *items):
    path.mkdir(exist_ok=True)
    (path / f"{len(list(path.iterdir()))}.json").write_text("\n".join(map(json.dumps, items)))
    return str(path)


def test_snapshots_and_stream(spark, tmp_path):
    folder = write(tmp_path / "in", snapshot("u1"), snapshot("u2"))
    units, facts = snapshots.decode(snapshots.read(spark, folder))
    assert rows(facts["reference_edges"].select("source_unit_id", "start_byte", "end_byte", "target")) == [("u1", 4, 6, "t"), ("u2", 4, 6, "t")]
    assert facts["symbols"].first().provenance.backend == "b" and units.count() == 2
    with pytest.raises(schema.FactError):
        snapshots.decode(snapshots.read(spark, write(tmp_path / "bad", snapshot(edge=7))))
    root = f"file://{tmp_path}/store"
    ingest.stream(spark, folder, root, f"{tmp_path}/cp").awaitTermination()
    store = Store(spark, root)
    assert store.verify()["symbols"] == 2 and store.verify()["application_arguments"] == 2
    write(tmp_path / "in", snapshot("u1", "f2"), {"source_unit": {"id": "u2"}})
    ingest.stream(spark, folder, root, f"{tmp_path}/cp").awaitTermination()
    assert rows(store.refresh().source_units().select("source_unit_id", "content_fp")) == [("u1", "f2")] and store.verify()["application_arguments"] == 1


def test_index_run(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    texts = spark.createDataFrame([("u1.kt", "f1", "class S"), ("u2.kt", "f2", "val s: S")], schema.struct("text_documents"))
    inputs = spark.createDataFrame([("pom.xml", "x", ["c"])], schema.struct("configuration_inputs"))

    def analyse(asked):
        ids = [r.source_unit_id for r in asked.collect()]
        found = {"u1": symbol(spark, ("s1", "u1", "class", "S", None, [])), "u2": symbol(spark, ("s2", "u2", "class", "T", None, []))}
        out = {"hierarchy_edges": edges(spark, *([("u2", "s2", "s1")] if "u2" in ids else []))} if "u2" in ids else {}
        symbols = found[ids[0]] if len(ids) == 1 else found["u1"].union(found["u2"])
        return asked, out | {"symbols": symbols}

    first = index.index(store, unit(spark, ("u1", "f1", "a"), ("u2", "f2", "a")), analyse, inputs, texts, "w")
    assert first == {"reuse": 0, "analyze": 2, "remove": 0, "dependents_removed": 0}
    again = index.index(store, unit(spark, ("u1", "f1", "a"), ("u2", "f2", "a")), analyse, inputs, texts, "w")
    assert again["reuse"] == 2 and again["analyze"] == 0
    now = unit(spark, ("u1", "f1", "a"), ("u2", "f2", "a"))
    assert status.status(store, now, inputs, spark.createDataFrame([], "blob_key string, length long")).metadata["freshness"] == "fresh"
    edit = index.index(store, unit(spark, ("u1", "f9", "b"), ("u2", "f2", "a")), analyse, inputs, texts, "w")
    assert edit["analyze"] == 1 and edit["dependents_removed"] == 1 and rows(store.source_units().select("source_unit_id")) == [("u1",)]
    assert status.status(store, now, inputs, spark.createDataFrame([], "blob_key string, length long")).metadata["freshness"] == "stale"
    with pytest.raises(schema.FactError):
        index.index(store, unit(spark, ("u7", "f", "a")), lambda asked: (asked.limit(0), {}), inputs, texts, "w")


def test_gate(spark):
    units = unit(spark, ("u1", "f1", None), ("u2", "f2", None))
    now = spark.createDataFrame([("u1.kt", "f1"), ("u2.kt", "new")], "workspace_path string, content_fp string")
    good = answer.Answer("ok", units.where("source_unit_id = 'u1'").select("source_unit_id"))
    bad = answer.Answer("ok", units.select("source_unit_id"))
    assert freshness.gate(good, units, now).status == "ok" and freshness.gate(bad, units, now, strategy="allow_stale").status == "ok"
    held = freshness.gate(bad, units, now)
    assert held.status == "stale" and held.exit_code == 3 and held.problems[0].retryable and held.envelope()["result"] is None


def test_paging(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(5)], "k string")
    seen, cursor = [], None
    while True:
        found, cursor = snapshots.page(df, "k", cursor, 2)
        seen += [r.k for r in found.collect()]
        if cursor is None:
            break
    assert seen == [f"k{i}" for i in range(5)]
    with pytest.raises(ValueError):
        snapshots.page(df, "k", None, 65)


def test_schema_checks(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), ("b", "x")], "k string, v string")
    schema.assert_unique(df.where("k = 'a'"), ["k", "v"])
    with pytest.raises(schema.FactError):
        schema.assert_unique(df, ["k", "v"])
    assert schema.out_of_domain(spark.createDataFrame([("fresh",), ("odd",)], "freshness string")).count() == 1


# --- commands and sinks ---------------------------------------------------------------------------------------


def test_commands_end_to_end(spark, tmp_path):
    from factloom.plans import commands

    queries = tmp_path / ".factloom" / "queries"
    queries.mkdir(parents=True)
    (queries / "sub.kql").write_text("command sub(t: symbol-id) {\n from subtype_of($t)\n limit 10\n}")
    package = tmp_path / ".factloom" / "query-packages" / "acme"
    (package / "commands").mkdir(parents=True)
    (package / "package.toml").write_text('format = 1\nrequires_core = "^1"\nid = "acme"\nversion = "1.0.0"\n[exports]\ncommands = ["echo"]\n[[capabilities]]\nname = "not.offered"\nversion = 1\nrequired = true\n')
    (package / "commands" / "echo.kql").write_text('command echo() {\n from applies(symbol-id("ann"))\n limit 10\n}')
    registry, facts = packages.Registry().load(str(tmp_path)), make_facts(spark)
    assert commands.available(str(tmp_path), registry) == ["sub", "acme.echo"]
    assert commands.describe(str(tmp_path), "acme.echo", registry)["negotiations"] == [{"name": "not.offered", "version": 1, "status": "missing"}]
    found = commands.run(str(tmp_path), "sub", {"t": "p"}, registry, facts)
    assert found.status == "ok" and found.rows.count() == 3
    assert commands.run(str(tmp_path), "sub", {}, registry, facts).status == "invalid_request"
    assert commands.run(str(tmp_path), "acme.echo", {}, registry, facts).status == "unsupported"
    now = spark.createDataFrame([("u1.kt", "new"), ("u2.kt", "f2")], "workspace_path string, content_fp string")
    assert commands.run(str(tmp_path), "sub", {"t": "p"}, registry, facts, current=now).status == "stale"


def test_sinks(spark, tmp_path):
    from factloom.sources import sinks

    df = spark.createDataFrame([("a", 1, None)], "symbol_id string, n long, none string")
    assert sinks.records(df).first().line == '{"status":"ok","symbol_id":"a","n":1}' and sinks.short(df, "symbol_id", "none").first().line == "a\t-"
    sinks.write_records(df, f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").count() == 1
    said = []
    assert sinks.print_answer(answer.Answer("ok", df), said.append) == 0 and json.loads(said[0])["result"][0]["symbol_id"] == "a"
    assert sinks.targets([" b ", "", '{"symbol_id": "a"}', said[0], "b"]) == ["a", "b"] and sinks.targets([], "x") == ["x"]
    pages = {None: ([("k1", "old"), ("k2", "x")], "c1"), "c1": ([("k1", "new")], None)}
    assert rows(sinks.paged(pages.__getitem__, spark, "k string, v string", "k")) == [("k1", "new"), ("k2", "x")]
    with pytest.raises(ValueError):
        sinks.paged(lambda c: ([("k", "v")], "same"), spark, "k string, v string", "k")


def test_snapshots_are_encoded_and_decoded(spark, tmp_path):
    folder = write(tmp_path / "in", snapshot("u1"), snapshot("u2"))
    units, facts = snapshots.decode(snapshots.read(spark, folder))
    snapshots.encode(units, facts).write.json(f"file://{tmp_path}/out")
    again_units, again = snapshots.decode(snapshots.read(spark, f"file://{tmp_path}/out"))
    assert rows(again_units.select("source_unit_id", "content_fp", "provenance.backend")) == rows(units.select("source_unit_id", "content_fp", "provenance.backend"))
    for name in ("occurrences", "reference_edges"):
        columns = ("source_unit_id", "start_byte", "end_byte", "kind", "target", "provenance.backend")
        assert rows(again[name].select(*columns)) == rows(facts[name].select(*columns))


def test_all_tables_are_encoded_and_decoded(spark, tmp_path):
    one = snapshot("u1")
    other = PROV | {"backend": "other"}
    one["provenances"] = [PROV, other]
    one["symbols"][0]["provenance"] = 1
    one["types"] = [{"id": "u1.t", "language": "kotlin", "display": "List", "freshness": "fresh", "completeness": "partial", "provenance": 1}]
    one["diagnostics"] = [{"range": {"start": 3, "end": 4}, "severity": "error", "code": "E1", "message": "m", "freshness": "fresh", "completeness": "complete", "provenance": 0}, {"severity": "warning", "message": "n", "freshness": "fresh", "completeness": "complete", "provenance": 1}]
    units, facts = snapshots.decode(snapshots.read(spark, write(tmp_path / "in", one, snapshot("u2"))))
    snapshots.encode(units, facts).write.json(f"file://{tmp_path}/out")
    _, again = snapshots.decode(snapshots.read(spark, f"file://{tmp_path}/out"))
    assert set(again) == set(facts)
    for name, table in facts.items():
        key = lambda r: json.dumps(r.asDict(True), sort_keys=True, default=str)
        assert sorted(map(key, again[name].select(*table.columns).collect())) == sorted(map(key, table.collect())), name


def test_the_last_snapshot_to_arrive_counts_and_a_batch_is_one_generation(spark, tmp_path):
    folder = write(tmp_path / "in", snapshot("u1", "f9"), snapshot("u2", "f1"), snapshot("u1", "f1"), {"source_unit": {"id": "u2"}}, snapshot("u3"))
    root = f"file://{tmp_path}/store"
    ingest.stream(spark, folder, root, f"{tmp_path}/cp").awaitTermination()
    store = Store(spark, root)
    assert rows(store.source_units().select("source_unit_id", "content_fp")) == [("u1", "f1"), ("u3", "f1")]
    before = store.generation["number"]
    write(tmp_path / "in", {"source_unit": {"id": "u1"}}, snapshot("u2", "f5"))
    ingest.stream(spark, folder, root, f"{tmp_path}/cp").awaitTermination()
    assert rows(store.refresh().source_units().select("source_unit_id")) == [("u2",), ("u3",)] and store.generation["number"] == before + 1


def test_hidden_and_empty_files_are_found(spark, tmp_path):
    for name in (".npmrc", ".yarnrc.yml", "app/.mvn/maven.config", "app/_B.java", "app/A.java", "package.json", ".git/config", ".factloom/config.toml", ".factloom/x"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"text of {name}")
    (tmp_path / "empty.txt").write_text("")
    found = {r.workspace_path: bytes(r.content).decode() for r in workspace.files(spark, str(tmp_path)).collect()}
    wanted = [".npmrc", ".yarnrc.yml", "app/.mvn/maven.config", "app/_B.java", "app/A.java", "package.json", ".factloom/config.toml"]
    assert found == {n: f"text of {n}" for n in wanted} | {"empty.txt": ""}
    before = workspace.configuration_digest(workspace.files(spark, str(tmp_path))).first()[0]
    (tmp_path / ".npmrc").write_text("changed")
    assert workspace.configuration_digest(workspace.files(spark, str(tmp_path))).first()[0] != before


def test_more_candidates_than_the_budget_are_refused(spark):
    facts = make_facts(spark)
    asked = []
    one = capability.Capability("x", 1, {}, lambda f, c, g: asked.append(1) or c.select("symbol_id", "completeness"))
    for budget in (capability.Budget(candidates=1, millis=30_000), capability.Budget(nodes=1, millis=30_000)):
        with pytest.raises(capability.CapabilityError, match="input exceeds"):
            capability.execute(one, facts, facts["symbols"].withColumn("source_unit_id", F.col("symbol_id")), {}, budget)
    assert not asked


def test_common_values_count_nulls_and_ordinals_run_on(spark):
    from factloom.operators import summaries

    df = spark.createDataFrame([("g", "a"), ("g", None), ("h", "a"), ("h", "a"), ("i", None)], "k string, v string")
    assert sorted(tuple(r) for r in summaries.common_values(df, "k", "v").collect()) == [("g", None), ("h", "a"), ("i", None)]
    symbols = spark.createDataFrame([(f"u{i % 3}", i, f"s{i}") for i in range(20)], "source_unit_id string, name_start long, symbol_id string")
    found = summaries.symbol_ordinals(symbols, 4).orderBy("source_unit_id", "name_start").collect()
    assert [r.ordinal for r in found] == list(range(20)) and [r.block for r in found if r.source_unit_id == "u1"] == [0, 0, 0, 0, 1, 1, 1]


def test_positions_of_all_terms_agree_with_one_by_one(spark):
    df = spark.createDataFrame([("p", "one 😀 needle\ntwo é\n\n  x y"), ("q", "\n\nz"), ("r", "")], "k string, content string")
    one = text.terms(df, "k").join(df, "k").select("k", "term", "start_byte", text.position(F.col("content"), F.col("start_byte")).alias("p")).select("k", "term", "start_byte", "p.line", "p.column")
    assert rows(text.term_positions(df, "k")) == rows(one)


def test_layers_are_written_anew_in_time(spark, tmp_path):
    from factloom.sources import store as stores

    store = Store(spark, f"file://{tmp_path}/s")
    for i in range(stores.MOST_LAYERS + 3):
        one = unit(spark, (f"u{i % 4}", f"f{i}", None))
        store.replace_snapshots(one, one, {"symbols": symbol(spark, (f"s{i}", f"u{i % 4}", "class", f"N{i}", None, []))})
        assert len(store.generation["tables"]["symbols"]) <= stores.MOST_LAYERS
        assert rows(store.table("symbols").select("source_unit_id", "name")) == sorted((f"u{k % 4}", f"N{k}") for k in range(max(0, i - 3), i + 1))
    assert rows(Store(spark, f"file://{tmp_path}/s").source_units().select("source_unit_id", "content_fp")) == sorted((f"u{k % 4}", f"f{k}") for k in range(i - 3, i + 1))
