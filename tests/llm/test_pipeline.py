"""The pipeline over small tables: each stage's rows against a brute-force reading of its rule."""



import corpus_pipeline
from factloom.llm.queries import queries
from tests.llm.test_operators import DOCS, brute_classes, brute_hits, near_texts, odd


def write(spark, tmp_path):
    texts = [*near_texts(21, 25), None, "", "123 456"]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    items = [(0, " ".join(texts[0].split()[:12])), (1, "never seen words")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = write(spark, tmp_path)
    text = {r[0]: r[1] for r in rows}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert kept["language_id"] == [i for i, t in text.items() if t and any(map(str.isalpha, t))]
    classes = brute_classes(kept["language_id"], [text[i] for i in kept["language_id"]])
    assert kept["minhash_dedup"] == sorted(set(classes.values()))
    assert kept["decontamination"] == [i for i in kept["minhash_dedup"] if not brute_hits(text[i], items)[1]]
    mixed = docs.collect()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in mixed) and all(r.intact for r in out)
    total = sum(r.n_tokens for r in out)
    assert out[-1].start + out[-1].n_tokens == total and set(kept["mixing"]) <= set(kept["decontamination"])


def test_run_agrees_with_itself(spark, tmp_path):
    write(spark, tmp_path)
    one, two = (sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) for _ in range(2))
    assert one == two and one


def test_stages_take_odd_tables(spark, tmp_path):
    write(spark, tmp_path)
    for docs in (odd(spark), odd(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_dedup", "decontamination", "mixing", "token_output"]
    assert sorted(int(q[2:].split("_")[0]) for q in queries()) == list(range(1, 11))
