"""Each training-data operator against brute force on small fixtures, and its odd cases."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import chat, decontaminate, html_extract, langid, licenses, mixing, neardup, quality, token_store, toxicity
from factloom.llm.common import word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def docs(spark, texts, source="s", lang="en"):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", "   \n\t ", "a", "a b c", "é 日本 ÀÉ x", "%%% ###", "x " * 3000, "same text here now", "same text here now"]


def odd(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and extra columns with working names."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, 1) for i, t in enumerate(ODD)]
    rows += [rows[8], (None, "no id", None, None, None), (8, "another text of id eight", "en", "s0", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("key", "class", "class_id", "bands", "row", "_doc", "bucket", "text_", "bench_spans", "lang_pred", "size", "rank", "start", "n", "Σ x.y"):
        df = df.withColumn(name, F.lit("own"))
    return df


# --- quality ---------------------------------------------------------------------------------------------


def brute_features(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(hit)


def test_quality_features(spark):
    rng = random.Random(1)
    texts = [*ODD, *(prose(rng, rng.randrange(80), 9).replace("w3 ", "w3\n") for _ in range(80)), "a b c a b c", "a a a a", "x\x0by\x1cz\x85q", "l\nl\n\nl"]
    found = quality.features(docs(spark, texts)).orderBy("doc_id").collect()
    for t, r in zip(texts, found, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == brute_features(t), t


def test_binomial_tail(spark):
    from math import comb

    for n, k, p in ((10, 0, 0.3), (40, 3, 0.2), (1000, 2, 0.005), (50, 49, 0.1)):
        exact = 1.0 if k >= n * p else sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p).alias("x")).first().x
        assert got == pytest.approx(exact, rel=1e-9)


def test_quality_cutoffs_hold_the_risk(spark):
    rng = random.Random(2)
    good = [prose(rng, 60, 5000) for _ in range(1500)]
    bad = [" ".join(w + "%%%" for w in prose(rng, 60, 5000).split()) for _ in range(40)]
    d = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 1500), 0) for i in range(1540)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.op1_quality(d, labels).collect()}
    assert sum(not kept[i] for i in range(1500)) <= 0.02 * 1500 and not any(kept[i] for i in range(1500, 1540))
    none = quality.op1_quality(d, labels.limit(0))
    assert none.where("kept").count() == 1540  # nothing labelled: no rule may reject


def test_quality_takes_a_trial_a_document_and_pools_sparse_strata(spark):
    assert quality.least_trials() == 1151 and 0.995**1151 <= 0.05 / 16 < 0.995**1150
    rng = random.Random(3)
    few = [prose(rng, 60, 5000) for _ in range(40)]
    d = docs(spark, few + [" ".join(w + "%%%" for w in prose(rng, 60, 5000).split())])
    again = spark.createDataFrame([(i, 1, 0) for i in range(40) for _ in range(60)], "doc_id long, quality int, toxic int")
    assert quality.op1_quality(d, again).where("kept").count() == 41  # forty documents, however often labelled
    both = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert [r.doc_id for r in quality.trials(quality.features(d.union(d)), both).collect()] == [2]
    counts = [(s, n, *([k] * 9 for k in (0, 1, 2, 3))) for s, n in ((0, 700), (1, 1400), (3, 100))]
    per = spark.createDataFrame(counts, "stratum int, n long, " + ", ".join(f"{r} array<long>" for r in quality.RULES))
    found = {r.stratum: (r.n, r.repeats[0]) for r in quality.pooled(per, 1151).collect()}
    assert found == {0: (2100, 4), 1: (1400, 2), 2: (1500, 4), 3: (1500, 4)} and quality.pooled(per, 2201).count() == 0


def test_quality_odd(spark):
    labels = spark.createDataFrame([(None, 1, None), (3, None, 1), (8, 1, 1), (8, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.op1_quality(odd(spark), labels).count() == odd(spark).count()
    assert quality.op1_quality(odd(spark).limit(0), labels).count() == 0


# --- toxicity ----------------------------------------------------------------------------------------------


def test_crf_inference_is_exact():
    rng = np.random.default_rng(3)
    crf = toxicity.Crf(["bad", "worse"])
    crf.weight[:], crf.before[:], crf.after[:], crf.bias = [3, 4], [0.5, 0.2], [0.3, -0.2], -3.0
    crf.move = rng.normal(size=(2, 2))
    crf.prepare()
    for words in (["bad"], ["x", "bad"], ["bad", "x", "y"], ["x"] * 4 + ["worse", "bad"] + ["y"] * 5, ["worse"] * 3):
        at, emission = crf.events(crf.hits(words), len(words))
        e = np.full(len(words), crf.bias)
        e[at] = emission
        paths = [tuple(map(int, np.binary_repr(k, len(words)))) for k in range(1 << len(words))]
        weight = np.array([sum(e[i] * s for i, s in enumerate(p)) + sum(crf.move[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
        prob = np.exp(weight - weight.max())
        prob /= prob.sum()
        lost, marginals = crf._messages(at, emission, len(words))
        assert lost == pytest.approx(-np.log(prob[0]), abs=1e-9)
        for i, m in zip(at, marginals, strict=True):
            assert m == pytest.approx(sum(q for q, p in zip(prob, paths, strict=True) if p[i]), abs=1e-9)


def test_toxicity_on_held_out(spark):
    rng = random.Random(4)
    texts, marks = [], []
    for i in range(400):
        words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(60)]
        if i % 4 == 0:
            for k in rng.sample(range(60), 4):
                words[k] = rng.choice(["vilezz", "vilexa", "crudeo"])
        texts.append(" ".join(words))
        marks.append(int(i % 4 == 0))
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.op2_toxicity(docs(spark, texts), labels).collect()}
    held = [i for i in found if found[i].held_out]
    assert set(held) == {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1} and all(found[i].predicted == marks[i] for i in held)
    crf = toxicity.train([(t, m) for t, m in zip(texts, marks, strict=True)])
    tagged = toxicity.tag(docs(spark, ["ok ok vilezz, fine"]), crf).first()
    assert [(s.start, s.stop) for s in tagged.toxic_spans] == [(6, 12)]


def test_the_training_sample_is_bounded_where_rows_share_an_id(spark):
    d = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0)], "doc_id long, toxic int")
    assert zlib.crc32(b"1") % 3 != 1
    found = toxicity.training_texts(d, labels, per_label=20)
    assert Counter(y for _, y in found) == {0: 20, 1: 20}


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        out = toxicity.op2_toxicity(odd(spark), lab).collect()
        assert len(out) == odd(spark).count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.op2_toxicity(odd(spark).limit(0), labels).count() == 0


# --- near duplicates -----------------------------------------------------------------------------------------


def bag(text):
    w = WORD.findall(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    shared = sum((a & b).values())
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


def brute_classes(ids, texts):
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [bag(t or "") for t in texts]
    for i, t in enumerate(texts):
        for j in range(i):
            if t is not None and texts[j] is not None and (t == texts[j] or (bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.8 - 1e-9)):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {ids[i]: min(ids[k] for k in range(len(ids)) if find(k) == find(i)) for i in range(len(ids))}


def near_texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = prose(rng, rng.choice([3, 30, 120, 300])).split()
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 3, 6])):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            out.append(" ".join(copy))
    return out


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    texts = [*near_texts(5, 60), *ODD]
    for block in (256, 4):  # small blocks take every path of the bucket comparison
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {r.doc_id: r.class_id for r in neardup.op3_near_duplicates(docs(spark, texts)).collect()}
        assert got == brute_classes(list(range(len(texts))), texts)


def test_near_duplicates_in_blocks_of_few_shingles_and_with_text_ids(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_WEIGHT", 300)
    texts = near_texts(15, 40)
    d = docs(spark, texts).withColumn("doc_id", F.format_string("d%05d", "doc_id"))
    got = {r.doc_id: r.class_id for r in neardup.op3_near_duplicates(d).collect()}
    assert got == brute_classes([f"d{i:05d}" for i in range(len(texts))], texts)


def test_signatures_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(6)
    element = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    weights = [rng.random(300) * 3 + 0.01, None]
    weights[1] = np.where(rng.random(300) < 0.7, weights[0], rng.random(300) * 3 + 0.01)
    true = np.minimum(*weights).sum() / np.maximum(*weights).sum()
    text = np.repeat([0, 1], 300)
    k = 4000
    s = neardup.dart_minhash(text, np.concatenate([element, element]), np.concatenate(weights), 2, k)
    assert (s != 0).all() and (s[0] == s[1]).mean() == pytest.approx(true, abs=4 * np.sqrt(true * (1 - true) / k))


def test_small_sets_fill_every_coordinate():
    s = neardup.dart_minhash(np.array([0, 2, 2]), np.array([5, 6, 7], np.uint64), np.ones(3), 3, 96)
    assert (s[0] != 0).all() and (s[2] != 0).all() and (s[1] == 0).all()


def test_word_hashes_keep_texts_apart():
    raw = "ab cd".encode() + b"ab" + b" cd  ab"
    h, owner = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, 5, 7, 7]), np.array([5, 7, 7, 14]))
    assert owner.tolist() == [0, 0, 1, 3, 3] and h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]


def test_dedup_keeps_one_of_each(spark):
    d = odd(spark)
    kept = neardup.drop_near_duplicates(d)
    assert kept.columns == d.columns and kept.where("key = 'own' and class_id = 'own'").count() == kept.count()
    texts = [r.text for r in kept.select("text").collect()]
    assert sorted(Counter(t for t in texts if t is not None).values()) == [1] * len({t for t in texts if t is not None}) and texts.count(None) == 1
    assert neardup.drop_near_duplicates(d.limit(0)).count() == 0
    assert neardup.op3_near_duplicates(d).count() == d.count()


# --- licences -----------------------------------------------------------------------------------------------


def test_licenses(spark):
    rng = random.Random(7)
    texts = [prose(rng, 40) for _ in range(60)]
    wanted = {
        0: ("Licensed under the Apache License, Version 2.0.", "apache"), 1: ("Released under the MIT License.", "mit"), 2: ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        3: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), 4: ("LICENSED UNDER CC BY 4.0.", "cc-by"), 5: ("Released under the Zorble Frobnicate License of 1871.", "unknown"),
    }
    for i, (line, _) in wanted.items():
        texts[i] = texts[i] + "\n" + line + "\n" + texts[i]
    found = {r.doc_id: r for r in licenses.op4_licenses(docs(spark, texts)).collect()}
    assert {i: found[i].families for i in wanted if i != 5} == {i: f for i, (_, f) in wanted.items() if i != 5}
    assert found[5].families in ("unknown", "") and all(found[i].families == "" for i in range(6, 60))
    assert licenses.op4_licenses(odd(spark)).count() == odd(spark).count() and licenses.op4_licenses(odd(spark).limit(0)).count() == 0


def test_licenses_judge_every_paragraph(spark):
    """No word list stands before the classifier, and its bound leaves out only what the full score leaves out."""
    rng = random.Random(9)
    lines = ["Creative Commons Attribution-ShareAlike 4.0 International", "Available under CC BY-SA 4.0", "CC0 1.0 Universal", "Released into the public domain"]
    texts = [*lines, *(prose(rng, 60) for _ in range(200))]
    scanner = licenses.fit(docs(spark, texts))
    found = {r.doc_id: [x.family for x in r.licences] for r in scanner.scan(docs(spark, texts)).collect()}
    assert [found[i] for i in range(4)] == [["cc-by-sa"], ["cc-by-sa"], ["public-domain"], ["public-domain"]]
    mixed = [" ".join(rng.sample([w for n in licenses.NOTICES.values() for x in n for w in x.split()] + [f"w{k}" for k in range(200)], 8)) for _ in range(300)]
    b = licenses.buckets(licenses.grams(licenses.words(F.col("text"))))
    rows = docs(spark, texts + mixed).select(scanner.possible(b).alias("u"), F.get(scanner._probabilities(b), F.lit(0)).alias("none")).collect()
    assert all(r.u for r in rows if r.none < 0.5) and any(r.none < 0.5 for r in rows) and not all(r.u for r in rows)


def brute_licences(scanner, text):
    """Every line in full by the scanner's weights, without the bound, then wrapped lines joined."""
    import xxhash

    hits = []
    for i, line in enumerate((text or "").split("\n")):
        grams = licenses._grams(line)
        if not grams:
            continue
        b = {np.int64(np.uint64(xxhash.xxh64_intdigest(g.encode(), 42))) % licenses.BUCKETS for g in grams}
        raw = np.array(scanner.bias) + np.array([scanner.weights[x] for x in b]).sum(0)
        p = np.exp(raw - raw.max())
        p /= p.sum()
        if p[0] >= 0.5:
            continue
        best = 1 + int(np.argmax(p[1:]))
        family = scanner.families[best - 1]
        share = max(len(set(grams) & set(n)) / min(len(grams), len(n)) for x in licenses.NOTICES[family] for n in [licenses._grams(x)])
        if p[best] / max(1 - p[0], 1e-12) < scanner.floor or share < licenses.SHARED:
            family = "unknown"
        if hits and hits[-1][0] + hits[-1][1] == i and not hits[-1][4]:
            known = max([(hits[-1][2] != "unknown", hits[-1][3], hits[-1][2]), (family != "unknown", p[best], family)])
            hits[-1] = [hits[-1][0], hits[-1][1] + 1, known[2], known[1], bool(re.search(r"[.!?:;]\s*$", line))]
        else:
            hits.append([i, 1, family, p[best], bool(re.search(r"[.!?:;]\s*$", line))])
    return [tuple(h[:3]) for h in hits]


def test_licences_match_brute_force(spark):
    rng = random.Random(19)
    notices = [x for lines in licenses.NOTICES.values() for x in lines]
    texts = [*ODD, *(prose(rng, 40) for _ in range(100))]
    for _ in range(60):
        parts = [prose(rng, rng.randrange(1, 20)) if rng.random() < 0.5 else rng.choice(notices) for _ in range(rng.randrange(1, 8))]
        mixed = rng.sample([w for n in notices for w in n.split()], 9)
        wrapped = " ".join(parts).split()
        texts += ["\n".join([*parts, " ".join(mixed)]), "\n".join(" ".join(wrapped[k : k + 9]) for k in range(0, len(wrapped), 9))]
    d = docs(spark, texts)
    scanner = licenses.fit(d)
    found = {r.doc_id: [(x.line, x.n_lines, x.family) for x in r.licences] for r in scanner.scan(d).collect()}
    assert found == {i: brute_licences(scanner, t) for i, t in enumerate(texts)}
    assert any(n > 1 for f in found.values() for _, n, _ in f) and any(x == "unknown" for f in found.values() for _, _, x in f)
    out = {r.doc_id: (r.n_licences, r.n_unknown, r.families) for r in licenses.op4_licenses(d).collect()}
    assert out == {i: (len(f), sum(x == "unknown" for *_, x in f), ",".join(sorted({x for *_, x in f}))) for i, f in found.items()}


def test_a_wrapped_notice_is_one_licence(spark):
    rng = random.Random(20)
    notice = "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files."
    texts = [f"{prose(rng, 30)}\n{notice}\n{prose(rng, 30)}", "Released under the MIT License.\nReleased under the MIT License."]
    texts += [prose(rng, 40) for _ in range(100)]
    found = {r.doc_id: (r.n_licences, r.families) for r in licenses.op4_licenses(docs(spark, texts)).collect()}
    assert found[0] == (1, "mit") and found[1] == (2, "mit") and all(found[i][0] == 0 for i in range(2, 102))


@pytest.mark.parametrize("family", ["gpl", "mpl", "cc-by"])
def test_families_never_seen_are_unknown(spark, monkeypatch, family):
    rng = random.Random(21)
    # Of a line as short as "Licensed under CC BY 4.0." nothing but two words is known without its family.
    lines = [x for x in licenses.NOTICES[family] if ("licensed under" in x.lower() or "public license, v" in x.lower()) and len(x.split()) > 5]
    alike = {"cc-by": ("cc-by", "cc-by-nc", "cc-by-sa")}.get(family, (family,))
    monkeypatch.setattr(licenses, "NOTICES", {f: x for f, x in licenses.NOTICES.items() if f not in alike})
    found = {r.doc_id: r.families for r in licenses.op4_licenses(docs(spark, lines + [prose(rng, 40) for _ in range(150)])).collect()}
    assert [found[i] for i in range(len(lines))] == ["unknown"] * len(lines)


# --- languages ------------------------------------------------------------------------------------------------


def test_languages(spark):
    rng = random.Random(8)
    make = lambda s: " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(60))
    kinds = {"xx": ["ba", "do", "ki"], "yy": ["schu", "ung", "ach"], "zz": ["éa", "oui", "ço"]}
    rows = [(i, make(kinds[k := list(kinds)[i % 3]]), k, "s", 0) for i in range(300)]
    rows.append((300, make(kinds["xx"]) + " " + make(kinds["yy"]), None, "s", 0))
    d = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: r for r in langid.op5_language_id(d).collect()}
    assert all(found[i].lang_pred == rows[i][2] for i in range(300)) and found[300].n_langs == 2 and 0.3 < found[300].score < 0.7
    assert {i for i in range(300) if found[i].held_out} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_em_finds_the_shares():
    p = np.array([[0.9, 0.1], [0.1, 0.9]])
    shares, _ = langid._fit_shares(p, np.array([70.0, 30.0]), np.full(2, 0.5), 500)
    grid = np.linspace(0, 1, 1001)
    best = grid[np.argmax([70 * np.log(0.9 * g + 0.1 * (1 - g)) + 30 * np.log(0.1 * g + 0.9 * (1 - g)) for g in grid])]
    assert shares[0] == pytest.approx(best, abs=0.01)


def test_the_sample_of_a_language_is_its_lowest_hashes(spark):
    """Copies count once, long texts count, and the counts are those of the texts drawn."""
    import xxhash

    rng = random.Random(12)
    texts = [*(prose(rng, 20) for _ in range(30)), *["the same copy"] * 50, prose(rng, 60_000)]
    d = docs(spark, texts)
    for per_lang in (5, 1000):
        drawn = sorted(set(texts), key=lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))[:per_lang]
        wanted = sum(np.bincount(langid._codes(langid._folded(np.frombuffer(t.encode(), np.uint8))), minlength=1 << langid.BITS) for t in drawn)
        model = langid.fit(d, per_lang)
        assert model.langs == ["en"] and np.allclose(model.p[:, 0], (wanted + 0.1) / (wanted + 0.1).sum())


def test_languages_odd(spark):
    out = {r.doc_id: r for r in langid.op5_language_id(odd(spark).where("doc_id is not null")).collect()}
    assert [out[i].lang_pred for i in (0, 1, 2, 6)] == ["und"] * 4 and out[5].lang_pred != "und"
    assert langid.op5_language_id(odd(spark).where("lang is null")).where("lang_pred <> 'und'").count() == 0
    kept = langid.keep_languages(odd(spark))
    assert kept.columns == odd(spark).columns and kept.where("lang_pred <> 'own'").count() == 0 and langid.keep_languages(odd(spark).limit(0)).count() == 0


# --- benchmark items without an id -------------------------------------------------------------------------------


def test_items_without_an_id_hit(spark):
    import duckdb

    from factloom.llm.queries import OP9_SQL

    rng = random.Random(4)
    items = [(1, prose(rng, 30)), (None, prose(rng, 30)), (None, "only three words"), (2, None)]
    texts = [f"a b {items[0][1]}", f"c {items[1][1]} d", "x only three words y", f"{items[0][1]} {items[1][1]}", "clean text"]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    documents, d = docs(spark, texts).toPandas(), docs(spark, texts)  # noqa: F841
    with duckdb.connect() as duck:
        duck.register("documents", documents)
        duck.register("benchmark", pa.table({"item_id": pa.array([x for x, _ in items], pa.int64()), "text": [x for _, x in items]}))
        wanted = sorted(duck.sql(OP9_SQL).fetchall())
    found = sorted(tuple(r) for r in decontaminate.op9_decontamination(d, benchmark).collect())
    assert found == wanted and [r[-1] for r in found] == [True, True, True, True, False]
    several = decontaminate.find_benchmark(d, benchmark, words_per_automaton=20).select(decontaminate.hit_words().alias("n")).collect()
    assert sorted(r.n for r in several) == sorted(r[2] for r in wanted)
    assert [r.doc_id for r in decontaminate.remove_benchmark(d, benchmark).collect()] == [4]


# --- pages ---------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header class="site"><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>{h}</h1></header><p>{a}<p>{b} &amp; c<br>next&nbsp;line</p><div class="ad">buy</div><ul><li>one</li><li>two</li></ul></article>
<aside>side</aside><section id="comments"><p>reader says</p></section><form><label>x</label><input></form><footer>&copy; foot</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.format(h=f"Head {i}", a=f"First {i}\n  text", b=f"Second <b>{i}</b>")) for i in range(5)]
    rows += [(5, None, None), (6, "no url", ""), (7, "https://h.example/7", "<p>cut <b>of"), (8, "https://x.example/", "<script>only"), (9, "https://y.example/", "plain text only"), (10, "https://z.example/", "<html><head><title>T<body><article><p>kept")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_host", F.lit("own")).withColumn("main", F.lit("own"))
    found = {r.page_id: r for r in html_extract.op6_html(d).collect()}
    for i in range(5):
        assert found[i].text == f"Head {i}\n\nFirst {i} text\n\nSecond {i} & c next line\n\none\n\ntwo" and found[i].n_chars == len(found[i].text)
    assert (found[5].text, found[6].text, found[7].text, found[8].text, found[9].text, found[10].text) == ("", "", "cut of", "", "plain text only", "kept")
    assert html_extract.op6_html(d.limit(0)).count() == 0


def brute_wrapper(pages):
    """All pages of a host in one, structure by structure, in order of the hash of the structure."""
    shapes = {}
    for page in pages:
        top = html_extract.expression(page)[0] if page else None
        if top and top.items:
            key = hashlib.md5(top.shape().encode()).hexdigest()
            shapes[key] = html_extract.combined(shapes[key], top, False) if key in shapes else top
    whole = None
    for key in sorted(shapes):
        whole = html_extract.combined(whole, shapes[key], False) if whole else shapes[key]
    return whole


def site(rng, n):
    """Pages of one host: an optional notice, a heading, a changing number of sections, a constant box; no article element."""
    out = []
    for i in range(n):
        notice = "<p>We moved house.</p>" if rng.random() < 0.6 else ""
        body = "".join(f"<h3>part {i}.{k}</h3><p>words {rng.random()}</p>" + "<ul><li>a</li><li>b</li></ul>" * rng.randrange(2) for k in range(rng.randrange(1, 4)))
        out.append(f"<div class=x>Our site</div>{notice}<h1>title {i}</h1><p>lead {i}</p>{body}<p class=end>Write to us</p>")
    return out


def test_expressions_fold_and_align():
    shape = lambda page: html_extract.expression(page)[0].shape()
    assert shape("<ul>" + "<li>a</li><li>b</li>" * 50 + "</ul>") == "[ul[li+[#]]]"
    assert shape("<h1>t</h1>" + "<h2>a</h2><p>b</p><p>c</p>" * 3 + "<nav><p>x</p></nav>") == "[h1[#] (+[h2[#] p+[#]] nav]"
    wrapper = brute_wrapper([f"<div class=x>same</div><h1>{n}</h1>{'<h2>a</h2><p>b</p>' * n}{'<pre>z</pre>' if n == 2 else ''}" for n in (1, 2, 3)])
    assert wrapper.shape() == "[div.x[#] h1[#] (+[h2[#] p[#]] pre?[#]]"
    assert len(wrapper.items[0].items[0].same) == 1 and not wrapper.items[1].items[0].same


def test_the_wrapper_decides(spark):
    """A notice among the paragraphs, at the same place as they: tags cannot tell it, nor what repeats at its place on all pages."""
    pages = site(random.Random(50), 30)
    rows = [(i, "https://h.example/", x) for i, x in enumerate(pages)] + [(99, "https://alone.example/", pages[0])]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    found = {r.page_id: r.text for r in html_extract.op6_html(d).collect()}
    assert any("We moved house." in x for x in pages) and not all("We moved house." in x for x in pages)
    for i, x in enumerate(pages):
        wanted = [re.sub("<.*?>", "", t) for t in re.findall(r"<(?:p|h\d|li)[^>]*>[^<]*<", x)]
        wanted = [t.rstrip("<") for t in wanted if not t.startswith(("We moved", "Write to"))]
        assert found[i].split("\n\n") == [t for t in wanted if t not in ("a", "b") or t in found[i].split("\n\n")]
        assert not {"Our site", "We moved house.", "Write to us"} & set(found[i].split("\n\n")) and f"lead {i}" in found[i]
    assert found[99].startswith("Our site\n\n")  # one page: tags alone
    article = [f"<article><h1>the same title</h1><p>text {i}</p><div class=x>Read it in our paper</div><ul><li>one</li><li>two</li></ul></article>" for i in range(4)]
    d = spark.createDataFrame([(i, "https://a.example/", x) for i, x in enumerate(article)], "page_id long, url string, html string")
    assert [r.text for r in html_extract.op6_html(d).orderBy("page_id").collect()] == [f"the same title\n\ntext {i}\n\none\n\ntwo" for i in range(4)]


@pytest.mark.parametrize("fan", [64, 2])
def test_wrappers_match_brute_force(spark, monkeypatch, fan):
    monkeypatch.setattr(html_extract, "HELD", 40)
    rng = random.Random(51)
    pages = {f"h{k}.example": site(rng, 12) for k in range(4)}
    rows = [(i, f"https://{h}/", x) for i, (h, x) in enumerate((h, x) for h, xs in pages.items() for x in xs)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    if fan == 64:
        told = {r.host: r.expression for r in html_extract.wrappers(d).collect()}
        assert told == {h: html_extract._written(brute_wrapper(xs)) for h, xs in pages.items()}
    monkeypatch.setattr(html_extract, "FAN", fan)
    found = [r.text for r in html_extract.op6_html(d).orderBy("page_id").collect()]
    if fan == 64:
        assert found == [html_extract.main_text(x, brute_wrapper(xs)) for xs in pages.values() for x in xs]
    assert all("Our site" not in t and "lead" in t for t in found) and found == [r.text for r in html_extract.op6_html(d.repartition(3)).orderBy("page_id").collect()]


def test_irregular_pages_are_bags(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "IRREGULAR", 4)
    pages = site(random.Random(52), 12)
    d = spark.createDataFrame([(i, "https://h.example/", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    for r in html_extract.op6_html(d).collect():
        assert "Our site" not in r.text and f"lead {r.page_id}" in r.text and f"title {r.page_id}" in r.text


def test_a_wrapper_is_the_same_at_any_depth(spark):
    """A text that another slot repeats is the page's own in its heading, however many elements are around both."""
    own = lambda i: "Welcome here" if i == 0 else f"Own title {i}"
    page = lambda i, deep: "<div>" * deep + f"<section><p>Welcome here</p></section><section><h2>{own(i)}</h2><p>words {i}</p></section>" + "</div>" * deep
    depths = (0, 3, 99, 150, 1500)
    rows = [(n * 10 + i, f"https://h{n}.example/{i}", page(i, deep)) for n, deep in enumerate(depths) for i in range(4)]
    found = {r.page_id: r.text for r in html_extract.op6_html(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {n * 10 + i: f"{own(i)}\n\nwords {i}" for n in range(len(depths)) for i in range(4)}
    top = html_extract.expression(page(1, 3000))[0]
    again = html_extract.Item.of(json.loads(json.dumps(top.plain())))
    assert again.shape() == top.shape() and again.size() == top.size() and html_extract.combined(again, top, False).shape() == top.shape()


def test_deep_pages(spark):
    deep = lambda i: "<div>" * 5000 + f"<p>text {i}</p><p>always</p><nav>menu</nav>" + "</div>" * 4000 + f"<p>after {i}</p><div class=x>box</div>"
    d = spark.createDataFrame([(i, "https://h.example/", deep(i)) for i in range(4)], "page_id long, url string, html string")
    assert [r.text for r in html_extract.op6_html(d).orderBy("page_id").collect()] == [f"text {i}\n\nafter {i}" for i in range(4)]


def test_marks_quotes_and_own_columns(spark):
    assert html_extract.main_text("<p>One <a href=x title=it's>two</a> three don't four</p>") == "One two three don't four"
    assert html_extract.main_text('<p title="a > b">x</p><p title=\'"\'>y</p><p title="open>z</p>') == "x\n\ny\n\nz"
    assert html_extract.main_text('<section class="related-work"><p>kept</p></section><div class="related-posts"><p>gone</p></div>') == "kept"
    d = spark.createDataFrame([(1, None, "<p>t</p>", "own", "own", "own")], "page_id long, url string, html string, _host string, host string, main_text string")
    out = html_extract.extract(d)
    assert out.columns == ["page_id", "url", "html", "_host", "host", "main_text"] and tuple(out.first()) == (1, None, "<p>t</p>", "own", "own", "t")


def test_article_is_asked_of_each_page(spark):
    """A host with an article template and one without: neither loses text."""
    rows = [(i, f"https://h.example/{i}", f"<div class=content><p>body {i}</p><p>more {i}</p></div>" if i % 2 else f"<article><p>story {i}</p></article><div class=content><p>rest {i}</p></div>") for i in range(40)]
    found = {r.page_id: r.text for r in html_extract.op6_html(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == (f"body {i}\n\nmore {i}" if i % 2 else f"story {i}") for i in range(40))


def test_wrappers_see_all_pages_places_and_whole_texts(spark):
    long = "a title of more than two hundred characters " * 6
    filler = "".join(f"<div class=c{'abcdefghij'[k // 100]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k % 10]}>x{{i}} {k}</div>" for k in range(450))
    page = lambda i: filler.replace("{i}", str(i)) + f"<div class=lead>{long}{i}</div><div class=site>our site</div>"
    rare = lambda i: f"<div class=other>words {i}</div><div class=slogan>good day</div>"
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(12)] + [(i, f"https://h.example/{i}", rare(i)) for i in range(12, 16)]
    rows += [(i, "https://copies.example/", "<div>all the same</div>") for i in range(16, 20)] + [(20 + i, "https://two.example/", f"<p>one {i}</p><div class=x>same</div>") for i in range(2)]
    found = {r.page_id: r.text for r in html_extract.op6_html(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    for i in range(12):
        blocks = found[i].split("\n\n")
        assert len(blocks) == 451 and blocks[-1] == f"{long}{i}"
    assert all(found[i] == f"words {i}" for i in range(12, 16)) and all(found[i] == "all the same" for i in range(16, 20))
    assert found[20] == "one 0" and found[21] == "one 1"


def test_wrappers_by_shuffle_give_the_same(spark, monkeypatch):
    rows = [(i, f"https://h{i % 2}.example/{i}", PAGE.format(h=f"Head {i}", a="a", b="b")) for i in range(6)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = sorted(html_extract.op6_html(d).collect())
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", -1)
    assert sorted(html_extract.op6_html(d).collect()) == one


# --- chats ----------------------------------------------------------------------------------------------------


def test_tool_calls(spark):
    call = lambda *c: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in c], "content": None})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call(("a", "get", {"q": "x"}), ("b", "sum", {"of": ["$a"]}), ("c", "sum", {"of": 3}), ("d", "zap", {}))),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": {"z": 1, "a": "é"}})), (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": 1})), (1, 4, "tool", json.dumps({"tool_call_id": "zz"})),
        (2, 0, "assistant", call(("p", "get", {"q": "$r"}), ("r", "get", {"q": "$p"}))), (2, 1, "tool", json.dumps({"tool_call_id": "p"})), (2, 2, "tool", json.dumps({"tool_call_id": "r"})),
        (3, 0, "user", "q"), (3, 1, "assistant", "answer"), (None, None, None, None), (4, 0, "user", "{not json"), (4, 0, "user", "{not json"),
    ]
    schemas = {"get": {"type": "object", "required": ["q"], "properties": {"q": {"type": "string"}}}, "sum": {"type": "object", "properties": {"of": {"type": "array"}}}}
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("status", F.lit("own")).withColumn("level", F.lit("own"))
    out = chat.link(d, schemas).collect()
    of = {(r.conv_id, r.kind, r.call_id): r for r in out}
    assert (of[1, "call", "a"].level, of[1, "call", "b"].level, of[1, "call", "a"].status, of[1, "call", "a"].linked_turn) == (0, 1, "linked", 3)
    assert of[1, "call", "c"].errors == "$.of: not array" and not of[1, "call", "d"].valid and of[1, "call", "c"].status == "open" and of[1, "result", "zz"].status == "orphan"
    assert of[2, "call", "p"].status == "cycle" and of[2, "call", "p"].level is None
    assert of[1, "result", "b"].json == '{"content":{"a":"é","z":1},"role":"tool","tool_call_id":"b"}'
    assert of[3, "call", "turn:0"].linked_turn == 1 and of[3, "result", "turn:0"].linked_turn == 0
    assert sum(r.conv_id == 4 for r in out) == 2 and of[None, "message", None].status == "plain" and chat.link(d.limit(0)).count() == 0


def test_schema_checks():
    s = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": ["integer", "null"], "minimum": 2}, "b": {"enum": ["x"]}, "c": {"type": "array", "items": {"type": "string", "maxLength": 1}}}}
    assert chat.problems({"a": 2, "b": "x", "c": ["y"]}, s) == [] and chat.problems({"a": None}, s) == []
    assert chat.problems({"a": 1, "b": "z", "c": ["yy"], "d": 1}, s) == ["$.a: below minimum", "$.b: not in enum", "$.c[0]: too long", "$.d: unknown"]
    assert chat.problems({"a": True}, s) == ["$.a: not integer/null"] and chat.problems({}, s) == ["$.a: missing"]


def test_schema_checks_tell_values_apart():
    assert chat.problems(True, {"enum": [1]}) and chat.problems(1, {"const": True}) and not chat.problems(1.0, {"const": 1}) and chat.problems([{"a": 0}], {"const": [{"a": False}]})
    assert chat.problems(10**400, {"type": "integer"}) == [] and chat.problems(0.5, {"type": "integer"}) == ["$: not integer"]


def test_hostile_messages(spark):
    """Lone surrogates, deep nesting, huge numbers and NaN neither stop the job nor give JSON that is none."""
    call = lambda a, n="get", i="a": json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a}]})
    deep = "[" * 100_000 + "]" * 100_000
    texts = [
        call({"q": "\ud800"}, "n\udfff", "i\udc00"), json.dumps({"tool_call_id": "i\udc00", "content": "\ud800"}), call(deep), '{"tool_calls": [{"id": "b", "arguments": %s}]}' % deep,
        call("1" * 400), call("[" * 900 + "]" * 900), '{"tool_call_id": "x", "content": NaN}', '{"tool_call_id": "y", "content": 1e999}', call("NaN"), '{"tool_call_id": 5, "content": ' + "9" * 5000 + "}",
    ]
    d = spark.createDataFrame([(1, i, "tool", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = {r.turn: r for r in chat.link(d, {"get": {"type": "integer"}}).collect()}
    strict = lambda x: json.loads(x, parse_constant=lambda c: 1 / 0)
    assert all(strict(r.json) is not None for r in out.values()) and len(out) == len(texts)
    assert strict(out[0].json)["arguments"] == {"q": "\ud800"} and out[0].call_id == "i\\udc00" and out[1].status == "linked"
    assert [out[i].kind for i in (3, 6, 7, 9)] == ["message"] * 4 and out[4].valid
    assert "not JSON" in out[2].errors and "not JSON" in out[8].errors


def brute_order(events):
    """Levels of calls, by walking down their needs; None on a cycle or behind one."""
    needs = {}
    for kind, key, need in events:
        if kind == "call":
            needs.setdefault(key, set()).update(need)
    level = {}
    for _ in needs:
        for k, n in needs.items():
            n = n & needs.keys()
            if all(x in level for x in n):
                level[k] = 1 + max((level[x] for x in n), default=-1)
    return {k: level.get(k) for k in needs}


@pytest.mark.parametrize("bound", [100_000, 3, 0])
def test_calls_are_ordered_topologically(spark, monkeypatch, bound):
    monkeypatch.setattr(chat, "EDGES", bound)
    rng = random.Random(30)
    rows, wanted = [], {}
    for conv in range(12):
        keys = [f"k{i}" for i in range(rng.randrange(1, 9))]
        told = []
        for i, k in enumerate(keys):
            loops = conv % 4 == 3
            pool = keys if loops else keys[:i]
            need = {x for x in pool if rng.random() < 0.4} | ({"nowhere"} if rng.random() < 0.2 else set())
            told.append(("call", k, need))
        wanted[conv] = brute_order(told)
        turns = list(range(2 * len(keys)))
        rng.shuffle(turns)
        for k, (_, _, need) in zip(keys, told, strict=True):
            rows.append((conv, turns.pop(), "assistant", json.dumps({"tool_calls": [{"id": k, "name": "f", "arguments": {"of": sorted(f"${x}" for x in need)}}]})))
            rows.append((conv, turns.pop(), "tool", json.dumps({"tool_call_id": k, "content": 1})))
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    linked = staged_once(chat.link(d))
    got = {}
    for r in linked.where("kind = 'call'").collect():
        got.setdefault(r.conv_id, {})[r.call_id] = r.level
    assert got == wanted
    lines = {}
    for r in chat.serialised(linked).collect():
        lines.setdefault(r.conv_id, []).append(json.loads(r.json))
    for conv, events in lines.items():
        answered, called = set(), set()
        for e in events:
            if "tool_call_id" in e:
                assert wanted[conv][e["tool_call_id"]] is None or e["tool_call_id"] in called
                answered.add(e["tool_call_id"])
            else:
                called.add(e["id"])
                assert wanted[conv][e["id"]] is None or {x[1:] for x in e["arguments"]["of"]} & wanted[conv].keys() <= answered


def staged_once(df):
    from factloom.llm.common import staged

    return staged(df, "test")


def test_plain_conversations_keep_their_turns(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(6)] + [("c", 0, "user", ""), ("c", 1, "assistant", None), ("d", 0, "user", None)]
    d = spark.createDataFrame([(str(a), *b) for a, *b in rows], "conv_id string, turn long, role string, text string")
    linked = chat.op7_chat(d)
    assert [json.loads(r.json)["content"] for r in chat.serialised(linked.where("conv_id = '1'")).collect()] == [f"t{t}" for t in range(6)]
    assert {r.conv_id: r.errors for r in linked.where("not valid").collect()} == {"c": "$.content: too short", "d": "$.content: not string"}


# --- mixing ----------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    got, open_, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        share = {s: left * w[s] / total for s in open_}
        full = {s for s in open_ if got[s] + share[s] >= 2 * sizes[s]}
        if not full:
            return {s: got[s] + share.get(s, 0.0) for s in names}
        for s in full:
            left -= 2 * sizes[s] - got[s]
            got[s] = 2.0 * sizes[s]
        open_ -= full
    return got


def test_targets_match_the_stepwise_rule(spark):
    rng = random.Random(9)
    for n in (1, 2, 5, 30):
        sizes = {(None if i == 0 and n > 2 else f"s{rng.randrange(999)}é{i}"): rng.choice([0, 1, 10, 500, 9999]) for i in range(n)}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6) for s in got)


def mixed_fixture(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randrange(1, 900)), "en", None if i % 9 == 0 else f"s{min(i % 7, 3)}", 0) for i in range(240)]
    return rows, spark.createDataFrame(rows, DOCS)


def test_mix(spark):
    rows, d = mixed_fixture(spark)
    out = mixing.op8_mixing(d).collect()
    size = {i: len(t.split()) for i, t, *_ in rows}
    per, want = Counter(), Counter()
    for r in out:
        assert r.size == size[r.doc_id] and r.taken <= 2 * r.size
        per[rows[r.doc_id][3]] += r.taken
        want[rows[r.doc_id][3]] = r.target
    totals = Counter()
    for i, _, _, s, _ in rows:
        totals[s] += size[i]
    assert {r.source_size for r in out} == set(totals.values())
    assert all(abs(per[s] - want[s]) <= 512 for s in want) and sorted(out) == sorted(mixing.op8_mixing(d.repartition(7)).collect())


def test_each_pass_takes_every_block_once(spark):
    for blocks in (1, 2, 7, 100):
        df = spark.range(2 * blocks).select(mixing._permuted(F.col("id"), F.lit(blocks).cast("long"), F.lit(3).cast("long")).alias("b"), F.floor(F.col("id") / blocks).alias("t"))
        got = df.groupBy("t").agg(F.count_distinct("b").alias("n"), F.max("b").alias("m")).collect()
        assert all(r.n == blocks and r.m == blocks - 1 for r in got)


def test_permutation_of_very_many_blocks(spark):
    """At 10**11 blocks: no overflow, no block twice, and the last block where it should be."""
    blocks = 10**11
    rng = random.Random(40)
    places = sorted({rng.randrange(2 * blocks) for _ in range(2000)} | set(range(50)) | set(range(blocks - 25, blocks + 25)))
    df = spark.createDataFrame([(j,) for j in places], "j long")
    n, rank = F.lit(blocks).cast("long"), F.lit(3).cast("long")
    rows = df.select("j", mixing._permuted(F.col("j"), n, rank).alias("b"), mixing._turn(F.col("j"), n).alias("t"), mixing._draw("prime", rank, mixing._turn(F.col("j"), n)).alias("p"), mixing._short_slot(mixing._turn(F.col("j"), n), n, rank).alias("s")).collect()
    assert len({(r.t, r.b) for r in rows}) == len(places)
    assert all(r.t == r.j // blocks and r.b == (mixing.PRIMES[r.p % 4] * (r.j % blocks - r.s) - 1) % blocks for r in rows)


def test_a_mix_meets_its_targets_to_a_word_in_shards_of_one_size(spark):
    rows, d = mixed_fixture(spark)
    sizes = d.select(F.col("doc_id").alias("row"), "doc_id", "source", F.size(F.split("text", " ")).cast("long").alias("size"))
    documents, pieces = mixing.mix(sizes, block=16, shard_slots=40)
    pieces = staged_once(pieces)
    target = {r["rank"]: r.target for r in documents.select("rank", "target").distinct().collect()}
    got = {r["rank"]: r.n for r in pieces.groupBy("rank").agg(F.sum("n").alias("n")).collect()}
    assert got == {k: int(t + 0.5) for k, t in target.items()}
    slots = pieces.select("shard", "place", "rank", "slot").distinct().collect()
    shards = Counter(r.shard for r in slots)
    last = max(shards)
    assert all(shards[s] == 40 for s in range(last)) and 0 < shards[last] <= 40 and len({(r.shard, r.place) for r in slots}) == len(slots)
    totals = Counter(r["rank"] for r in slots)
    # Each shard's counts are near the sources' shares of all slots: within five standard deviations.
    for s in range(last):
        for rank, n in totals.items():
            p = n / len(slots)
            mine = sum(r.shard == s and r["rank"] == rank for r in slots)
            assert abs(mine - 40 * p) <= 5 * (40 * p * (1 - p)) ** 0.5
    # No word of a document is taken twice in a pass.
    for r in pieces.groupBy("row", "turn").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("s")).collect():
        assert all(a.first + a.n <= b.first for a, b in zip(r.s, r.s[1:], strict=False))


def test_small_sources_meet_their_targets(spark):
    rows = [(i, prose(random.Random(i), n), "en", s, 0) for i, (s, n) in enumerate([("a", 3), ("b", 1), ("c", 700), ("d", 300), ("d", 1)])]
    got = Counter()
    want = {}
    for r in mixing.op8_mixing(spark.createDataFrame(rows, DOCS)).collect():
        got[rows[r.doc_id][3]] += r.taken
        want[rows[r.doc_id][3]] = r.target
        assert r.taken <= 2 * r.size
    assert got == Counter({s: int(t + 0.5) for s, t in want.items()})


def test_mixed_documents_hold_the_words_taken(spark):
    rows, d = mixed_fixture(spark)
    out = mixing.mix_documents(d).collect()
    taken = {r.doc_id: r.taken for r in mixing.op8_mixing(d).collect()}
    words = Counter()
    for r in out:
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text) and set(r.text.split()) <= set(rows[r.doc_id][1].split())
    assert words == Counter({i: n for i, n in taken.items() if n})
    assert sorted(mixing.mix_documents(d, in_shards=True).collect()) == sorted(out)
    draws = mixing.shard_counts(mixing.mix(d.select(F.col("doc_id").alias("row"), "doc_id", "source", F.lit(100).cast("long").alias("size")))[1])
    assert draws.count() > 0


def test_mixing_odd(spark):
    d = odd(spark)
    out = mixing.op8_mixing(d).collect()
    assert len(out) == d.count() and all(r.taken <= 2 * r.size for r in out) and mixing.op8_mixing(d.limit(0)).count() == 0
    assert mixing.mix_documents(d).columns == d.columns and mixing.mix_documents(d.limit(0)).count() == 0


# --- benchmark ---------------------------------------------------------------------------------------------------

NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return NORMAL.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items, window=10):
    w = lowered(text)
    hit, found = set(), set()
    for key, item in items:
        it = lowered(item)
        k = min(window, len(it))
        for a in range(len(it) - k + 1) if it else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == it[a : a + k]:
                    hit |= set(range(i, i + k))
                    found.add(key)
    return len(w), len(hit), sorted(found)


def bench_fixture(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice([0, 1, 3, 9, 10, 11, 25]), 6)) for i in range(25)] + [(99, None), (100, "É Ü 10 items, of Ten-words here; and one more É")]
    texts = [prose(rng, rng.randrange(60), 6) for _ in range(60)] + [*ODD, "x é ü 10 ITEMS of ten words HERE and one more é y"]
    return items, texts


@pytest.mark.parametrize("words_per_automaton", [1_000_000, 60])
def test_decontamination(spark, words_per_automaton):
    items, texts = bench_fixture(11)
    b = spark.createDataFrame([*items, items[3]], "item_id long, text string")
    found = decontaminate.find_benchmark(docs(spark, texts), b, words_per_automaton=words_per_automaton).orderBy("doc_id").collect()
    for t, r in zip(texts, found, strict=True):
        n, hits, keys = brute_hits(t, items)
        assert (r.bench_n_words, sum(s.stop - s.start for s in r.bench_spans), r.bench_items) == (n, hits, keys), t
    digest = decontaminate.op9_decontamination(docs(spark, texts), b).orderBy("doc_id").collect()
    for t, r in zip(texts, digest, strict=True):
        keys = brute_hits(t, items)[2]
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, keys))).encode()).hexdigest() and r.contaminated == bool(keys)


def test_decontamination_with_text_ids(spark):
    items, texts = bench_fixture(13)
    b = spark.createDataFrame([(f"item {i}", t) for i, t in items], "item_id string, text string")
    d = docs(spark, texts).withColumn("doc_id", F.concat(F.lit("d"), F.format_string("%04d", "doc_id")))
    for bound in (1_000_000, 60):
        found = decontaminate.find_benchmark(d, b, words_per_automaton=bound).orderBy("doc_id").collect()
        assert [r.bench_items for r in found] == [sorted(f"item {k}" for k in brute_hits(t, items)[2]) for t in texts]


def test_equal_words_take_one_step_each():
    """A text of one word runs up no links: eight times the words take far less than eight squared times as long."""
    from time import perf_counter

    automaton = decontaminate.SuffixAutomaton([(1, [b"a"] * 20_000), (2, [b"a"] * 3)], 10)
    seconds = []
    for n in (5_000, 40_000):
        begin = perf_counter()
        spans, longest, found = automaton.scan([b"a"] * n)
        seconds.append(perf_counter() - begin)
        assert spans == [(0, n)] and longest == min(n, 20_000) and found == {1, 2}
    assert seconds[1] < 32 * seconds[0]


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = docs(spark, [f"before {item.upper()}, after it all the rest of a long clean text follows", "clean", None])
    assert [r.doc_id for r in decontaminate.remove_benchmark(d, b).orderBy("doc_id").collect()] == [1, 2]
    cut = decontaminate.remove_benchmark(d, b, most_coverage=0.9).orderBy("doc_id").collect()
    assert cut[0].text == "before , after it all the rest of a long clean text follows" and len(cut) == 3
    o = odd(spark)
    kept = decontaminate.remove_benchmark(o, b.limit(0))
    assert kept.columns == o.columns and kept.count() == o.count() and kept.where("bench_spans = 'own'").count() == o.count()


# --- token store ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


def test_encoder_is_the_library(vocabulary):
    from tokenizers import Tokenizer

    rng = random.Random(12)
    wild = ["".join(rng.choice("aB é́ '\n\t\x0b\x1c\x85\xa0µª²½s.re,!<|endoftext|>日本12#İßÞ%ÿ_-") for _ in range(50)) for _ in range(400)]
    texts = [*ODD, *wild, *(prose(rng, 50) for _ in range(20)), " x.y, a..b <|ENDOFTEXT|> it's", "A,b.C of%%% the***"]
    library = Tokenizer.from_file(vocabulary)
    encoder = token_store.Encoder(vocabulary, 2, 2)
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        flat, bounds = encoder.encode(part)
        for t, a, b in zip(part, bounds, bounds[1:], strict=False):
            assert flat[a:b].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 2], t


def test_store_round_trip(spark, vocabulary, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(13)
    shared = prose(rng, 4000)
    texts = [*ODD, *(prose(rng, rng.randrange(3000)) for _ in range(20)), shared + " x", "y " + shared, shared, shared]
    path = f"file://{tmp_path}/store"
    d = docs(spark, texts).repartition(5)
    token_store.write_store(d, path, vocabulary)
    library = Tokenizer.from_file(vocabulary)
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert {r.doc_id: r.ids for r in token_store.read_documents(spark, path).collect()} == dict(enumerate(ids))
    start = 0
    for r, x in zip(token_store.read_digests(spark, path).orderBy("start").collect(), ids, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32, r.intact) == (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), True)
        start += len(x)
    chunks = spark.read.parquet(f"{path}/chunks")
    recipes = spark.read.parquet(f"{path}/recipes")
    assert chunks.count() == chunks.select("chunk").distinct().count() < recipes.agg(F.sum(F.size("chunks"))).first()[0]
    manifest = {r.segment: r for r in spark.read.parquet(f"{path}/manifest").collect()}
    for s, m in manifest.items():
        own = recipes.where(F.col("segment") == s).orderBy("start").collect()
        assert m.root == token_store.merkle([token_store.merkle([bytes(c) for c in r.chunks]) for r in own]) and m.n_docs == len(own)
    assert len(token_store.store_root(spark, path)) == 64
    # A changed chunk is noticed.
    first = chunks.orderBy("chunk").limit(1).collect()[0].chunk
    bad = chunks.withColumn("ids", F.when(F.col("chunk") == F.lit(first), F.concat(F.unhex(F.lit("0700")), F.substring("ids", 3, 1 << 20))).otherwise(F.col("ids")))
    bad.write.parquet(f"{path}2/chunks")
    recipes.write.parquet(f"{path}2/recipes")
    assert 0 < token_store.read_digests(spark, f"{path}2").where("not intact").count() < len(texts)


def test_store_notices_what_changed(spark, vocabulary, tmp_path):
    """A changed recipe, a lost segment, swapped manifest rows, a wrong stored root and a lost chunk are told of."""
    rng = random.Random(17)
    texts = [prose(rng, rng.randrange(20, 2000)) for _ in range(60)]
    base = f"file://{tmp_path}/store"
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else a table as small as this is one segment
    try:
        token_store.write_store(docs(spark, texts).repartition(4), base, vocabulary)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    parts = {n: spark.read.parquet(f"{base}/{n}") for n in ("chunks", "recipes", "manifest", "root")}
    segments = [r.segment for r in parts["manifest"].orderBy("segment").collect()]
    assert len(segments) > 1
    copies = iter(range(100))

    def read(**changed):
        path = f"{base}-{next(copies)}"
        for n, df in (parts | changed).items():
            df.write.parquet(f"{path}/{n}")
        return token_store.read_digests(spark, path).collect(), {r.segment: r for r in token_store.verify_store(spark, path).collect()}, path

    rows, told, _ = read()
    assert all(r.intact and r.segment_ok and r.store_ok for r in rows) and all(r.segment_ok and r.store_ok for r in told.values()) and len(rows) == 60
    recipes = parts["recipes"]
    mine = recipes.where("doc_id = 5").first()
    other = recipes.where(f"segment = {mine.segment} and doc_id <> 5").first()
    swapped = recipes.withColumn("chunks", F.when(F.col("doc_id") == 5, F.array(*(F.lit(bytes(c)) for c in other.chunks))).otherwise(F.col("chunks")))
    rows, told, path = read(recipes=swapped)
    assert [r.doc_id for r in rows if not r.intact] == [5] and {r.segment for r in rows if not r.segment_ok} == {mine.segment} and not any(r.store_ok for r in rows)
    assert [r.doc_id for r in token_store.read_documents(spark, path).where("not intact and ids is null").collect()] == [5]
    rows, told, _ = read(recipes=recipes.where(F.col("segment") != segments[0]))
    assert all(r.intact and r.segment_ok and not r.store_ok for r in rows) and [s for s, r in told.items() if not r.segment_ok] == [segments[0]]
    moved = parts["manifest"].withColumn("segment", F.when(F.col("segment") == segments[0], segments[1]).when(F.col("segment") == segments[1], segments[0]).otherwise(F.col("segment")))
    rows, told, _ = read(manifest=moved)
    assert all(r.intact for r in rows) and {s for s, r in told.items() if not r.segment_ok} == set(segments[:2])
    named = recipes.withColumn("doc_id", F.when(F.col("doc_id") == 5, 500).otherwise(F.col("doc_id")))
    assert {r.segment for r in read(recipes=named)[0] if not r.segment_ok} == {mine.segment}
    rows, _, _ = read(root=parts["root"].withColumn("root", F.unhex(F.lit("00" * 32))))
    assert all(r.intact and r.segment_ok and not r.store_ok for r in rows)
    rows, _, path = read(chunks=parts["chunks"].where(F.col("chunk") != F.lit(bytes(mine.chunks[0]))))
    assert [r.doc_id for r in rows if not r.intact] == [5] and token_store.read_documents(spark, path).where("intact").count() == 59


def test_store_of_text_ids_and_other_tokenizers(spark, vocabulary, tmp_path):
    from pathlib import Path

    from tokenizers import Tokenizer

    other = str(Path(vocabulary).with_name("byte_bpe_50k.json"))
    assert token_store.splits_words(token_store.definition(vocabulary)) and not token_store.splits_words(token_store.definition(other))
    texts = ["It's a Test, of  some\n\ntext", "ÀÉ日本 and so on", "", prose(random.Random(1), 300)]
    d = docs(spark, texts).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    path = token_store.write_store(d, f"file://{tmp_path}/s", other, end_id=0, width=4)
    library = Tokenizer.from_file(other)
    found = {r.doc_id: r.ids for r in token_store.read_documents(spark, path, width=4).collect()}
    assert found == {f"d{i}": [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert [r.doc_id for r in token_store.read_digests(spark, path, width=4).orderBy("start").collect()] == ["d0", "d1", "d2", "d3"]


def test_store_odd(spark, vocabulary):
    d = odd(spark)
    out = token_store.op10_token_store(d, vocabulary).orderBy("start").collect()
    assert len(out) == d.count() and [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1].tolist()] and out[0].doc_id is None
    assert [r.doc_id for r in out[1:]] == sorted(r.doc_id for r in out[1:]) and token_store.op10_token_store(d.limit(0), vocabulary).count() == 0


def test_borders_are_content_defined():
    rng = np.random.default_rng(14)
    x = rng.integers(0, 49_000, 30_000).astype(np.uint32)
    plain, moved = (token_store.borders(y, np.array([0, len(y)]))[0] for y in (x, np.concatenate([x[:100], x])))
    assert len({e + 100 for e in plain} & set(moved)) >= len(plain) - 3
    sizes = np.diff([0, *plain])
    assert sizes[:-1].min() >= token_store.LEAST and sizes.max() <= token_store.MOST and plain[-1] == len(x)
    flat = token_store.borders(np.zeros(20_000, np.uint32), np.array([0, 20_000]))[0]
    assert flat[-1] == 20_000 and max(np.diff([0, *flat])) <= token_store.MOST


def test_shifted_crc():
    a, b = b"some bytes", b"and more of them" * 9
    got = token_store.crc_shifted(np.array([zlib.crc32(a), zlib.crc32(b)], np.uint32), np.array([len(b), 0]))
    assert int(got[0] ^ got[1]) == zlib.crc32(a + b)
