"""Near-duplicate documents: DartMinHash signatures, banded joining, exact check, components.

A document is its bag of five-word shingles (a text of fewer words is one shingle); similarity is weighted
Jaccard, sum of the smaller counts over sum of the larger. DartMinHash: every shingle owns a plane of
darts, a Poisson process over (weight, rank) that depends on the shingle only; a document of total
weight w sees its shingles' darts below its weights and of rank up to theta = t / w, about t darts whatever
its length; each dart falls on one of K coordinates and the earliest on each is kept. Two documents agree on
a coordinate with probability equal to their similarity.

Steps (no step emits a group's pairs, or gathers a group in a task or the driver):
  1. equal texts collapse into one node (a text's MD5), whatever their number;
  2. ROWS coordinates make a band; nodes that share a band's value share a bucket;
  3. every node is checked exactly against the lowest node of each of its buckets;
  4. components of the links so found; in buckets that still hold two components the nodes of different ones
     are all compared, in blocks of about BLOCK nodes or BLOCK_WEIGHT shingles a side, each task emitting only links
     that join components;
  5. components again. With 24 bands of 4 rows a pair of similarity 0.8 shares no bucket once in 300,000.

Cases: a null text is in no group (its own class); empty texts and texts of white space only equal copies
of themselves; repeated rows are copies; ties are broken by the lowest doc_id (null last; ids may be of any type
with an order); an empty table gives an empty result; extra columns are ignored by near_duplicates() and kept by drop_near_duplicates().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.llm.common import mix, packed, staged, text_slices, word_hashes

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 4
#: Nodes and shingles of one side of a comparison; a single text may have more of the latter.
BLOCK, BLOCK_WEIGHT = 256, 200_000


def shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = SHINGLE):
    """(text, shingle, count) arrays in order of (text, shingle), for texts given as in word_hashes."""
    words, owner = word_hashes(data, starts, ends)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.float64)
    per = np.bincount(owner, minlength=len(starts))
    first = np.cumsum(per) - per
    place = np.arange(n) - first[owner]
    code = np.zeros(n, np.uint64)
    for j in range(size):  # words beyond a short text's end are left out
        inside = place + j < per[owner]
        word = np.zeros(n, np.uint64)
        word[: n - j] = words[j:]
        code = np.where(inside, code * np.uint64(0x100000001B3) + word, code)
    fine = (place + size <= per[owner]) | (place == 0)
    text, code = owner[fine], mix(code[fine])
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(new)
    return text[at], code[at], np.diff(np.append(at, len(text))).astype(np.float64)


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1], 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def dart_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """(n_texts, k) signatures of weighted sets given as (text, element, weight), weights above 0.

    The weight axis is cut into unit layers; in each an element's darts arrive in order of rank with exponential
    gaps, at a weight of its own. A layer that the weight fills in part takes the darts below it. Texts that
    miss a coordinate look on to twice the rank; the earlier darts stay the same.
    """
    layers = np.ceil(weight).astype(np.int64)
    item = np.repeat(np.arange(len(text)), layers)
    layer = np.arange(len(item)) - np.repeat(np.cumsum(layers) - layers, layers)
    code = mix(element[item] + mix(layer.astype(np.uint64)) * (layer > 0))
    text, fill = text[item], np.minimum(1.0, weight[item] - layer)
    total = np.bincount(text, fill, minlength=n_texts)
    limit = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-9)
    best, mark = np.full(n_texts * k, np.inf), np.zeros(n_texts * k, np.uint64)
    clock = np.zeros(len(code))
    alive, drawn = np.arange(len(code)), np.zeros(len(code), np.int64)
    step = 1
    while len(alive):
        turn = drawn[alive][:, None] + np.arange(step)[None, :]
        dart = mix(code[alive][:, None] ^ (turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        rank = clock[alive][:, None] + np.cumsum(-np.log(_uniform(dart)), axis=1)
        detail = mix(dart ^ np.uint64(0xD1B54A32D192ED03))
        seen = (rank <= limit[text[alive]][:, None]) & (_uniform(detail) <= fill[alive][:, None])
        row, col = np.nonzero(seen)
        value, where = rank[row, col], text[alive[row]] * k + ((detail[row, col] & np.uint64(0xFFFF)).astype(np.int64) * k >> 16)
        np.minimum.at(best, where, value)
        won = value == best[where]
        mark[where[won]] = dart[row[won], col[won]]
        clock[alive] = rank[:, -1]
        drawn[alive] += step
        more = rank[:, -1] <= limit[text[alive]]
        if not more.any():
            lacking = (best.reshape(n_texts, k) == np.inf).any(1) & (total > 0)
            if not lacking.any():
                break
            limit[lacking] *= 2
            # A clock that has run past the limit holds a dart that was not looked at: go back to its start.
            alive = np.flatnonzero(lacking[text])
            clock[alive] = 0.0
            drawn[alive] = 0
            step = 1
            continue
        alive = alive[more]
        step = min(64, step * 2)
    return mark.reshape(n_texts, k)


def band_codes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    code = np.zeros((len(signature), bands), np.uint64)
    for j in range(rows):
        code = mix(code * np.uint64(0x100000001B3) + signature[:, j::rows][:, :bands])
    return mix(code ^ np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, weight, bands): key is the MD5 of the text, weight its number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, starts, ends, _ in text_slices(batch.column("text")):
                n = len(starts)
                text, code, count = shingles(data, starts, ends)
                weight = np.bincount(text, count, minlength=n)
                signature = dart_minhash(text, code, count, n, bands * rows)
                codes = band_codes(signature, bands, rows)
                lists = pa.ListArray.from_arrays(np.arange(0, (n + 1) * bands, bands, dtype=np.int32), pa.array(codes.ravel()))
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(weight.astype(np.int64)), lists], ["doc_id", "key", "weight", "bands"]
                )

    # An empty text, like any without a word, has no shingle; it only equals its copies.
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key string, weight long, bands array<long>")


def _components(links: DataFrame) -> DataFrame:
    """(node, root): the lowest node of each node's component, for nodes with links (a, b).

    Each round every node takes the lowest root around it, then its root's root; a round's table is staged,
    so lost executors cost a round at most. Only a count comes to the driver.
    """
    both = staged(links.union(links.select("b", "a")).where("a <> b").distinct(), "links").toDF("a", "b")
    label = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "label")
    while True:
        near = both.join(label.toDF("b", "r"), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("near"))
        step = label.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = label.toDF("root", "further")
        new = staged(step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root")), "label")
        changed = new.where("old <> root").limit(1).count()
        label = new.select("node", "root")
        if not changed:
            return label


def _verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Those of pairs (a, b) whose texts (node, text) are similar, by their exact weighted Jaccard."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = part.num_rows
                both = pa.concat_arrays([part.column("ta").cast(pa.large_string()), part.column("tb").cast(pa.large_string())])
                a, b = [], []
                for first, data, starts, ends, _ in text_slices(both):
                    text, code, count = shingles(data, starts, ends)
                    text = text + first
                    for into, side in ((a, text < n), (b, text >= n)):
                        into.append((text[side] % n, code[side], count[side]))
                pair, code, count = (np.concatenate([x[i] for x in (*a, *b)]) for i in range(3))
                order = np.lexsort((code, pair))
                pair, code, count = pair[order], code[order], count[order]
                same = np.flatnonzero((pair[1:] == pair[:-1]) & (code[1:] == code[:-1]))
                shared = np.bincount(pair[same], np.minimum(count[same], count[same + 1]), minlength=n)
                whole = np.bincount(pair, count, minlength=n) - shared
                near = shared >= similar * whole - 1e-9
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(near))

    full = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return full.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _whole_buckets(members: DataFrame, texts: DataFrame, similar: float, bands: int) -> DataFrame:
    """Links (a, b) between different roots in the same bucket of members (bucket, node, weight, root).

    A bucket's largest component needs no comparison in itself. It and the rest are each cut into blocks of about
    BLOCK nodes by a hash; every block of the rest meets every block of the largest, and every other block of the
    rest once. So a bucket in which a few nodes are left beside a large component is sent about once. A pair
    that meets in several buckets is compared in its first one. A task keeps a union-find over its group and emits
    a link only where it joins two components.
    """
    per_root = members.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    blocks = lambda n, w: F.ceil(F.greatest(n / F.lit(BLOCK), w / F.lit(BLOCK_WEIGHT)))
    sizes = per_root.groupBy("bucket").agg(F.max(F.struct("n", "root", "w")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w")).select(
        "bucket", F.col("top.root").alias("top"),
        blocks(F.col("top.n"), F.col("top.w")).alias("tops"), blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("rests"),
    )
    mine = members.drop("weight").join(sizes, "bucket").withColumn("in_top", F.col("root") == F.col("top"))
    mine = mine.withColumn("i", F.pmod(F.xxhash64("node", "bucket"), F.when(F.col("in_top"), F.col("tops")).otherwise(F.col("rests"))))
    zero = F.lit(0).cast("long")
    group = lambda kind, x, y, left: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), F.lit(left).alias("is_left"))
    every = lambda n: F.sequence(zero, F.col(n) - 1)
    # Around the circle of the rest's blocks to half of it; the last step of an even circle would come twice.
    around = F.filter(F.sequence(zero, F.floor(F.col("rests") / 2)), lambda g: (2 * g != F.col("rests")) | (F.col("i") < g))
    behind = F.filter(F.sequence(zero, F.floor(F.col("rests") / 2)), lambda g: (g > 0) & ((2 * g != F.col("rests")) | (F.pmod(F.col("i") - g, F.col("rests")) < g)))
    of_top = F.transform(every("rests"), lambda j: group(0, F.col("i"), j, True))
    of_rest = F.concat(
        F.transform(every("tops"), lambda j: group(0, j, F.col("i"), False)),
        F.transform(around, lambda g: group(1, F.col("i"), g, True)),
        F.transform(behind, lambda g: group(1, F.pmod(F.col("i") - g, F.col("rests")), g, False)),
    )
    # Texts are met before the rows grow: once for each bucket that a node is in.
    met = mine.select("bucket", "node", "root", F.when(F.col("in_top"), of_top).otherwise(of_rest).alias("gs")).join(texts, "node")
    full = met.select("bucket", "node", "root", "weight", "bands", "text", F.explode("gs").alias("g")).select("*", "g.*").drop("g")

    def compare(table: pa.Table) -> pa.Table:
        node, root, weight = (np.asarray(table.column(c)) for c in ("node", "root", "weight"))
        code = np.asarray(table.column("bands").combine_chunks().flatten()).reshape(-1, bands)
        is_left = np.asarray(table.column("is_left"))
        inside = table.column("kind")[0].as_py() == 1 and table.column("y")[0].as_py() == 0
        here = int(np.flatnonzero((code == table.column("bucket")[0].as_py()).all(0))[0])
        parts = []
        for chunk, base in zip(table.column("text").chunks, np.cumsum([0, *map(len, table.column("text").chunks)]), strict=False):
            for first, data, starts, ends, _ in text_slices(chunk):
                text, element, count = shingles(data, starts, ends)
                parts.append((text + first + base, element, count))
        text, element, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
        # One column for each (shingle, repetition): shared weight is then a count of shared columns.
        times = count.astype(np.int64)
        who = np.repeat(text, times)
        what = mix(np.repeat(element, times) + (np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64))
        what, column, many = np.unique(what, return_inverse=True, return_counts=True)
        use = many[column] > 1
        who, column = who[use], np.cumsum(many > 1)[column[use]] - 1
        shared = np.zeros((len(node), len(node)), np.float32)
        order = np.argsort(column, kind="stable")
        who, column = who[order], column[order]
        width = 4096
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [low, low + width])
            dense = np.zeros((len(node), width), np.float32)
            dense[who[a:b], column[a:b] - low] = 1
            shared += dense @ dense.T
        near = shared >= similar * (weight[:, None] + weight[None, :] - shared) - 1e-6
        near &= root[:, None] != root[None, :]
        near &= np.triu(np.ones_like(near), 1) if inside else is_left[:, None] & ~is_left[None, :]
        parent = {r: r for r in root.tolist()}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(near), strict=True):
            if (code[i, :here] == code[j, :here]).any():
                continue
            x, y = find(int(root[i])), find(int(root[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(root[i]), int(root[j])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return full.groupBy("bucket", "kind", "x", "y").applyInArrow(compare, "a long, b long")


def _key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, class, class_id, class_docs, class_texts) for each distinct text: key is md5(text), class a number of
    this run, class_id the class's lowest doc_id."""
    keyed = docs.select("doc_id", F.col("text").alias("text"), _key(F.col("text")).alias("key")).where("text is not null")
    signed = staged(_signed(keyed, bands, rows), "signed")
    per_text = signed.groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("weight").alias("weight"), F.first("bands").alias("bands")
    )
    nodes = staged(per_text.withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.where("weight > 0").select("node", "weight", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    meeting = staged(banded.join(buckets, "bucket").select("bucket", "node", "weight", "low"), "meeting")
    pairs = meeting.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    wanted = meeting.select("node").distinct().join(nodes.select("node", "key", "doc_id", "weight", "bands"), "node")
    texts = staged(
        keyed.join(wanted.withColumnRenamed("doc_id", "rep"), "key").where("doc_id <=> rep").dropDuplicates(["key"]).select("node", "text", "weight", "bands"), "texts"
    )
    links = staged(_verified(pairs, texts.select("node", "text"), similar), "links")
    first = _components(links)
    named = meeting.join(first, "node", "left").select("bucket", "node", "weight", F.coalesce("root", "node").alias("root"))
    mixed = named.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    # In a bucket of two nodes the only pair has been checked already.
    open_buckets = mixed.where("n > 2").select("bucket")
    members = named.join(open_buckets, "bucket")
    more = _whole_buckets(staged(members, "members"), texts, similar, bands)
    second = staged(_components(more).toDF("root", "top"), "roots")
    rooted = nodes.join(first, "node", "left").withColumn("root", F.coalesce("root", "node")).join(second, "root", "left")
    rooted = rooted.select("key", "doc_id", "copies", F.coalesce("top", "root").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_docs"), F.count("*").alias("class_texts"))
    return rooted.join(classes, "root").select("key", F.col("root").alias("class"), "class_id", "class_docs", "class_texts")


def op3_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (lowest doc_id of its class), class_docs, class_texts (distinct), for each document."""
    classes = staged(near_duplicates(docs), "classes")
    return (
        docs.select("doc_id", _key(F.col("text")).alias("key")).join(classes, "key", "left")
        .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_docs", F.lit(1)).alias("class_docs"), F.coalesce("class_texts", F.lit(1)).alias("class_texts"))
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, the one with the lowest doc_id; null texts stay.

    Rows that share a doc_id in a class are one document: one of them stays.
    """
    classes = staged(near_duplicates(docs).select("key", "class", "class_id"), "classes")
    kept = packed(docs, "doc_id", "text").withColumn("key", _key(F.col("text"))).drop("text").join(classes, "key", "left")
    rest = kept.where("key is null").select("_doc.*")
    first = kept.where(F.col("key").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id"))).dropDuplicates(["class"])
    return rest.unionByName(first.select("_doc.*"))


def oracle() -> str:
    """All pairs of texts that share a shingle, by their exact weighted Jaccard, and the classes that links reach."""
    return r"""
WITH RECURSIVE texts AS (SELECT text, row_number() OVER () AS id FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
split AS (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
shingles AS (SELECT id, s, count(*) AS c FROM (
  SELECT id, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT id, w, least(len(w), 5) AS k FROM split WHERE len(w) > 0))) GROUP BY ALL),
weights AS (SELECT id, sum(c) AS n FROM shingles GROUP BY id),
shared AS (SELECT x.id AS a, y.id AS b, sum(least(x.c, y.c)) AS m FROM shingles x JOIN shingles y ON x.s = y.s AND x.id < y.id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN weights x ON x.id = a JOIN weights y ON y.id = b WHERE 5 * m >= 4 * (x.n + y.n - m)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(id, other) AS (SELECT id, id FROM texts UNION SELECT reached.id, b FROM reached JOIN both_ways ON other = a),
roots AS (SELECT id, min(other) AS root FROM reached GROUP BY id),
rooted AS (SELECT doc_id, text, id, root FROM documents JOIN texts USING (text) JOIN roots USING (id)),
classes AS (SELECT root, min(doc_id) AS class_id, count(*) AS class_docs, count(DISTINCT id) AS class_texts FROM rooted GROUP BY root)
SELECT doc_id, class_id, class_docs, class_texts FROM rooted JOIN classes USING (root)
UNION ALL SELECT doc_id, doc_id, 1, 1 FROM documents WHERE text IS NULL"""
