"""Token ids in a content-addressed store: rolling-hash chunks, recipes, Merkle manifests.

Writing: texts are encoded in place (no shuffle of text); a rolling hash over the ids cuts each document
into chunks; a chunk is named by the SHA-256 of its bytes. Four Parquet folders make a store:

  chunks/    (chunk, n_ids, ids)            each distinct chunk once, ids as little-endian uint16 or
                                            uint32 (width is a parameter: 2 bytes hold a 49k vocabulary)
  recipes/   (doc_id, row, segment, start, n_ids, chunks array, root)
                                            ascending doc_id; root is the Merkle root of the chunks
  manifest/  (segment, n_docs, n_ids, root, listing)
                                            Merkle root of each segment's documents; listing is the SHA-256
                                            of its ids, starts and lengths in order
  root/      (root, n_segments, n_docs, n_ids) one row: the Merkle root of the segments' roots

Reading verifies and tells of each document: `intact`, its chunks' bytes hash to their names, its recipe finds them
with the lengths it states and their Merkle root is the recipe's; `segment_ok`, the roots and listing of its segment,
computed anew from the recipes, are the manifest's; `store_ok`, every segment of the manifest is there and
agrees, and the manifest's roots give the stored root. `verify_store` has a row a segment, lost ones too.

Cases: null and empty texts are a lone end id; repeated rows and repeated doc_ids each have a recipe (ties
by row); doc_ids of any type with an order keep it; a null doc_id sorts first; an empty table makes an empty store;
without a manifest no segment is ok; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from factloom.llm.common import discard, mix, scratch_path, staged

#: Chunk bounds in ids: none is cut before LEAST, all are cut at MOST, one id in MASK + 1 is a border.
LEAST, MOST, MASK, SPAN = 256, 8192, 1023, 16
#: Pieces of text whose ids an encoder keeps at a time; the memory of a worker is bounded by it.
CACHE = 1_000_000

_GEAR = mix(np.arange(1 << 16, dtype=np.uint64)).astype(np.uint32)


#: Latin-1 in lower case with '\\n' as ' ', and the class of each byte: a for letters and digits, ' ' for white space.
_LOWER = bytes(32 if c == 10 else c + 32 if 65 <= c <= 90 or (192 <= c <= 222 and c != 215) else c for c in range(256))
_CLASS = bytes(97 if chr(c).isalnum() else 32 if chr(c).isspace() else 46 for c in range(256))
_WORD = re.compile(rb"([a-z\xdf-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")


class _Numbers(dict):
    """Numbers for pieces in order of first sight; `new` lists those that have no ids yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes | str] = []

    def __missing__(self, piece: bytes | str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class Encoder:
    """The library's tokenizer over whole texts, with the ids of pieces of text kept.

    The tokenizer is given as a file's path or as its JSON. With by_word (None: where `splits_words` says so), for
    tokenizers that normalise by NFC and lower case and part words at white space and between letters and punctuation, a text is split at ' ' and '\\n', which no token spans. Latin-1
    texts are put in lower case first, and their commas and full stops split off, where this cannot change a token:
    no two marks touch and no special token can be in the text. A piece that is a word, with marks behind it
    or not, is the word's ids and the marks'; new words go to the library many at a time, and each ends with a token
    that ends a word. All other pieces go to the library as they are. Without by_word each text does.
    """

    def __init__(self, tokenizer: str, end_id: int, width: int, by_word: bool | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        told = definition(tokenizer)
        self.tokenizer = Tokenizer.from_str(told)
        by_word = splits_words(told) if by_word is None else by_word
        self.kind = {2: np.dtype("<u2"), 4: np.dtype("<u4")}[width]
        size = self.tokenizer.get_vocab_size()
        if size > 256**width or end_id >= 256**width:
            raise ValueError("ids do not fit the width")
        self.by_word, self.end_id = by_word, end_id
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.marks: dict[bytes, np.ndarray] = {}
        self.flat = np.zeros(1 << 16, self.kind)
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0
        self.numbers[None] = 0  # the end of a text
        self._put_all([0], [np.array([self.end_id], self.kind)])

    def _put(self, numbers: list[int] | np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of numbered pieces, back to back in flat."""
        while len(self.numbers) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[numbers] = self.used + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.used += len(flat)

    def _put_all(self, numbers: list[int], ids: list[np.ndarray]) -> None:
        if ids:
            self._put(numbers, np.concatenate(ids), np.array([len(x) for x in ids], np.int64))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words back to back, and how many each has."""
        lines = [b" ".join(words[at : at + 250]).decode("latin-1") for at in range(0, len(words), 250)]
        ids = np.concatenate(self._whole(lines))
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        if len(stops) == len(words):
            return ids, np.diff(stops, prepend=0)
        each = self._whole([w.decode("latin-1") for w in words])  # not of this family after all
        return np.concatenate(each), np.array([len(x) for x in each])

    def _learn(self) -> None:
        new, first = self.numbers.new, len(self.numbers) - len(self.numbers.new)
        self.numbers.new = []
        alone, words, marked, other = [], [], [], []
        match = _WORD.fullmatch
        for k, piece in enumerate(new, first):
            m = match(piece) if type(piece) is bytes else None
            if m is None:
                other.append((k, piece))
            elif m[2]:
                marked.append((k, m[1], m[2]))
            else:
                alone.append(k)
                words.append(piece)
        for at in range(0, len(words), 20_000):
            self._put(alone[at : at + 20_000], *self._words(words[at : at + 20_000]))
        if marked:
            if fresh := list({marks for _, _, marks in marked}.difference(self.marks)):
                self.marks.update(zip(fresh, self._whole([m.decode("latin-1") for m in fresh]), strict=True))
            flat, sizes = self._words([w for _, w, _ in marked])
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            self._put_all([k for k, _, _ in marked], [np.concatenate([x, self.marks[m]]) for x, (_, _, m) in zip(parts, marked, strict=True)])
        texts = [piece.decode("latin-1") if type(piece) is bytes else piece for _, piece in other]
        self._put_all([k for k, _ in other], self._whole(texts))

    @staticmethod
    def _pieces(text: str) -> list:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ").split(" ")
        if b"<|" in raw:
            return text.replace("\n", " ").split(" ")
        raw = raw.translate(_LOWER)
        if b".." not in raw.translate(_CLASS):
            raw = raw.replace(b",", b" ,").replace(b".", b" .")
        return raw.split(b" ")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each with the end id, back to back; where each text starts, and the end."""
        if not self.by_word:
            ids = [np.append(x, self.kind.type(self.end_id)) for x in self._whole([t or "" for t in texts])]
            return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        if len(self.numbers) > CACHE:
            self._forget()
        every: list = []
        ends = []
        for t in texts:
            every += self._pieces(t) if t else []
            every.append(None)
            ends.append(len(every))
        number = np.fromiter(map(self.numbers.__getitem__, every), np.int64, len(every))
        if self.numbers.new:
            self._learn()
        sizes = self.size[number]
        stop = np.cumsum(sizes)
        place = np.arange(stop[-1]) + np.repeat(self.start[number] - stop + sizes, sizes)
        return self.flat[place], np.concatenate([[0], stop[np.array(ends) - 1]])


def definition(tokenizer: str) -> str:
    """The tokenizer's JSON, of a file's path or of itself."""
    if tokenizer.lstrip()[:1] == "{":
        return tokenizer
    with open(tokenizer, encoding="utf-8") as f:
        return f.read()


def splits_words(told: str) -> bool:
    """Whether a tokenizer's JSON is of the family that Encoder may feed word by word: all that its rules rely on."""
    j = json.loads(told)
    normal = (j.get("normalizer") or {}).get("normalizers") or []
    pre = (j.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = j.get("model") or {}
    kinds = [n.get("type") for n in normal] == ["NFC", "Replace", "Lowercase"] and [n.get("type") for n in pre] == ["Split", "ByteLevel"]
    return (
        kinds and normal[1].get("pattern") == {"Regex": "\\s+"} and normal[1].get("content") == " "
        and pre[0].get("behavior") == "Removed" and pre[0].get("invert") is True
        and pre[0].get("pattern") == {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
        and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")
        and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        and all(a.get("content", "").startswith("<|") for a in j.get("added_tokens") or [])
    )


_encoders: dict[tuple, Encoder] = {}


def encoder(key: tuple, tokenizer: str) -> Encoder:
    """The process's encoder: Python workers run many tasks, and what one has learnt serves the next."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer, *key[1:])
    return _encoders[key]


def borders(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Chunk ends of each text ids[bounds[i]:bounds[i+1]], relative to its start.

    The rolling hash at a place is a function of the SPAN ids before it, so equal passages are cut at equal
    places wherever they stand. LEAST >= SPAN, hence no window of a usable border spans two texts.
    """
    gear = _GEAR[ids & np.uint32(0xFFFF)]
    rolling = gear.copy()
    for j in range(1, SPAN):
        rolling[j:] += gear[:-j] << np.uint32(2 * j)
    places = np.flatnonzero((rolling >> np.uint32(20)) & np.uint32(MASK) == 0) + 1
    low = np.searchsorted(places, bounds[:-1], side="left")
    high = np.searchsorted(places, bounds[1:], side="left")
    out = []
    for a, b, lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), low.tolist(), high.tolist(), strict=True):
        ends, last = [], a
        for p in places[lo:hi].tolist() if hi > lo else ():
            while p - last > MOST:
                last += MOST
                ends.append(last - a)
            if p - last >= LEAST:
                last = p
                ends.append(p - a)
        while b - last > MOST:
            last += MOST
            ends.append(last - a)
        out.append([*ends, b - a] if last < b else ends)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary SHA-256 tree; an odd node goes up as it is; no leaf: the hash of nothing."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0]


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_LONG, _BYTES, _BOOL = T.LongType(), T.BinaryType(), T.BooleanType()


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, width: int, by_word: bool | None) -> DataFrame:
    """A recipe row for each document and a chunk row for each chunk that its task has not emitted yet.

    The tokenizer goes to the executors as its JSON (a vocabulary, whose size does not grow with the data).
    """
    told = definition(tokenizer)
    key = (hashlib.sha256(told.encode()).hexdigest(), end_id, width, by_word)
    shared = docs.sparkSession.sparkContext.broadcast(told)
    schema = _struct(
        kind=T.StringType(), doc_id=docs.schema["doc_id"].dataType, row=_LONG, n_ids=_LONG, chunks=T.ArrayType(_BYTES), sizes=T.ArrayType(T.IntegerType()), root=_BYTES, chunk=_BYTES, ids=_BYTES
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(key, shared.value).encode
        row = TaskContext.get().partitionId() << 40
        emitted: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                piece = batch.slice(at, 128)
                flat, bounds = encode(piece.column("text").to_pylist())
                cuts = borders(flat.astype(np.uint32), bounds)
                out: list[tuple] = []
                for doc_id, begin, ends in zip(piece.column("doc_id").to_pylist(), bounds.tolist(), cuts, strict=False):
                    names, sizes, a = [], [], 0
                    x = flat[begin : begin + ends[-1]]
                    for b in ends:
                        data = x[a:b].tobytes()
                        name = hashlib.sha256(data).digest()
                        names.append(name)
                        sizes.append(b - a)
                        if name not in emitted:
                            if len(emitted) > CACHE:
                                emitted.clear()
                            emitted.add(name)
                            out.append(("chunk", None, None, b - a, None, None, None, name, data))
                        a = b
                    out.append(("recipe", doc_id, row, len(x), names, sizes, merkle(names), None, None))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, width: int = 2, by_word: bool | None = None) -> str:
    """Encode docs (doc_id, text) into a store at path, a folder of the shared store; gives path.

    tokenizer is a path on the driver, or the tokenizer's JSON; by_word is Encoder's.
    """
    spark = docs.sparkSession
    raw = scratch_path(spark, "ids")
    rows = staged(_encoded(docs, tokenizer, end_id, width, by_word), "ids", raw, partition_by=["kind"])
    chunks = rows.where("kind = 'chunk'").select("chunk", "n_ids", "ids")
    chunks.dropDuplicates(["chunk"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = rows.where("kind = 'recipe'").select("doc_id", "row", "n_ids", "chunks", "sizes", "root")
    # Range-partitioned by doc_id: a partition is a segment, its number is written with it.
    ordered = staged(recipes.sort("doc_id", "row").withColumn("segment", F.spark_partition_id().cast("long")), "recipes")
    totals = ordered.groupBy("segment").agg(F.sum("n_ids").alias("ids"))
    # One row a segment, and the number of segments is the shuffle's partition count.
    offsets = totals.withColumn("base", F.sum("ids").over(W.orderBy("segment")) - F.col("ids")).select("segment", "base")
    inside = W.partitionBy("segment").orderBy("doc_id", "row")
    placed = (
        ordered.withColumn("before", F.sum("n_ids").over(inside) - F.col("n_ids"))
        .join(F.broadcast(offsets), "segment")
        .withColumn("start", F.col("base") + F.col("before"))
    )
    columns = ["doc_id", "row", "segment", "start", "n_ids", "chunks", "sizes", "root"]
    placed.select(*columns).write.option("compression", "zstd").parquet(f"{path}/recipes")
    _segments(spark.read.parquet(f"{path}/recipes"), "root").write.parquet(f"{path}/manifest")
    totals = spark.read.parquet(f"{path}/manifest").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_ids")), F.count("*").alias("n_segments"))
    totals.select(F.unhex(F.lit(store_root(spark, path))).alias("root"), "n_segments", "n_docs", "n_ids").write.parquet(f"{path}/root")
    discard(spark, raw)
    return path


def _segments(recipes: DataFrame, root: str) -> DataFrame:
    """(segment, n_docs, n_ids, root, listing): each segment's documents in order; `root` is the column with their roots."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, docs, ids, roots, listing = None, 0, 0, [], hashlib.sha256()
        done = []
        for batch in batches:
            for s, doc_id, start, n, one in zip(*(batch.column(c).to_pylist() for c in ("segment", "name", "start", "n_ids", "root")), strict=True):
                if s != segment and segment is not None:
                    done.append((segment, docs, ids, merkle(roots), listing.digest()))
                    docs, ids, roots, listing = 0, 0, [], hashlib.sha256()
                segment = s
                docs, ids = docs + 1, ids + n
                roots.append(one)
                listing.update(f"{doc_id!r} {start} {n}\n".encode())
        if segment is not None:
            done.append((segment, docs, ids, merkle(roots), listing.digest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["segment", "n_docs", "n_ids", "root", "listing"])

    rows = recipes.select("segment", F.col("doc_id").cast("string").alias("name"), "start", "n_ids", F.col(root).alias("root"))
    return rows.repartition("segment").sortWithinPartitions("segment", "start").mapInArrow(fold, "segment long, n_docs long, n_ids long, root binary, listing binary")


def store_root(spark: SparkSession, path: str) -> str:
    """One hash for the whole store, from the manifest's row for each segment."""
    rows = spark.read.parquet(f"{path}/manifest").sort("segment").select("root").collect()
    return merkle([bytes(r.root) for r in rows]).hex()


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes with `found_root`, the Merkle root of the chunks they name, and `whole`: it and the sizes are as stated."""
    recipes = spark.read.parquet(f"{path}/recipes")
    names = recipes.schema.names

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, fine = [], []
            for chunks, sizes, root, n in zip(*(batch.column(c).to_pylist() for c in ("chunks", "sizes", "root", "n_ids")), strict=True):
                roots.append(merkle(chunks or []))
                fine.append(roots[-1] == root and len(chunks or []) == len(sizes or []) and sum(sizes or []) == n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary()), pa.array(fine, pa.bool_())], [*names, "found_root", "whole"])

    return staged(recipes.mapInArrow(check, T.StructType([*recipes.schema.fields, *_struct(found_root=_BYTES, whole=_BOOL)])), "recipes")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def verify_store(spark: SparkSession, path: str, recipes: DataFrame | None = None) -> DataFrame:
    """(segment, segment_ok, store_ok), a row for each segment of the manifest or the recipes: roots and listings computed
    anew from the recipes against the manifest, and the manifest's roots against the stored one."""
    found = staged(_segments(recipes or _recipes(spark, path), "found_root"), "segments")
    if not _exists(spark, f"{path}/manifest"):
        return found.select("segment", F.lit(False).alias("segment_ok"), F.lit(False).alias("store_ok"))
    told = spark.read.parquet(f"{path}/manifest")
    columns = ["n_docs", "n_ids", "root", "listing"]
    both = found.toDF("segment", *(f"_{c}" for c in columns)).join(told, "segment", "full")
    fine = F.lit(True)
    for c in columns:
        fine = fine & F.col(c).isNotNull() & F.col(f"_{c}").eqNullSafe(F.col(c))
    # A row a segment, of which there are as many as the writing shuffle had partitions.
    rows = staged(both.select("segment", fine.alias("segment_ok")), "verified")
    stored = spark.read.parquet(f"{path}/root").first() if _exists(spark, f"{path}/root") else None
    whole = stored is not None and bytes(stored.root).hex() == store_root(spark, path) and not rows.where("not segment_ok").limit(1).count()
    return rows.withColumn("store_ok", F.lit(whole))


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of reflected polynomials over GF(2) modulo the CRC-32 polynomial, elementwise."""
    a, b = a.astype(np.uint32).copy(), b.astype(np.uint32).copy()
    product = np.zeros_like(a)
    for i in range(32):
        product ^= np.where(a & np.uint32(1 << (31 - i)), b, np.uint32(0)).astype(np.uint32)
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ _POLY, b >> np.uint32(1)).astype(np.uint32)
    return product


_SHIFTS = [np.array([0x00800000], np.uint32)]  # x to the power 8, then each the square of the last
while len(_SHIFTS) < 48:
    _SHIFTS.append(_times(_SHIFTS[-1], _SHIFTS[-1]))


def crc_shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a part with this CRC-32 adds to the CRC-32 of a whole in which n_bytes follow the part.

    CRC-32 of A+B is shifted(crc(A), len(B)) xor crc(B); so a whole's is the xor over its parts.
    """
    out, left, k = crc.astype(np.uint32), n_bytes.astype(np.int64).copy(), 0
    while left.any():
        step = (left & 1).astype(bool)
        if step.any():
            out[step] = _times(out[step], np.broadcast_to(_SHIFTS[k], int(step.sum())))
        left >>= 1
        k += 1
    return out


def read_digests(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, row, segment, start, n_tokens, ids_crc32, intact, segment_ok, store_ok) of each document from the store's files.

    Each chunk is read, verified and digested once where it lies; only digests are joined with recipes, and
    a document's CRC-32 is the xor of its chunks' shifted ones. So no id moves, and a chunk that a third of
    all documents share is still read once.
    """
    kind = {2: np.dtype("<u2"), 4: np.dtype("<u4")}[width]
    keep = ["doc_id", "row", "segment", "start", "found", "same"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, data = batch.column("chunk").to_pylist(), batch.column("ids").to_pylist()
            good = [hashlib.sha256(d).digest() == n for n, d in zip(names, data, strict=True)]
            ids = [np.frombuffer(d, kind) for d in data]
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk"), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(good)],
                ["chunk", "found", "crc", "good"],
            )

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = np.asarray(batch.column("crc").fill_null(0)).astype(np.uint32)
            part = crc_shifted(crc, 4 * np.asarray(batch.column("after")))
            named = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*named, pa.array(part.astype(np.int64))], [*keep, "part"])

    chunks = spark.read.parquet(f"{path}/chunks").select("chunk", "ids").mapInArrow(digest, "chunk binary, found long, crc long, good boolean")
    recipes = _recipes(spark, path)
    segments = verify_store(spark, path, recipes)
    pieces = recipes.select(
        "doc_id", "row", "segment", "start", "n_ids", "whole",
        F.posexplode_outer(F.arrays_zip("chunks", "sizes")).alias("pos", "piece"), "sizes",
    ).select(
        "doc_id", "row", "segment", "start", "whole", F.col("piece.chunks").alias("chunk"), F.col("piece.sizes").alias("size"),
        F.aggregate(F.slice("sizes", F.col("pos") + 2, F.size("sizes")), F.lit(0).cast("long"), lambda a, x: a + x).alias("after"),
    )
    same = F.coalesce(F.col("whole") & F.col("good") & (F.col("found") == F.col("size")), F.lit(False))
    joined = pieces.hint("merge").join(chunks, "chunk", "left").withColumn("same", same)
    shifted = _struct(doc_id=recipes.schema["doc_id"].dataType, row=_LONG, segment=_LONG, start=_LONG, found=_LONG, same=_BOOL, part=_LONG)
    parts = joined.select(*keep, F.coalesce("after", F.lit(0).cast("long")).alias("after"), "crc").mapInArrow(shift, shifted)
    whole = parts.groupBy("doc_id", "row", "segment", "start").agg(
        F.sum("found").alias("n_tokens"), F.bit_xor("part").alias("ids_crc32"), F.bool_and("same").alias("intact")
    )
    return whole.join(F.broadcast(segments), "segment", "left").select(*whole.columns, "segment_ok", "store_ok")


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, row, ids array<int>, intact): every document's ids, put together again by its recipe.

    Each chunk must hash to its name and the names give the recipe's root; else intact is false and ids null.
    """
    kind = {2: np.dtype("<u2"), 4: np.dtype("<u4")}[width]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fine = [], []
            for parts, whole in zip(batch.column("parts").to_pylist(), batch.column("whole").to_pylist(), strict=True):
                ok = bool(whole) and all(p["ids"] is not None and hashlib.sha256(p["ids"]).digest() == p["chunk"] for p in parts)
                fine.append(ok)
                ids.append(np.frombuffer(b"".join(p["ids"] for p in parts), kind).astype(np.int32) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(ids, pa.list_(pa.int32())), pa.array(fine)], ["doc_id", "row", "ids", "intact"])

    recipes = _recipes(spark, path)
    pieces = recipes.select("doc_id", "row", "whole", F.posexplode_outer("chunks").alias("pos", "chunk"))
    gathered = (
        pieces.join(spark.read.parquet(f"{path}/chunks").select("chunk", "ids"), "chunk", "left")
        .groupBy("doc_id", "row", "whole")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "chunk", "ids"))).alias("parts"))
    )
    schema = _struct(doc_id=recipes.schema["doc_id"].dataType, row=_LONG, ids=T.ArrayType(T.IntegerType()), intact=_BOOL)
    return gathered.mapInArrow(join, schema)


def op10_token_store(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write docs' ids to a store, read it back: doc_id, start, n_tokens, ids_crc32, and what reading verified."""
    spark = docs.sparkSession
    path = write_store(docs, path or scratch_path(spark, "store"), tokenizer)
    return read_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "intact", "segment_ok", "store_ok")
