"""Benchmark decontamination with a generalised suffix automaton over normalised test items.

The items' words are inserted into one automaton, item by item. A document's words are then streamed
through it; at each word the automaton gives the longest suffix of the text so far that occurs in some
item. A window is `window` consecutive item words (a shorter item is one window whole); every document
word inside an occurrence of a window is hit.

An automaton covers whole items of about words_per_automaton words together (some 100 MB in a Python worker). A larger
benchmark is worked through part by part: each part is a job of its own whose automaton goes when it ends, and only
the rows that it hits are written; the parts' findings are joined with the documents by row.

Cases: null or empty texts have no words and are never contaminated; items without words have no
window; repeated rows and repeated items are handled row by row; an empty benchmark hits nothing; ids of documents and
items may be of any type with an order (bench_items keeps the items'); extra columns pass through untouched (ones
named bench_... are replaced by find_benchmark). No text is cut, however long.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm.common import packed, staged

#: Bytes that part words (all ASCII but 0-9 A-Z a-z) become spaces, A-Z become a-z.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

NAMES = ("bench_n_words", "bench_spans", "bench_longest", "bench_items")
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def _result(item: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, k) for n, k in zip(NAMES, (T.LongType(), _SPANS, T.LongType(), T.ArrayType(item)), strict=True)]


def normalised_words(text: str | None) -> list[bytes]:
    """Lower-cased A-Z, split at every other ASCII character that is not a digit."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """All substrings of all items; of each state the items that hold its window."""

    def __init__(self, items: list[tuple[Any, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(key, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for key, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        # By length every state comes after its link: what lies up the links is known in one step.
        link, length = self.link, self.length
        self.of_window = list(range(len(link)))
        order = sorted(range(1, len(link)), key=length.__getitem__)
        for s in order:
            if length[link[s]] >= window:
                self.of_window[s] = self.of_window[link[s]]
        self.items: dict[int, set[Any]] = {}
        self.short: dict[int, list[tuple[int, Any]]] = {}
        self.least = min([window, *(len(words) for _, words in coded)])
        for key, words in coded:
            state = 0
            if len(words) < window:
                for w in words:
                    state = self.next[state][w]
                self.short.setdefault(state, []).append((len(words), key))
                continue
            for i, w in enumerate(words):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.items.setdefault(self.of_window[state], set()).add(key)
        # The next state up the links, or the state itself, that short items end in; 0: none.
        self.up_short = [0] * len(link)
        for s in order:
            self.up_short[s] = s if s in self.short else self.up_short[link[s]]

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:  # another item already brought this substring
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, q, w)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return new

    def _split(self, p: int, q: int, w: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], int, set[Any]]:
        """Hit spans of word positions, the longest match, the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[Any] = set()
        classes: set[int] = set()
        longest, n = 0, len(words)
        if n < self.least or not self.vocabulary:
            return spans, longest, found
        ids = np.fromiter(map(self.vocabulary.get, words, [-1] * n), np.int64, n)
        # Words of no item put the automaton back to its root, so only runs of known words need steps.
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
        nxt, link, length, window = self.next, self.link, self.length, self.window
        of_window, up_short = self.of_window, self.up_short
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if stop - start < self.least:
                continue
            state = matched = 0
            for i, w in enumerate(ids[start:stop].tolist(), start):
                while w not in nxt[state] and state:
                    state = link[state]
                    matched = length[state]
                if w in nxt[state]:
                    state = nxt[state][w]
                    matched += 1
                longest = max(longest, matched)
                if matched >= window:
                    self._hit(spans, i + 1 - window, i + 1)
                    classes.add(of_window[state])
                if self.short:
                    up = up_short[state]
                    while up:  # fewer than `window` times: each has a length of its own below it
                        for size, key in self.short[up]:
                            if size <= matched:
                                self._hit(spans, i + 1 - size, i + 1)
                                found.add(key)
                        up = up_short[link[up]]
        return spans, longest, found.union(*(self.items[c] for c in classes))

    @staticmethod
    def _hit(spans: list[tuple[int, int]], start: int, stop: int) -> None:
        while spans and spans[-1][1] >= start:
            before = spans.pop()
            start, stop = min(start, before[0]), max(stop, before[1])
        spans.append((start, stop))


_built: dict[str, SuffixAutomaton] = {}


def _automaton(key: str, items: list[tuple[Any, list[bytes]]], window: int) -> SuffixAutomaton:
    """The process's automaton: built once for all tasks that a Python worker runs; one is kept."""
    if key not in _built:
        _built.clear()
        _built[key] = SuffixAutomaton(items, window)
    return _built[key]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, words_per_automaton: int = 400_000) -> DataFrame:
    """docs with bench_n_words, bench_spans (word positions), bench_longest and bench_items.

    Items with a null item_id hit as others do; in bench_items they are one null, which op9_decontamination counts in
    n_items and leaves out of items_sha256.

    The benchmark's words are counted first; one that fits one automaton is found in the pass that reads the documents.
    """
    words = F.regexp_count(F.col("text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    sized = benchmark.select("item_id", F.col("text").alias("text"), words.alias("words")).where("words > 0")
    parts = max(1, -(-sized.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0] // words_per_automaton))
    own = [f for f in docs.schema.fields if f.name not in NAMES]
    kind = sized.schema["item_id"].dataType
    if parts == 1:
        return _pass(docs, sized, window, own, False)
    rest = docs.select(*(F.col(f"`{f.name}`") for f in own))
    numbered = staged(packed(rest, "text").withColumn("row", F.monotonically_increasing_id()), "numbered")
    row = [T.StructField("row", T.LongType())]
    found = None
    for k in range(parts):
        part = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        one = staged(_pass(numbered.select("row", "text"), part, window, row, True), "found")
        found = one if found is None else found.unionByName(one)
    joined = found.groupBy("row").agg(
        F.flatten(F.collect_list("bench_spans")).alias("bench_spans"), F.max("bench_longest").alias("bench_longest"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("bench_items")))).alias("bench_items"),
    )
    kinds = {f.name: f.dataType for f in joined.schema.fields}
    joined = joined.mapInArrow(_merged, T.StructType([T.StructField(c, kinds[c]) for c in ("row", "bench_longest", "bench_items", "bench_spans")]))
    n_words = F.coalesce(words.cast("long"), F.lit(0).cast("long"))
    whole = numbered.withColumn("bench_n_words", n_words).join(joined, "row", "left")
    empty = {"bench_spans": F.array().cast(_SPANS), "bench_longest": F.lit(0).cast("long"), "bench_items": F.array().cast(T.ArrayType(kind))}
    return whole.select("_doc.*", "bench_n_words", *(F.coalesce(F.col(c), e).alias(c) for c, e in empty.items()))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their spans in order, joined where they meet."""
    for batch in batches:
        out = []
        for row in batch.column("bench_spans").to_pylist():
            spans: list[tuple[int, int]] = []
            for start, stop in sorted((x["start"], x["stop"]) for x in row):
                SuffixAutomaton._hit(spans, start, stop)
            out.append([{"start": a, "stop": b} for a, b in spans])
        names = ["row", "bench_longest", "bench_items"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(out, to_arrow_type(_SPANS))], [*names, "bench_spans"])


def _pass(docs: DataFrame, sized: DataFrame, window: int, keep: list[T.StructField], hits_only: bool) -> DataFrame:
    """docs' columns `keep` with what the items of sized hit; with hits_only, no rows without a hit or match."""
    added = _result(sized.schema["item_id"].dataType)
    schema = T.StructType([*keep, *added])
    items = [(row.item_id, normalised_words(row.text)) for row in sized.select("item_id", "text").collect()]
    shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    names, arrow = [f.name for f in keep], [to_arrow_type(f.dataType) for f in added]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, shared.value, window)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                got = [(len(w), *automaton.scan(w)) for w in map(normalised_words, piece.column("text").to_pylist())]
                if hits_only:
                    some = [g[2] > 0 for g in got]
                    piece, got = piece.filter(pa.array(some, pa.bool_())), [g for g, ok in zip(got, some, strict=True) if ok]
                new = [
                    pa.array([g[0] for g in got], arrow[0]),
                    pa.array([[{"start": a, "stop": b} for a, b in g[1]] for g in got], arrow[1]),
                    pa.array([g[2] for g in got], arrow[2]),
                    pa.array([sorted(g[3], key=lambda x: (x is None, x)) for g in got], arrow[3]),
                ]
                yield pa.RecordBatch.from_arrays([*(piece.column(name) for name in names), *new], schema.names)

    return docs.mapInArrow(scan, schema)


def hit_words() -> F.Column:
    return F.aggregate("bench_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_longest: int = 10, most_coverage: float = 0.0) -> DataFrame:
    """docs without what they share with the benchmark, in their own columns.

    A document goes when its hit words are more than most_coverage of its words; otherwise it stays and
    spans of at least most_longest words are cut from its text (at word borders; what stands between two
    kept words stays). Documents without a hit stay as they are. Null texts stay.
    """
    found = find_benchmark(packed(docs, "text"), benchmark, window)
    share = hit_words() / F.greatest(F.col("bench_n_words"), F.lit(1))
    kept = found.where(share <= most_coverage)
    if most_coverage <= 0:  # nothing that stays has a hit
        return kept.select("_doc.*")
    schema = T.StructType([kept.schema["_doc"], T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("bench_spans").to_pylist(), strict=True):
                spans = [s for s in spans or () if s["stop"] - s["start"] >= most_longest]
                if text and spans:
                    at = [m.span() for m in word.finditer(text)]
                    for s in reversed(spans):
                        text = text[: at[s["start"]][0]] + text[at[s["stop"] - 1][1] :]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(texts, pa.string())], ["_doc", "text"])

    return kept.select("_doc", "text", "bench_spans").mapInArrow(cut, schema).select(F.col("_doc").withField("text", F.col("text")).alias("_doc")).select("_doc.*")


def op9_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of find_benchmark: see the module for nulls, empties and ties."""
    found = find_benchmark(docs.select("doc_id", "text"), benchmark)
    names = F.array_join(F.array_sort(F.transform("bench_items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col("bench_n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (hit_words() > 0).alias("contaminated"),
    )


def item_digest(keys: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, keys))).encode()).hexdigest()
