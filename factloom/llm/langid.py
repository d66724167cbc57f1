"""Language identification as a mixture of languages over hashed byte trigrams.

Each language is a smoothed distribution over trigram buckets, counted from labelled texts. A document's
language shares are found by expectation-maximisation of its trigrams' likelihood under the mixture; its set of
languages grows from the likeliest one while each further language raises the log-likelihood by more than
a penalty in the style of BIC.

Cases: a text that is null or has no letter is `und` with score 0 and no languages; without any labelled
text all documents are `und`; case, digits, punctuation and white space do not count; texts are read whole,
however long; extra columns pass through (ones named as predict's results are replaced there); repeated rows get equal
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from factloom.llm.common import packed, text_slices

BITS = 14
_SPACE = 32
_LOWER = np.array(
    [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else _SPACE for c in range(256)], np.uint8
)
_ASCII_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])


def _folded(data: np.ndarray) -> np.ndarray:
    """Letters in lower case (ASCII and Latin-1's two-byte ones); all other ASCII is a space."""
    out = _LOWER[data]
    upper = np.zeros(len(data), bool)
    upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[upper] += 32
    return out


def _codes(folded: np.ndarray) -> np.ndarray:
    """Bucket of each trigram of one text (a space before and after it), without runs of spaces."""
    x = np.empty(len(folded) + 2, np.uint32)
    x[0] = x[-1] = _SPACE
    x[1:-1] = folded
    gap = x == _SPACE
    fine = ~((gap[:-2] & gap[1:-1]) | (gap[1:-1] & gap[2:]))
    code = ((x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:])[fine]
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(32 - BITS)).astype(np.int64)


def _has_letter(raw: np.ndarray) -> bool:
    if _ASCII_LETTER[raw].any():
        return True
    return bool((raw >= 0x80).any()) and any(map(str.isalpha, raw.tobytes().decode("utf-8", "replace")))


def _fit_shares(p: np.ndarray, count: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """EM: the shares that make the trigrams likeliest, and the log-likelihood."""
    total = count.sum()
    for _ in range(rounds):
        joint = p * shares
        new = (count / joint.sum(1)) @ joint / total
        done = np.abs(new - shares).max() < 1e-3
        shares = new
        if done:
            break
    return shares, float(count @ np.log(p @ shares))


def mixture(p: np.ndarray, count: np.ndarray, penalty: float) -> tuple[list[int], np.ndarray]:
    """Languages chosen (likeliest first) and their shares, from p (trigrams x languages) and counts."""
    n_langs = p.shape[1]
    everyone, _ = _fit_shares(p, count, np.full(n_langs, 1 / n_langs), 12)
    order = np.argsort(-everyone, kind="stable")
    single = count @ np.log(p[:, order[:2]])
    first = int(order[int(single[-1] > single[0])]) if n_langs > 1 else 0
    chosen, shares, best = [first], np.ones(1), float(single.max())
    cost = penalty * np.log(count.sum() + 1)
    for extra in order:
        if extra in chosen:
            continue
        if everyone[extra] < 0.01:
            break
        start = np.append(shares * 0.9, 0.1)
        new, reached = _fit_shares(p[:, [*chosen, int(extra)]], count, start, 12)
        if reached - best <= cost:
            break
        chosen, shares, best = [*chosen, int(extra)], new, reached
    rank = np.argsort(-shares, kind="stable")
    return [chosen[i] for i in rank], shares[rank]


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.1):
        self.langs = langs
        raised = counts + smooth
        self.p = np.ascontiguousarray((raised / raised.sum(1, keepdims=True)).T) if langs else np.zeros((1 << BITS, 0))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n): trigrams of the batches' texts."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for at, data, starts, ends, _ in text_slices(batch.column("text")):
            folded = _folded(data)
            for lang, a, b in zip(langs[at:], starts.tolist(), ends.tolist(), strict=False):
                found = np.bincount(_codes(folded[a:b]), minlength=1 << BITS)
                counts[lang] = counts[lang] + found if lang in counts else found
    for lang, found in counts.items():
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(found[seen])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, per_lang: int = 1500) -> Model:
    """Count trigrams of the per_lang labelled texts of each language that have the lowest hashes.

    Only this sample is bounded: per_lang distinct texts a language, whatever their lengths and the number of rows. Texts
    are counted where they lie; a row a language and bucket comes to the driver.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    # Each task keeps its per_lang lowest of a language before any row moves; copies of a text are one.
    lowest = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    first = labelled.select("lang", "h").distinct().withColumn("i", lowest).where(F.col("i") <= per_lang)
    tops = {r.lang: r.top for r in first.groupBy("lang").agg(F.max("h").alias("top")).collect()}
    langs = sorted(tops)
    counts = np.zeros((len(langs), 1 << BITS))
    if not langs:
        return Model(langs, counts)
    top = F.create_map(*(F.lit(x) for lang in langs for x in (lang, tops[lang])))
    picked = labelled.where(F.col("h") <= F.element_at(top, F.col("lang"))).dropDuplicates(["lang", "h"]).select("lang", "text")
    summed = picked.mapInArrow(_counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    for row in summed.toLocalIterator():
        counts[langs.index(row.lang), row.bucket] = row.n
    return Model(langs, counts)


RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("lang_score", T.DoubleType()),
        T.StructField("lang_shares", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def predict(docs: DataFrame, model: Model, penalty: float = 8.0) -> DataFrame:
    """docs with lang_pred, lang_score (its share) and lang_shares (the chosen languages' shares)."""
    schema = T.StructType([*(f for f in docs.schema.fields if f.name not in RESULT.names), *RESULT.fields])
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p = shared.value
        for batch in batches:
            found: list[tuple[str, float, list[tuple[str, float]]]] = []
            for _, data, starts, ends, valid in text_slices(batch.column("text")):
                folded = _folded(data)
                for a, b, ok in zip(starts.tolist(), ends.tolist(), valid.tolist(), strict=True):
                    if not ok or a == b or not langs or not _has_letter(data[a:b]):
                        found.append(("und", 0.0, []))
                        continue
                    codes = _codes(folded[a:b])
                    if len(codes) > 2000:
                        count = np.bincount(codes, minlength=1 << BITS)
                        seen = np.flatnonzero(count)
                        count = count[seen]
                    else:
                        seen, count = np.unique(codes, return_counts=True)
                    chosen, shares = mixture(p[seen], count.astype(float), penalty)
                    found.append((langs[chosen[0]], float(min(1.0, shares[0])), [(langs[c], float(s)) for c, s in zip(chosen, shares, strict=True)]))
            keep = [n for n in batch.schema.names if n not in RESULT.names]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *new], [*keep, *RESULT.names])

    return docs.mapInArrow(run, schema)


def fold_of(modulus: int) -> F.Column:
    """crc32 of doc_id as text, modulo; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def op5_language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_langs; learnt from the rows that are not held out."""
    held = fold_of(5) == 0
    model = fit(docs.where(~held).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.size("lang_shares").alias("n_langs")
    )


def keep_languages(docs: DataFrame, least_share: float = 0.5) -> DataFrame:
    """docs whose language is known and holds at least least_share of them, in their own columns."""
    held = fold_of(5) == 0
    model = fit(docs.where(~held).select("doc_id", "text", "lang"))
    kept = predict(packed(docs, "text"), model).where((F.col("lang_pred") != "und") & (F.col("lang_score") >= least_share))
    return kept.select("_doc.*")
