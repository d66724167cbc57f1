"""Shared pieces of the training-data operators: word patterns, staged tables, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space (space, \t \n \v \f \r).
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_own_scratch: list[str] = []
_written: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one where it is unset and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _own_scratch:
        _own_scratch.append("file://" + tempfile.mkdtemp(prefix="factloom-"))
    return _own_scratch[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    _written.append(f"{scratch_root(spark)}/factloom-{name}-{uuid.uuid4().hex}")
    return _written[-1]


def staged(df: DataFrame, name: str, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and return a reader of it: lineage ends there.

    A lost executor then costs a re-read, never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged folder through Hadoop's file system, whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs as one struct column `_doc` beside copies of the named columns: no own column can clash with a working one."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    return docs.select(whole, *(F.col(f"`{c}`") for c in columns))


def clear_staged(spark: SparkSession) -> None:
    """Delete every folder this process has staged; results read from them must have been written before."""
    while _written:
        discard(spark, _written.pop())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def visible(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    That serves wherever this folder is at the same place on all machines; elsewhere ship it with --py-files.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    visible(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- vectorised hashing over UTF-8 buffers -------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
        _inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INV)]), dtype=np.uint64)
    return _powers, _inverse


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each white-space word of the texts data[starts[i]:ends[i]], and its text's index.

    data holds the texts' UTF-8 back to back (an Arrow string column's value buffer). A word's hash is
    its polynomial over 2**64, so one running sum serves all words; no Python object is made per word.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    powers, inverse = _power_tables(n + 1)
    solid = ~_IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = starts[(starts < ends)]
    first[inner] = solid[inner]  # a word never spans two texts
    begin = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tails = ends[(starts < ends)] - 1
    last[tails] = solid[tails]
    stop = np.flatnonzero(last) + 1
    running = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=running[1:])
    hashed = mix((running[stop] - running[begin]) * inverse[begin] + (stop - begin).astype(np.uint64))
    full = np.flatnonzero(starts < ends)
    owner = full[np.searchsorted(starts[full], begin, side="right") - 1]
    return hashed, owner


def text_slices(array, limit: int = 1 << 21):
    """(first row, data, starts, ends, valid) of an Arrow string column, in runs of about limit bytes.

    A single text longer than the limit is a run of its own: texts are never cut.
    """
    import pyarrow as pa

    array = array.cast(pa.large_string())
    n, shift = len(array), array.offset
    offsets = np.frombuffer(array.buffers()[1], np.int64, n + shift + 1)[shift:] if n else np.zeros(1, np.int64)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    valid = np.asarray(array.is_valid())
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        base = offsets[at]
        yield at, data[base : offsets[stop]], offsets[at:stop] - base, offsets[at + 1 : stop + 1] - base, valid[at:stop]
        at = stop
