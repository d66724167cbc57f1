"""Immutable dependency facts by content: one Parquet folder a blob key, published once."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.graph import positions
from factloom.schema import FactError
from factloom.sources.staging import staged

#: Columns that publishing adds: a row's place in the blob, and that of its owner if the blob has it.
ADDED = ("ordinal", "owner_ordinal")
#: Rows of a file at most, so that a task can digest a file whole.
FILE_ROWS = 500_000


@dataclass(frozen=True)
class Promotion:
    """What publishing did: promoted is False if another had published the key."""

    promoted: bool
    rows: int
    files: int
    octets: int
    write_millis: int
    verify_millis: int


class BlobCache:
    """Blobs under root/<key>: facts.parquet by ordinal (order of qualified name), and blob.json.

    blob.json has identity, rows, the rows' digest, and each file's name, length and SHA-256.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, key: str) -> str:
        """The key's folder: `:` is written `-`, and `-` and `_` with `_` before, so no two keys share one."""
        if not key or not all(c.isalnum() or c in "-_:" for c in key):
            raise ValueError(f"not a blob key: {key!r}")
        return f"{self.root}/" + "".join({":": "-", "-": "_-", "_": "__"}.get(c, c) for c in key)

    def readable(self, key: str) -> bool:
        return self._fs.exists(self._path(f"{self._at(key)}/blob.json"))

    def publish(self, key: str, identity: str, symbols: DataFrame, expected_digest: str | None = None) -> bool:
        """False if the key is there already. Written aside and renamed whole; a wrong digest publishes nothing."""
        return not self.readable(key) and self.promote(key, identity, symbols, expected_digest).promoted

    def promote(self, key: str, identity: str, symbols: DataFrame, expected_digest: str | None = None, expected_rows: int | None = None) -> Promotion:
        """Write aside, read back, compare with what is expected, and rename whole unless the key has come meanwhile.

        Nothing is published and nothing left behind if rows or digest are not as expected.
        """
        aside = f"{self.root}/.stage-{uuid.uuid4().hex}"
        try:
            began = time.monotonic()
            linked(symbols).sort("ordinal").write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{aside}/facts.parquet")
            wrote = time.monotonic()
            facts = self.spark.read.parquet(f"{aside}/facts.parquet")
            digest, rows = content_digest(facts.drop(*ADDED)), facts.count()
            if expected_digest is not None and digest != expected_digest:
                raise FactError(f"blob {key}: digest {digest}, expected {expected_digest}")
            if expected_rows is not None and rows != expected_rows:
                raise FactError(f"blob {key}: {rows} rows, expected {expected_rows}")
            files = self._files(f"{aside}/facts.parquet")
            stream = self._fs.create(self._path(f"{aside}/blob.json"), True)
            try:
                stream.write(bytearray(json.dumps({"identity": identity, "rows": rows, "digest": digest, "files": files}).encode()))
            finally:
                stream.close()
            checked = time.monotonic()
            promoted = self._rename(aside, self._at(key))
        finally:
            if self._fs.exists(self._path(aside)):
                self._fs.delete(self._path(aside), True)
        return Promotion(promoted, rows, len(files), sum(f["length"] for f in files), int(1000 * (wrote - began)), int(1000 * (checked - wrote)))

    def _rename(self, source: str, target: str) -> bool:
        """Rename a folder unless the target exists: FileContext refuses then, where FileSystem may move it inside."""
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(source).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(source), self._path(target), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError:
            if self._fs.exists(self._path(f"{target}/blob.json")):
                return False
            raise
        return True

    def _files(self, folder: str) -> list[dict]:
        """Name, length and SHA-256 of each file, digested by the tasks; a blob has one per FILE_ROWS rows or task."""
        read = self.spark.read.format("binaryFile").load(folder)
        rows = read.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
        return [r.asDict() for r in rows.orderBy("name").collect()]

    def header(self, key: str) -> dict:
        stream = self._fs.open(self._path(f"{self._at(key)}/blob.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def open(self, key: str) -> dict | None:
        """The header, or None if there is no blob. Looks at names and lengths of files, at no byte of them."""
        if not self.readable(key):
            return None
        header = self.header(key)
        there = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(f"{self._at(key)}/facts.parquet"))}
        if any(there.get(f["name"]) != f["length"] for f in header["files"]):
            raise FactError(f"blob {key}: files are missing or of another length")
        return header

    def _rows(self, key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._at(key)}/facts.parquet")

    def load(self, key: str) -> DataFrame:
        return self._rows(key).drop(*ADDED)

    def verified(self, key: str) -> bool:
        """Whether files and facts are what the header says; a header or facts that cannot be read are not."""
        try:
            header = self.open(key)
            return header is not None and self._files(f"{self._at(key)}/facts.parquet") == header["files"] and content_digest(self.load(key)) == header["digest"]
        except (Py4JJavaError, PySparkException, FactError, ValueError, KeyError, TypeError):
            return False

    def remove_invalid(self, key: str) -> bool:
        """Delete a blob whose facts are not what its header says; whether it did."""
        if not self._fs.exists(self._path(self._at(key))) or self.verified(key):
            return False
        return bool(self._fs.delete(self._path(self._at(key)), True))

    def by_name(self, key: str, qualified_name: str) -> DataFrame:
        """Details of a qualified name: sorted files let whole row groups be skipped."""
        return self.load(key).where(F.col("qualified_name") == qualified_name)

    def ordinals(self, key: str, qualified_name: str) -> tuple[int, int] | None:
        """First and last place of a qualified name, whose rows lie side by side; None if it has none."""
        found = self._rows(key).where(F.col("qualified_name") == qualified_name).agg(F.min("ordinal").alias("a"), F.max("ordinal").alias("z")).first()
        return None if found.a is None else (found.a, found.z)

    def between(self, key: str, first: int, last: int) -> DataFrame:
        """Rows with first <= ordinal <= last, with ordinals; files and row groups outside the range are skipped."""
        return self._rows(key).where(F.col("ordinal").between(first, last))


def linked(symbols: DataFrame) -> DataFrame:
    """symbols with ordinal, their place by qualified name and id from 0, and owner_ordinal, null if the owner is not among them.

    Of several rows with the owner's id the first is meant. No task numbers or holds all rows.
    """
    order = ["qualified_name", "symbol_id"]
    ordered = staged(symbols.sort(*order).withColumn("part", F.spark_partition_id()), "blob")
    placed = staged(positions(ordered, order, -1).withColumnRenamed("position", "ordinal").select(*symbols.columns, F.col("ordinal").cast("long")), "blob")
    first = placed.where(F.col("symbol_id").isNotNull()).groupBy(F.col("symbol_id").alias("owner")).agg(F.min("ordinal").alias("owner_ordinal"))
    return placed.join(first, "owner", "left").select(*symbols.columns, *ADDED)


def content_digest(facts: DataFrame) -> str:
    """Digest of rows whatever their order, repeats counted.

    Each row's SHA-256 is eight numbers of 32 bits; partitions add them up alone, and the sums and the number of
    rows are hashed.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(facts.columns))), 256)
    lanes = [F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{i}") for i in range(8)]
    return facts.agg(F.count("*").cast("string").alias("n"), *lanes).select(F.sha2(F.concat_ws("|", "n", *(F.coalesce(f"s{i}", F.lit("0")) for i in range(8))), 256).alias("d")).first().d
