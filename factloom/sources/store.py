"""A store of fact tables: layers of immutable Parquet folders and one pointer to the current generation.

A table is a list of layers. A layer has rows, and keys whose rows in older layers no longer count: so a change
writes what changed, however large the table. Reading takes the layers' union, each without the keys dropped after
it; filters still reach every scan. A table of more than MOST_LAYERS layers is written anew as one.

A generation names every table's layers. Changes write new folders and then move the pointer in one rename.
Readers take the pointer once, so they see one generation whole, and a failed write leaves the old one. One writer
at a time (the driver); all files go through Hadoop's file system, so any shared store serves.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.schema import DDL, FORMAT_VERSION, KEYS, LOOKUP, FactError, assert_unique, conform, struct

#: Layers that a table may have before it is written anew.
MOST_LAYERS = 8
#: Columns by which a layer drops rows of older ones, where they are not the table's key.
OWNER = {
    **dict.fromkeys(("symbols", "occurrences", "reference_edges", "call_edges", "hierarchy_edges", "applications", "types", "diagnostics", "symbol_locators"), ["source_unit_id"]),
    "application_arguments": ["application_id"],
    "text_terms": ["workspace_path"],
}
#: Tables whose rows belong to a source unit and leave with it.
OWNED = ("symbols", "occurrences", "reference_edges", "call_edges", "hierarchy_edges", "applications", "types", "diagnostics")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self.generation = self._read()

    # --- generations -------------------------------------------------------------------------

    def _read(self) -> dict:
        pointer = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(pointer):
            return {"format": FORMAT_VERSION, "number": 0, "tables": {}}
        stream = self._fs.open(pointer)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        if found["format"] != FORMAT_VERSION:
            raise FactError(f"store format {found['format']}, this engine reads {FORMAT_VERSION}")
        return found

    def refresh(self) -> Store:
        self.generation = self._read()
        return self

    def table(self, name: str) -> DataFrame:
        out, dropped = None, None
        for layer in reversed(self.generation["tables"].get(name, [])):
            if layer["rows"]:
                rows = self.spark.read.schema(struct(name)).parquet(layer["rows"])
                rows = rows if dropped is None else rows.join(dropped, OWNER.get(name, KEYS[name]), "left_anti").select(*struct(name).names)
                out = rows if out is None else out.unionByName(rows)
            if layer["drop"]:
                keys = T.StructType([struct(name)[k] for k in OWNER.get(name, KEYS[name])])
                drop = self.spark.read.schema(keys).parquet(layer["drop"])
                dropped = drop if dropped is None else dropped.unionByName(drop)
        return self.spark.createDataFrame([], struct(name)) if out is None else out

    def commit(self, tables: dict[str, DataFrame] | None = None, changes: dict[str, tuple[DataFrame | None, DataFrame | None]] | None = None) -> int:
        """Make a new generation current and give its number: tables whole, changes as (new rows, dropped keys)."""
        number = self.generation["number"] + 1
        folder = f"{self.root}/g{number:08d}-{uuid.uuid4().hex[:8]}"
        named = dict(self.generation["tables"])
        for name, rows in (tables or {}).items():
            named[name] = [{"rows": self._write(name, rows, f"{folder}/{name}"), "drop": None}]
        for name, (rows, drop) in (changes or {}).items():
            layer = {"rows": None if rows is None else self._write(name, rows, f"{folder}/{name}"), "drop": None}
            if drop is not None and named.get(name):
                layer["drop"] = f"{folder}/{name}-drop"
                drop.select(*OWNER.get(name, KEYS[name])).distinct().write.parquet(layer["drop"])
            if layer["rows"] or layer["drop"]:
                named[name] = [*named.get(name, []), layer]
        before, self.generation = self.generation, self.generation | {"tables": named}
        try:
            for name, layers in named.items():
                if len(layers) > MOST_LAYERS:
                    named[name] = [{"rows": self._write(name, self.table(name), f"{folder}/{name}-whole"), "drop": None}]
        finally:
            self.generation = before
        new = {"format": FORMAT_VERSION, "number": number, "tables": named}
        temporary = self._path(f"{self.root}/.next-{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, True)
        try:
            stream.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        finally:
            stream.close()
        pointer = self._path(f"{self.root}/CURRENT")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temporary, pointer, overwrite)
        self.generation = new
        return number

    @staticmethod
    def _write(name: str, rows: DataFrame, path: str) -> str:
        out = conform(rows, name)
        out = out.sort(*LOOKUP[name]) if name in LOOKUP else out
        out.write.option("compression", "zstd").parquet(path)
        return path

    # --- snapshots -----------------------------------------------------------------------------

    def _leaving(self, ids: DataFrame) -> DataFrame:
        """Applications of units, whose arguments leave with them."""
        return self.table("applications").join(ids, "source_unit_id", "left_semi").select("application_id")

    def replace_snapshots(self, expected: DataFrame, units: DataFrame, facts: dict[str, DataFrame], gone: DataFrame | None = None) -> int:
        """Replace all facts of units by facts, all or nothing; expected says which contents may come. Units of gone
        (source_unit_id) leave with the same commit.

        Written is what comes and the units' ids, not the tables.
        """
        from factloom.operators.validate import require_valid

        require_valid(expected, units, facts)
        ids = units.select("source_unit_id")
        ids = ids.unionByName(gone.select("source_unit_id")).distinct() if gone is not None else ids
        if "symbols" in facts:  # an id is one unit's in the whole store
            held = self.table("symbols").join(ids, "source_unit_id", "left_anti").select("symbol_id")
            if clash := held.join(facts["symbols"].select("symbol_id"), "symbol_id", "left_semi").limit(1).collect():
                raise FactError(f"symbols: {clash[0].symbol_id} belongs to another unit")
        changes = {"source_units": (units, ids)} | {name: (facts.get(name), ids) for name in OWNED}
        changes["application_arguments"] = (facts.get("application_arguments"), self._leaving(ids))
        return self.commit(changes=changes)

    def remove_units(self, ids: DataFrame) -> int:
        changes = {name: (None, ids) for name in ("source_units", *OWNED)}
        return self.commit(changes=changes | {"application_arguments": (None, self._leaving(ids))})

    # --- upserts and replacements ------------------------------------------------------------------

    def upsert(self, name: str, rows: DataFrame) -> int:
        assert_unique(conform(rows, name), KEYS[name], name)
        return self.commit(changes={name: (rows, rows)})

    def replace(self, name: str, rows: DataFrame) -> int:
        assert_unique(conform(rows, name), KEYS[name], name)
        return self.commit({name: rows})

    def put_artifacts(self, artifacts: DataFrame, locators: DataFrame) -> int:
        """Upsert descriptors; a descriptor's locators are replaced by the given ones."""
        assert_unique(conform(artifacts, "artifacts"), KEYS["artifacts"], "artifacts")
        return self.commit(changes={"artifacts": (artifacts, artifacts), "symbol_locators": (locators, artifacts)})

    def replace_catalog(self, artifacts: DataFrame, locators: DataFrame) -> int:
        """The whole catalog; blob references of units that left it go too."""
        assert_unique(artifacts, KEYS["artifacts"], "artifacts")
        refs = self.table("blob_refs").join(artifacts.select("source_unit_id"), "source_unit_id", "left_semi")
        return self.commit({"artifacts": artifacts, "symbol_locators": locators, "blob_refs": refs})

    def record_blob(self, unit: str, blob_key: str, identity: str, byte_length: int) -> int:
        """A blob and its unit's reference; a key that is known under another identity is an error."""
        known = self.table("blob_catalog").where(F.col("blob_key") == blob_key).limit(1).collect()
        if known and known[0].identity != identity:
            raise FactError(f"blob {blob_key} has another identity")
        one = self.spark.range(1)
        now = F.current_timestamp()
        made = F.lit(known[0].created_at).cast("timestamp") if known else now
        row = one.select(F.lit(blob_key).alias("blob_key"), F.lit(identity).alias("identity"), F.lit(byte_length).cast("long").alias("byte_length"), made.alias("created_at"), now.alias("accessed_at"))
        ref = one.select(F.lit(unit).alias("source_unit_id"), F.lit(blob_key).alias("blob_key"))
        return self.commit(changes={"blob_catalog": (row, row), "blob_refs": (ref, ref)})

    def reconcile_refs(self, readable: DataFrame) -> int:
        """Drop references whose blob has no readable file; gives how many."""
        refs = self.table("blob_refs")
        lost = refs.join(readable.select("blob_key").distinct(), "blob_key", "left_anti").select("source_unit_id")
        gone = lost.count()
        if gone:
            self.commit(changes={"blob_refs": (None, lost)})
        return gone

    def sync_texts(self, current: DataFrame) -> int:
        """Bring texts and terms to current: written are new and changed texts, their terms, and the paths that left."""
        from factloom.operators.lexical import changed_texts
        from factloom.functions.text import terms

        fresh, gone = changed_texts(self.table("text_documents"), current)
        return self.commit(changes={"text_documents": (fresh, gone), "text_terms": (terms(fresh, "workspace_path"), gone)})

    # --- scans -----------------------------------------------------------------------------------

    def source_units(self) -> DataFrame:
        return self.table("source_units").orderBy("source_unit_id")

    def snapshot_inputs(self) -> DataFrame:
        return self.table("source_units").select("source_unit_id", "content_fp").orderBy("source_unit_id")

    def analysis_inputs(self) -> DataFrame:
        return self.table("source_units").select("source_unit_id", "content_fp", "context_fp", "public_api_fp", "provenance.*").orderBy("source_unit_id")

    def configuration_inputs(self) -> DataFrame:
        return self.table("configuration_inputs").orderBy("workspace_path")

    def latest_manifest(self) -> DataFrame:
        return self.table("manifests").orderBy("workspace_id").limit(1)

    def manifest(self, workspace: str) -> DataFrame:
        return self.table("manifests").where(F.col("workspace_id") == workspace)

    def checkpoint(self) -> DataFrame:
        return self.table("checkpoints").orderBy("workspace_id").limit(1)

    def verify(self) -> dict[str, int]:
        """Rows of each table of the current generation."""
        return {name: self.table(name).count() for name in self.generation["tables"] if name in DDL}
