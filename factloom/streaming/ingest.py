"""Snapshots as a stream: JSON files in a folder, each micro-batch one generation of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W
from pyspark.sql import functions as F

from factloom.sources import snapshots
from factloom.sources.staging import staged
from factloom.sources.store import Store


def apply_batch(store: Store, batch: DataFrame) -> int:
    """Store a batch of snapshots in one commit; of several of one unit the last to arrive counts. Removals are snapshots
    without provenance or facts. Gives the generation.

    Order of arrival is that of `arrived` (time, path and place of a line's file) if it is a column, then that of the rows.
    """
    came = batch.withColumn("arrived", F.struct(*([F.col("arrived")] if "arrived" in batch.columns else []), F.monotonically_increasing_id().alias("row")))
    # Each task hands on its last snapshot of a unit only.
    last = came.withColumn("_r", F.row_number().over(W.partitionBy("source_unit.id").orderBy(F.desc("arrived")))).where("_r = 1").drop("_r", "arrived")
    last = staged(last, "batch")
    gone = last.where(F.col("provenances").isNull()).select(F.col("source_unit.id").alias("source_unit_id"))
    rows = last.where(F.col("provenances").isNotNull())
    if last.isEmpty():
        return store.generation["number"]
    if rows.isEmpty():
        return store.remove_units(gone)
    units, facts = snapshots.decode(rows)
    return store.replace_snapshots(units, units, facts, gone)


def stream(spark: SparkSession, folder: str, store_root: str, checkpoint: str) -> StreamingQuery:
    """Start ingestion of what is in folder; it ends when all of it is stored. Batches that come again after a
    failure replace the same units by the same facts."""
    read = spark.readStream.schema(snapshots.SCHEMA).json(folder)
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start")
    source = read.select("*", place.alias("arrived"))

    def each(batch: DataFrame, _: int) -> None:
        apply_batch(Store(batch.sparkSession, store_root), batch)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
