"""Reads as a stream: each read is mapped once, by the stored barcode index, and new mapped reads are counted into profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from cutscape.operators import mapping


def running_counts(reads: DataFrame) -> DataFrame:
    """Profile counts of a stream (sample, oligo_id, indel, oligo_indel); complete or update mode."""
    return reads.groupBy("sample", "oligo_id", "indel", "oligo_indel").agg(F.count("*").alias("reads"))


def append_batches(reads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's counts under the batch's number, so a batch that is tried again replaces its own rows only."""

    def write(batch: DataFrame, number: int) -> None:
        running_counts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def map_stream(reads: DataFrame, targets: DataFrame, index: DataFrame, path: str, checkpoint: str, time: str = "time", delay: str = "1 hour") -> StreamingQuery:
    """Maps a stream of reads (read_id, seq, time) to targets by a stored barcode index (targets.store_barcode_index) and writes
    them (read_id, seq, hits, score), a folder for each batch.

    A read id that comes again within `delay` of its time is dropped: the ids seen are state, kept until the watermark has
    passed them. State and the batches' numbers are in the checkpoint, so after a restart a batch that was not finished is
    written anew in place, and no read twice. Reads without a hit have null hits, those without an id are mapped once together.
    """
    once = reads.withWatermark(time, delay).dropDuplicatesWithinWatermark(["read_id"])

    def write(batch: DataFrame, number: int) -> None:
        mapping.map_reads(batch.select("read_id", "seq"), targets, index=index).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
