"""Incremental archiving of a stream: each micro-batch stores the blocks that no earlier one holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import chunked, keyed
from ..operators.index import first_occurrences, new_blocks


def ingest(files: DataFrame, index_path: str, checkpoint: str, salt: bytes, size: int):
    """Starts the ingestion of a stream of files (archive, id, content) into a table of blocks at index_path.

    A batch writes into a folder of its own number, so that a batch that is run again replaces what it wrote before.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        blocks = first_occurrences(keyed(chunked(batch, size), salt), "archive", "id", "block_no")
        schema = "storage_key string, block_size long, block binary, batch int"
        try:
            old = spark.read.schema(schema).parquet(index_path).where(F.col("batch") != number)
            blocks = new_blocks(blocks, old)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        blocks.select("storage_key", "block_size", "block").write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
