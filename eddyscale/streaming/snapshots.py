"""Snapshot files as a stream: each micro-batch goes through the batch function.

No state: a snapshot is complete in one file, and a result belongs to its field_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import modes as M


def diagnose(spark: SparkSession, folder: str, run: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 8, available_now: bool = True) -> StreamingQuery:
    """Read modes as Parquet from ``folder``; append ``run`` of each batch to ``out``.

    A batch is written under its number, so a batch that is run again replaces itself.
    """
    stream = spark.readStream.schema(M.MODES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        run(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        M.release()  # what the batch's plans have kept

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
