"""A folder of exports as a stream: each run loads what arrived since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from servicenight.sources import exports, ledger

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_exports(spark: SparkSession, folder: str, root: str, state: str,
                   files_per_batch: int = 64) -> StreamingQuery:
    """Load new exports of ``folder`` and stop; ``state`` is the stream's checkpoint folder.

    The log makes a batch that is replayed after a failure harmless: its files are either
    all logged, and skipped, or loaded again under the same ids.
    """
    arriving = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
                .option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", files_per_batch)
                .load(folder))

    def load(batch: DataFrame, _: int) -> None:
        ledger.load_files(exports.describe_files(batch), root)

    return (arriving.writeStream.foreachBatch(load).option("checkpointLocation", state)
            .trigger(availableNow=True).start())
