"""Change logs that keep arriving, taken into a versioned table by Structured Streaming: a micro-batch is a version.

The query's checkpoint says which files were read, the table's manifest which batch it has; a batch that is delivered
again after a failure is known by its number and taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators.versioned import VersionedTable


def ingest(spark: SparkSession, source: str, schema, table: VersionedTable, checkpoint: str, arrived: str = "landed_at", files: int = 100) -> StreamingQuery:
    """Start (or go on with) taking the Parquet files of a folder into the table, and stop when all are in."""

    def take(rows: DataFrame, batch: int) -> None:
        latest = table.latest()
        if latest and table.manifest(latest).meta.get("batch", -1) >= batch:
            return
        table.append_log(rows, F.col(arrived), {"batch": batch})

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
