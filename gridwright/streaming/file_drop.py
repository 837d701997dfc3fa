"""Files that are dropped into a folder, extracted as they come (Structured Streaming).

An extension: the batch pipeline, applied to each new file once.  The stream only
carries file names; ``foreachBatch`` runs the batch plan and appends to a Parquet table, under the
batch's number, so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridwright.config import Settings
from gridwright.functions.fields import FieldRegistry
from gridwright.plans import pipeline, sinks


def watch(spark: SparkSession, folder: str, target: str, checkpoint: str, settings: Settings | None = None, registry: FieldRegistry | None = None) -> StreamingQuery:
    """Start (and return) a query that extracts every new file in ``folder`` and stops when none is left."""
    registry = registry or FieldRegistry()
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    names = spark.readStream.format("binaryFile").schema(schema).load(folder).select("path")

    def batch(df: DataFrame, number: int) -> None:
        for row in df.toLocalIterator():  # names of new files
            x = pipeline.extract(df.sparkSession, row.path, settings, registry=registry)
            name = row.path.rsplit("/", 1)[-1]
            rows = sinks.table_rows(x.records, row.path, registry).withColumns({"batch": F.lit(number), "file": F.lit(name)})
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "file").parquet(target)

    return names.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
