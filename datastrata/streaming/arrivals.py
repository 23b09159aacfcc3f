"""Beyond the reference: a monitor of files that arrive, hashed as they come."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append ``(path, md5, size, seen)`` of new files to a Parquet table; processes what is there and stops.

    Spark's file source passes over empty and hidden files; ``functions.hashing`` does not.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    rows = files.select("path", F.md5("content").alias("md5"), F.col("length").alias("size"), F.col("modificationTime").alias("seen"))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
