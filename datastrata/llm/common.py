"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The word rule of the contracts: maximal runs of anything but ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch handed to Python. Texts may be long, so batches are
#: kept far below Spark's default of 10,000 rows.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of one Arrow batch; a lower setting is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) is a folder of
    our own chosen, and set, so later calls agree.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not found:
        found = tempfile.mkdtemp(prefix="datastrata-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set(key, found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/datastrata/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already; the folder is scratch
            pass

    atexit.register(remove)
    return path


#: Spark removes a query's shuffle files as the query ends; used where its rows are written, so none is read again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, **measures: Column) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back. ``free`` takes it away again.

    ``measures`` are aggregates of its rows, in the result's ``measured``: seen as they are written, they cost no job."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    seen = Observation(name)
    if measures:
        df = df.observe(seen, *[c.alias(k) for k, c in measures.items()])
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch = path
    found.measured = seen.get if measures else {}
    return found


def free(*frames: DataFrame) -> None:
    """Delete the files of frames that ``written`` made and nothing lazy reads any more."""
    for df in frames:
        _delete(df.sparkSession, df.scratch)


def words(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
