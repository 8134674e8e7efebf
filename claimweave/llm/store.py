"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: dict[str, SparkSession] = {}
#: Spark removes a statement's shuffle files when it ends; what is written needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on one machine (tests), a temporary folder is set, on a cluster an error is raised."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="claimweave-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def write(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to a new folder and reads it back: lineage ends there and no executor's loss undoes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    if spark.conf.get(_CLEANUP, None) is None:
        spark.conf.set(_CLEANUP, "true")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    _written[path] = spark
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table of write() that no later plan reads."""
    _delete(df.sparkSession, df.written_path)


def _delete(spark: SparkSession, path: str) -> None:
    _written.pop(path, None)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def clean() -> None:
    """Deletes what is left when the driver ends; a result may read it until then."""
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(spark, path)
