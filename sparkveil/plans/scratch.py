"""Tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table to the folder named by
``spark.checkpoint.dir`` and reading it again.  A table is written once (a
``checkpoint()`` computes its last stage twice) and survives a lost executor.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="sparkveil-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def write(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` to a new shared table; returns the table and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sparkveil-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def own(spark: SparkSession, path: str) -> None:
    """Have a folder that something else has written removed at exit."""
    _written.append((spark, path))


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in list(_written):
        try:
            if spark.sparkContext._jsc is not None:
                drop(spark, path)
        except Exception:  # the session has ended: its owner cleans the shared folder
            return


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
