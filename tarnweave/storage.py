"""Where intermediate tables live: the folder that every executor shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder."""
    path = spark.conf.get(_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tarnweave-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone at exit
            return


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the application ends."""
    if not _made:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/tarnweave/{uuid.uuid4().hex}-{label}"
    _made.append((spark, path))
    return path


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and that nothing reads any more."""
    for spark, path in _made[:]:
        if path == getattr(df, "_scratch", None):
            _delete(spark, path)
            _made.remove((spark, path))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written or collected within sends whole texts to Python ``rows`` at a time at most; then the session's setting holds again.

    An executor and each of its workers hold a batch's texts several times over.
    """
    before = spark.conf.get(_ROWS, None)
    if before is None or not 0 < int(before) <= rows:
        spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ROWS)
        else:
            spark.conf.set(_ROWS, before)


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out
