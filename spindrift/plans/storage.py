"""Places that the driver and all executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A temporary folder is set only where none is configured and all runs on one machine, as in tests.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if named:
        if held.isEmpty():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if held.isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spindrift-"))
        held = sc._jsc.sc().getCheckpointDir()
    return str(held.get()).rstrip("/")


_announced: set[str] = set()


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the application's part of the shared folder, which goes when the application ends."""
    base = f"{shared_dir(spark)}/spindrift-{spark.sparkContext.applicationId}"
    if base not in _announced:
        fs, p = _fs(spark, base)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _announced.add(base)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here and survives lost executors.

    The shuffles of the write are deleted with its end, instead of when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    held = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if held is None else spark.conf.set(CLEANUP, held)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a stored table that no later plan reads."""
    path = getattr(df, "_stored_at", None)
    if path:
        fs, p = _fs(df.sparkSession, path)
        fs.delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
