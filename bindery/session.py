"""Session helpers: the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A temporary folder of this machine stands in only for a local session.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="bindery-")
    return _local_dirs[app]


def fresh_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{(folder or shared_dir(spark)).rstrip('/')}/bindery-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, folder: str | None = None, *, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    Cuts the lineage, so a lost executor costs a re-read instead of a re-run, and
    keeps column pruning for the jobs that follow, which a checkpoint would not. A
    caller that wants to ``discard`` the table names its ``path``.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, name, folder)
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes what ``store`` wrote; a path that is not there is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """Spreads a freshly read table over all slots when it has fewer partitions.

    A table of one row group is read by one task, which then does all row-local work
    alone. Large tables have more partitions than slots and stay as they are. Meant for
    a plain read: asking a query with shuffles for its partitions would run them.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, *keys) if df.rdd.getNumPartitions() < slots else df
