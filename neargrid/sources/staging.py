"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders that this driver has named; `clear` deletes them.
_NAMED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent (tests, a laptop) is it set, to a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='neargrid-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    _NAMED.append(f"{base.rstrip('/')}/neargrid-{uuid.uuid4().hex}")
    return _NAMED[-1]


def mark() -> int:
    """How many folders have been named so far, for `clear`."""
    return len(_NAMED)


def clear(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the staged tables that this driver has named after a mark, once the results that read them have been written;
    the last `keep` stay."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = _NAMED[since : len(_NAMED) - keep]
    del _NAMED[since : len(_NAMED) - keep]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def stage(df: DataFrame, partition_by: list[str] | None = None, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends, and lost executors cost nothing."""
    path = shared_dir(df.sparkSession)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    # the schema is given, so that no file has to be opened for it and empty tables read well
    fields = [f for f in df.schema if f.name not in (partition_by or [])]
    fields += [f for f in df.schema if f.name in (partition_by or [])]
    return df.sparkSession.read.schema(type(df.schema)(fields)).parquet(path)
