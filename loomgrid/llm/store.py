"""Tables that cut a lineage, written under the shared folder of the session."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local default only in local mode, where all is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/loomgrid-checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    The files outlive every executor, so what follows never recomputes ``df``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomgrid/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._loomgrid_path = path
    return out


def files_for(rows: int, each: int = 1 << 16) -> int:
    """Files of a table of ``rows`` rows: one for ``each`` rows, at least 16; for ``coalesce``, which never adds any."""
    return max(16, rows // each)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` once nothing lazy reads them, and free shuffle files."""
    for table in tables:
        path = getattr(table, "_loomgrid_path", None)
        if path:
            delete(table.sparkSession, path)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()
