"""Cutting lineage with a written table in the folder the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that drops a job's shuffle files when the job ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the bytes that a Python worker gets at once, and what is enough for long texts.
ARROW, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="callsheet-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def write_once(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet. The job's shuffle files go when it ends, as nothing reads them again."""
    spark = df.sparkSession
    held = {name: spark.conf.get(name) for name in (CLEANUP, ARROW)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(ARROW, ARROW_BYTES)
    try:
        # a frame of its own: the setting counts for frames made while it holds
        df.select("*").write.parquet(path)
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back, so that what follows does not recompute it."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/callsheet-{uuid.uuid4().hex}"
    write_once(df, path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.lineage_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` wrote, when all that was made of them has been written too."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.lineage_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
