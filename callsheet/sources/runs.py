"""Run sink and source: ``runs`` is the manifest, ``responses`` holds one row per cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsheet.schemas import RESPONSES, RUNS

#: Folders that runs are spread over by a hash of their id; fixed for stores that exist.
BUCKETS = 64


def bucket_of(run_id: Column) -> Column:
    """The folder that holds a run's rows."""
    return F.pmod(F.xxhash64(run_id), F.lit(BUCKETS).cast("bigint")).cast("int")


def _write(table: DataFrame, schema: T.StructType, path: str, mode: str) -> None:
    rows = table.select(*schema.fieldNames(), bucket_of(F.col("run_id")).alias("bucket"))
    # several tasks may share a bucket, so that no bucket has to fit one of them
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS * 4).cast("bigint"))).sortWithinPartitions("bucket", "run_id")
    dealt.write.mode(mode).partitionBy("bucket").parquet(path)


def store_runs(runs: DataFrame, responses: DataFrame, path: str, mode: str = "append") -> None:
    """Write both tables, a folder for each bucket of run ids, sorted by ``run_id``.

    Reading one run back lists and reads its bucket only, and within it prunes on the row-group
    statistics. The manifest is written last: it is the truth.
    """
    _write(responses, RESPONSES, f"{path}/responses", mode)
    _write(runs, RUNS, f"{path}/runs", mode)


def compact_runs(spark: SparkSession, path: str, target: str) -> None:
    """Write a copy of a store with the small files of many appends merged."""
    store_runs(*load_runs(spark, path), target, mode="errorifexists")


def _read(spark: SparkSession, schema: T.StructType, path: str, run_id: str | None) -> DataFrame:
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)
    if run_id is not None:
        bucket = spark.range(1).select(bucket_of(F.lit(run_id))).first()[0]
        rows = rows.filter((F.col("bucket") == bucket) & (F.col("run_id") == run_id))
    return rows.select(*schema.fieldNames())


def load_runs(
    spark: SparkSession, path: str, run_id: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(runs, responses)`` of a stored run; an unknown run raises."""
    runs = _read(spark, RUNS, f"{path}/runs", run_id)
    responses = _read(spark, RESPONSES, f"{path}/responses", run_id)
    if runs.isEmpty():
        raise ValueError(f"{path} holds no such run")
    return runs, responses


def export_cells(responses: DataFrame, path: str) -> None:
    """One JSON file set per (run, provider, mode), for inspecting a few runs by hand."""
    cells = responses.withColumns({"p": F.col("provider"), "m": F.col("mode")})
    cells.write.partitionBy("run_id", "p", "m").json(path)
