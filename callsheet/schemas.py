"""Explicit schemas for everything that is stored or exchanged."""

from __future__ import annotations

from pyspark.sql import types as T

HIT = "struct<step:int,sub:int,pos:int,key:string,value:string>"

RAW_RESPONSE = T.StructType(
    [
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("input_tokens", T.IntegerType()),
        T.StructField("output_tokens", T.IntegerType()),
        T.StructField("reasoning_tokens", T.IntegerType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("stop_reason", T.StringType()),
    ]
)
RESPONSES = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("capture_id", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("total", T.IntegerType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("prompt_chars", T.LongType()),
        T.StructField("dry_run", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("response", RAW_RESPONSE),
    ]
)
RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("capture_id", T.StringType()),
        T.StructField("fixture", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("dry_run", T.BooleanType()),
        T.StructField("providers", T.ArrayType(T.StringType())),
        T.StructField("modes", T.ArrayType(T.StringType())),
    ]
)
