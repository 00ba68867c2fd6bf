"""Comparison matrix: modes as rows, providers as columns; nothing is scored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.operators.runs import errored

NO_CELL = "—"
ERROR_CHARS = 120


def seconds(ms: Column) -> Column:
    """``ms / 1000`` with one decimal, rounded half-even on the exact binary value."""
    value = (ms / F.lit(1000.0)).cast("double")
    scale = (
        F.when(value < 1, F.lit(2.0**62))
        .when(value < 1024, F.lit(2.0**52))
        .otherwise(F.lit(2.0**32))
    )
    unit = scale.cast("bigint").cast("decimal(19,0)")
    tenths = (value * scale).cast("bigint").cast("decimal(19,0)") * F.lit(10).cast("decimal(2,0)")
    whole = F.floor(tenths / unit)
    twice = (tenths - whole * unit) * 2
    up = (twice > unit) | ((twice == unit) & (whole % 2 == 1))
    rounded = whole.cast("bigint") + F.when(up, 1).otherwise(0)
    return F.format_string("%d.%ds", F.floor(rounded / 10), rounded % 10)


def meta_line(error: Column, response: Column) -> Column:
    """Model, tokens, reasoning and latency; zero or absent parts are left out."""

    def shown(name: str) -> Column:
        value = response[name]
        return F.when(value != 0, value.cast("string"))

    tokens = F.concat(
        F.coalesce(shown("input_tokens"), F.lit(NO_CELL)),
        F.lit("/"),
        F.coalesce(shown("output_tokens"), F.lit(NO_CELL)),
        F.lit(" tok"),
    )
    either = shown("input_tokens").isNotNull() | shown("output_tokens").isNotNull()
    parts = F.concat_ws(
        " · ",
        response["model"],
        F.when(either, tokens),
        F.concat(shown("reasoning_tokens"), F.lit(" reasoning")),
        F.when(response["latency_ms"] != 0, seconds(response["latency_ms"])),
    )
    failed = F.concat(F.lit("error: "), F.substring(error, 1, ERROR_CHARS))
    return F.when(errored(error), failed).otherwise(parts)


def latest(responses: DataFrame) -> DataFrame:
    """Last response of each (run, provider, mode)."""
    return responses.groupBy("run_id", "provider", "mode").agg(
        F.max_by(F.struct("error", "response"), "seq").alias("cell")
    )


def matrix(runs: DataFrame, responses: DataFrame) -> DataFrame:
    """Every provider x mode cell of every run in reading order; missing cells hold a dash."""
    grid = runs.select("run_id", "providers", F.posexplode("modes").alias("mode_pos", "mode")).select(
        "run_id", "mode_pos", "mode", F.posexplode("providers").alias("provider_pos", "provider")
    )
    cell = F.col("cell")
    missing = cell.isNull()
    text = cell["response"]["text"]
    return grid.join(latest(responses), ["run_id", "provider", "mode"], "left").select(
        "run_id",
        "mode_pos",
        "mode",
        "provider_pos",
        "provider",
        F.when(missing, F.lit("")).otherwise(meta_line(cell["error"], cell["response"])).alias("meta"),
        F.when(missing | (text == ""), F.lit(NO_CELL)).otherwise(text).alias("body"),
        F.when(missing, F.lit(False)).otherwise(errored(cell["error"])).alias("errored"),
        missing.alias("missing"),
    )


def pivoted(cells: DataFrame, providers: Sequence[str], value: str = "body") -> DataFrame:
    """Matrix rows (run, mode) with one column per provider; the names are given, not collected."""
    return (
        cells.groupBy("run_id", "mode_pos", "mode")
        .pivot("provider", list(providers))
        .agg(F.first(value))
    )
