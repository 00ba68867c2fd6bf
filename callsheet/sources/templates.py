"""Prompt templates: one Markdown file per ``<root>/<mode>/<version>.md``, or a folder of that name with one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TEMPLATE_BYTES = 16 * 1024 * 1024


def read_templates(spark: SparkSession, root: str) -> DataFrame:
    """``templates(mode, version, body)``, the names taken from the paths."""
    name = F.url_decode(F.input_file_name())
    path = r"([^/]+)/([^/]+)\.md(?:/[^/]*)?$"
    return spark.read.text(f"{root.rstrip('/')}/*/*.md", wholetext=True).select(
        F.regexp_extract(name, path, 1).alias("mode"),
        F.regexp_extract(name, path, 2).alias("version"),
        F.col("value").alias("body"),
    )


def available_modes(templates: DataFrame) -> DataFrame:
    return templates.select("mode").distinct().orderBy("mode")


def unknown_modes(requested: DataFrame, templates: DataFrame) -> DataFrame:
    """Requested modes that no template has; must be empty before a run."""
    return requested.select("mode").distinct().join(
        templates.select("mode").distinct(), "mode", "left_anti"
    )


def size_checked(templates: DataFrame, body: str = "body", max_bytes: int = MAX_TEMPLATE_BYTES) -> DataFrame:
    """``templates`` marked for broadcast if they are measured to fit ``max_bytes``, else as they are."""
    size = templates.agg(F.sum(F.octet_length(F.concat_ws("", body)))).first()[0] or 0
    return F.broadcast(templates) if size <= max_bytes else templates
