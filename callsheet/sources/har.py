"""HAR files as tables: one row per capture, then one row per entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsheet.functions.entry import objects
from callsheet.functions.jsontext import LONG, is_json, normal_form

LOOKS_LIKE_OBJECT = r'[\[,]\s*"\{'


def read_har(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per file: ``capture_id`` is the path, ``source_har`` the file name."""
    name = F.input_file_name()
    return spark.read.text(list(paths), wholetext=True).select(
        name.alias("capture_id"),
        F.url_decode(F.element_at(F.split(name, "/"), -1)).alias("source_har"),
        F.col("value").alias("har_text"),
    )


def is_har(text: Column) -> Column:
    """A capture is one complete JSON object."""
    return is_json(text) & F.startswith(F.ltrim(text, F.lit(" \t\r\n")), F.lit("{"))


def split_valid(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects)``: a malformed capture becomes a reject row, never a failed job."""
    checked = captures.withColumn("_ok", F.coalesce(is_har(F.col("har_text")), F.lit(False)))
    rejects = checked.filter(~F.col("_ok")).select(
        "capture_id", "source_har", F.lit("expected a top-level JSON object").alias("reason")
    )
    return checked.filter("_ok").drop("_ok"), rejects


def explode_entries(captures: DataFrame) -> DataFrame:
    """``log.entries`` as rows in normal form; a mistyped ``log`` or ``entries`` gives no rows.

    Items that are no objects are dropped but still use up an index.
    """
    items, typed = (
        F.from_json("har_text", f"log struct<entries:array<{kind}>>", LONG)["log"]["entries"]
        for kind in ("string", "variant")
    )
    # only a string item that starts like an object needs the types
    entries = F.when(F.rlike("har_text", F.lit(LOOKS_LIKE_OBJECT)), objects(items, typed)).otherwise(items)
    return captures.select("capture_id", F.posexplode(entries).alias("pos", "entry_json")).select(
        "capture_id", F.col("pos").cast("bigint").alias("entry_index"), "entry_json"
    ).filter(F.startswith("entry_json", F.lit("{")))


def _normalised(rows: DataFrame) -> DataFrame:
    """``rows`` with the normal form of ``entry_json``, null where it is no JSON object."""
    is_object = F.startswith(F.ltrim("entry_json", F.lit(" \t\r\n")), F.lit("{"))
    return rows.select(
        "capture_id",
        F.col("entry_index").cast("bigint").alias("entry_index"),
        F.when(is_object, normal_form(F.col("entry_json"))).alias("entry_json"),
    )


def normalise_entries(rows: DataFrame) -> DataFrame:
    """Entry rows from any table (``capture_id, entry_index, entry_json``) in normal form.

    The way in for captures too big for one file: they arrive as rows and never as one string.
    """
    return _normalised(rows).filter(F.col("entry_json").isNotNull())


def normalise_rejects(rows: DataFrame) -> DataFrame:
    """``capture_id, entry_index, reason`` of the rows that ``normalise_entries`` leaves out."""
    left_out = _normalised(rows).filter(F.col("entry_json").isNull())
    return left_out.select("capture_id", "entry_index", F.lit("expected a JSON object").alias("reason"))
