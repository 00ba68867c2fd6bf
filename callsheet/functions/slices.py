"""Skew-proof join of entry rows with per-capture rows.

A capture may hold a third of all entries, so entries are never hashed on ``capture_id`` alone.
They are hashed on ``(capture_id, slice)`` with a slice of consecutive entries, and each
per-capture row is repeated once per slice its capture really has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.functions.lineage import cut_lineage

ENTRIES_PER_SLICE = 1024
#: Keys that count as hot in a join: at most so many can hold their share of the rows.
HOT_KEYS = 4096
#: Rows of a key below which it is never hot.
HOT_ROWS = 10_000


def slice_of(index: Column | str = "entry_index") -> Column:
    index = F.col(index) if isinstance(index, str) else index
    return F.floor(index / F.lit(ENTRIES_PER_SLICE)).cast("bigint")


def capture_spans(entries: DataFrame) -> DataFrame:
    """Highest entry index per capture; combines before its shuffle."""
    return entries.groupBy("capture_id").agg(F.max("entry_index").alias("last_index"))


def per_slice(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Repeat per-capture ``rows`` for every slice of their capture."""
    slices = F.explode(F.sequence(F.lit(0).cast("bigint"), slice_of("last_index")))
    return rows.join(spans, "capture_id").withColumn("slice", slices).drop("last_index")


def join_by_slice(
    entries: DataFrame, rows: DataFrame, spans: DataFrame, how: str = "left"
) -> DataFrame:
    """Join entry rows with one-per-capture ``rows`` on ``(capture_id, slice)``."""
    return (
        entries.withColumn("slice", slice_of())
        .join(per_slice(rows, spans), ["capture_id", "slice"], how)
        .drop("slice")
    )


def hot_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys of more than ``1 / HOT_KEYS`` of all ``rows`` (and ``HOT_ROWS``), so ``HOT_KEYS`` at most.

    Counts combine before their shuffle, so a hot key costs no task more than others do. None if no
    key is hot.
    """
    counts = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(HOT_ROWS, total // HOT_KEYS)).select(*keys)
    return None if hot.isEmpty() else hot


def join_apart(rows: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of ``rows``, where a few keys may hold most of them, with unique keys of ``lookup``.

    Rows of hot keys stay where they are and meet a broadcast of the few rows that ``lookup`` has for
    them; only the others are shuffled. ``rows`` should be cheap to read twice.
    """
    hot = hot_keys(rows, keys)
    if hot is None:
        return rows.join(lookup, list(keys))
    few = F.broadcast(hot)  # HOT_KEYS keys at most
    cold = rows.join(few, list(keys), "left_anti").join(lookup, list(keys))
    return cold.unionByName(rows.join(F.broadcast(lookup.join(few, list(keys), "left_semi")), list(keys)))


SALTS = 16


def salted(rows: DataFrame, key: Column) -> DataFrame:
    """Add ``salt``, telling apart rows of one hot capture by ``key``."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))


def every_salt(rows: DataFrame) -> DataFrame:
    """Repeat short per-capture rows for every salt, to meet ``salted`` rows."""
    return rows.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))


#: Rows of a table that a task turns into traffic: a few seconds of text work.
ROWS_PER_TASK = 20_000


def spread(rows: DataFrame) -> DataFrame:
    """Use every core, and tasks of at most about ``ROWS_PER_TASK`` rows.

    A few small files are a few tasks however many rows they hold, and the text work per row is
    heavy. Inputs with enough partitions are left alone.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-rows.count() // ROWS_PER_TASK))
    return rows.repartition(wanted) if rows.rdd.getNumPartitions() < wanted else rows
