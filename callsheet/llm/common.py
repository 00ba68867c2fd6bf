"""Byte views of text columns, folds, row keys and vector sums, shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(column: Column, n: int) -> Column:
    """crc32 of the id as text modulo ``n``; a null id counts as empty text (remainder 0)."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(n).cast("bigint"))


def row_key(id_column: Column, text: Column) -> list[Column]:
    """128 bits that tell rows apart by id and text; rows equal in both share a key."""
    parts = [id_column.cast("string"), text, id_column.isNull(), text.isNull()]
    return [
        F.xxhash64(*parts).alias("key_a"),
        F.xxhash64(F.lit("b"), *reversed(parts)).alias("key_b"),
    ]


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names match without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Texts(NamedTuple):
    """Consecutive rows of a batch: ``data[bounds[i]:bounds[i + 1]]`` is row ``first + i``."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def byte_views(column: pa.Array, limit: int = 1 << 19) -> Iterator[Texts]:
    """UTF-8 bytes of a string column without copies, ``limit`` bytes at a time; null is empty.

    A row longer than ``limit`` comes alone and whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    bounds = bounds[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield Texts(row, raw[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row])
        row = stop


#: Random values per byte and an odd base for rolling hashes modulo 2**64.
_RANDOM = np.random.default_rng(20260101)
BYTE_VALUES = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a finaliser of multiply and shift steps)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64, kept for the worker's next batch."""
    kept = _POWERS.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        kept[0] = 1
        kept = np.cumprod(kept)
        if len(kept) <= 1 << 22:
            _POWERS[int(base)] = kept
    return kept[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``, from one pass of running sums."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, n), out=sums[1:])
    shift = powers(BASE_INVERSE, n + 1)[starts]
    return mixed((sums[ends] - sums[starts]) * shift + (ends - starts).astype(np.uint64))


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true bytes that stay within their row: starts, ends, and each row's first run."""
    n = len(inside)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(bounds), np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def summed_vectors(partials: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """Add up equally long arrays per key; ``part`` numbers the partial sums.

    Two levels, so that no task holds more than the square root of all partial sums of a key.
    """

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(frame[vector].to_numpy()), axis=0)
        return pd.DataFrame({key: frame[key].iloc[:1], "slot": [0], vector: [total]})

    kind = partials.schema[key].dataType.simpleString()
    shape = f"{key} {kind}, slot int, {vector} array<double>"
    slots = F.pmod(F.xxhash64("part"), F.lit(64).cast("bigint")).cast("int")
    first = partials.withColumn("slot", slots).groupBy(key, "slot").applyInPandas(add, shape)
    return first.groupBy(key).applyInPandas(add, shape).select(key, vector)
