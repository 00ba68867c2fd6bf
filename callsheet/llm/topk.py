"""Exact top-k by inner product over a bit-sliced index."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callsheet.functions.lineage import cut_lineage

SCALE = 1024
#: Candidates in one index and queries that meet it in one task. Every vector is sent once for each
#: block of queries, every query once for each block of vectors: blocks of one size send the least.
ROWS_PER_BLOCK = 16_384
QUERIES_PER_BLOCK = 16_384


def quantised(vector: Column) -> Column:
    """floor(SCALE * x) of each component; null for vectors that take no part.

    Those are null or empty ones, and ones with a null or non-finite component. A vector whose
    squared length reaches 2**62, so that a long might not hold its scores, raises an error.
    """
    wide = F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(SCALE)).cast("double")))
    real = vector.cast("array<double>")
    fine = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    squares = F.aggregate(real, F.lit(0.0), lambda a, x: a + x * x * F.lit(float(SCALE) ** 2))
    too_large = F.raise_error(F.lit("a vector is too large for scores in a long")).cast("array<bigint>")
    return F.when((F.size(vector) > 0) & F.coalesce(fine, F.lit(False)), F.when(squares < 2.0**62, wide).otherwise(too_large))


class Index(NamedTuple):
    """``slices[d, b]`` is the bitmap of bit ``b`` of component ``d``, each less ``low[d]``."""

    ids: np.ndarray
    low: np.ndarray
    slices: np.ndarray
    words: int


def packed(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of 64-bit words along the last axis."""
    pad = -bits.shape[-1] % 64
    bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], pad), bool)], axis=-1)
    # a transposed array with one bit of padding stays transposed, and its words could not be viewed
    return np.packbits(np.ascontiguousarray(bits), axis=-1, bitorder="little").view(np.uint64)


def build(ids: np.ndarray, vectors: np.ndarray) -> Index:
    """Index of rows in the order of their ids, so that a bitmap's order settles ties."""
    order = np.argsort(ids, kind="stable")
    vectors = vectors[order]
    low = vectors.min(axis=0)
    raised = (vectors - low).astype(np.uint64).T
    depth = max(1, int(raised.max()).bit_length())
    slices = np.stack([packed((raised >> np.uint64(b)) & np.uint64(1) != 0) for b in range(depth)], axis=1)
    return Index(ids[order], low, slices, slices.shape[-1])


def product_slices(index: Index, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Bit slices of ``query . row`` for all rows, less the offset that comes with them.

    A component times a query number is a sum of its slices, shifted by the number's bits; for a
    negative number the slices are complemented, which changes the offset alone. Bitmaps of equal
    weight are added three at a time: their sum stays, their carry goes one weight up.
    """
    depth = index.slices.shape[1]
    size = np.abs(query).astype(np.uint64)
    by_weight: dict[int, list[np.ndarray]] = {}
    for b in range(int(size.max()).bit_length() if len(size) else 0):
        for sign, rows in ((1, (query > 0)), (-1, (query < 0))):
            chosen = np.flatnonzero(rows & (size >> np.uint64(b) & np.uint64(1) != 0))
            if len(chosen):
                for i in range(depth):
                    maps = index.slices[chosen, i]
                    by_weight.setdefault(b + i, []).append(maps if sign > 0 else ~maps)
    offset = int((query * index.low).sum()) - int(size[query < 0].sum()) * ((1 << depth) - 1)
    out: list[np.ndarray] = []
    weight, empty = 0, np.zeros(index.words, np.uint64)
    while weight <= max(by_weight, default=-1):
        maps = np.concatenate(by_weight[weight]) if weight in by_weight else np.zeros((0, index.words), np.uint64)
        carries = []
        while len(maps) > 2:
            n = len(maps) // 3
            a, b, c = maps[:n], maps[n : 2 * n], maps[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            maps = np.concatenate([half ^ c, maps[3 * n :]])
        if len(maps) == 2:
            carries.append((maps[0] & maps[1])[None])
            maps = (maps[0] ^ maps[1])[None]
        out.append(maps[0] if len(maps) else empty)
        if carries:
            by_weight.setdefault(weight + 1, []).extend(carries)
        weight += 1
    return out, offset


def select(index: Index, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best rows but the query's own, from the most significant slice down.

    ``sure`` rows are in; ``open`` rows tie on all slices seen so far. What is still open at the
    end has the boundary score, and the smallest ids among it fill the places left.
    """
    slices, offset = product_slices(index, query)
    candidates = packed(index.ids != own)
    k = min(k, int(np.bitwise_count(candidates).sum()))
    sure, still = np.zeros_like(candidates), candidates
    held = 0
    for bits in reversed(slices):
        high = still & bits
        n = int(np.bitwise_count(high).sum())
        if held + n > k:
            still = high
        else:
            sure, held, still = sure | high, held + n, still & ~bits
            if held == k:
                break
    places = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    rows = places(sure)
    if held < k:
        rows = np.concatenate([rows, places(still)[: k - held]])
    scores = np.full(len(rows), offset, np.int64)
    for weight, bits in enumerate(slices):
        scores += ((bits[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << weight
    return index.ids[rows], scores


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The ``k`` best rows of ``vectors`` (``vec_id``, ``embedding``) for each row that ``is_query``.

    Scores are exact integer inner products of quantised vectors of equal length. Returns
    ``query_id, rank, vec_id, score``, ranks from 1, ties to the smaller ``vec_id``; all candidates
    if fewer than ``k``. Rows of null id or unusable vector (see ``quantised``) take no part. Rows
    repeated in id count once; if their vectors differ, the smallest in array order counts. An empty
    table gives an empty table. Other columns are not read.

    Rows are cut into blocks of bounded size, each block is indexed, and blocks of queries meet
    every block of rows of their length; only ``k`` rows per query and block leave a task.
    """
    query = vectors.select("vec_id", quantised(F.col("embedding")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = query.where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    rows = cut_lineage(rows.withColumn("dim", F.size("v")))
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).select(
        "dim",
        F.ceil(F.col("n") / ROWS_PER_BLOCK).cast("int").alias("row_blocks"),
        F.ceil(F.col("q") / QUERIES_PER_BLOCK).cast("int").alias("query_blocks"),
    ).where("query_blocks > 0")
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n).cast("bigint")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sized = rows.join(counts, "dim")
    there = sized.withColumn("row_block", spread("row_blocks")).withColumn("query_block", every("query_blocks"))
    asked = sized.where("asks").withColumn("query_block", spread("query_blocks")).withColumn("row_block", every("row_blocks"))
    cell = ["dim", "row_block", "query_block"]

    def meet(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        asked, found, scored = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(candidates) and len(queries):
            index = build(candidates["vec_id"].to_numpy(), np.stack(candidates["v"].to_numpy()).astype(np.int64))
            for vector, own in zip(queries["asked_v"], queries["asked_id"], strict=True):
                ids, scores = select(index, np.asarray(vector, np.int64), own, k)
                asked += [own] * len(ids)
                found.append(ids)
                scored.append(scores)
        return pd.DataFrame({"query_id": np.array(asked, np.int64), "vec_id": np.concatenate(found), "score": np.concatenate(scored)})

    shape = "query_id bigint, vec_id bigint, score bigint"
    there = there.select(*cell, "vec_id", "v")
    asked = asked.select(*[F.col(c).alias(f"asked_{c}") for c in cell], F.col("vec_id").alias("asked_id"), F.col("v").alias("asked_v"))
    best = there.groupBy(*cell).cogroup(asked.groupBy(*[f"asked_{c}" for c in cell])).applyInPandas(meet, shape)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
