"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.functions.lineage import cut_lineage
from callsheet.llm.common import byte_views, remainder, span_hashes, spans, summed_vectors

STATISTICS = 23
FOURIER = 160
RIDGE = 1e-2
FOLDS = 4
BINS = 2048

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GROUPS = [(65, 91), (97, 123), (48, 58), (128, 256)]
_MARKS = [b".,;:?'\"-()", b"!", b"|<>[]{}/\\", b"#$%&*+=@^_~`"]


def _share(a: float, b: float) -> float:
    return a / b if b else 0.0


def statistics(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> list[float]:
    """``STATISTICS`` numbers about one whole text, given its words and their hashes."""
    n, words = len(data), len(starts)
    seen = np.bincount(data, minlength=256)
    groups = [_share(seen[a:b].sum(), n) for a, b in _GROUPS] + [_share(sum(seen[c] for c in m), n) for m in _MARKS]
    p = seen[seen > 0] / max(n, 1)
    lengths = ends - starts
    _, times = np.unique(hashes, return_counts=True)
    pairs = hashes[1:] * np.uint64(3) + hashes[:-1]
    first, last = (data[starts], data[ends - 1]) if words else (data, data)
    breaks = np.flatnonzero(data == 10)
    edges = np.concatenate([[0], breaks + 1, [n]])
    lines, line_times = np.unique(span_hashes(data, edges[:-1], np.maximum(edges[1:] - 1, edges[:-1])), return_counts=True) if n else (edges[:0], edges[:0])
    upper = _share(((first >= 65) & (first <= 90)).sum(), words)
    ends_odd = _share((~((last >= 97) & (last <= 122)) & (last < 128)).sum(), words)
    return [
        np.log1p(n), np.log1p(words), *groups, _share(seen[[9, 10, 11, 12, 13, 32]].sum(), n), float(-(p * np.log(p)).sum()),
        _share(lengths.sum(), words), float(lengths.std()) if words else 0.0, np.log1p(lengths.max()) if words else 0.0,
        _share(len(times), words), _share(times.max(), words) if words else 0.0,
        _share((hashes[1:] == hashes[:-1]).sum(), words), _share(len(np.unique(pairs)), len(pairs)),
        _share(len(lines), line_times.sum() if len(line_times) else 0), _share(n, len(breaks) + 1) / 1000, upper, ends_odd,
    ]


def statistics_of(column: pa.Array) -> np.ndarray:
    out = np.zeros((len(column), STATISTICS))
    for texts in byte_views(column):
        starts, ends, first = spans(~_SPACE[texts.data], texts.bounds)
        hashes = span_hashes(texts.data, starts, ends)
        for i in range(len(texts)):
            a, b, o = first[i], first[i + 1], texts.bounds[i]
            out[texts.first + i] = statistics(texts.data[o : texts.bounds[i + 1]], starts[a:b] - o, ends[a:b] - o, hashes[a:b])
    return out


def with_statistics(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def measure(column: pa.Array) -> pa.Array:
        values = statistics_of(column)
        return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * STATISTICS, values.ravel())

    return measure(text)


class Model(NamedTuple):
    mean: np.ndarray
    spread: np.ndarray
    fold_weights: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray


def features(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Cosines of random projections, whose inner products approximate a Gaussian kernel."""
    rng = np.random.default_rng(7)
    directions = rng.normal(size=(STATISTICS, FOURIER)) / np.sqrt(2 * STATISTICS)
    phases = rng.uniform(0, 2 * np.pi, FOURIER)
    z = np.clip((stats - mean) / spread, -8, 8)
    return np.hstack([np.sqrt(2 / FOURIER) * np.cos(z @ directions + phases), z / 8, np.ones((len(z), 1))])


WIDTH = FOURIER + STATISTICS + 1


def normal_equations(lessons: DataFrame, mean: np.ndarray, spread: np.ndarray) -> dict[int, np.ndarray]:
    """``[Z'Z | Z'y]`` per fold, summed in partitions first; ``FOLDS`` small matrices come back."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            stats = np.stack(batch.column(0).to_numpy(False)) if batch.num_rows else np.zeros((0, STATISTICS))
            y, fold = batch.column(1).to_numpy(False), batch.column(2).to_numpy(False)
            for start in range(0, len(y), 4096):
                z = features(stats[start : start + 4096], mean, spread)
                full = np.hstack([z, y[start : start + 4096, None]])
                for k in np.unique(fold[start : start + 4096]):
                    own = fold[start : start + 4096] == k
                    sums[int(k)] = sums.get(int(k), 0) + z[own].T @ full[own]
        if sums:
            rows = {"fold": list(sums), "part": [TaskContext.get().partitionId()] * len(sums), "vector": [m.ravel() for m in sums.values()]}
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("fold", pa.int32()), ("part", pa.int32()), ("vector", pa.list_(pa.float64()))]))

    partials = lessons.select("stats", "y", "fold").mapInArrow(add, "fold int, part int, vector array<double>")
    return {r["fold"]: np.array(r["vector"]).reshape(WIDTH, WIDTH + 1) for r in summed_vectors(partials, "fold").collect()}


def ridge(equations: np.ndarray) -> np.ndarray:
    n = max(equations[WIDTH - 1, WIDTH - 1], 1)
    penalty = RIDGE * np.sqrt(n) * np.eye(WIDTH)
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(equations[:, :WIDTH] + penalty, equations[:, WIDTH])


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; each pool becomes a knot at its mean, lines lie between."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, n, strict=True):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            top = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], top, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def calibrated(raw: np.ndarray, model: Model) -> np.ndarray:
    """Isotonic level, with a thousandth left to the raw score so that ranks stay apart."""
    level = np.interp(raw, model.knots, model.levels) if len(model.knots) else np.full(len(raw), 0.5)
    return 0.999 * level + 0.001 * np.clip((raw + 1) / 3, 0, 1)


def fit(lessons: DataFrame) -> Model | None:
    """Learn from rows ``stats, y, fold``. Calibration sees only scores of other folds' models."""
    moments = lessons.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    if not moments:
        return None
    mean = np.array([r["m"] for r in moments])
    spread = np.array([r["s"] if r["s"] > 1e-9 else 1.0 for r in moments])
    parts = normal_equations(lessons, mean, spread)
    total = sum(parts.values())
    weights = ridge(total)
    others = np.array([ridge(total - parts[k]) if k in parts and len(parts) > 1 else weights for k in range(FOLDS)])

    @F.pandas_udf("double")
    def other_score(stats: pd.Series, fold: pd.Series) -> pd.Series:
        z = features(np.stack(stats.to_numpy()), mean, spread) if len(stats) else np.zeros((0, WIDTH))
        return pd.Series((z * others[fold.to_numpy()]).sum(axis=1))

    binned = lessons.withColumn("raw", other_score("stats", "fold")).withColumn("bin", F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "raw")) + 1) * (BINS / 3)))
    rows = binned.groupBy("bin").agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    knots, levels = isotonic(*(np.array([r[c] for r in rows], dtype=float) for c in ("x", "y", "n")))
    return Model(mean, spread, others, weights, knots, levels)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every whole text of ``docs`` (``doc_id``, ``text``), learned from ``labels``.

    Returns ``doc_id, held_out, score, predicted``, one row per input row, repeated rows included.
    A null text counts as empty and gets a score like any other. Labels that are null or belong to
    no document teach nothing; a document with several labels teaches their mean. A label counts
    for every row of its id. Without any lesson all scores are 0.5. Tied statistics give tied
    scores. A null ``doc_id`` matches no label. Empty tables give an empty table. Other columns
    are not read.
    """
    key = F.col("doc_id")
    stats = cut_lineage(docs.select(key, with_statistics(F.col("text")).alias("stats")))
    known = labels.where("quality is not null and doc_id is not null").groupBy(key).agg(F.avg("quality").alias("y"))
    lessons = stats.where(remainder(key, 3) != 1).join(known, "doc_id").select("stats", "y", F.pmod(F.xxhash64(key), F.lit(FOLDS).cast("bigint")).cast("int").alias("fold"))
    model = fit(cut_lineage(lessons))

    @F.pandas_udf("double")
    def rate(column: pd.Series) -> pd.Series:
        if model is None or not len(column):
            return pd.Series(np.full(len(column), 0.5))
        z = features(np.stack(column.to_numpy()), model.mean, model.spread)
        return pd.Series(calibrated(z @ model.weights, model))

    rated = stats.select("doc_id", (remainder(key, 3) == 1).alias("held_out"), rate("stats").alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
