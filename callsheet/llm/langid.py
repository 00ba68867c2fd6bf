"""Language identification with error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.llm.common import byte_views, remainder, summed_vectors

FEATURES = 1 << 14
UNDETERMINED = "und"

_SYMBOL = np.zeros(256, dtype=np.uint32)
_SYMBOL[65:91] = _SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = np.arange(27, 155)


def ngram_counts(data: np.ndarray) -> np.ndarray:
    """Counts of the letter 1- to 3-grams of one text, hashed to ``FEATURES`` places.

    Everything but letters counts as one symbol, and grams of only that symbol are left out.
    """
    s = _SYMBOL[data]
    counts = np.bincount(s, minlength=FEATURES)
    counts[0] = 0
    if len(s) > 1:
        two = s[:-1] * np.uint32(155) + s[1:]
        gram = (two * np.uint32(2654435761)) >> np.uint32(18)
        counts += np.bincount(gram[two > 0], minlength=FEATURES)
    if len(s) > 2:
        three = two[:-1] * np.uint32(155) + s[2:] + np.uint32(1 << 24)
        gram = (three * np.uint32(2246822519)) >> np.uint32(18)
        counts += np.bincount(gram[three > 1 << 24], minlength=FEATURES)
    return counts


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text holds a character of a Unicode letter class; null has none."""
    return pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(False)


class Codes(NamedTuple):
    """``words[language, bit]`` is +1 or -1; a bit's classifier is a column of ``weights``."""

    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray


def codewords(n: int) -> np.ndarray:
    """All two-way splits for up to six languages, else one against the rest and random splits."""
    if n <= 6:
        rest = [set(c) for k in range(n - 1) for c in combinations(range(1, n), k)]
        return np.array([[1 if i == 0 or i in c else -1 for c in rest] for i in range(n)]).reshape(n, -1)
    rng = np.random.default_rng(n)
    random = [rng.permutation(np.arange(n) % 2) * 2 - 1 for _ in range(int(np.ceil(10 * np.log2(n))))]
    return np.hstack([2 * np.eye(n, dtype=int) - 1, np.array(random).T])


def language_counts(docs: DataFrame) -> DataFrame:
    """n-gram mass per ``lang`` over all of ``docs``; long texts weigh by the log of their length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for texts in byte_views(batch.column(1)):
                for i in range(len(texts)):
                    counts = ngram_counts(texts.data[texts.bounds[i] : texts.bounds[i + 1]])
                    total = counts.sum()
                    if total:
                        mass = sums.setdefault(langs[texts.first + i], np.zeros(FEATURES))
                        mass += counts * (np.log1p(total) / total)
        if sums:
            part = TaskContext.get().partitionId()
            rows = {"lang": list(sums), "part": [part] * len(sums), "vector": list(sums.values())}
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("lang", pa.string()), ("part", pa.int32()), ("vector", pa.list_(pa.float64()))]))

    partials = docs.select("lang", "text").mapInArrow(count, "lang string, part int, vector array<double>")
    return summed_vectors(partials, "lang")


def fit(docs: DataFrame) -> Codes | None:
    """Learn from every row with text and a language; ``None`` if there is none.

    Only one vector of ``FEATURES`` numbers per language reaches the driver.
    """
    rows = sorted(language_counts(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())).collect())
    if not rows:
        return None
    mass = np.array([r["vector"] for r in rows])
    share = (mass + 0.01) / (mass + 0.01).sum(axis=1, keepdims=True)
    words = codewords(len(rows))
    positive, negative = words == 1, words == -1
    side = lambda chosen: (chosen / np.maximum(chosen.sum(axis=0), 1)).T @ share
    weights = (np.log(side(positive)) - np.log(side(negative))).T if words.size else np.zeros((FEATURES, 0))
    expected = words * (share @ weights)  # a bit that mixed languages cannot tell apart gets no say
    trust = np.clip(expected.min(axis=0), 0, None) if words.size else np.zeros(0)
    return Codes([r["lang"] for r in rows], words, weights.astype(np.float32), np.maximum(expected.mean(axis=0), 1e-9) if words.size else trust, trust)


def decode(codes: Codes, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword by weighted logistic loss: language number, score, lead over the next."""
    n = len(codes.languages)
    if n == 1:
        one = np.ones(len(counts))
        return np.zeros(len(counts), int), one, one
    margins = (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)) @ codes.weights / codes.scale
    loss = np.logaddexp(0, -4 * margins[:, None, :] * codes.words[None]) @ codes.trust / max(codes.trust.sum(), 1e-9)
    best = loss.argmin(axis=1)
    weight = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
    weight /= weight.sum(axis=1, keepdims=True)
    ordered = np.sort(weight, axis=1)
    return best, ordered[:, -1], ordered[:, -1] - ordered[:, -2]


AMBIGUOUS_LEAD = 0.1


def languages_of(codes: Codes | None, column: pa.Array) -> pa.StructArray:
    """``lang_pred``, ``score`` and ``ambiguous`` of each text."""
    n, letters = len(column), has_letter(column)
    names, score, lead = [UNDETERMINED] * n, np.zeros(n), np.zeros(n)
    if codes is not None:
        for texts in byte_views(column):
            for start in range(0, len(texts), 128):
                stop = min(start + 128, len(texts))
                cut = [texts.data[texts.bounds[i] : texts.bounds[i + 1]] for i in range(start, stop)]
                best, sure, gap = decode(codes, np.array([ngram_counts(d) for d in cut], dtype=np.float32))
                for i, k in enumerate(best, texts.first + start):
                    if letters[i]:
                        names[i], score[i], lead[i] = codes.languages[k], sure[i - texts.first - start], gap[i - texts.first - start]
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(lead < AMBIGUOUS_LEAD)], ["lang_pred", "score", "ambiguous"])


def predicted(codes: Codes | None, text: Column) -> Column:
    """A struct column with the prediction for ``text``."""

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def predict(column: pa.Array) -> pa.Array:
        return languages_of(codes, column)

    return predict(text)


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that the classifier may learn from."""
    return docs.where(remainder(F.col("doc_id"), 4) != 2)


def identify(docs: DataFrame) -> DataFrame:
    """Language of every whole text of ``docs`` (``doc_id``, ``text``, ``lang``).

    Returns ``doc_id, held_out, lang_pred, score, ambiguous``, one row per input row, repeated
    rows included. A null, empty or letterless text gives ``und`` with score 0. Rows of null
    ``lang`` or ``text`` teach nothing; without any lesson every row is ``und``. Ties between
    codewords go to the first language in alphabetical order and are ambiguous. A null ``doc_id``
    counts as empty text in the split. An empty table gives an empty table. Other columns are
    not read.
    """
    codes = fit(learnable(docs.select("doc_id", "text", "lang")).select("text", "lang"))
    return docs.select(
        "doc_id",
        (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        predicted(codes, F.col("text")).alias("found"),
    ).select("doc_id", "held_out", "found.*")
