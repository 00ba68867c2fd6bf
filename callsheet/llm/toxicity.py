"""Toxicity scores from a small bidirectional gated recurrent network with attention pooling."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callsheet.llm.common import Texts, byte_views, mixed, remainder, span_hashes, spans

WINDOW = 32
#: Half a window, so that a passage of up to ``WINDOW - STRIDE + 1`` words lies whole in one.
STRIDE = WINDOW // 2
HIDDEN = 8
INPUTS = 4
BUCKETS = 1 << 18
ORDERS = (3, 4, 5)

#: The training sample: so many documents of each class at most, none longer than so many bytes.
SAMPLE_TOXIC = 1500
SAMPLE_CLEAN = 3000
SAMPLE_BYTES = 16_384
EPOCHS = 10

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


class Words(NamedTuple):
    """Distinct words of some texts, the texts as numbers of words, and the character n-grams."""

    hashes: np.ndarray
    inverse: np.ndarray
    first: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]


def words_of(texts: Texts) -> Words:
    data = _LOWER[texts.data]
    starts, ends, first = spans(_LETTER[data], texts.bounds)
    hashes, where, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    starts, lengths = starts[where], (ends - starts)[where]
    size = lengths + 2  # a mark before and after each word
    edges = np.concatenate([[0], np.cumsum(size)])
    body = np.zeros(edges[-1], np.uint64)
    at = np.arange(edges[-1]) - np.repeat(edges[:-1], size)
    inner = (at > 0) & (at <= np.repeat(lengths, size))
    body[inner] = data[(np.repeat(starts, size) + at - 1)[inner]]
    owner = np.repeat(np.arange(len(lengths)), size)
    left = np.repeat(size, size) - at
    grams = []
    for order in ORDERS:
        ok = np.flatnonzero(left >= order)
        code = np.full(len(ok), order, np.uint64)
        for i in range(order):
            code = code * np.uint64(257) + body[ok + i]
        grams.append((owner[ok], (mixed(code) >> np.uint64(64 - 18)).astype(np.int32)))
    return Words(hashes, inverse.astype(np.int64), first, grams)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 18)).astype(np.int32)


class Tables(NamedTuple):
    """Shrunken log-odds of the toxic class per word and per character n-gram."""

    words: np.ndarray
    grams: np.ndarray


def log_odds(words: Words, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> Tables:
    """From the numbers of toxic and clean documents that hold each distinct word."""

    def odds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ratio = np.log((a + 1) / (n_toxic + 2)) - np.log((b + 1) / (n_clean + 2))
        return (ratio * (a + b) / (a + b + 4)).astype(np.float32)

    sums = lambda index, weight: np.bincount(index, weight, BUCKETS)
    place = _bucket(words.hashes)
    gram_a = sum(sums(g, toxic[o]) for o, g in words.grams)
    gram_b = sum(sums(g, clean[o]) for o, g in words.grams)
    return Tables(odds(sums(place, toxic), sums(place, clean)), odds(gram_a, gram_b))


def inputs(words: Words, tables: Tables) -> np.ndarray:
    """Per distinct word: its log-odds, the highest and the mean of its n-grams', and one."""
    n = len(words.hashes)
    top, total, number = np.full(n, -9, np.float32), np.zeros(n), np.full(n, 1e-9)
    for owner, gram in words.grams:
        if len(owner):
            value = tables.grams[gram]
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            own = owner[begin]
            top[own] = np.maximum(top[own], np.maximum.reduceat(value, begin))
            total += np.bincount(owner, value, n)
            number += np.bincount(owner, minlength=n)
    return np.column_stack([tables.words[_bucket(words.hashes)], top, total / number, np.ones(n)]).astype(np.float32) / np.array([3, 3, 1, 1], np.float32)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every window of every text as (index of words, owner); -1 fills a text's last window."""
    lengths = np.diff(first)
    per = np.where(lengths > 0, np.maximum(0, -(-(lengths - WINDOW) // STRIDE)) + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), per)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    at = (k * STRIDE)[:, None] + np.arange(WINDOW)
    return np.where(at < lengths[owner][:, None], at + first[:-1][owner][:, None], -1), owner


Net = dict[str, np.ndarray]


def new_net(seed: int = 3) -> Net:
    rng = np.random.default_rng(seed)
    shapes = {"x": (2, INPUTS, 3 * HIDDEN), "h": (2, HIDDEN, 2 * HIDDEN), "c": (2, HIDDEN, HIDDEN), "q": (2 * HIDDEN,), "v": (2 * HIDDEN,), "b": (1,)}
    return {k: (rng.normal(size=s) * 0.3).astype(np.float32) for k, s in shapes.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(net: Net, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
    """Logits of windows ``x[n, WINDOW, INPUTS]``, whose last input is 0 where no word is.

    Both directions run as one batch, the second over the reversed window. A place without a word
    leaves the state as it is and gets no attention.
    """
    n = len(x)
    both = np.stack([x, x[:, ::-1]])
    mask = both[:, :, :, -1:]
    drive = both.reshape(2, n * WINDOW, INPUTS) @ net["x"]
    drive = drive.reshape(2, n, WINDOW, 3 * HIDDEN)
    h = np.zeros((2, n, HIDDEN), np.float32)
    states = np.empty((2, n, WINDOW, HIDDEN), np.float32)
    steps = []
    for t in range(WINDOW):
        a = drive[:, :, t]
        gates = _sigmoid(a[:, :, : 2 * HIDDEN] + h @ net["h"])
        z, r = gates[:, :, :HIDDEN] * mask[:, :, t], gates[:, :, HIDDEN:]
        c = np.tanh(a[:, :, 2 * HIDDEN :] + (r * h) @ net["c"])
        if keep:
            steps.append((h, gates, r, c))
        h = h + z * (c - h)
        states[:, :, t] = h
    joined = np.concatenate([states[0], states[1][:, ::-1]], axis=2)
    focus = np.where(x[:, :, -1] > 0, joined @ net["q"], -30)
    focus = np.exp(focus - focus.max(axis=1, keepdims=True)) * (x[:, :, -1] > 0)
    focus /= np.maximum(focus.sum(axis=1, keepdims=True), 1e-9)
    pooled = (focus[:, None, :] @ joined)[:, 0]
    return pooled @ net["v"] + net["b"][0], {"both": both, "mask": mask, "steps": steps, "joined": joined, "focus": focus, "pooled": pooled}


def backward(net: Net, kept: dict, slope: np.ndarray) -> Net:
    """Gradients of all weights, given the loss's slope at each logit."""
    joined, focus, pooled, mask = kept["joined"], kept["focus"], kept["pooled"], kept["mask"]
    out = {"v": pooled.T @ slope, "b": slope.sum(keepdims=True)}
    d_pool = slope[:, None] * net["v"]
    d_focus = focus * ((joined @ d_pool[:, :, None])[:, :, 0] - (pooled * d_pool).sum(axis=1, keepdims=True))
    out["q"] = (d_focus[:, :, None] * joined).sum(axis=(0, 1))
    d_joined = focus[:, :, None] * d_pool[:, None, :] + d_focus[:, :, None] * net["q"]
    d_states = np.stack([d_joined[:, :, :HIDDEN], d_joined[:, ::-1, HIDDEN:]])
    out |= {"h": np.zeros_like(net["h"]), "c": np.zeros_like(net["c"]), "x": np.zeros_like(net["x"])}
    d_h = np.zeros_like(d_states[:, :, 0])
    swap = lambda m: m.transpose(0, 2, 1)
    for t in reversed(range(WINDOW)):
        h, gates, r, c = kept["steps"][t]
        d_h = d_h + d_states[:, :, t]
        z, m = gates[:, :, :HIDDEN], mask[:, :, t]
        d_c = d_h * z * m * (1 - c * c)
        d_z = d_h * (c - h) * m * z * (1 - z)
        d_rh = d_c @ swap(net["c"])
        d_r = d_rh * h * r * (1 - r)
        d_gates = np.concatenate([d_z, d_r], axis=2)
        out["c"] += swap(r * h) @ d_c
        out["h"] += swap(h) @ d_gates
        out["x"] += swap(kept["both"][:, :, t]) @ np.concatenate([d_gates, d_c], axis=2)
        d_h = d_h * (1 - z * m) + d_rh * r + d_gates @ swap(net["h"])
    return out


def _taken(values: np.ndarray, inverse: np.ndarray, index: np.ndarray) -> np.ndarray:
    x = values[inverse[index]]
    x[index < 0] = 0
    return x


def logits(net: Net, values: np.ndarray, inverse: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Logits of all windows, a few thousand at a time."""
    parts = [forward(net, _taken(values, inverse, index[i : i + 2048]))[0] for i in range(0, len(index), 2048)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


class Model(NamedTuple):
    tables: Tables
    net: Net


def fit(texts: list[str], toxic: np.ndarray) -> Model | None:
    """Train on whole documents of which only the label is known.

    Log-odds that a document is trained with come from the other half of the sample. Each round
    scores all windows and learns from every document's highest one, toxic or clean.
    """
    if not texts or toxic.all() or not toxic.any():
        return None
    view = next(byte_views(pa.array(texts, pa.large_string()), limit=1 << 40))
    words = words_of(view)
    n, half = len(texts), np.arange(len(texts)) % 2
    owner = np.repeat(np.arange(n), np.diff(words.first))
    pairs = np.unique(owner * len(words.hashes) + words.inverse)
    doc, word = pairs // max(len(words.hashes), 1), pairs % max(len(words.hashes), 1)
    count = lambda chosen: np.bincount(word[chosen[doc]], minlength=len(words.hashes)).astype(float)
    made = lambda chosen: log_odds(words, count(chosen & toxic), count(chosen & ~toxic), int((chosen & toxic).sum()), int((chosen & ~toxic).sum()))
    values = [inputs(words, made(half != k)) for k in (0, 1)]
    index, where = windows(words.first)
    if not len(index):
        return None
    tables = made(np.ones(n, bool))
    net = new_net()
    rng = np.random.default_rng(11)
    step = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in net.items()}
    score = np.zeros(len(index), np.float32)
    for k in (0, 1):
        own = half[where] == k
        score[own] = _taken(values[k], words.inverse, index[own])[:, :, :2].max(axis=2).sum(axis=1)
    beat = 0
    for epoch in range(EPOCHS):
        if epoch:
            for k in (0, 1):
                own = half[where] == k
                score[own] = logits(net, values[k], words.inverse, index[own])
        order = np.lexsort((-score, where))
        best = order[np.flatnonzero(np.r_[True, where[order][1:] != where[order][:-1]])]
        share = toxic[where[best]].mean()
        for _ in range(4):
            best = rng.permutation(best)
            for i in range(0, len(best), 64):
                rows = best[i : i + 64]
                x = np.where((half[where[rows]] == 0)[:, None, None], _taken(values[0], words.inverse, index[rows]), _taken(values[1], words.inverse, index[rows]))
                y = toxic[where[rows]].astype(np.float32)
                z, kept = forward(net, x, keep=True)
                weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
                beat += 1
                for name, g in backward(net, kept, (_sigmoid(z) - y) * weight / len(rows)).items():
                    m, v = step[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    net[name] = net[name] - np.float32(0.01) * (m / (1 - 0.9**beat)) / (np.sqrt(v / (1 - 0.999**beat)) + 1e-8) - np.float32(1e-4) * net[name]
    return Model(tables, {k: w.astype(np.float32) for k, w in net.items()})


def scores_of(model: Model | None, column: pa.Array) -> np.ndarray:
    """The highest window's score of each whole text; 0 without any word."""
    out = np.zeros(len(column))
    if model is None:
        return out
    for texts in byte_views(column):
        words = words_of(texts)
        index, owner = windows(words.first)
        if len(index):
            z = logits(model.net, inputs(words, model.tables), words.inverse, index)
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[texts.first + owner[begin]] = _sigmoid(np.maximum.reduceat(z, begin).astype(float))
    return out


def rated(model: Model | None, text: Column) -> Column:
    @F.arrow_udf("double")
    def rate(column: pa.Array) -> pa.Array:
        return pa.array(scores_of(model, column))

    return rate(text)


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A bounded sample of labelled documents, chosen by hash: ``text, toxic``.

    Only labels of documents that fit ``SAMPLE_BYTES`` take a place.
    """
    key = F.col("doc_id")
    known = labels.where("toxic is not null and doc_id is not null").where(remainder(key, 5) != 0)
    fits = docs.where(F.octet_length("text") <= SAMPLE_BYTES)
    known = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("toxic")).join(fits.select("doc_id"), "doc_id", "left_semi")
    rank = F.row_number().over(W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    limit = F.when(F.col("toxic"), SAMPLE_TOXIC).otherwise(SAMPLE_CLEAN)
    ids = known.withColumn("rank", rank).where(F.col("rank") <= max(SAMPLE_TOXIC, SAMPLE_CLEAN)).where(F.col("rank") <= limit)
    fitting = fits.join(F.broadcast(ids), "doc_id")  # at most 4,500 ids
    one = fitting.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "toxic")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every whole text of ``docs`` (``doc_id``, ``text``), learned from ``labels``.

    Returns ``doc_id, held_out, score, predicted``, one row per input row, repeated rows included.
    All overlapping windows of a text are scored and the highest counts. Null, empty and wordless
    texts score 0, and so does every text if the sample lacks one of the classes. Null labels and
    labels of no document teach nothing; several labels of a document count by their mean; one row
    of a repeated id is learned from. A null ``doc_id`` matches no label. Empty tables give an
    empty table. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    known = sample(docs, labels).toPandas()
    model = fit(known["text"].tolist(), known["toxic"].to_numpy(bool))
    found = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), rated(model, F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
