"""Token counts from an exact histogram of encoded lengths."""

from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK = 4096


@lru_cache(maxsize=4)
def encoding(name: str):
    """The tokenizer of a rank file, built once per worker."""
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_length(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of each whole text; special tokens' strings are ordinary text, null has none."""

    @F.arrow_udf("long")
    def measure(column: pa.Array) -> pa.Array:
        encode = encoding(vocabulary).encode_ordinary
        return pa.array([len(encode(t.as_py())) if t.is_valid else 0 for t in column], pa.int64())

    return measure(text)


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``n_tokens, n_docs``: how many documents have each length. Combines before the shuffle."""
    return docs.select(encoded_length(F.col("text"), vocabulary).alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def answers(lengths: DataFrame) -> DataFrame:
    """Every context limit's answers from a histogram (``n_tokens, n_docs``).

    A row per length that occurs, taken as ``context_limit``: ``n_docs`` of just that length,
    ``docs_fitting`` and ``docs_cut`` (no longer, longer), ``tokens_kept`` if every document is
    cut at the limit, ``tokens_cut`` off, ``tokens_total``, and ``quantile``, the share of
    documents that fit. Sums run within blocks of ``BLOCK`` lengths, on top of the blocks' sums.
    """
    block = F.floor(F.col("n_tokens") / F.lit(BLOCK))
    tokens = F.col("n_tokens") * F.col("n_docs")
    rows = lengths.withColumn("block", block).withColumn("tokens", tokens)
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("mass"))
    beyond = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sums = sums.select(
        "block",
        F.coalesce(F.sum("docs").over(beyond), F.lit(0)).alias("docs_beyond"),
        F.coalesce(F.sum("mass").over(beyond), F.lit(0)).alias("mass_beyond"),
        F.sum("docs").over(everything).alias("docs_all"),
        F.sum("mass").over(everything).alias("tokens_total"),
    )
    longer = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    rows = (
        rows.join(sums, "block")
        .withColumn("docs_cut", F.col("docs_beyond") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0)))
        .withColumn("mass_cut", F.col("mass_beyond") + F.coalesce(F.sum("tokens").over(longer), F.lit(0)))
        .withColumn("tokens_cut", F.col("mass_cut") - F.col("docs_cut") * F.col("n_tokens"))
    )
    return rows.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        (F.col("docs_all") - F.col("docs_cut")).alias("docs_fitting"),
        "docs_cut",
        (F.col("tokens_total") - F.col("tokens_cut")).alias("tokens_kept"),
        "tokens_cut",
        "tokens_total",
        ((F.col("docs_all") - F.col("docs_cut")) / F.col("docs_all")).alias("quantile"),
    )


def answer(found: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, docs_fitting, docs_cut, tokens_kept, tokens_cut`` for any given limits.

    The longest occurring length up to a limit carries the counts; tokens follow from it.
    """
    limit = F.explode(F.array(*[F.lit(int(n)).cast("bigint") for n in limits])).alias("asked")
    per = found.select(limit, "*")
    whole = per.groupBy("asked").agg(F.max("tokens_total").alias("total"), F.max(F.col("docs_fitting") + F.col("docs_cut")).alias("docs"))
    below = per.where("context_limit <= asked").groupBy("asked").agg(
        F.max("docs_fitting").alias("fitting"), F.min("docs_cut").alias("cut"),
        F.max(F.col("tokens_kept") - F.col("docs_cut") * F.col("context_limit")).alias("held"),
    )
    joined = whole.join(below, "asked", "left").select("asked", "total", F.coalesce("fitting", F.lit(0)).alias("docs_fitting"), F.coalesce("cut", "docs").alias("docs_cut"), F.coalesce("held", F.lit(0)).alias("held"))
    kept = F.col("held") + F.col("docs_cut") * F.col("asked")
    return joined.select(F.col("asked").alias("context_limit"), "docs_fitting", "docs_cut", kept.alias("tokens_kept"), (F.col("total") - kept).alias("tokens_cut"))


def count(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token counts of every whole text of ``docs`` (``text``), answered for every context limit.

    Null and empty texts have length 0 and count as documents; repeated rows count each. Ties in
    length share a row. An empty table gives an empty table. Other columns are not read.
    """
    return answers(histogram(docs, vocabulary))
