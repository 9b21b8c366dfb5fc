"""Exact histogram of encoded lengths, and the answers its suffix sums give."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, prefix_sums


@lru_cache(maxsize=4)
def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """n_tokens of each row's whole text (null: 0 tokens); one row a document, no other column."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(vocabulary, pattern)
        for b in batches:
            yield pd.DataFrame({"n_tokens": pd.Series([len(enc.encode_ordinary(x)) if x else 0 for x in b["text"]], dtype="int64")})

    return in_batches(docs).select(F.col(text).alias("text")).mapInPandas(count, "n_tokens long")


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """One row a distinct length: n_docs, n_tokens_total, and sums over the whole histogram at that length.

    docs_ge / tokens_ge: documents at least so long and their tokens (suffix sums); truncated_total: tokens left
    if every document were cut to this length; docs_le and share_le: documents no longer than it. Null lengths
    count as 0; an empty table gives no rows. Only the histogram, not the documents, goes through a window.
    """
    hist = lengths.groupBy(F.coalesce(F.col(column), F.lit(0)).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))
    hist = prefix_sums(hist, ["length"], {"docs_lt": F.col("n_docs"), "tokens_lt": F.col("n_docs") * F.col("length")}, "lengths")
    docs_ge, tokens_ge = F.col("_total_docs_lt") - F.col("docs_lt"), F.col("_total_tokens_lt") - F.col("tokens_lt")
    return hist.select(
        "length",
        "n_docs",
        (F.col("n_docs") * F.col("length")).alias("n_tokens_total"),
        docs_ge.alias("docs_ge"),
        tokens_ge.alias("tokens_ge"),
        (F.col("tokens_lt") + F.col("length") * docs_ge).alias("truncated_total"),
        (F.col("docs_lt") + F.col("n_docs")).alias("docs_le"),
        ((F.col("docs_lt") + F.col("n_docs")) / F.col("_total_docs_lt")).alias("share_le"),
    )


def quantiles(hist: DataFrame, qs: list[float]) -> DataFrame:
    """(q, length): the least length that a share q of the documents doesn't exceed, for each q asked."""
    asked = hist.sparkSession.createDataFrame([(float(q),) for q in qs], "q double")
    near = hist.join(F.broadcast(asked), F.col("share_le") >= F.col("q") - 1e-12)  # qs is the caller's short list
    return near.groupBy("q").agg(F.min("length").alias("length"))


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context, tokens, truncated_docs): tokens left and documents cut for any context limits, also between lengths.

    From the histogram alone: the rows up to the limit give their tokens, all others give the limit.
    """
    asked = hist.sparkSession.createDataFrame([(int(x),) for x in limits], "context long")
    each = hist.crossJoin(F.broadcast(asked)) if limits else hist.join(asked)  # histogram x the caller's short list
    return each.groupBy("context").agg(
        F.sum(F.col("n_docs") * F.least("length", "context")).alias("tokens"),
        F.sum(F.when(F.col("length") > F.col("context"), F.col("n_docs")).otherwise(0)).alias("truncated_docs"),
    )
