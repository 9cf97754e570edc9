"""Exact histogram of encoded lengths; suffix sums answer totals, quantiles and truncated totals for every context limit."""

from __future__ import annotations

import base64
import functools
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import map_arrow, prefix_sums, stash

#: Where the public vocabulary files are.
TOKENIZERS = os.environ.get("SIFTLINE_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
#: The fixed splitting pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLOT = 1024


@functools.lru_cache(2)
def encoder(folder: str = TOKENIZERS, ranks: str = RANKS):
    import tiktoken

    with open(f"{folder}/{ranks}", "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def with_lengths(docs: DataFrame, folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens of every whole text; a null or empty text has 0 tokens, marks of special tokens are ordinary text.

    Rows that repeat a doc_id are counted one by one, no rows give none; no other column is looked at, whatever its name."""

    def count(batches):
        enc = encoder(folder, ranks)
        for b in batches:
            n = [0 if x is None else len(enc.encode_to_numpy(x, disallowed_special=())) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), count, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """Exact histogram n_tokens, n_docs: partial counts map-side, then one row per length."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_table(hist: DataFrame) -> DataFrame:
    """One row per distinct length L = n_tokens, from the histogram alone:

    n_docs, doc_tokens (L * n_docs), docs_from and tokens_from (documents of L tokens or more, and their tokens), docs_upto and
    tokens_upto (of at most L), truncated_tokens (the corpus total if every document is cut to L), lost_tokens (what that cuts off)
    and quantile (share of documents of at most L tokens). Lengths are summed in slots of SLOT, so no task holds the whole
    histogram. No documents: no rows.
    """
    h = hist.withColumn("doc_tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("_slot", F.floor(F.col("n_tokens") / SLOT)).withColumn("_one", F.lit(0))
    before = prefix_sums(h, ["_one"], [F.col("n_tokens")], {"docs_under": "n_docs", "tokens_under": "doc_tokens"}, SLOT)
    total = hist.agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("tokens")).first()  # two numbers
    x = before.withColumns({"_docs": F.lit(total["docs"] or 0).cast("long"), "_tokens": F.lit(total["tokens"] or 0).cast("long")})
    return x.select(
        "n_tokens", "n_docs", "doc_tokens",
        (F.col("_docs") - F.col("docs_under")).alias("docs_from"),
        (F.col("_tokens") - F.col("tokens_under")).alias("tokens_from"),
        (F.col("docs_under") + F.col("n_docs")).alias("docs_upto"),
        (F.col("tokens_under") + F.col("doc_tokens")).alias("tokens_upto"),
        (F.col("tokens_under") + F.col("n_tokens") * (F.col("_docs") - F.col("docs_under"))).alias("truncated_tokens"),
        (F.col("_tokens") - F.col("tokens_under") - F.col("n_tokens") * (F.col("_docs") - F.col("docs_under"))).alias("lost_tokens"),
        ((F.col("docs_under") + F.col("n_docs")) / F.col("_docs")).alias("quantile"),
    )


def at_limit(table: DataFrame, limit: int) -> DataFrame:
    """One row: docs_cut, kept_tokens and lost_tokens if every document is cut to `limit` tokens, from the suffix table."""
    over = F.col("n_tokens") > limit
    return table.agg(
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
        F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("kept_tokens"),
        F.coalesce(F.sum(F.when(over, (F.col("n_tokens") - limit) * F.col("n_docs"))), F.lit(0)).alias("lost_tokens"),
    )


def length_at_quantile(table: DataFrame, q: float) -> DataFrame:
    """One row, n_tokens: the least length such that a share q of the documents is no longer; null if there are none."""
    return table.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def length_report(docs: DataFrame, folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """The suffix table of a corpus; the histogram, a few bytes per distinct length, is written once and reread.

    Null and empty texts have length 0, rows that repeat a doc_id count each, and no rows give no table; further columns of docs,
    such as one named n_tokens, are ignored."""
    return suffix_table(stash(histogram(with_lengths(docs, folder, ranks)), "lengths"))
