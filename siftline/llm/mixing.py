"""Temperature mixing of sources to target weights, realised as budgeted block permutations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import SPACE_CLASS, join_hot, prefix_sums, stash

#: No source is gone through more often than this; tokens of one block of the mixture; expected rows of a slot of a permutation.
MAX_EPOCHS, BLOCK_TOKENS, SLOT_ROWS = 2.0, 1_000_000, 4096
#: Exponents that one pass over the table of sources tries, decimals to which the exponent is settled.
TRIES, DECIMALS = 15, 6
SEED = "mix-1"

N_TOKENS = rf"CAST(size(filter(split(coalesce(text, ''), r'[{SPACE_CLASS}]+'), x -> x <> '')) AS BIGINT)"


def bisect_exponent(shares: DataFrame, measure: Callable[[float], Column], target: float) -> float:
    """The exponent in [0, 1] at which `measure`, an aggregate over shares p that falls as the exponent rises, meets the target.

    The nearer end if it is always above or below; 1 without sources. The interval is cut at TRIES points at once, that is some
    halvings for each pass over the table of sources.
    """
    lo, hi = 0.0, 1.0
    while hi - lo > 0.1 * 10**-DECIMALS:
        cuts = [lo + (hi - lo) * k / (TRIES + 1) for k in range(TRIES + 2)]
        got = list(shares.agg(*(measure(a).alias(f"m{k}") for k, a in enumerate(cuts))).first())
        if got[0] is None or got[-1] > target:
            return 1.0 if got[0] is None else round(hi, DECIMALS)
        k = next(i for i, v in enumerate(got) if v <= target)
        if k == 0:
            return round(lo, DECIMALS)
        lo, hi = cuts[k - 1], cuts[k]
    return round((lo + hi) / 2, DECIMALS)


def repetition(a: float) -> Column:
    """Epochs of the most repeated source when the least repeated one is gone through once."""
    e = F.pow(F.col("p"), F.lit(a - 1))
    return F.max(e) / F.min(e)


def entropy(a: float) -> Column:
    """Entropy, in nats, of the weights p^a / sum(p^a)."""
    w = F.pow(F.col("p"), F.lit(a))
    return F.log(F.sum(w)) - a * F.sum(w * F.log("p")) / F.sum(w)


def mixing_table(totals: DataFrame, max_epochs: float = MAX_EPOCHS, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """totals (one row per source: _key, n_docs, tokens) with p, alpha, weight, epochs and quota (tokens to draw).

    alpha is bisected to the flattest mixture whose repetition is at most max_epochs or, if target_entropy is given, to that
    entropy. Without a budget the least repeated source is drawn whole once, so every document is drawn; with one, each source's
    quota is budget * weight. A source without tokens has weight 0 and is drawn once.
    """
    whole = totals.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    p = stash(totals.withColumn("p", F.col("tokens") / F.lit(float(max(1, whole)))), "mix-shares")
    some = p.where("tokens > 0")
    alpha = bisect_exponent(some, repetition, max_epochs) if target_entropy is None else bisect_exponent(some, entropy, target_entropy)
    norm = some.agg(F.sum(F.pow("p", F.lit(alpha))).alias("s"), F.min(F.pow("p", F.lit(alpha - 1))).alias("e")).first()
    weight = F.when(F.col("tokens") > 0, F.pow("p", F.lit(alpha)) / F.lit(norm["s"] or 1.0)).otherwise(0.0)
    if budget is None:
        epochs = F.round(F.pow("p", F.lit(alpha - 1)) / F.lit(norm["e"] or 1.0), 9)
    else:
        epochs = F.round(F.lit(float(budget)) * weight / F.col("tokens"), 9)
    epochs = F.when(F.col("tokens") > 0, epochs).otherwise(1.0)
    return p.withColumns({"alpha": F.lit(alpha), "weight": weight, "epochs": epochs}).withColumn("quota", F.floor(F.col("tokens") * F.col("epochs") + 1e-6))


def mix(docs: DataFrame, max_epochs: float = MAX_EPOCHS, target_entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = SEED) -> DataFrame:
    """The mixture: doc_id, source, n_tokens, epoch, block, start and key, one row for each time a document is drawn.

    Tokens are words. Each epoch of a source is a permutation of its documents by a hash; start is the position in the source's
    stream of epochs, and a document is drawn if it starts before the source's quota, so quotas are met to within one document.
    block deals all streams evenly over blocks of about block_tokens, so each block holds the sources in their weights; within a
    block, rows are ordered by key. A source without tokens is drawn once. Null sources are one source, a null text has no tokens,
    rows that repeat a doc_id are documents of their own; other columns are ignored. No rows, no mixture.
    """
    key = F.to_json(F.struct("source"))
    rows = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.expr(N_TOKENS).alias("n_tokens"), key.alias("_key")), "mix-rows")
    totals = rows.groupBy("_key").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    table = stash(mixing_table(totals, max_epochs, target_entropy, budget), "mix-table")
    whole = table.agg(F.sum("quota").alias("q")).first()["q"] or 0
    blocks = max(1, -(-int(whole) // block_tokens))
    x = join_hot(rows, table.select("_key", "n_docs", "tokens", "quota"), "_key", "n_docs", how="inner")
    last = F.when(F.col("tokens") > 0, F.expr("(quota - 1) DIV tokens")).otherwise(0)
    x = x.withColumn("epoch", F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))))
    x = x.withColumn("key", F.md5(F.concat_ws("|", F.lit(seed), F.col("epoch"), F.col("doc_id")).cast("binary")))
    slots = F.ceil(F.col("n_docs") / SLOT_ROWS)
    x = x.withColumn("_slot", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * slots, 32))
    x = prefix_sums(x, ["_key", "epoch"], [F.col("key"), F.col("n_tokens")], {"_before": "n_tokens"}, SLOT_ROWS)
    x = x.withColumn("start", F.col("epoch") * F.col("tokens") + F.col("_before")).where("start < quota OR tokens = 0")
    block = F.when(F.col("quota") > 0, F.expr(f"CAST(start AS DECIMAL(20,0)) * {blocks} DIV quota")).otherwise(0)
    return x.select("doc_id", "source", "n_tokens", "epoch", block.cast("long").alias("block"), "start", "key")
