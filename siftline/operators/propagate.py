"""Label propagation over a shared key such as a source address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import or_empty, strip

MIN_SAMPLES, MIN_PURITY, FULL = 3, 0.6, 10
#: Labelled rows from which a key counts as hot, most hot keys (all that is broadcast), and parts that each is dealt into.
HOT_ROWS, HOT_KEYS, PARTS = 100_000, 4096, 64


def salted_left_join(left: DataFrame, right: DataFrame, key: str, weights: DataFrame, order: str) -> DataFrame:
    """left with right (one row per key) joined to it; rows of hot keys (weights: key, n) are dealt into PARTS by a hash of `order`, so
    no task gets all rows of a key. left is read once."""
    hot = weights.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), key).limit(HOT_KEYS).select(key, F.lit(PARTS).alias("_parts"))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(order), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    each = right.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1))).drop("_parts")
    return dealt.join(each, [key, "_part"], "left").drop("_part")


def fit_keys(messages: DataFrame, key: str = "ip", min_samples: int = MIN_SAMPLES, min_purity: float = MIN_PURITY, order: str = "seq") -> DataFrame:
    """key, category, purity, n of the keys whose labelled rows mostly agree; of equal categories the one seen first.

    Two aggregations, (key, category) and then key: a key's rows are counted map-side and never meet in one place.
    """
    rows = messages.where((or_empty(F.col("category")) != "") & (strip(or_empty(F.col(key))) != ""))
    pairs = rows.groupBy(key, "category").agg(F.count("*").alias("c"), F.min(order).alias("first"))
    top = F.max_by("category", F.struct(F.col("c"), -F.col("first")))
    keys = pairs.groupBy(key).agg(F.sum("c").alias("n"), F.max("c").alias("most"), top.alias("category"))
    purity = F.col("most") / F.col("n")
    return keys.where((F.col("n") >= min_samples) & (purity >= min_purity)).select(key, "category", purity.alias("purity"), "n")


def predict(messages: DataFrame, keys: DataFrame, key: str = "ip", order: str = "seq") -> DataFrame:
    """messages with key_category and key_confidence, half the purity and less for fewer samples; '' and 0 for unknown keys."""
    known = keys.select(F.col(key), F.col("category").alias("key_category"), F.bround(0.5 * F.col("purity") * F.least(F.lit(1.0), F.col("n") / FULL), 3).alias("key_confidence"))
    out = salted_left_join(messages, known, key, keys.select(F.col(key), F.col("n")), order)
    return out.withColumns({"key_category": F.coalesce("key_category", F.lit("")), "key_confidence": F.coalesce("key_confidence", F.lit(0.0))})


def propagate(messages: DataFrame, keys: DataFrame, key: str = "ip") -> DataFrame:
    """The unclassified rows whose key is known, with the category and confidence that they get; one pass, not transitive."""
    rows = messages.where(or_empty(F.col("category")) == "")
    got = predict(rows.drop("category"), keys, key).where("key_category <> ''")
    return got.withColumnRenamed("key_category", "category").withColumnRenamed("key_confidence", "confidence").withColumn("source", F.lit("key"))


def key_stats(keys: DataFrame) -> DataFrame:
    return keys.groupBy("category").agg(F.count("*").alias("keys"))


def two_pass(messages: DataFrame, key: str = "ip", min_samples: int = MIN_SAMPLES, min_purity: float = MIN_PURITY) -> DataFrame:
    """messages (category from rules) with final_category: their own, else what their key tells."""
    keys = fit_keys(messages, key, min_samples, min_purity)
    return predict(messages, keys, key).withColumn("final_category", F.when(or_empty(F.col("category")) != "", F.col("category")).otherwise(F.col("key_category")))
