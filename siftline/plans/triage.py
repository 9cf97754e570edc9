"""Whole plans: log to labelled table, strategies side by side, label comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import fusion, propagate, rules
from siftline.operators.model import Predictor


def triage(messages: DataFrame, rule_set: list[rules.Rule], taxonomy: list[str], predictor: Predictor | None = None, key: str = "ip", threshold: float = rules.THRESHOLD) -> DataFrame:
    """messages with rule, model, fused and key verdicts, and final_category: the fused one, else that of the row's key.

    The rules run once; the model, if any, adds model_cat and model_conf. The key's map is learnt from the rows' own verdicts.
    """
    x = rules.classify(messages, rule_set, taxonomy, threshold)
    x = predictor(x) if predictor else x.withColumns({"model_cat": F.lit(""), "model_conf": F.lit(0.0)})
    x = x.withColumnRenamed("rule_category", "rule_cat").withColumnRenamed("rule_confidence", "rule_conf").drop("category")
    return propagate.two_pass(fusion.fuse_rows(x), key)


def strategies(x: DataFrame) -> DataFrame:
    """Long table (strategy, seq, record_id, category, confidence, source) of the verdicts of one triaged table."""
    one = lambda name, cat, conf, source: x.select(F.lit(name).alias("strategy"), "seq", "record_id", F.col(cat).alias("category"), F.col(conf).alias("confidence"), source.alias("source"))
    return one("rule", "rule_cat", "rule_conf", F.lit("rule")).unionByName(one("model", "model_cat", "model_conf", F.lit("model"))).unionByName(one("fused", "category", "confidence", F.col("source")))
