"""Fusion of rule and model verdicts, its report, and hybrid policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import or_empty


def fuse(rule_cat: Column, rule_conf: Column, model_cat: Column, model_conf: Column) -> Column:
    """struct(category, confidence, source); the first case that applies: a sure model; agreement; a fair model, at 0.1 less; a
    strong rule; any model; any rule; nothing."""
    rule_cat, model_cat = or_empty(rule_cat), or_empty(model_cat)
    has_model, has_rule = model_cat != "", rule_cat != ""

    def verdict(cat, conf, source):
        return F.struct(cat.alias("category"), conf.cast("double").alias("confidence"), F.lit(source).alias("source"))

    return (
        F.when(has_model & (model_conf >= 0.8), verdict(model_cat, model_conf, "model"))
        .when(has_model & (model_cat == rule_cat), verdict(model_cat, F.greatest(model_conf, rule_conf), "consensus"))
        .when(has_model & (model_conf >= 0.5), verdict(model_cat, model_conf - 0.1, "model"))
        .when(has_rule & (rule_conf >= 0.7), verdict(rule_cat, rule_conf, "rule_fallback"))
        .when(has_model, verdict(model_cat, model_conf, "model"))
        .when(has_rule, verdict(rule_cat, rule_conf, "rule_fallback"))
        .otherwise(verdict(F.lit(""), F.lit(0.0), ""))
    )


def fuse_rows(rows: DataFrame) -> DataFrame:
    """rows (rule_cat, rule_conf, model_cat, model_conf) with category, confidence and source."""
    f = fuse(F.col("rule_cat"), F.col("rule_conf"), F.col("model_cat"), F.col("model_conf"))
    return rows.withColumn("_f", f).select("*", "_f.*").drop("_f")


def confidence_bucket(conf: Column) -> Column:
    return F.when(conf < 0.3, "0.0-0.3").when(conf < 0.5, "0.3-0.5").when(conf < 0.7, "0.5-0.7").when(conf < 0.9, "0.7-0.9").otherwise("0.9-1.0")


def confidence_buckets(fused: DataFrame) -> DataFrame:
    return fused.where("category <> ''").groupBy(confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("cnt"))


def confidence_by_category(fused: DataFrame) -> DataFrame:
    """Number, mean, least, largest and upper median of the confidence of each category, to three places.

    The median is the smallest value that more than half of the rows do not exceed, from the counts of distinct values, so no
    list of a category's rows is made."""
    from pyspark.sql.window import Window

    rows = fused.where("category <> ''")
    counts = rows.groupBy("category", "confidence").agg(F.count("*").alias("k"))
    w = Window.partitionBy("category")
    upto = counts.select("category", "confidence", F.sum("k").over(w.orderBy("confidence")).alias("c"), F.sum("k").over(w).alias("n"))
    median = upto.where(F.col("c") > F.floor(F.col("n") / 2)).groupBy("category").agg(F.min("confidence").alias("median"))
    stats = rows.groupBy("category").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.min("confidence").alias("low"), F.max("confidence").alias("high"))
    return stats.join(median, "category").select("category", "n", *(F.bround(x, 3).alias(x) for x in ("mean", "low", "high", "median")))


def source_counts(fused: DataFrame) -> DataFrame:
    return fused.groupBy("source").agg(F.count("*").alias("cnt"))


def agreement_pairs(fused: DataFrame, limit: int = 30) -> DataFrame:
    pairs = fused.where("rule_cat <> '' AND model_cat <> ''").groupBy("rule_cat", "model_cat").agg(F.count("*").alias("cnt"))
    return pairs.orderBy(F.desc("cnt"), "rule_cat", "model_cat").limit(limit)


def override_pairs(fused: DataFrame, limit: int = 20) -> DataFrame:
    """Where the model's verdict stood against a rule's."""
    pairs = fused.where("source = 'model' AND rule_cat <> '' AND rule_cat <> category").groupBy("rule_cat", "category").agg(F.count("*").alias("cnt"))
    return pairs.orderBy(F.desc("cnt"), "rule_cat", "category").limit(limit)


def coverage(rows: DataFrame, column: str) -> DataFrame:
    n = F.count_if(or_empty(F.col(column)) != "")
    return rows.agg(F.count("*").alias("total"), n.alias("classified"), F.coalesce(F.bround(F.try_divide(100.0 * n, F.count("*")), 1), F.lit(0.0)).alias("pct"))


def report(fused: DataFrame, taxonomy: list[str]) -> dict[str, DataFrame]:
    """All sections of the fusion report; a category outside the taxonomy is shown like any other."""
    spark = fused.sparkSession
    names = spark.createDataFrame([(k, c) for k, c in enumerate(taxonomy)], "ord int, category string")
    rules = fused.groupBy(F.col("rule_cat").alias("category")).agg(F.count("*").alias("cnt")).where("category <> ''")
    return {
        "buckets": confidence_buckets(fused), "by_category": confidence_by_category(fused), "sources": source_counts(fused), "agreement": agreement_pairs(fused),
        "overrides": override_pairs(fused), "rule_coverage": coverage(fused, "rule_cat"), "rule_distribution": names.join(rules, "category", "full").select("category", F.coalesce("cnt", F.lit(0)).alias("cnt")),
    }


def rule_when(min_rule: float, below: float = 0.7) -> Column:
    """The rule's category where the model is unsure and the rule is not."""
    return F.when((F.col("model_conf") < below) & (F.col("rule_cat") != "") & (F.col("rule_conf") >= min_rule), F.col("rule_cat")).otherwise(F.col("model_cat"))


def policies() -> dict[str, Column]:
    rule_else_model = F.when(F.col("rule_cat") != "", F.col("rule_cat")).otherwise(F.col("model_cat"))
    return {"model_only": F.col("model_cat"), "rule_else_model": rule_else_model, "rule_if_03": rule_when(0.3), "rule_if_05": rule_when(0.5), "rule_if_07": rule_when(0.7)}


def rule_for(categories: list[str], below: float = 0.7) -> Column:
    """The rule's category where the model is unsure of one of these categories."""
    return F.when((F.col("model_conf") < below) & F.col("model_cat").isin(categories) & (F.col("rule_cat") != ""), F.col("rule_cat")).otherwise(F.col("model_cat"))


def hybrid_scores(rows: DataFrame, candidates: dict[str, Column]) -> DataFrame:
    """policy, n, correct, accuracy of each policy against `truth`, in one pass."""
    sums = rows.agg(F.count("*").alias("n"), *(F.count_if(v == F.col("truth")).alias(k) for k, v in candidates.items()))
    stack = ", ".join(f"'{k}', `{k}`" for k in candidates)
    long = sums.selectExpr("n", f"stack({len(candidates)}, {stack}) AS (policy, correct)")
    return long.withColumn("accuracy", F.coalesce(F.try_divide(F.col("correct"), F.col("n")), F.lit(0.0)))


def summary(fused: DataFrame, key_category: str | None = None) -> DataFrame:
    """One row of counters: total, classified, unclassified and, if that column is given, by_key: rows that only their key classified."""
    own = F.count_if(or_empty(F.col("category")) != "")
    by_key = [] if key_category is None else [F.count_if((or_empty(F.col("category")) == "") & (or_empty(F.col(key_category)) != "")).alias("by_key")]
    return fused.agg(F.count("*").alias("total"), own.alias("classified"), (F.count("*") - own).alias("unclassified"), *by_key)


def long_report(sections: dict[str, DataFrame]) -> DataFrame:
    """section, k1, k2, n of report sections that count (cnt, classified or n) by up to two keys, as one table."""
    out = None
    for name, df in sections.items():
        n = next(c for c in ("cnt", "classified", "n", "total") if c in df.columns)
        keys = [c for c, t in df.dtypes if t == "string"]
        k = [F.col(c) for c in keys[:2]] + [F.lit(None).cast("string")] * (2 - len(keys[:2]))
        part = df.select(F.lit(name).alias("section"), k[0].alias("k1"), k[1].alias("k2"), F.col(n).cast("long").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out
