"""Mapping of free labels to classes: keyword schemes, exact lists, balance of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import contains_any

#: A scheme: classes with their keywords, in the order in which they are tried.
Scheme = list[tuple[str, list[str]]]


def keyword_class(label: Column, scheme: Scheme, default: str | None = None) -> Column:
    """The first class one of whose keywords is in the label (case counts); the default if none is."""
    out = F.lit(default).cast("string")
    for name, words in reversed(scheme):
        out = F.when(contains_any(label, words), name).otherwise(out)
    return out


def exact_table(spark, lists: dict[str, list[str]]) -> DataFrame:
    """label, class of exact lists; of a label in several lists the last one counts."""
    return spark.createDataFrame(sorted({w: c for c, words in lists.items() for w in words}.items()) or [], "label string, class string")


def map_labels(labels: DataFrame, lists: dict[str, list[str]], scheme: Scheme, default: str) -> DataFrame:
    """labels with class: by exact list, else by keyword, else the default. The lists are written by people and broadcast."""
    table = exact_table(labels.sparkSession, lists)
    return labels.join(F.broadcast(table), "label", "left").withColumn("class", F.coalesce("class", keyword_class(F.col("label"), scheme, default)))


def preview(labels: DataFrame, scheme: Scheme, examples: int = 8) -> dict[str, DataFrame]:
    """Of labels (label, cnt): the scheme's distribution, unmapped labels, most frequent labels of each class, and the spread."""
    from pyspark.sql.window import Window

    x = labels.withColumn("class", keyword_class(F.col("label"), scheme))
    by = x.where("class IS NOT NULL").groupBy("class").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("labels"))
    w = Window.partitionBy("class").orderBy(F.desc("cnt"), "label")
    tops = x.where("class IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= examples)
    return {"distribution": by, "unmapped": x.where("class IS NULL").orderBy(F.desc("cnt"), "label").limit(15), "examples": tops, "spread": spread(by)}


def spread(classes: DataFrame) -> DataFrame:
    """Range, sample deviation and its quotient by the mean of class sizes (cnt)."""
    return classes.agg((F.max("cnt") - F.min("cnt")).alias("range"), F.stddev_samp("cnt").alias("stdev"), F.try_divide(F.stddev_samp("cnt"), F.avg("cnt")).alias("cv"))


def assigned_sizes(labels: DataFrame, lists: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(class, cnt, labels) of exact lists, a label in several lists counting in each, and the labels in none."""
    table = labels.sparkSession.createDataFrame([(w, c) for c, words in lists.items() for w in words], "label string, class string")
    sizes = labels.join(F.broadcast(table), "label").groupBy("class").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("labels"))
    return sizes, labels.join(F.broadcast(table.select("label").distinct()), "label", "left_anti")


def head_and_rest(labels: DataFrame, n: int = 40) -> DataFrame:
    """The n most frequent labels, and the rest as one row (label null)."""
    head = labels.orderBy(F.desc("cnt"), "label").limit(n)
    rest = labels.join(head.select("label"), "label", "left_anti").agg(F.lit(None).cast("string").alias("label"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("cnt"))
    return head.select("label", "cnt").unionByName(rest.select("label", "cnt"))
