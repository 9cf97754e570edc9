"""Reproducible samples and splits: the order of a seeded hash stands in for chance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.functions.text import or_empty


def draw(seed: str, key: str = "record_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))


def _first_per_group(rows: DataFrame, group: str, quota: Column, order: list[str], most: int) -> DataFrame:
    """The first rows of each group by `order`, as many as its quota (at most `most`).

    Spark keeps the best `most` rows of a group in each task before the shuffle, so a hot group does not meet in one place."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where((F.col("_rank") <= most) & (F.col("_rank") <= quota)).drop("_rank")


def quota_sample(messages: DataFrame, quotas: dict[str, int], seed: str, used: DataFrame | None = None, key: str = "record_id") -> DataFrame:
    """As many rows of each category as its quota, or all there are; '' stands for unclassified rows. Rows in `used` are left out."""
    rows = messages if used is None else messages.join(used.select(key), key, "left_anti")
    rows = rows.withColumns({"_g": or_empty(F.col("category")), "_h": draw(seed, key)})
    pairs = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    rows = rows.where(F.col("_g").isin(list(quotas)))
    return _first_per_group(rows, "_g", F.try_element_at(pairs, F.col("_g")), ["_h", key], max(quotas.values(), default=0)).drop("_g", "_h")


def proportional_quotas(counts: dict[str, int], n: int, floor: int = 10) -> dict[str, int]:
    """Quotas of n rows in proportion to counts, at least `floor` or all there are; what is over or missing is made up one by one
    where most rows are free, or from the largest quota above its floor."""
    total = sum(counts.values())
    if not total:
        return {}
    least = {c: min(floor, k) for c, k in counts.items()}
    quota = {c: min(k, max(least[c], round(n * k / total))) for c, k in counts.items()}
    n = min(n, total)
    while (now := sum(quota.values())) < n:
        quota[max(sorted(counts), key=lambda c: counts[c] - quota[c])] += 1
    while now > n:
        over = [c for c in sorted(quota) if quota[c] > least[c]]
        if not over:
            break
        quota[max(over, key=lambda c: quota[c])] -= 1
        now -= 1
    return quota


def proportional_sample(messages: DataFrame, n: int, seed: str, key: str = "record_id") -> DataFrame:
    counts = {r["category"]: r["cnt"] for r in messages.where("coalesce(category, '') <> ''").groupBy("category").agg(F.count("*").alias("cnt")).collect()}  # one row per category
    return quota_sample(messages, proportional_quotas(counts, n), seed, key=key) if counts else messages.limit(0)


def capped_per_label(rows: DataFrame, label: str, n: int = 50, seed: str = "42", key: str = "record_id") -> DataFrame:
    """At most n rows of each label, null ones among them, in the order of a seeded hash."""
    return _first_per_group(rows.withColumn("_h", draw(seed, key)), label, F.lit(n), ["_h", key], n).drop("_h")


def split_distribution(parts: DataFrame, label: str) -> DataFrame:
    """split, label, cnt of split rows."""
    return parts.groupBy("split", F.col(label).alias("label")).agg(F.count("*").alias("cnt"))


def random_rows(messages: DataFrame, n: int, seed: str, key: str = "record_id") -> DataFrame:
    return messages.orderBy(draw(seed, key), key).limit(n)


def split_sizes(n: int, test: float = 0.15, val: float = 0.15) -> tuple[int, int, int]:
    """train, validation and test rows of n: test first, validation as its share of the rest, both rounded up."""
    t = math.ceil(n * test)
    v = math.ceil((n - t) * (val / (1 - test)) - 1e-9)
    return n - t - v, v, t


def stratified_split(rows: DataFrame, label: str, seed: str = "42", key: str = "record_id", test: float = 0.15, val: float = 0.15) -> DataFrame:
    """rows with `split`: within each label, rows by the order of a hash go to test, validation and train in the given shares.

    The share that falls to a label is the difference of rounded running totals over labels, so totals are those of split_sizes().
    A label's rows are ranked within slots of its hash and the slots' totals added up, so no task holds a whole label.
    """
    slot = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    x = rows.withColumn("_h", draw(seed, key)).withColumns({"_slot": slot, "_key": F.to_json(F.struct(label))})  # a null label is one like others
    counts = x.groupBy("_key", "_slot").agg(F.count("*").alias("_k"), F.first(label).alias("_label"))
    before = counts.select("_key", "_slot", F.coalesce(F.sum("_k").over(Window.partitionBy("_key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    labels = counts.groupBy("_key").agg(F.sum("_k").alias("n"), F.first("_label").alias("_label")).orderBy("_label").collect()  # one row per label
    total = sum(r["n"] for r in labels)
    _, v_all, t_all = split_sizes(total, test, val)
    sizes, done = [], 0
    for r in labels:
        a, z = done, done + r["n"]
        done = z
        sizes.append((r["_key"], round(t_all * z / total) - round(t_all * a / total), round(v_all * z / total) - round(v_all * a / total)))
    table = rows.sparkSession.createDataFrame(sizes, "_key string, _t long, _v long")
    rank = F.row_number().over(Window.partitionBy("_key", "_slot").orderBy("_h", key)) + F.col("_before")
    x = x.join(before, ["_key", "_slot"]).join(F.broadcast(table), "_key").withColumn("_r", rank)
    split = F.when(F.col("_r") <= F.col("_t"), "test").when(F.col("_r") <= F.col("_t") + F.col("_v"), "validation").otherwise("train")
    return x.withColumn("split", split).drop("_h", "_slot", "_key", "_before", "_t", "_v", "_r").select(*rows.columns, "split")


def class_weights(rows: DataFrame, label: str, taxonomy: list) -> DataFrame:
    """label, cnt, weight = sqrt(total / cnt) / classes to four places for each class of the taxonomy; a missing class counts 1."""
    names = rows.sparkSession.createDataFrame([(c,) for c in taxonomy], f"{label} {rows.schema[label].dataType.simpleString()}")
    counts = rows.groupBy(label).agg(F.count("*").alias("cnt"))
    total = rows.count()
    x = names.join(counts, label, "left").select(label, F.coalesce("cnt", F.lit(1)).alias("cnt"))
    return x.withColumn("weight", F.bround(F.sqrt(F.lit(float(total)) / F.col("cnt")) / len(taxonomy), 4))
