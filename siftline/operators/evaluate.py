"""Evaluation of labelling strategies: coverage, agreement, confusion, precision, recall, F1, IoU and alignment of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import or_empty


def valid_label(taxonomy: list[str], category: str = "llm_category", confidence: str = "llm_confidence", error: str = "error", least: float = 0.5) -> Column:
    return (or_empty(F.col(error)) == "") & F.col(category).isin(taxonomy) & (F.col(confidence) >= least)


def training_label(taxonomy: list[str], least: float = 0.5) -> tuple[Column, Column, Column]:
    """category, confidence and whether a row can be trained on: the labeller's where it is neither empty nor 0, else the rule's."""
    cat = F.coalesce(F.nullif("llm_category", F.lit("")), F.nullif("rule_category", F.lit("")), F.lit(""))
    conf = F.coalesce(F.nullif("llm_confidence", F.lit(0.0)), F.nullif("rule_confidence", F.lit(0.0)), F.lit(0.0))
    return cat, conf, cat.isin(taxonomy) & (conf >= least)


def strategy_coverage(long: DataFrame) -> DataFrame:
    """strategy, total, classified, pct of a long table (strategy, category)."""
    n = F.count_if(or_empty(F.col("category")) != "")
    return long.groupBy("strategy").agg(F.count("*").alias("total"), n.alias("classified"), F.bround(100.0 * n / F.count("*"), 1).alias("pct"))


def strategy_distribution(long: DataFrame) -> DataFrame:
    return long.groupBy("strategy", "category").agg(F.count("*").alias("cnt"))


def pairwise_agreement(wide: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, agree, total of every pair of verdict columns; two empty verdicts agree. All pairs in one pass."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    sums = wide.agg(F.count("*").alias("total"), *(F.count_if(or_empty(F.col(a)) == or_empty(F.col(b))).alias(f"p{k}") for k, (a, b) in enumerate(pairs)))
    stack = ", ".join(f"'{a}', '{b}', p{k}" for k, (a, b) in enumerate(pairs))
    return sums.selectExpr("total", f"stack({len(pairs)}, {stack}) AS (a, b, agree)")


def confidence_bands(long: DataFrame) -> DataFrame:
    rows = long.where(or_empty(F.col("category")) != "")
    c = F.col("confidence")
    return rows.groupBy("strategy").agg(
        F.bround(F.avg(c), 4).alias("mean_conf"), F.count_if(c >= 0.9).alias("high"), F.count_if((c >= 0.7) & (c < 0.9)).alias("medium"),
        F.count_if((c >= 0.5) & (c < 0.7)).alias("low"), F.count_if(c < 0.5).alias("very_low"),
    )


def wins(wide: DataFrame, rule: str = "rule_cat", model: str = "model_cat") -> DataFrame:
    """model_wins: both verdicts differ, or only the model has one; rule_wins: only the rule has one."""
    r, m = or_empty(F.col(rule)), or_empty(F.col(model))
    return wide.agg(F.count_if((m != "") & (m != r)).alias("model_wins"), F.count_if((r != "") & (m == "")).alias("rule_wins"))


def confusion(rows: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("cnt"))


def per_class(matrix: DataFrame, taxonomy: list[str]) -> DataFrame:
    """category, tp, fp, fn, precision, recall, f1, iou of each class of the taxonomy, from a confusion table (truth, pred, cnt).

    A wrong prediction outside the taxonomy counts against its truth alone. Quotients without a denominator are 0.
    """
    spark = matrix.sparkSession
    names = spark.createDataFrame([(c,) for c in taxonomy], "category string")
    right = F.when(F.col("truth").eqNullSafe(F.col("pred")), F.col("cnt")).otherwise(0)
    wrong = F.col("cnt") - right
    by_truth = matrix.groupBy(F.col("truth").alias("category")).agg(F.sum(right).alias("tp"), F.sum(wrong).alias("fn"))
    by_pred = matrix.groupBy(F.col("pred").alias("category")).agg(F.sum(wrong).alias("fp"))
    x = names.join(by_truth, "category", "left").join(by_pred, "category", "left").na.fill(0, ["tp", "fp", "fn"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return x.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "iou": ratio(tp, tp + fp + fn)})


def scores(matrix: DataFrame, taxonomy: list[str]) -> DataFrame:
    """One row: n, accuracy, macro_f1, weighted_f1, iou_score (times 100) over the classes of the taxonomy."""
    c = per_class(matrix, taxonomy)
    total = matrix.agg(F.sum("cnt").alias("n"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("cnt")).otherwise(0)).alias("right")).first()
    n, right = total["n"] or 0, total["right"] or 0
    support = F.col("tp") + F.col("fn")
    return c.agg(F.avg("f1").alias("macro_f1"), F.coalesce(F.try_divide(F.sum(F.col("f1") * support), F.sum(support)), F.lit(0.0)).alias("weighted_f1"), (100 * F.avg("iou")).alias("iou_score")).select(F.lit(n).cast("long").alias("n"), F.lit(right / n if n else 0.0).alias("accuracy"), "macro_f1", "weighted_f1", "iou_score")


def disagreements(rows: DataFrame, limit: int = 50, order: str = "seq") -> DataFrame:
    return rows.where(~F.col("truth").eqNullSafe(F.col("pred"))).orderBy(order).limit(limit)


def outcome(truth: Column, rule: Column, model: Column) -> Column:
    return F.when((rule == truth) & (model != truth), "rule_better").when((model == truth) & (rule != truth), "model_better").when((rule != truth) & (model != truth), "both_wrong").otherwise("both_right")


def sample_results(sample: DataFrame, labels: DataFrame, long: DataFrame, taxonomy: list[str]) -> DataFrame:
    """strategy, record_id, truth, pred of sampled rows with a valid label; a strategy without the row leaves it out."""
    truth = sample.select("record_id").join(labels.where(valid_label(taxonomy)).select("record_id", F.col("llm_category").alias("truth")), "record_id")
    return truth.join(long.select("strategy", "record_id", or_empty(F.col("category")).alias("pred")), "record_id")


def align(matrix: DataFrame) -> list[tuple[str, str]]:
    """Greedy alignment of labels b to labels a of a table (a, b, cnt): the largest cell whose labels are both free pairs them, ties
    in the order of the labels; a b that is left goes with the a that it meets most.

    Cells are at most labels times labels, summed in Spark; their number is checked before they reach the driver.
    """
    rows = matrix.where("a IS NOT NULL AND b IS NOT NULL").orderBy(F.desc("cnt"), "a", "b").limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("more than a million pairs of labels")
    of: dict[str, str] = {}
    taken: set[str] = set()
    for r in rows:
        if r["a"] not in taken and r["b"] not in of:
            of[r["b"]] = r["a"]
            taken.add(r["a"])
    for r in rows:
        of.setdefault(r["b"], r["a"])
    return sorted(of.items())


def compare_labels(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """Two label tables (record_id, label): overlap counts, raw confusion, mapping of b's labels, aligned agreement per label."""
    spark = a.sparkSession
    both = a.select("record_id", F.col("label").alias("a")).join(b.select("record_id", F.col("label").alias("b")), "record_id", "full")
    overlap = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))
    common = both.where("a IS NOT NULL AND b IS NOT NULL")
    matrix = common.groupBy("a", "b").agg(F.count("*").alias("cnt"))
    mapping = spark.createDataFrame(align(matrix), "b string, mapped string")
    aligned = common.join(F.broadcast(mapping), "b")
    by_label = aligned.groupBy("a").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("mapped")).alias("agree"))
    return {"overlap": overlap, "confusion": matrix, "mapping": mapping, "by_label": by_label, "aligned": aligned.groupBy("a", "mapped").agg(F.count("*").alias("cnt")), "mismatches": aligned.where("a <> mapped")}


def low_confidence(wide: DataFrame, threshold: float = 0.7, conf: str = "model_conf", order: str = "seq") -> DataFrame:
    """The rows whose model is unsure, in the table's order."""
    return wide.where(F.col(conf) < threshold).orderBy(order)


def compare_on(sample: DataFrame, labels: DataFrame, wide: DataFrame, taxonomy: list[str], columns: tuple[str, ...] = ("rule_cat", "model_cat", "category")) -> DataFrame:
    """record_id, truth and the verdict columns of sampled rows with a valid label; a row that a strategy lacks has ''.

    labels: record_id, llm_category, llm_confidence, error. The same sample serves all comparisons: coverage(), confusion(),
    per_class(), pair_counts() and outcome()."""
    truth = sample.select("record_id").join(labels.where(valid_label(taxonomy)).select("record_id", F.col("llm_category").alias("truth")), "record_id")
    return truth.join(wide.select("record_id", *columns), "record_id", "left").select("record_id", "truth", *(or_empty(F.col(c)).alias(c) for c in columns))


def pair_counts(rows: DataFrame, a: str = "rule_cat", b: str = "model_cat", limit: int | None = None) -> DataFrame:
    """a, b, cnt of two verdict columns where the first one has a verdict, most frequent first."""
    out = rows.where(or_empty(F.col(a)) != "").groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("cnt"))
    return out if limit is None else out.orderBy(F.desc("cnt"), "a", "b").limit(limit)


def union_labels(*parts: DataFrame) -> DataFrame:
    """label: the distinct non-empty labels of several tables."""
    out = parts[0].select("label")
    for p in parts[1:]:
        out = out.unionByName(p.select("label"))
    return out.where(or_empty(F.col("label")) != "").distinct()
