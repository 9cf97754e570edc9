"""Writers: message tables, label snapshots, CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import or_empty, strip
from siftline.sources.messages import EXPORTED

UNKNOWN_LABEL = -1


def write_table(messages: DataFrame, path: str, overwrite: bool = False) -> None:
    messages.write.mode("overwrite" if overwrite else "append").parquet(path)


def export_csv(messages: DataFrame, path: str, fields: list[str] | None = None) -> None:
    messages.select(*(fields or EXPORTED)).write.option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def label_updates(messages: DataFrame, updates: DataFrame) -> DataFrame:
    """messages with category replaced where updates (record_id, category; the last by seq counts) have the id: a new snapshot."""
    last = updates.groupBy("record_id").agg(F.max_by("category", "seq").alias("_new")) if "seq" in updates.columns else updates.select("record_id", F.col("category").alias("_new"))
    return messages.join(last, "record_id", "left").withColumn("category", F.coalesce("_new", "category")).drop("_new").select(*messages.columns)


def matched_rows(messages: DataFrame, updates: DataFrame) -> DataFrame:
    """One row: how many rows of messages an update reaches; unknown ids add nothing."""
    return messages.join(updates.select("record_id").distinct(), "record_id", "left_semi").agg(F.count("*").alias("matched"))


def numeric_labels(results: DataFrame, ids: dict[str, int]) -> DataFrame:
    """record_id, spam_type: the taxonomy's number of each category, UNKNOWN_LABEL for an empty or unknown one."""
    pairs = F.create_map(*(F.lit(x) for kv in ids.items() for x in kv))
    return results.select("record_id", F.coalesce(F.try_element_at(pairs, or_empty(F.col("category"))), F.lit(UNKNOWN_LABEL)).alias("spam_type"))


def write_labels(labels: DataFrame, stem: str, formats: tuple[str, ...] = ("csv", "jsonl")) -> None:
    if "csv" in formats:
        labels.write.option("header", True).csv(f"{stem}.csv")
    if "jsonl" in formats:
        labels.write.json(f"{stem}.jsonl")


def annotation_rows(messages: DataFrame, content_chars: int = 500) -> DataFrame:
    """What annotators get: content is cut first, then cleaned; an existing category is a rule label of confidence 1."""
    content = strip(F.replace(F.substring(or_empty(F.col("content")), 1, content_chars), F.lit("\r"), F.lit("")))
    category = or_empty(F.col("category"))
    return messages.select("record_id", strip(or_empty(F.col("from_name"))).alias("from_name"), strip(or_empty(F.col("subject"))).alias("subject"), content.alias("content"), category.alias("rule_category"), F.when(category != "", 1.0).otherwise(0.0).alias("rule_confidence"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", False).json(path)


def write_strategies(long: DataFrame, path: str) -> None:
    """One partition per strategy; a later stage adds to what is there and overwrites nothing."""
    long.write.mode("append").partitionBy("strategy").parquet(path)


def holdout(messages: DataFrame, used: DataFrame) -> DataFrame:
    return messages.join(used.select("record_id"), "record_id", "left_anti")


def create_table(spark, name: str, path: str | None = None) -> None:
    """The message table in the session's catalog, if it is not there yet; its indexes are derived tables (search.inverted_index)."""
    from siftline.sources.messages import INT_FIELDS, TEXT_FIELDS

    columns = ["record_id STRING", *(f"{c} STRING" for c in TEXT_FIELDS.values()), "timestamp STRING", *(f"{c} BIGINT" for c in INT_FIELDS.values()), "category STRING", "raw_json STRING", "seq BIGINT"]
    where = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(columns)}) USING parquet{where}")


def export_histogram(labels: DataFrame, most: int = 4) -> DataFrame:
    """spam_type, cnt of exported numbers from 0 to `most`."""
    return labels.where(F.col("spam_type").between(0, most)).groupBy("spam_type").agg(F.count("*").alias("cnt"))


def report_json(sections: dict[str, DataFrame]) -> DataFrame:
    """A report of one-row sections as one row, json: an object with a member for each section."""
    out = None
    for name, df in sections.items():
        one = df.select(F.struct(*df.columns).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out.select(F.to_json(F.struct(*sections), {"ignoreNullFields": "false"}).alias("json"))


def labelled_name(path: str) -> str:
    """Where labelled rows of a file go: <stem>_labeled<suffix>."""
    stem, dot, suffix = path.rpartition(".")
    return f"{stem}_labeled.{suffix}" if dot and "/" not in suffix else f"{path}_labeled"


def write_labelled(rows: DataFrame, source: str, out: str | None = None) -> str:
    out = out or labelled_name(source)
    write_jsonl(rows, out)
    return out


def sample_rows(sample: DataFrame, messages: DataFrame, chars: int = 500) -> DataFrame:
    """The sampled ids with what annotators need, the content cut to its first characters; of repeated ids in messages the last by
    seq counts, an id that is not there is left out."""
    fields = ["from_name", "subject", "content"]
    last = messages.groupBy("record_id").agg(F.max_by(F.struct(*fields), "seq").alias("_m"))
    cut = F.substring(or_empty(F.col("_m.content")), 1, chars)
    return sample.join(last, "record_id").select(*sample.columns, *(or_empty(F.col(f"_m.{f}")).alias(f) for f in fields[:2]), cut.alias("content"))


def write_split_dataset(rows: DataFrame, path: str, taxonomy: list[str], label: str = "label", **kwargs) -> None:
    """rows (record_id, text, label) split into train, validation and test, with the label map and class weights of the training
    rows, under one folder; see sampling.stratified_split()."""
    from siftline.operators import sampling

    spark = rows.sparkSession
    sampling.stratified_split(rows, label, **kwargs).write.partitionBy("split").parquet(f"{path}/rows")
    spark.createDataFrame(list(enumerate(taxonomy)), "id int, label string").coalesce(1).write.json(f"{path}/label_map")
    train = spark.read.parquet(f"{path}/rows").where("split = 'train'")
    sampling.class_weights(train.select(F.col(label).alias("label")), "label", taxonomy).select("label", "weight").coalesce(1).write.json(f"{path}/class_weights")
