"""Readers: tab-separated JSON message logs, rule files, label files, strategy files and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siftline.functions.text import extract_ips, extract_urls, json_int, or_empty, split_recipients, strip

# The log's keys and the names of the columns that they fill.
TEXT_FIELDS = {
    "mid": "mid", "tid": "tid", "from": "from_addr", "fromname": "from_name", "sender": "sender", "rcpt": "recipient", "subject": "subject", "content": "content", "doccontent": "doccontent",
    "htmlurl": "htmlurl", "htmltag": "html_tag", "url": "urls", "attach": "attach", "authuser": "auth_user", "ip": "ip", "regionip": "region_ip", "region": "region", "recviplist": "recv_ip_list",
    "domainrep": "domain_rep", "licenseid": "license_id", "xmailer": "xmailer",
}
INT_FIELDS = {"size": "size", "textsize": "text_size", "wlistcnt": "wlist_cnt", "dwlistcnt": "dwlist_cnt"}
EXPORTED = ["record_id", *TEXT_FIELDS.values(), "timestamp", *INT_FIELDS.values()]


def parse_lines(lines: DataFrame, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages, rejects) of lines `<record_id> TAB <json object>` in column `value`.

    Blank lines are dropped; a line without a tab, or whose payload is no JSON object, is a reject with a reason. Text fields that
    are null or absent are empty, `timestamp` stays null. seq orders the rows as `order` does (the reader's order by default).
    """
    rows = lines.select(strip(F.make_valid_utf8(F.col("value"))).alias("line"), (order if order is not None else F.monotonically_increasing_id()).alias("seq")).where("line <> ''")
    parts = rows.select("line", "seq", F.split("line", "\t", 2).alias("p"))
    payload = strip(F.try_element_at(F.col("p"), F.lit(2)))
    parsed = parts.select("line", "seq", F.element_at("p", 1).alias("record_id"), payload.alias("raw_json"))
    fine = F.col("raw_json").isNotNull() & F.col("raw_json").startswith("{") & (F.get_json_object("raw_json", "$").isNotNull())
    rejects = parsed.where(~fine | F.col("raw_json").isNull()).select("seq", "line", F.when(F.col("raw_json").isNull(), "no tab").otherwise("no JSON object").alias("reason"))
    schema = T.StructType([T.StructField(k, T.StringType()) for k in [*TEXT_FIELDS, "@timestamp"]])
    got = F.from_json("raw_json", schema)
    x = parsed.where(fine).withColumn("_j", got)
    texts = [or_empty(F.col("_j")[k]).alias(v) for k, v in TEXT_FIELDS.items()]
    ints = [json_int(F.col("raw_json"), k).alias(v) for k, v in INT_FIELDS.items()]
    x = x.select("record_id", *texts, F.col("_j")["@timestamp"].alias("timestamp"), *ints, F.lit("").alias("category"), "raw_json", "seq")
    lists = {"parsed_urls": extract_urls(F.col("urls")), "parsed_ips": extract_ips(F.concat_ws(" ", "urls", "ip")), "parsed_rcpts": split_recipients(F.col("recipient"))}
    return x.withColumns(lists), rejects


def file_order() -> Column:
    """Orders rows of text files as they stand in them: by file, split and place in the split."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_lines(spark.read.text(path), file_order())


def keep_first(new: DataFrame, key: str = "record_id", order: str = "seq", stored: DataFrame | None = None) -> DataFrame:
    """The first row of each key, without keys that are stored already: min_by is combined map-side, so a hot key costs no more."""
    rows = F.struct(*(F.col(c) for c in new.columns))
    first = new.groupBy(key).agg(F.min_by(rows, F.col(order)).alias("_r")).select("_r.*")
    return first if stored is None else first.join(stored.select(key), key, "left_anti").select(*new.columns)


RULE_SCHEMA = "field string, pattern string, category string, confidence double, weight double, reason string"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON array file, or of all such files of a folder in the order of their names: confidence falls back to weight,
    then 0.5. rule_ord is the order of the rules; rule files are small and read to their end by one task each."""
    raw = spark.read.schema(RULE_SCHEMA).option("multiLine", True).json(path).select("*", F.col("_metadata.file_name").alias("_f"), F.monotonically_increasing_id().alias("_i"))
    order = F.row_number().over(Window.orderBy("_f", "_i")) - 1
    return raw.select(order.alias("rule_ord"), "field", "pattern", "category", F.coalesce("confidence", "weight", F.lit(0.5)).alias("confidence"), or_empty(F.col("reason")).alias("reason"))


def _looks_like_json(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).select(F.get_json_object("value", "$").isNotNull() & F.ltrim("value").startswith("{")).collect()
    return bool(first and first[0][0])


def read_rows(spark: SparkSession, path: str, schema: str, limit: int = 0) -> DataFrame:
    """Rows of a JSON lines file with seq, the order of the file; blank lines are skipped, and a limit keeps the first rows (0: all)."""
    rows = spark.read.schema(schema).json(path).withColumn("seq", file_order())
    return rows.orderBy("seq").limit(limit) if limit else rows


def default_rules(spark: SparkSession | None = None) -> list[tuple]:
    """The rules that come with the package (siftline/rules/default.json): (field, pattern, category, confidence, reason)."""
    import json
    from importlib.resources import files

    held = json.loads((files("siftline") / "rules" / "default.json").read_text())
    return [(r["field"], r["pattern"], r["category"], r["confidence"], r["reason"]) for r in held]


def read_labels(spark: SparkSession, path: str, key: str = "spam_type", id_col: str = "record_id") -> DataFrame:
    """record_id, label of a label file: .csv with a header, .json or .jsonl with JSON lines, and under any other name JSON lines if
    its first line that is not blank is a JSON object, else CSV; the last of repeated ids counts."""
    from siftline.functions.text import normal_label

    if path.endswith(".csv") or not path.endswith((".jsonl", ".json")) and not _looks_like_json(spark, path):
        raw = spark.read.option("header", True).csv(path)
    else:
        raw = spark.read.schema(f"`{id_col}` string, `{key}` string").json(path)
    rows = raw.select(F.col(id_col).alias("record_id"), normal_label(F.col(key)).alias("label"), file_order().alias("seq"))
    rows = rows.where("record_id <> '' AND label IS NOT NULL")
    return rows.groupBy("record_id").agg(F.max_by("label", "seq").alias("label"))


LABELLED_SCHEMA = "record_id string, from_name string, subject string, content string, rule_category string, rule_confidence double, llm_category string, llm_confidence double, llm_reason string, error string"


def read_labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all *_labeled.jsonl and *_labelled.jsonl files whose name has no `cluster` in it, one row for each record_id."""
    rows = spark.read.schema(LABELLED_SCHEMA).option("pathGlobFilter", "*_label{ed,led}.jsonl").json(folder)
    rows = rows.select("*", F.col("_metadata.file_name").alias("_f"), F.monotonically_increasing_id().alias("_i")).where("NOT contains(_f, 'cluster')")
    return keep_first(rows.withColumn("seq", F.struct("_f", "_i")).drop("_f", "_i")).drop("seq")


def read_open_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELLED_SCHEMA).json(path).where("coalesce(error, '') = ''")


def read_strategies(spark: SparkSession, path: str) -> DataFrame:
    """strategy, seq, record_id, category, confidence, source of a strategy file: one JSON object with results of each strategy."""
    row = "array<struct<record_id: string, category: string, confidence: double, source: string, rule_cat: string, bert_cat: string>>"
    raw = spark.read.schema(f"total long, results struct<rule: {row}, bert: {row}, fused: {row}>").option("multiLine", True).json(path)
    each = [raw.select(F.lit(k).alias("strategy"), F.posexplode(f"results.{k}").alias("seq", "r")).select("strategy", F.col("seq").cast("long").alias("seq"), "r.*") for k in ("rule", "bert", "fused")]
    return each[0].unionByName(each[1]).unionByName(each[2])


def sql_query(spark: SparkSession, text: str, tables: dict[str, DataFrame], **params) -> DataFrame:
    """Any SQL over the given tables, with named parameters bound by the engine."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=params)


def open_label_groups(labels: DataFrame, examples: int = 15) -> DataFrame:
    """label, cnt, first_ids of open labels, most frequent first: how many rows have a label, and the first few of them by seq.

    Of a label's rows each task keeps the first `examples`, so no list grows with the data."""
    rows = labels.where("coalesce(llm_category, '') <> ''").select(F.col("llm_category").alias("label"), "record_id", "seq")
    top = Window.partitionBy("label").orderBy("seq")
    first = rows.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= examples)
    ids = first.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "record_id"))), lambda x: x["record_id"]).alias("first_ids"))
    return rows.groupBy("label").agg(F.count("*").alias("cnt")).join(ids, "label").orderBy(F.desc("cnt"), "label")


def read_split_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int], dict[str, float]]:
    """rows (with split), label map and class weights that sinks.write_split_dataset() wrote."""
    rows = spark.read.parquet(f"{path}/rows")
    labels = {r["label"]: r["id"] for r in spark.read.schema("label string, id int").json(f"{path}/label_map").collect()}
    weights = {r["label"]: r["weight"] for r in spark.read.schema("label string, weight double").json(f"{path}/class_weights").collect()}
    return rows, labels, weights
