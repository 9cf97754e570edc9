"""Search, filters and statistics over a table of messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import ascii_lower, month, or_empty, strip, url_domain

LIKE_FIELDS = ["subject", "content", "sender", "from_addr", "recipient", "urls"]
# Columns that a search by field and a ranking of values accept.
SEARCHABLE = {"record_id", "sender", "from_addr", "from_name", "recipient", "subject", "content", "ip", "region", "urls", "attach", "license_id", "category"}
RANKABLE = {"sender", "from_addr", "recipient", "ip", "region", "license_id", "xmailer", "domain_rep", "category"}


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def keyword_filter(messages: DataFrame, keyword: str, fields: list[str], case_sensitive: bool = False) -> DataFrame:
    """Rows with the keyword as it stands in any of the fields; a missing field is empty. Case is folded on both sides."""
    if case_sensitive:
        return messages.where(_any(or_empty(F.col(f)).contains(keyword) for f in fields))
    return messages.where(_any(F.lower(or_empty(F.col(f))).contains(keyword.lower()) for f in fields))


def date_range(messages: DataFrame, start: str, end: str, column: str = "timestamp") -> DataFrame:
    """Rows whose timestamp text lies in the closed range, compared as text; a null or empty one never does."""
    return messages.where((F.col(column) != "") & F.col(column).between(start, end))


def search_like(messages: DataFrame, keyword: str, fields: list[str] | None = None, limit: int = 50, order: str = "seq") -> DataFrame:
    """The first rows with a field LIKE %keyword%; % and _ in the keyword stay wild, A-Z equal a-z and nothing else is folded."""
    pattern = "%" + keyword.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\\", "\\\\") + "%"
    return messages.where(_any(ascii_lower(or_empty(F.col(f))).like(pattern) for f in fields or LIKE_FIELDS)).orderBy(order).limit(limit)


def search_by_field(messages: DataFrame, field: str, value: str, limit: int = 100, order: str = "seq") -> DataFrame:
    if field not in SEARCHABLE:
        raise ValueError(f"cannot search by {field}")
    return search_like(messages, value, [field], limit, order)


def by_category(messages: DataFrame, category: str, limit: int | None = 100, order: str = "seq") -> DataFrame:
    rows = messages.where(F.col("category") == category)
    return rows if limit is None else rows.orderBy(order).limit(limit)


def unclassified(messages: DataFrame, limit: int | None = 100, order: str = "seq") -> DataFrame:
    rows = messages.where(or_empty(F.col("category")) == "")
    return rows if limit is None else rows.orderBy(order).limit(limit)


def top_values(messages: DataFrame, column: str, limit: int = 30, check: bool = True) -> DataFrame:
    """The most frequent values as they stand, without empty and null ones; ties by value."""
    if check and column not in RANKABLE:
        raise ValueError(f"cannot rank {column}")
    counts = messages.where(or_empty(F.col(column)) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "value").limit(limit)


def monthly(messages: DataFrame, column: str = "timestamp") -> DataFrame:
    return messages.where(F.col(column).isNotNull()).groupBy(month(F.col(column)).alias("month")).agg(F.count("*").alias("cnt"))


def category_distribution(messages: DataFrame) -> DataFrame:
    return messages.groupBy("category").agg(F.count("*").alias("cnt"))


def category_summary(messages: DataFrame) -> DataFrame:
    name = F.when(or_empty(F.col("category")) == "", "unclassified").otherwise(F.col("category"))
    return messages.groupBy(name.alias("category")).agg(F.count("*").alias("cnt"))


def overview(messages: DataFrame) -> DataFrame:
    """One row: number of rows, first and last timestamp (as text), total size in KB and mean size, to one place."""
    return messages.agg(
        F.count("*").alias("total"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        F.bround(F.coalesce(F.sum("size"), F.lit(0)) / 1024, 1).alias("size_kb"), F.bround(F.avg("size"), 1).alias("avg_size"),
    )


def report(messages: DataFrame, columns: tuple[str, ...] = ("region", "sender", "recipient", "ip", "license_id"), limit: int = 30) -> dict[str, DataFrame]:
    return {"overview": overview(messages), "monthly": monthly(messages)} | {f"top_{c}": top_values(messages, c, limit) for c in columns}


#: Ranked lists of the log statistics: what is counted, and how many are kept.
STATS_TOPS = {"regions": 20, "senders": 50, "recipients": 50, "licenses": 30, "ips": 20, "domains": 20}


def log_stats(messages: DataFrame) -> dict[str, DataFrame]:
    """Statistics of parsed messages: one row of totals, and value rankings with ties in the order of first appearance (seq).

    Senders are trimmed and lower-cased, recipients and URL domains come from the parsed lists. No messages: a total of 0.
    """
    totals = messages.agg(
        F.count("*").alias("total"), F.min(F.nullif("timestamp", F.lit(""))).alias("first_ts"), F.max(F.nullif("timestamp", F.lit(""))).alias("last_ts"),
        F.bround(F.sum("size") / 1024, 1).alias("size_kb"), F.bround(F.avg("size"), 1).alias("avg_size"),
        F.count_if(strip(F.col("content")) != "").alias("with_content"), F.count_if(strip(F.col("attach")) != "").alias("with_attach"),
        F.bround(F.avg("wlist_cnt"), 4).alias("avg_wlist"), F.bround(F.avg("dwlist_cnt"), 4).alias("avg_dwlist"),
    )
    values = {
        "regions": messages.select(strip(F.col("region")).alias("value"), "seq"),
        "senders": messages.select(F.lower(strip(F.col("sender"))).alias("value"), "seq"),
        "recipients": messages.select(F.explode("parsed_rcpts").alias("value"), "seq").select(F.lower("value").alias("value"), "seq"),
        "licenses": messages.select(strip(F.col("license_id")).alias("value"), "seq"),
        "ips": messages.select(strip(F.col("ip")).alias("value"), "seq"),
        "domains": messages.select(F.explode("parsed_urls").alias("value"), "seq").select(url_domain(F.col("value")).alias("value"), "seq"),
    }
    tops = {k: ranked(v, STATS_TOPS[k]) for k, v in values.items()}
    return {"totals": totals, "months": monthly(messages)} | tops


def ranked(values: DataFrame, limit: int) -> DataFrame:
    """value, cnt of the most frequent non-empty values of (value, seq); ties by first appearance."""
    counts = values.where(or_empty(F.col("value")) != "").groupBy("value").agg(F.count("*").alias("cnt"), F.min("seq").alias("_first"))
    return counts.orderBy(F.desc("cnt"), "_first").limit(limit).drop("_first")


def by_id(messages: DataFrame, record_id: str, key: str = "record_id") -> DataFrame:
    """The rows of one id; the filter reaches the scan."""
    return messages.where(F.col(key) == record_id)


def fetch(messages: DataFrame, ids: DataFrame, key: str = "record_id") -> DataFrame:
    """The rows whose id is in ids."""
    return messages.join(ids.select(key), key, "left_semi")


def first_rows(messages: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The first n rows in the table's order; 0 means all."""
    return messages.orderBy(order).limit(n) if n else messages


def long_stats(sections: dict[str, DataFrame]) -> DataFrame:
    """section, value, cnt of a report or of log statistics as one table: rankings and months by value, totals by name."""
    out = None
    for name, df in sections.items():
        if "cnt" in df.columns:
            value = next(c for c in df.columns if c != "cnt")
            part = df.select(F.lit(name).alias("section"), F.col(value).cast("string").alias("value"), F.col("cnt").cast("double").alias("cnt"))
        else:
            numbers = [c for c, t in df.dtypes if t != "string"]
            each = F.explode(F.array(*(F.struct(F.lit(c).alias("value"), F.col(c).cast("double").alias("cnt")) for c in numbers)))
            part = df.select(F.lit(name).alias("section"), each.alias("e")).select("section", "e.*")
        out = part if out is None else out.unionByName(part)
    return out
