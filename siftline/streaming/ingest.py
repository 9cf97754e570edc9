"""Incremental ingest of message logs: each new file is parsed once, and the first row of an id is kept across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.sources.messages import keep_first, parse_lines


def ingest_stream(spark: SparkSession, folder: str, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Follows a folder of logs and appends new messages to a Parquet table; rejects go to `<table>_rejects`.

    A batch is written under its number, so a batch that is run again after a failure replaces what it wrote before.
    """
    lines = spark.readStream.format("text").load(folder)

    def batch(df: DataFrame, number: int) -> None:
        messages, rejects = parse_lines(df)
        reader = spark.read.schema(messages.schema)
        try:
            stored = reader.option("recursiveFileLookup", True).parquet(table).where(~F.col("_metadata.file_path").contains(f"/batch={number}/"))
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = None
        keep_first(messages, stored=stored).write.mode("overwrite").parquet(f"{table}/batch={number}")
        rejects.write.mode("overwrite").parquet(f"{table}_rejects/batch={number}")

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "1 hour", width: str = "1 day", key: str = "event_type") -> DataFrame:
    """Rows per key and time window of a stream, with a watermark for late rows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("cnt"))


def first_rows(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """The stream without repeated keys within the watermark, so its state is bounded."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
