"""Line deduplication over levelled sorted runs of line hashes, compacted as they pile up."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.common import join_hot, map_arrow, new_path, remove, stash

#: Shortest key, in code points, and least number of documents of a key that is boilerplate.
MIN_CHARS, MIN_DOCS = 40, 5
#: Runs of one level that are merged into one of the next; batches in which a corpus is added.
FANOUT, BATCHES = 2, 6
#: Lines of the corpus for each bucket of a run, and most buckets.
BUCKET_LINES, MOST_BUCKETS = 250_000, 50_000
RUN = "digest binary, n_docs long, last_doc long"


def line_key(line: bytes) -> bytes:
    """The line without the six ASCII white-space characters at both ends, and with A-Z lower-cased."""
    return line.strip().lower()


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8")) >= least)


def document_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """batch, doc_id, digest: the distinct long keys of each document."""

    def scan(arrow):
        for b in arrow:
            ids, keys = [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                found = [digest(k) for k in {line_key(y) for y in (x.as_py() or b"").split(b"\n")} if long_enough(k, min_chars)]
                ids += [i] * len(found)
                keys += found
            lots = pa.array([(i or 0) % batches for i in ids], pa.int32())
            yield pa.RecordBatch.from_arrays([lots, pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["batch", "doc_id", "digest"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), scan, "batch int, doc_id long, digest binary")


class LineRuns:
    """A store of line keys in levels of sorted runs: digest, n_docs and last_doc, bucketed and sorted by digest.

    Each key is in exactly one run. add() merge-anti-joins a batch with every run, bucket by bucket and without a shuffle of the
    runs: the keys that no run holds become a run of level 0, and what the batch adds to known keys becomes a run of increments
    beside them. Once a level has `fanout` runs they are merged into one of the next level, so a key is rewritten a logarithmic
    number of times. keys() reads the keys from the runs and adds the increments up; without the anti-join it would give keys
    twice. Runs are tables of the session's catalog with files in the shared folder; they are never changed, and close() drops them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, buckets: int = 8):
        self.spark, self.path, self.fanout, self.buckets = spark, path or new_path(spark, "line-runs"), fanout, buckets
        self.levels: list[list[str]] = []
        self.increments: list[list[str]] = []
        self.merges = 0
        self._name, self._made = f"siftline_{uuid.uuid4().hex}", 0

    def _write(self, run: DataFrame) -> str:
        self._made += 1
        name = f"{self._name}_{self._made:06d}"
        rows = run.select("digest", "n_docs", "last_doc").write.bucketBy(self.buckets, "digest").sortBy("digest")
        rows.option("path", f"{self.path}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{self.path}/{name}")

    def _merged(self, names: list[str]) -> DataFrame:
        runs = reduce(DataFrame.unionByName, [self.spark.table(n) for n in names])
        return runs.groupBy("digest").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def _push(self, levels: list[list[str]], name: str, level: int = 0) -> None:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(name)
        if len(levels[level]) >= self.fanout:
            old, levels[level] = levels[level], []
            self.merges += 1
            self._push(levels, self._write(self._merged(old)), level + 1)
            for n in old:
                self._drop(n)

    def runs(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose digest no run holds."""
        return reduce(lambda b, n: b.join(self.spark.table(n).select("digest"), "digest", "left_anti"), self.runs(), batch)

    def add(self, lines: DataFrame) -> None:
        """Adds the lines (doc_id, digest; one row per document and key) of documents that were in no batch before."""
        counted = lines.groupBy("digest").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        batch = self._write(counted.repartition(self.buckets, "digest"))
        if not self.runs():
            self._push(self.levels, batch)
            return
        fresh = self._write(self.unseen(self.spark.table(batch)))
        known = self.spark.table(batch).join(self.spark.table(fresh).select("digest"), "digest", "left_anti")
        self._push(self.increments, self._write(known))
        self._push(self.levels, fresh)
        self._drop(batch)

    def keys(self) -> DataFrame:
        """One row per key: in how many documents it is, and the largest doc_id of them."""
        names = [n for level in self.increments for n in level]
        runs = [self.spark.table(n) for n in self.runs()]
        if not runs:
            return self.spark.createDataFrame([], RUN)
        if names:
            more = self._merged(names).select("digest", F.col("n_docs").alias("_n"), F.col("last_doc").alias("_last"))
            runs = [r.join(more, "digest", "left").select("digest", (F.col("n_docs") + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "_last").alias("last_doc")) for r in runs]
        return reduce(DataFrame.unionByName, runs)

    def close(self) -> None:
        for n in [*self.runs(), *(n for level in self.increments for n in level)]:
            self._drop(n)
        remove(self.spark, self.path)


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """docs with `text` less its repeated lines, and n_lines (before) and n_dropped; all other columns stay as they are.

    Texts are split at \\n; a null or empty text is one empty line and comes back as an empty text. A line whose key has at least
    min_chars code points and is in at least min_docs rows goes, except in the row of the largest doc_id that holds it, where all
    its lines stay. Rows count as documents of their own even if they repeat a doc_id; rows of equal doc_id are treated alike. A
    row without a doc_id counts too, but keeps its lines. Columns n_lines and n_dropped of the input are replaced.
    """
    spark = docs.sparkSession
    path = new_path(spark, "lines")
    document_lines(docs, batches, min_chars).write.option("compression", "uncompressed").partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, digest binary, batch int").parquet(path)
    store = LineRuns(spark, buckets=min(MOST_BUCKETS, 1 + lines.count() // BUCKET_LINES))
    for k in range(batches):
        store.add(lines.where(F.col("batch") == k))
    repeated = stash(store.keys().where(F.col("n_docs") >= min_docs), "line-repeated")
    store.close()
    held = join_hot(lines.select("doc_id", "digest"), repeated, "digest", "n_docs", how="inner")
    drops = stash(held.where("doc_id <> last_doc").groupBy("doc_id").agg(F.collect_set("digest").alias("_gone")), "line-drops", codec="uncompressed")
    remove(spark, path)
    remove(spark, repeated.stash_path)
    kept = docs.drop("n_lines", "n_dropped")
    at, to = kept.columns.index("text"), kept.schema.fields
    to = [T.StructField(f.name, f.dataType, True) for f in to]
    schema = T.StructType([*to, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def rebuild(arrow):
        for b in arrow:
            cols = list(b.columns)
            texts, before, lost = [], [], []
            for x, gone in zip(cols[at].cast(pa.binary()), cols[-1], strict=True):
                rows = (x.as_py() or b"").split(b"\n")
                stay = rows
                if gone.is_valid:
                    gone = set(gone.as_py())
                    stay = [y for y in rows if not (long_enough(k := line_key(y), min_chars) and digest(k) in gone)]
                texts.append(b"\n".join(stay))
                before.append(len(rows))
                lost.append(len(rows) - len(stay))
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols[:-1], pa.array(before, pa.int64()), pa.array(lost, pa.int64())], names=schema.names)

    renamed = drops.withColumnRenamed("doc_id", "_gone_id").hint("shuffle_hash")
    return map_arrow(kept.join(renamed, kept["doc_id"] == renamed["_gone_id"], "left").drop("_gone_id"), rebuild, schema)
