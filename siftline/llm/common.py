"""Shared helpers: the cluster's shared folder, written tables, skew-proof joins and prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space that separates words, as a character class body and as a string.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes of one Arrow batch: what a Python worker holds of its input at once.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: Rows of a hot key that stay together in join_salted().
SALT_ROWS = 20_000
#: Most keys that a join handles map-side as hot ones; times a key's size this bounds what is broadcast.
HOT_KEYS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder set on the context.

    Where neither is set, a local session (tests) gets a temporary folder; on a cluster that is an error, for executors would not
    see such a folder.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="siftline-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siftline/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stash(df: DataFrame, name: str, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def drop_stash(*frames: DataFrame) -> None:
    for df in frames:
        remove(df.sparkSession, df.stash_path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow(), over batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes: the session's bounds are lowered to these."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"[^0-9-]", "", df.sparkSession.conf.get(key)))
        if not 0 < now <= most:
            df.sparkSession.conf.set(key, str(most))
    return df.mapInArrow(function, schema)


def join_salted(left: DataFrame, right: DataFrame, key: str, per: int = SALT_ROWS) -> DataFrame:
    """left ⋈ right on key; the rows of a key that more than `per` rows of left hold are dealt over salts, and right's rows repeated.

    At most HOT_KEYS keys are salted, all others hold at most 1/HOT_KEYS of left each. left is read twice, so pass a stash.
    """
    counts = left.groupBy(key).agg(F.ceil(F.count("*") / per).cast("int").alias("_salts")).where("_salts > 1")
    hot = stash(counts.orderBy(F.desc("_salts"), key).limit(HOT_KEYS), "hot", codec="uncompressed")
    if hot.isEmpty():
        return left.join(right, key)
    own = F.pmod(F.xxhash64(*left.columns), F.coalesce("_salts", F.lit(1))).cast("int")
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_salt", own).drop("_salts")
    each = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(each, [key, "_salt"]).drop("_salt")


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, least: int = 1000, how: str = "left") -> DataFrame:
    """left ⋈ right on key, right having one row per key and in `weight` how many left rows hold it.

    The heaviest HOT_KEYS keys, if of `least` rows or more, are joined map-side from a broadcast of at most HOT_KEYS rows;
    all others hold at most 1/HOT_KEYS of the rows each and are joined through a shuffle. left is read twice, so pass a stash.
    """
    hot = right.where(F.col(weight) >= least).orderBy(F.desc(weight), key).limit(HOT_KEYS)
    names = F.broadcast(hot.select(key).withColumn("_hot", F.lit(True)))
    fast = left.join(F.broadcast(hot), key, "inner")
    slow = left.join(names, key, "left").where("_hot IS NULL").drop("_hot")
    return fast.unionByName(slow.join(right, key, how))


def prefix_sums(df: DataFrame, parts: list[str], order: list[Column], sums: dict[str, str], width: int, rows: str = "_slot") -> DataFrame:
    """Adds running totals before each row, per `parts` and in `order`, without one task per part.

    df holds in `rows` a slot number that never falls as `order` rises; a slot is expected to hold about `width` rows.
    Totals of slots are summed first (a few rows per slot), then rows within their slot. sums: new column -> column to add up.
    """
    totals = df.groupBy(*parts, rows).agg(*(F.sum(v).alias(f"_t_{k}") for k, v in sums.items()))
    before = Window.partitionBy(*parts).orderBy(rows).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*parts, rows, *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums))
    own = Window.partitionBy(*parts, rows).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.select("*", *(F.coalesce(F.sum(v).over(own), F.lit(0)).alias(f"_i_{k}") for k, v in sums.items()))
    out = inner.join(offsets, [*parts, rows])
    for k in sums:
        out = out.withColumn(k, F.col(f"_i_{k}") + F.col(f"_o_{k}")).drop(f"_i_{k}", f"_o_{k}")
    return out
