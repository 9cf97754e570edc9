"""Content-addressed web archive: payloads stored once by digest, record headers apart, records rebuilt by joins."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import join_hot, join_salted, map_arrow, new_path, remove, stash

#: Level at which payloads are deflated in the store.
ZLIB_LEVEL = 3
STAMP = "1970-01-01T00:00:00Z"
#: What ends a record, and a header.
END = "\r\n\r\n"
EMPTY_SHA256 = hashlib.sha256(b"").digest()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _facts(batches):
    for b in batches:
        n, sha1, sha256 = [], [], []
        for x in b.column(2).cast(pa.binary()):
            p = x.as_py() or b""
            n.append(len(p))
            sha1.append(base32_sha1(p))
            sha256.append(hashlib.sha256(p).digest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha1, pa.string()), pa.array(sha256, pa.binary())], names=["page_id", "url", "n", "sha1", "digest"])


def _pack(batches):
    for b in batches:
        digests, packed = [], []
        for x in b.column(1).cast(pa.binary()):
            p = x.as_py() or b""
            digests.append(hashlib.sha256(p).digest())
            packed.append(zlib.compress(p, ZLIB_LEVEL))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["page_id", "digest", "packed"])


def _clean(value: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", value or "")


def header_text(page_id, url, kind: str, n: int, sha1: str, sha256: bytes, refers_to, refers_url, when: str = STAMP) -> str:
    """The exact header of one record, ending in the empty line. A null id is written as `-`, line ends in a URL as spaces."""
    name = lambda i: "<urn:page:" + ("-" if i is None else str(i)) + ">"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {when}"]
    lines += [] if url is None else [f"WARC-Target-URI: {_clean(url)}"]
    block = EMPTY_SHA256 if kind == "revisit" else sha256  # a revisit has no block
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha256:{block.hex()}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
        lines += [] if refers_url is None else [f"WARC-Refers-To-Target-URI: {_clean(refers_url)}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if kind == 'revisit' else n}"]
    return "\r\n".join(lines) + "\r\n\r\n"


def parse_header(text: str) -> dict[str, str]:
    """Fields of a record header by lower-case name; raises ValueError if the version line or the end is missing."""
    if not text.startswith("WARC/1.") or not text.endswith("\r\n\r\n"):
        raise ValueError("not a WARC record header")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in text[:-4].split("\r\n")[1:])}


def _heads(batches):
    for b in batches:
        rows = b.to_pylist()
        heads = [header_text(r["page_id"], r["url"], r["kind"], r["n"], r["sha1"], r["digest"], r["first_id"], None) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), b.column(b.schema.get_field_index("digest"))], names=["header", "digest"])


def write_archive(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> str:
    """Archives pages (page_id, url, html) and returns the archive's folder, with two tables:

    `payloads` (digest = SHA-256, packed = deflated bytes, first_id, copies), each distinct payload once, and `headers` (header, digest), the exact
    header of each record. Of records with equal payloads of at least min_bytes, that with the smallest page_id is the response and
    the others are revisits of it; shorter payloads are all responses. A null html is an empty payload. Rows that tie on the
    smallest page_id are all responses, a null page_id counts as larger than any other. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    ids = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    facts = stash(map_arrow(ids, _facts, "page_id long, url string, n long, sha1 string, digest binary"), "warc-facts")
    packed = map_arrow(ids.select("page_id", "html"), _pack, "page_id long, digest binary, packed binary")
    # Copies meet map-side first, so a payload is shuffled at most once by each task that has it.
    once = packed.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("packed").alias("packed"))
    once.write.option("compression", "uncompressed").parquet(f"{path}/payloads")
    firsts = spark.read.parquet(f"{path}/payloads").select("digest", "first_id", "copies")
    joined = join_hot(facts.withColumn("sole", F.col("n") < min_bytes), firsts, "digest", "copies")
    kind = F.when(F.col("sole") | F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id")), "response").otherwise("revisit")
    map_arrow(joined.withColumn("kind", kind), _heads, "header string, digest binary").write.parquet(f"{path}/headers")
    remove(spark, facts.stash_path)
    return path


def _page(name: str | None) -> int | None:
    return None if name is None or name == "<urn:page:->" else int(name[len("<urn:page:") : -1])


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """header, digest (SHA-256 of the full payload) of every record, as stored."""
    return spark.read.schema("header string, digest binary").parquet(f"{path}/headers")


def _unpack(batches):
    for b in batches:
        html = []
        for d, z in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            payload = zlib.decompress(z)
            if hashlib.sha256(payload).digest() != d:
                raise ValueError(f"payload {d.hex()} is damaged")
            html.append(payload)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(html, pa.binary()).cast(pa.string())], names=["header", "html"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """header, html of every record: the original records, rebuilt by joining headers with payloads (a revisit's block is empty).

    A payload that does not match its SHA-256 makes the read fail. Short payloads may be the blocks of many records, so hot digests
    are dealt over salts.
    """
    heads = read_headers(spark, path)
    revisit = F.col("header").contains("\r\nWARC-Type: revisit\r\n")
    full = join_salted(heads.where(~revisit), spark.read.schema("digest binary, packed binary").parquet(f"{path}/payloads"), "digest")
    rebuilt = map_arrow(full.select("header", "digest", "packed"), _unpack, "header string, html string")
    return rebuilt.unionByName(heads.where(revisit).select("header", F.lit("").alias("html")))


def export_warc(spark: SparkSession, path: str, out: str) -> str:
    """Writes the archive as gzipped WARC/1.1 files in the folder `out`, one per partition, through Spark: any store that Spark
    writes to will do."""
    text = records(spark, path).select(F.concat("header", "html").alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").text(out)
    return out


class Records:
    """Takes the bytes of WARC files piece by piece and gives whole records: (header, block)."""

    def __init__(self):
        self.held, self.at, self.need, self.header = bytearray(), 0, 0, b""

    def feed(self, piece: bytes):
        self.held += piece
        while True:
            if not self.need:
                end = self.held.find(b"\r\n\r\n", self.at)
                if end < 0:
                    self.at = max(0, len(self.held) - 3)
                    return
                self.header = bytes(self.held[: end + 4])
                self.need = len(self.header) + int(parse_header(self.header.decode())["content-length"]) + 4
            if len(self.held) < self.need:
                return
            block, end = bytes(self.held[len(self.header) : self.need - 4]), self.held[self.need - 4 : self.need]
            if end != b"\r\n\r\n":
                raise ValueError("a record's block is longer than its Content-Length")
            yield self.header, block
            del self.held[: self.need]
            self.at = self.need = 0

    def close(self) -> None:
        if self.held:
            raise ValueError("a WARC file is cut off")


def _record_facts(header: bytes, block: bytes) -> dict:
    h = parse_header(header.decode())
    revisit = h["warc-type"] == "revisit"
    said, digest = h["warc-payload-digest"].removeprefix("sha1:"), base32_sha1(block)
    if h["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest() or not revisit and said != digest:
        raise ValueError(f"the block of {h['warc-record-id']} does not match its digest")
    return {"page_id": _page(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "refers_to": _page(h.get("warc-refers-to")), "payload_digest": said, "payload_bytes": None if revisit else len(block), "html": None if revisit else block.decode()}


def read_warc(spark: SparkSession, folder: str, html: bool = False) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes (null for revisits) of every record of a folder of
    gzipped WARC files as export_warc() writes them; with html, also the block.

    Files are read through Spark; a gzipped file is one split, whose text comes in order, cut at every empty line, and is put
    together again byte by byte, one record at a time. Each block must match its SHA-256 and, in a response, its SHA-1.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"] + ["html"] * html
    kinds = dict(zip(names, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=False))

    def run(batches):
        parser = Records()
        for b in batches:
            rows = [_record_facts(*r) for x in b.column(0).cast(pa.binary()) for r in parser.feed(x.as_py() + END.encode())]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names=names)
        parser.close()

    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", html string" * html
    return map_arrow(spark.read.option("lineSep", END).text(folder), run, schema)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record of the archive at `path`.

    The records are rebuilt by joins and written as WARC files, and what is returned is read from these: a response has its
    payload there, a revisit finds that of its response by a join on the payload's digest. An archive without pages gives no rows.
    """
    found = stash(read_warc(spark, export_warc(spark, path, f"{path}/warc")), "warc-records")
    full, again = found.where("record_type = 'response'"), found.where("record_type <> 'response'")
    counts = again.groupBy("payload_digest").agg(F.count("*").alias("_n"))
    sizes = full.groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes")).join(counts, "payload_digest")
    back = join_hot(again.drop("payload_bytes"), stash(sizes, "warc-sizes"), "payload_digest", "_n", how="inner")
    return full.unionByName(back.drop("_n")).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
