"""Hashed counts of character n-grams, the same vectors as Spark ML's RegexTokenizer, NGram and HashingTF give one after another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from siftline.functions.arrow import bound_batches
from siftline.functions.text import or_empty

#: Longest n-gram that fits one number, characters that are counted at once, and the seed of Spark ML's hash.
MOST, CHUNK, SEED = 4, 1 << 20, 42


def hashed_ngrams(spark: SparkSession, text: Column, n: int, features: int) -> Column:
    """A sparse vector of how often each n-gram of a text in lower case occurs, under the hash of its characters with blanks between
    them. As Spark ML does, characters beyond the basic plane count as two question marks."""
    bound_batches(spark)

    def count(texts: pa.Array) -> pa.Array:
        out = [_vectors(part, n, features) for part in _chunks(texts.to_pylist())]
        return pa.concat_arrays(out) if out else _vectors([], n, features)

    return F.arrow_udf(count, VectorUDT())(F.lower(or_empty(text)))


def _chunks(texts: list[str]) -> Iterator[list[np.ndarray]]:
    """Texts as UTF-16 units, in runs of about CHUNK units."""
    part, size = [], 0
    for t in texts:
        part.append(np.frombuffer(t.encode("utf-16-le"), np.uint16))
        size += len(part[-1])
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _vectors(texts: list[np.ndarray], n: int, features: int) -> pa.Array:
    sizes = np.array([len(t) for t in texts], np.int64)
    units = np.concatenate([*texts, np.empty(0, np.uint16)])
    units = np.where((units >= 0xD800) & (units <= 0xDFFF), np.uint16(ord("?")), units)
    grams = np.maximum(sizes - n + 1, 0)
    rows = np.repeat(np.arange(len(texts)), grams)
    at = np.arange(len(rows)) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(grams) - grams), grams)
    keys = np.zeros(len(rows), np.uint64)
    for k in range(n):
        keys = keys << np.uint64(16) | units[at + k]
    coded = pa.array(keys).dictionary_encode()
    buckets = _buckets(coded.dictionary.to_numpy(), n, features)
    cells, counts = np.unique(rows * features + buckets[coded.indices.to_numpy()], return_counts=True)
    ends = pa.array(np.searchsorted(cells, np.arange(len(texts) + 1) * features), pa.int32())
    indices = pa.ListArray.from_arrays(ends, pa.array(cells % features, pa.int32()))
    values = pa.ListArray.from_arrays(ends, pa.array(counts, pa.float64()))
    zeros = np.zeros(len(texts), np.int8)
    return pa.StructArray.from_arrays([pa.array(zeros), pa.array(zeros + np.int32(features), pa.int32()), indices, values], ["type", "size", "indices", "values"])


def _buckets(keys: np.ndarray, n: int, features: int) -> np.ndarray:
    """The place of each n-gram: its UTF-8 bytes under murmur3, modulo the number of features."""
    units = np.stack([(keys >> np.uint64(16 * (n - 1 - k))).astype(np.uint16) for k in range(n)], axis=1) if len(keys) else np.empty((0, n), np.uint16)
    spaced = np.full((len(keys), 2 * n), ord(" "), np.uint16)
    spaced[:, ::2], spaced[:, -1] = units, ord("\n")
    width = (1 + (units >= 0x80) + (units >= 0x800)).sum(axis=1) + n
    out = np.empty(len(keys), np.int64)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        raw = np.frombuffer(spaced[own].tobytes().decode("utf-16-le").encode(), np.uint8).reshape(len(own), w)[:, :-1]
        out[own] = _murmur3(raw).view(np.int32).astype(np.int64) % features
    return out


def _murmur3(raw: np.ndarray) -> np.ndarray:
    """32-bit murmur3 of each row of bytes."""
    def turn(x: np.ndarray, r: int) -> np.ndarray:
        return x << np.uint32(r) | x >> np.uint32(32 - r)

    def mixed(k: np.ndarray) -> np.ndarray:
        return turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    size = raw.shape[1]
    whole = size - size % 4
    h = np.full(len(raw), SEED, np.uint32)
    for i in range(0, whole, 4):
        h = turn(h ^ mixed(np.ascontiguousarray(raw[:, i : i + 4]).view("<u4")[:, 0]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    tail = np.zeros(len(raw), np.uint32)
    for i in range(whole, size):
        tail ^= raw[:, i].astype(np.uint32) << np.uint32(8 * (i - whole))
    h ^= mixed(tail)
    h ^= np.uint32(size)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return h ^ h >> np.uint32(16)
