"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.common import drop_stash, join_salted, map_arrow, stash

#: Shortest tile in words; share of an item's words that tiles must cover to call a document contaminated.
LEAST, THRESHOLD = 5, 0.5
#: Bits of the filter over the benchmark's seeds for each seed, and at most: what is broadcast is MOST_BITS / 8 bytes or less.
BITS_EACH, MOST_BITS = 512, 1 << 27
#: Candidate items that are tiled against one text at once.
CHUNK_ITEMS = 1000
#: Seed hits of one pair beyond which matches are searched row by row, in memory that grows with the text alone.
MANY_HITS = 2_000_000

_TO_SPACE = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def words(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates like white space."""
    return (text or "").lower().encode().translate(_TO_SPACE).split()


def word_ids(tokens: list[bytes]) -> np.ndarray:
    """A 64-bit id per word, of two checksums: the same for equal words in all processes."""
    low, high = (np.fromiter(map(f, tokens), np.uint64, len(tokens)) for f in (zlib.crc32, zlib.adler32))
    return low | high << np.uint64(32)


def window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of k words, each rolled on by a multiplication and an addition."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = ids[:n].copy()
    for i in range(1, k):
        h *= np.uint64(_BASE)
        h += ids[i : i + n]
    return h


def _runs(at_item: np.ndarray, at_doc: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, item start, document start) from hits of k words: hits that follow each other on a diagonal."""
    order = np.lexsort((at_doc, at_doc - at_item))
    i, j = at_item[order], at_doc[order]
    new = np.ones(len(i), bool)
    new[1:] = (j[1:] - i[1:] != j[:-1] - i[:-1]) | (j[1:] != j[:-1] + 1)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(i))) + k - 1
    return list(zip(sizes.tolist(), i[starts].tolist(), j[starts].tolist(), strict=True))


def _longest(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray) -> tuple[int, int, int]:
    """Longest common run of unmarked words, row by row; ties go to the earliest place in a, then in b."""
    best, row = (0, 0, 0), np.zeros(len(b) + 1, np.int32)
    for i in range(len(a)):
        grown = np.zeros_like(row)
        if free_a[i]:
            grown[1:] = np.where((b == a[i]) & free_b, row[:-1] + 1, 0)
        row = grown
        if (n := int(row.max())) > best[0]:
            best = (n, i - n + 1, int(row.argmax()) - n)
    return best


def tile(item: np.ndarray, doc: np.ndarray, least: int = LEAST, hits: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two id arrays: (length, item start, document start) of each tile.

    Again and again the longest match of at least `least` unmarked words is marked in both; ties go to the earliest place in the
    item, then in the document. hits: the places of all shared windows of `least` words, if known.
    """
    if min(len(item), len(doc)) < least:
        return []
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles = []
    if hits is None:
        hits = shared_windows(window_hashes(item, least), window_hashes(doc, least))
    if hits is None:  # too many to hold
        while (found := _longest(item, doc, free_i, free_d))[0] >= least:
            n, i, j = found
            free_i[i : i + n] = free_d[j : j + n] = False
            tiles.append(found)
        return tiles
    heap = [(-n, i, j) for n, i, j in _runs(*hits, least) if np.array_equal(item[i : i + n], doc[j : j + n])]
    heapq.heapify(heap)
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        open_ = free_i[i : i + n] & free_d[j : j + n]
        if open_.all():
            free_i[i : i + n] = free_d[j : j + n] = False
            tiles.append((n, i, j))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], open_.view(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return tiles


def shared_windows(of_item: np.ndarray, of_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs of places with equal window hashes; None if there are more than MANY_HITS."""
    order = np.argsort(of_item, kind="stable")
    ranked = of_item[order]
    lo, hi = np.searchsorted(ranked, of_doc, "left"), np.searchsorted(ranked, of_doc, "right")
    n = hi - lo
    if int(n.sum()) > MANY_HITS:
        return None
    at_doc = np.repeat(np.arange(len(of_doc)), n)
    within = np.arange(len(at_doc)) - np.repeat(np.cumsum(n) - n, n)
    return order[np.repeat(lo, n) + within], at_doc


def seeds_of(ids: np.ndarray, k: int) -> np.ndarray:
    """The windows of k words as mixed 64-bit hashes."""
    h = window_hashes(ids, k) + np.uint64(k)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def telling(counts: np.ndarray, places: np.ndarray, k: int, size: int, threshold: float) -> np.ndarray:
    """Which of an item's windows need be looked up: the most frequent ones are left out, as many as cover less than `threshold` of
    its words, for a text that shares none but these cannot reach it."""
    keep = np.ones(len(places), bool)
    covered = np.zeros(size, bool)
    for w in np.argsort(-counts, kind="stable").tolist():
        covered[places[w] : places[w] + k] = True
        if covered.sum() >= threshold * size:
            break
        keep[w] = False
    return keep


_ITEM = "_item long, item_id long, _k int, _words binary"


def bench_items(bench: DataFrame, least: int) -> DataFrame:
    """_item (a number of its own), item_id, _k (words of its windows: `least`, or all of a shorter item) and _words (ids) of every
    row of bench that has words."""

    def run(batches):
        for b in batches:
            found = [word_ids(words(x)) for x in b.column(2).to_pylist()]
            good = pa.array([len(w) > 0 for w in found], pa.bool_())
            cols = [b.column(0), b.column(1), pa.array([min(least, len(w)) for w in found], pa.int32()), pa.array([w.tobytes() for w in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["_item", "item_id", "_k", "_words"]).filter(good)

    rows = bench.select(F.monotonically_increasing_id().alias("_item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return stash(map_arrow(rows, run, _ITEM), "bench-items")


def bench_seeds(items: DataFrame, threshold: float) -> DataFrame:
    """_seed, _item: the windows by which texts are joined with items."""

    def cut(batches):
        for b in batches:
            for item, k, w in zip(*(b.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                h, at = np.unique(seeds_of(np.frombuffer(w, np.uint64), k), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.repeat(pa.scalar(item, pa.int64()), len(h)), pa.array(at.astype(np.int32))], names=["_seed", "_item", "_at"])

    def choose(batches):
        for b in batches:
            for item, k, size, rows in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                h, at, n = (np.array([r[c] for r in rows], np.int64) for c in ("_seed", "_at", "n"))
                keep = telling(n, at, k, size, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.repeat(pa.scalar(item, pa.int64()), int(keep.sum()))], names=["_seed", "_item"])

    each = stash(map_arrow(items, cut, "_seed long, _item long, _at int"), "bench-windows")
    counted = join_salted(each, each.groupBy("_seed").agg(F.count("*").alias("n")), "_seed")
    of_item = counted.groupBy("_item").agg(F.sort_array(F.collect_list(F.struct("_at", "_seed", "n"))).alias("_rows"))
    sized = items.select("_item", "_k", (F.octet_length("_words") / 8).cast("int").alias("_size")).join(of_item, "_item")
    out = stash(map_arrow(sized.select("_item", "_k", "_size", "_rows"), choose, "_seed long, _item long"), "bench-seeds")
    drop_stash(each)
    return out


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """Two bits for each seed, in bytes; a window that lacks one of its bits is no seed."""
    bits = 1 << 16
    n = seeds.count()
    while bits < min(MOST_BITS, n * BITS_EACH):
        bits <<= 1
    slots = seeds.select(F.explode(F.array(*(F.expr(f"shiftright(_seed, {by}) & {bits - 1}L") for by in (0, 32)))).alias("s"))
    sums = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(s & 63 AS INT))")).alias("b")).toArrow()
    table = np.zeros(bits >> 6, np.int64)
    table[sums["w"].to_numpy()] = sums["b"].to_numpy()
    return table.view(np.uint8)


def in_filter(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Those of the hashes that the filter lets pass."""
    for by in (0, 32):
        slot = h >> by & np.int64(len(table) * 8 - 1)
        h = h[table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1]
    return h


def coverage(doc: np.ndarray, item: np.ndarray, least: int, threshold: float) -> float:
    """Share of the item's words that tiles cover; 0 if it is below the threshold."""
    k = min(least, len(item))
    of_item, of_doc = window_hashes(item, k), window_hashes(doc, k)
    # A tile is made of shared windows, so the words that these cover bound the coverage from above.
    if (np.convolve(np.isin(of_item, of_doc), np.ones(k, int)) > 0).sum() < threshold * len(item):
        return 0.0
    share = sum(n for n, _, _ in tile(item, doc, k)) / len(item)
    return share if share >= threshold else 0.0


def score_contamination(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """docs with contaminated boolean, item_id long, coverage double and n_items long.

    coverage is the largest share of a benchmark item's words that tiles of at least `least` words cover, among the items that
    reach the threshold (0 and a null item_id if none does; ties go to the smallest item_id), n_items their number. Tiles may be
    in any order, so reordered passages count. An item of fewer than `least` words is matched as a whole. A null or empty text is
    clean, null items and items without a word match nothing, and an empty benchmark leaves all documents clean. Rows that repeat
    a doc_id or an item_id are rows of their own. Columns of these four names in docs are replaced.

    Texts and items are joined on seeds, the windows that they share. A filter of bounded size over the benchmark's seeds, which is
    all that is broadcast, tells in one pass which texts have any: the others leave as they are, without a shuffle.
    """
    spark = docs.sparkSession
    own = docs.drop("contaminated", "item_id", "coverage", "n_items")
    items = bench_items(bench, least)
    seeds = bench_seeds(items, threshold)
    sizes = [r[0] for r in items.select("_k").distinct().collect()]  # at most `least` numbers
    held = spark.sparkContext.broadcast(seed_filter(seeds))
    at = own.columns.index("text")
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in own.schema.fields), T.StructField("_seeds", T.ArrayType(T.LongType()))])

    def scan(batches):
        table = held.value
        for b in batches:
            out = []
            for x in b.column(at).to_pylist():
                ids = word_ids(words(x))
                found = [np.unique(in_filter(seeds_of(ids, k), table)) for k in sizes]
                out.append(np.concatenate(found) if found else None)
            sized = np.cumsum([0, *(0 if x is None else len(x) for x in out)])
            flat = np.concatenate([np.empty(0, np.int64), *(x for x in out if x is not None)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(sized, pa.int32()), pa.array(flat))], names=schema.names)

    scanned = map_arrow(own, scan, schema)
    none = {"item_id": F.lit(None).cast("long"), "coverage": F.lit(0.0), "n_items": F.lit(0).cast("long")}
    clean = scanned.where("size(_seeds) = 0").drop("_seeds").withColumns(none)
    some = stash(scanned.where("size(_seeds) > 0").withColumn("_row", F.monotonically_increasing_id()), "seeded-docs")
    hits = stash(some.select("_row", F.explode("_seeds").alias("_seed")), "seed-hits")
    pairs = join_salted(hits, seeds, "_seed").select("_row", "_item").distinct()
    pairs = stash(pairs, "tile-pairs")
    many = pairs.groupBy("_row").agg(F.ceil(F.count("*") / CHUNK_ITEMS).cast("int").alias("_chunks"))
    chunked = join_salted(pairs, items, "_item").join(many, "_row").withColumn("_chunk", F.pmod(F.xxhash64("_item"), "_chunks"))
    lists = chunked.groupBy("_row", "_chunk").agg(F.collect_list(F.struct("item_id", "_words")).alias("_items"))

    def tiles(batches):
        for b in batches:
            rows = []
            for row, x, found in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                doc = word_ids(words(x))
                scored = [(c, i["item_id"]) for i in found if (c := coverage(doc, np.frombuffer(i["_words"], np.uint64), least, threshold))]
                if scored:
                    best = min(scored, key=lambda f: (-f[0], f[1] is None, f[1]))
                    rows.append((row, best[0], best[1], len(scored)))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["_row", "coverage", "item_id", "n"])

    found = map_arrow(some.select("_row", "text").join(lists, "_row").select("_row", "text", "_items"), tiles, "_row long, coverage double, item_id long, n long")
    best = F.min(F.struct((-F.col("coverage")).alias("c"), F.col("item_id").isNull().alias("z"), "item_id")).alias("b")
    judged = stash(found.groupBy("_row").agg(best, F.sum("n").alias("n_items")).select("_row", "b.item_id", (-F.col("b.c")).alias("coverage"), "n_items"), "tile-scores")
    drop_stash(hits, pairs, seeds, items)
    rest = some.drop("_seeds").join(judged, "_row", "left").drop("_row")
    rest = rest.select(*own.columns, "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"))
    return clean.unionByName(rest).withColumn("contaminated", F.col("n_items") > 0)


def decontaminate(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """The clean rows of docs, with their own columns; all cases as in score_contamination()."""
    own = [c for c in docs.columns if c not in ("contaminated", "item_id", "coverage", "n_items")]
    return score_contamination(docs, bench, threshold, least).where("NOT contaminated").select(*own)
