"""Near-duplicate classes by order MinHash, sensitive to edit similarity; candidates are verified by banded alignment."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import drop_stash, join_hot, join_salted, map_arrow, stash
from siftline.llm.components import components

#: Words of a k-mer, k-mers of a sketch, number of sketches, least edit similarity on words.
K, TAKE, SKETCHES, SIMILARITY = 5, 2, 80, 0.8
#: Elements of the table of ranks that is held at once for one document.
HELD = 1 << 20
#: Bits for each word of a text that stand for its words; members of a bucket that a task compares with as many others at once.
BITS_EACH, BLOCK = 8, 1024
#: Rivals of each member of a block that are verified before the others, which need not be where these have joined their classes.
NEAREST = 2
#: Most nodes that are broadcast, so that the texts of others are not moved.
FEW = 50_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 1 << 63, 4096, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def kmers(codes: np.ndarray, k: int = K) -> np.ndarray:
    """64-bit hashes of all runs of k words; a shorter text is one run."""
    if not len(codes):
        return np.empty(0, np.uint64)
    k = min(k, len(codes))
    c = _mixed(codes.astype(np.uint64) + _PRIME)
    h = np.zeros(len(c) - k + 1, np.uint64)
    for i in range(k):
        h = h * _PRIME + c[i : i + len(h)]
    return _mixed(h)


def occurrences(h: np.ndarray) -> np.ndarray:
    """0 for the first place of a k-mer, 1 for its second, and so on."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    return out


def sketch(codes: np.ndarray, k: int = K, take: int = TAKE, sketches: int = SKETCHES) -> np.ndarray:
    """One bucket key per sketch: its `take` smallest occurrence-labelled k-mers under a random order, in the order of the text."""
    h = kmers(codes, k)
    n = len(h)
    if not n:
        return np.empty(0, np.int64)
    labelled = _mixed(h + occurrences(h).astype(np.uint64) * _PRIME)
    places = np.empty((sketches, min(take, n)), np.int64)
    step = max(1, HELD // n)
    for a in range(0, sketches, step):
        z = min(sketches, a + step)
        ranks = ((labelled[None, :] ^ _XOR[a:z, None]) * _MUL[a:z, None] >> np.uint64(32)).astype(np.uint32)
        rows = np.arange(z - a)
        for t in range(places.shape[1]):
            best = ranks.argmin(axis=1)
            places[a:z, t] = best
            ranks[rows, best] = 0xFFFFFFFF
    places.sort(axis=1)
    key = np.arange(sketches, dtype=np.uint64) * _PRIME
    for t in range(places.shape[1]):
        key = _mixed(key * _PRIME + h[places[:, t]])
    return key.view(np.int64)


def full_distance(a: list[int], b: list[int]) -> int:
    """Edit distance by columns of bits over the whole of a."""
    if not a:
        return len(b)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    at: dict[int, int] = {}
    for p, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << p
    up, down, dist = full, 0, len(a)
    for x in b:
        m = at.get(x, 0)
        d = ((((m & up) + up) ^ up) | m | down) & full
        hp, hn = down | (full & ~(d | up)), d & up
        dist += bool(hp & top) - bool(hn & top)
        hp, hn = (hp << 1 | 1) & full, hn << 1 & full
        up, down = hn | (full & ~(d | hp)), hp & d
    return dist


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences if it is at most `most`, else most + 1, from the band of `most` diagonals on either side.

    One column of the band is two integers of 2 * most + 2 bits (vertical steps up and down) that slide along the diagonal.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    if most >= min(len(a), len(b)):  # the band is everything
        return min(full_distance(a, b), most + 1)
    width = 2 * most + 2
    full = (1 << width) - 1
    at: dict[int, int] = {}
    for p, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << p
    up, down = full << (width - most - 1) & full, 0
    top, side = 1 << (width - 1), 1 << (width - 2)
    start, dist, stop = most + 1 - width, most, 2 * most + len(b) - len(a)
    for i, x in enumerate(b):
        m = at.get(x, 0)
        m = (m >> start if start >= 0 else m << -start) & full
        start += 1
        d = ((((m & up) + up) ^ up) | m | down) & full
        hp, hn = down | (full & ~(d | up)), d & up
        if i < len(a) - most:
            dist += not d & top
        else:
            dist += bool(hp & side) - bool(hn & side)
            side >>= 1
        if dist > stop:
            return most + 1
        down_d = d >> 1
        up, down = hn | (full & ~(down_d | hp)), down_d & hp
    return dist if dist <= most else most + 1


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether 1 - edit distance / length of the longer one is at least `least`, on word codes."""
    n = max(len(a), len(b))
    most = int((1 - least) * n + 1e-9)
    if n - min(len(a), len(b)) > most:
        return False
    x, y = a.tolist(), b.tolist()
    if n - sum((Counter(x) & Counter(y)).values()) > most:  # words that have no partner at all
        return False
    return banded_distance(x, y, most) <= most


def _sketches(batches):
    for b in batches:
        digests, counts, keys = [], [], []
        for x in b.column(1).cast(pa.binary()):
            words = tokens(x.as_py())
            digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
            counts.append(len(words))
            keys.append(sketch(word_codes(words)) if words else None)
        columns = [b.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "words", "keys"])


def _codes(batches):
    for b in batches:
        codes = [word_codes(tokens(x.as_py())).tobytes() for x in b.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary())], names=["node", "codes"])


def _verified(batches):
    for b in batches:
        x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
        good = pa.array([similar(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)) for p, q in zip(x, y, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(good)


def text_codes(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """node, codes of the texts of all nodes in pairs (a, b: node ids); no other texts are moved."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes.hint("shuffle_hash"), "node", "left_semi")
    return stash(map_arrow(texts, _codes, "node long, codes binary").distinct(), "near-codes")


def rows_of(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of table for nodes (node), if these are FEW at most, without moving the others; else the whole table."""
    nodes = nodes.distinct()
    return table.join(F.broadcast(nodes), "node", "left_semi") if nodes.limit(FEW + 1).count() <= FEW else table


def verify(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """The pairs (a, b: node ids, repeated by no other row; a stash) whose texts are similar; codes from text_codes().

    b may be the leader of any number of pairs, which are dealt over salts."""
    codes = rows_of(codes, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    one = join_salted(pairs, codes.select(F.col("node").alias("b"), F.col("codes").alias("y")), "b")
    two = one.join(codes.select(F.col("node").alias("a"), F.col("codes").alias("x")), "a")
    return map_arrow(two.select("a", "b", "x", "y"), _verified, "a long, b long").distinct()


def word_bits(codes: np.ndarray) -> np.ndarray:
    """A power of two of bits, BITS_EACH or more a word and 64 at least, in bytes: each word sets one, a repeated word one for each
    time. Two texts of edit distance d have at most d bits that the other one lacks, also when the larger is folded."""
    size = 64
    while size < BITS_EACH * len(codes):
        size <<= 1
    bits = np.zeros(size, bool)
    if len(codes):
        h = codes.astype(np.uint64)
        bits[_mixed(h + occurrences(h).astype(np.uint64) * _PRIME) & np.uint64(size - 1)] = True
    return np.packbits(bits, bitorder="little")


def folded(bits: np.ndarray) -> np.ndarray:
    """Rows of bits folded to half their number."""
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


def word_marks(codes: np.ndarray) -> np.ndarray:
    """16 bits of the hash of each word, a repeated word one for each time, each value once. Two texts of edit distance d have at
    most d values that the other one lacks; fewer words share a value by chance than share a bit of word_bits()."""
    h = codes.astype(np.uint64)
    return np.unique((_mixed(h + occurrences(h).astype(np.uint64) * _PRIME) >> np.uint64(32)).astype(np.uint16)) if len(h) else np.empty(0, np.uint16)


def _facts(batches):
    for b in batches:
        codes = [np.frombuffer(x.as_py(), np.uint32) for x in b.column(1)]
        bits, marks = (pa.array([f(c).tobytes() for c in codes], pa.binary()) for f in (word_bits, word_marks))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(c) for c in codes], pa.int64()), bits, marks], names=["node", "words", "bits", "marks"])


def _apart_rows(own: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """How many of own's bits each row of bits lacks, or own of theirs if these are more."""
    lost, more = np.bitwise_count(own & ~bits).sum(axis=1), np.bitwise_count(bits & ~own).sum(axis=1)
    return np.maximum(lost, more)


def _apart_marks(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The same of marks, of which each text has one at least."""
    has = np.zeros(1 << 16, bool)
    has[own] = True
    sizes = np.array([len(x) for x in others])
    both = np.add.reduceat(has[np.concatenate(others)], np.cumsum(sizes) - sizes, dtype=np.int64)
    return np.maximum(len(own), sizes) - both


def _nearest(i: np.ndarray, j: np.ndarray, gap: np.ndarray, nearest: int) -> np.ndarray:
    """Places of the pairs (i, j) that are among the `nearest` of least gap of one of their two ends."""
    ends, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((pair, np.tile(gap, 2), ends))
    ranked = ends[order]
    rank = np.arange(len(order)) - np.searchsorted(ranked, ranked)
    return np.unique(pair[order[rank < nearest]])


def _short_keys(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(k, np.int64).astype(np.uint32).tobytes() for k in b.column(1).to_pylist()], pa.binary())], names=["node", "short"])


def _rivals(group: pa.Table, nearest: int | None = None) -> pa.Table:
    """Pairs of members of different classes (of different sides, if there are two) that lengths, word_bits() and word_marks(), where
    the group has these, let be similar.

    Members that share several buckets meet in that of their first common sketch alone; `short` has 32 bits of each of their keys.
    With `nearest`, only the pairs that are likeliest similar for one of their members, so many for each; rows without b name the
    members a of the others.
    """
    words = group.column("words").to_numpy()
    order = np.argsort(words, kind="stable")
    words = words[order]
    short = np.frombuffer(b"".join(group.column("short").take(pa.array(order)).to_pylist()), np.uint32).reshape(len(words), -1)
    here = int((short[0] == np.uint32(group.column("key")[0].as_py() & 0xFFFFFFFF)).argmax())
    node, root, side = (group.column(c).to_numpy()[order] for c in ("node", "root", "side"))
    listed = group.column("bits").take(pa.array(order)).to_pylist()
    most = ((1 - SIMILARITY) * words + 1e-9).astype(np.int64)
    ends = np.searchsorted(words - most, words, side="right")
    split = (side != side[0]).any()
    marks = [np.frombuffer(x, np.uint16) for x in group.column("marks").take(pa.array(order)).to_pylist()] if "marks" in group.column_names else None
    one, two, gap = ([np.empty(0, np.int64)] for _ in range(3))
    # Members of one size of bits stand together; a similar text is of the same size or the next one.
    sizes = np.array([len(x) for x in listed])
    starts = np.flatnonzero(np.append(True, sizes[1:] != sizes[:-1])).tolist() + [len(words)]
    tables = [np.frombuffer(b"".join(listed[x:y]), np.uint64).reshape(y - x, -1) for x, y in zip(starts, starts[1:], strict=False)]
    for t, (x, y) in enumerate(zip(starts, starts[1:], strict=False)):
        wider = folded(tables[t + 1]) if y < len(words) and sizes[y] == 2 * sizes[x] else None
        for i in range(x, y):
            for from_, to, table in ((i + 1, min(int(ends[i]), y), tables[t]), (y, min(int(ends[i]), starts[t + 2]) if wider is not None else y, wider)):
                base = x if table is tables[t] else y
                if to <= from_:
                    continue
                good = root[from_:to] != root[i]
                if split:
                    good &= side[from_:to] != side[i]
                at = np.flatnonzero(good) + from_
                at = at[(short[at] == short[i]).argmax(axis=1) == here]
                apart = _apart_rows(tables[t][i - x], table[at - base])
                at, apart = at[apart <= most[at]], apart[apart <= most[at]]
                if marks and len(at):
                    apart = _apart_marks(marks[i], [marks[k] for k in at])
                    at, apart = at[apart <= most[at]], apart[apart <= most[at]]
                one.append(np.full(len(at), i))
                two.append(at)
                gap.append(apart.astype(np.int64) - most[at])
    one, two, gap = map(np.concatenate, (one, two, gap))
    kept = _nearest(one, two, gap, nearest) if nearest else np.arange(len(one))
    x, y = node[one[kept]], node[two[kept]]
    a, b = np.maximum(x, y).tolist(), np.minimum(x, y).tolist()
    held_back = np.setdiff1d(np.arange(len(one)), kept)
    open_ = node[np.unique(np.concatenate([one[held_back], two[held_back]]))].tolist()
    keys = [group.column("key")[0].as_py()] * (len(a) + len(open_))
    return pa.table([pa.array(a + open_, pa.int64()), pa.array(b + [None] * len(open_), pa.int64()), pa.array(keys, pa.int64())], names=["a", "b", "key"])


def dealt(held: DataFrame) -> DataFrame:
    """held (key, node, root; _n, _most, _big: members of the bucket, of its largest class, that class) with side, _low, _high: one row
    for each cell that a member is in.

    Members are dealt into blocks of about BLOCK by a hash of the node, and every two blocks that have something to compare meet in a
    cell of their own, so no task holds a whole bucket. The members of a bucket's largest class need not meet each other: they are
    dealt into blocks of their own where this makes fewer rows.
    """
    rest, big, whole = (F.ceil(n / BLOCK).cast("int") for n in (F.col("_n") - F.col("_most"), F.col("_most"), F.col("_n")))
    own_blocks = F.col("_most") * rest + (F.col("_n") - F.col("_most")) * (rest + big) < F.col("_n") * whole
    in_big, by = F.col("root") == F.col("_big"), F.xxhash64("node")
    side = F.when(~own_blocks, F.pmod(by, whole)).when(in_big, rest + F.pmod(by, big)).otherwise(F.pmod(by, rest)).cast("int")
    others = F.when(~own_blocks, whole).when(in_big, rest).otherwise(rest + big)
    cells = held.withColumn("side", side).withColumn("_other", F.explode(F.sequence(F.lit(0), others - 1)))
    return cells.withColumn("_low", F.least("side", "_other")).withColumn("_high", F.greatest("side", "_other"))


def rivals(members: DataFrame, roots: DataFrame, codes: DataFrame, reps: DataFrame, nearest: int | None = None) -> DataFrame:
    """Pairs (a, b), each once, of members (key, node) of one bucket that are in different classes and may be similar, and the key.

    With `nearest`, those that are among so many likeliest ones of either member in a block, and rows (node, null, key) of the
    members that have more.

    What comes out are the pairs that pass the bounds, not all pairs of the bucket. Members that share several buckets meet in one.
    """
    classes = stash(members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "near-members")
    of_class = classes.groupBy("key", "root").agg(F.count("*").alias("_c"))
    sizes = of_class.groupBy("key").agg(F.sum("_c").alias("_n"), F.max("_c").alias("_most"), F.max_by("root", "_c").alias("_big")).where("_most < _n")
    held = join_hot(classes, stash(sizes, "near-mixed", codec="uncompressed"), "key", "_n", how="inner")
    facts = map_arrow(codes, _facts, "node long, words long, bits binary, marks binary").distinct().join(map_arrow(reps.select("node", "keys"), _short_keys, "node long, short binary"), "node")
    held = held.join(facts, "node")
    cells = dealt(held).select("key", "_low", "_high", "side", "node", "root", "words", "bits", "marks", "short")
    return cells.groupBy("key", "_low", "_high").applyInArrow(lambda group: _rivals(group, nearest), "a long, b long, key long")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, of_a: its class, b; a stash) of different classes, as a stash of a and b; b may be in any number of them."""
    of_b = pairs.groupBy("b").agg(F.count("*").alias("_n")).join(roots.select(F.col("node").alias("b"), F.col("root").alias("of_b")), "b", "left")
    named = join_hot(pairs, stash(of_b, "near-mixed", codec="uncompressed"), "b", "_n", how="inner")
    return stash(named.where(F.col("of_a") != F.coalesce("of_b", "b")).select("a", "b"), "near-pairs")


def joined(roots: DataFrame | None, pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """roots (node, root) after the similar ones of pairs are linked too; the classes of before stand for their links."""
    good = stash(verify(pairs, codes), "near-links")
    if roots is None:
        out = components(good)
    elif good.isEmpty():
        out = roots
    else:
        out = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(good))
    drop_stash(good)
    return out


def near_lengths(shares: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows of shares (node, leader, ...; a stash) whose lengths let them be similar, as a stash; reps: node, words (how many).

    leader may be in any number of rows. A node whose doc_id is repeated has several lengths, of which any will do."""
    lengths = reps.groupBy("node").agg(F.min("words").alias("_least"), F.max("words").alias("_most"))
    of_leader = lengths.select(F.col("node").alias("leader"), F.col("_least").alias("_from"), F.col("_most").alias("_to"))
    led = stash(shares.groupBy("leader").agg(F.count("*").alias("_rows")).join(of_leader, "leader"), "near-mixed", codec="uncompressed")
    both = join_hot(shares, led, "leader", "_rows", how="inner").join(lengths, "node")
    longer, shorter = F.greatest("_least", "_from"), F.least("_most", "_to")
    out = stash(both.where(longer - shorter <= F.floor(F.lit(1 - SIMILARITY) * longer + 1e-9)).select(shares.columns), "near-shares")
    drop_stash(led)
    return out


def links(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """node, root of the linked ones among reps (node, words: how many, keys), which have different texts; see components().

    In each bucket the smallest node leads, and every other member is verified against it, if their lengths let them be similar: each
    node first against the leader it shares most buckets with, then against those leaders that are not of its class after this. Then the leader is taken out, and
    where the others are still of several classes, every two of different classes are verified too, unless bounds of their edit
    distance rule them out or they have been compared: first the NEAREST of each member of a block, then all others that are still of
    different classes, so members that the first ones join are not compared pair by pair. So any two members of a bucket are in one
    class in the end, or are known not to be similar. What is missed are pairs that no sketch brings together: next to none at a
    similarity of 0.85 or more, about one in fourteen just at 0.8, and pairs of texts of so few words that they share fewer than two
    runs of K words.
    """
    buckets = reps.select("node", F.explode("keys").alias("key"))
    sizes = buckets.groupBy("key").agg(F.count("*").alias("_n"), F.min("node").alias("leader")).where("_n > 1")
    sizes = stash(sizes, "near-sizes", codec="uncompressed")
    shared = join_hot(buckets, sizes, "key", "_n", how="inner")
    members = stash(shared.where("node <> leader").select("key", "node", "leader"), "near-buckets")
    shares = stash(members.groupBy("node", "leader").agg(F.count("*").alias("_n")), "near-shares")
    near = near_lengths(shares, reps)
    met = stash(near.groupBy(F.col("node").alias("a")).agg(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("_n"), "leader")))["leader"].alias("leaders")), "near-leaders")
    pairs = met.select("a", F.explode("leaders").alias("b"))
    codes = text_codes(shares.select(F.col("node").alias("a"), F.col("leader").alias("b")), docs)
    drop_stash(shares, near)
    roots = joined(None, stash(met.select("a", F.col("leaders")[0].alias("b")), "near-pairs"), codes)
    named = met.join(roots.select(F.col("node").alias("a"), "root"), "a", "left")
    others = stash(named.select("a", F.coalesce("root", "a").alias("of_a"), F.explode(F.slice("leaders", 2, F.size("leaders"))).alias("b")), "near-others")
    roots = joined(roots, apart(others, roots), codes)
    near = stash(rivals(members.select("key", "node"), roots, codes, reps, NEAREST), "near-rivals")
    first = stash(near.where("b IS NOT NULL").select("a", "b").join(pairs, ["a", "b"], "left_anti"), "near-pairs")
    roots = joined(roots, first, codes)
    more = stash(near.where("b IS NULL").select("key", F.col("a").alias("node")).distinct(), "near-buckets")
    if not more.isEmpty():
        own = more.select("node")
        rest = rivals(more, roots, rows_of(codes, own), rows_of(reps, own)).select("a", "b").join(pairs, ["a", "b"], "left_anti")
        roots = joined(roots, stash(rest.join(first, ["a", "b"], "left_anti"), "near-pairs"), codes)
    drop_stash(sizes, members, met, others, codes, near, first, more)
    return roots  # written, so what it came from can go


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id: one row per document, whose class is named after its smallest doc_id.

    Texts with the same words, A-Z lower-cased, are copies; documents whose word sequences have an edit similarity of at least
    SIMILARITY are linked, and classes are the components of links. A null or empty text, or one of white space alone, is a class
    of its own. Rows that repeat a doc_id are judged by their own text, no rows give none. A row without a doc_id takes the class of its copies, or
    null if none has an id. Other columns are ignored.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stash(map_arrow(ids, _sketches, "doc_id long, digest binary, words long, keys array<long>"), "near-rows", codec="uncompressed")
    worded = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.any_value("words").alias("words"), F.any_value("keys").alias("keys"))
    reps = stash(worded, "near-reps", codec="uncompressed")
    roots = links(reps.where("node IS NOT NULL").select("node", "words", "keys"), ids)
    named = reps.select("digest", "node", "copies").join(roots, "node", "left").select("digest", "copies", F.coalesce("root", "node").alias("_class"))
    named = stash(named, "near-classes")
    member = join_hot(rows.select("doc_id", "digest"), named, "digest", "copies")
    return member.select("doc_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("_class")).alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that name their class, with all their columns: one document of each class stays.

    Rows without a doc_id stay. Of rows that repeat a doc_id, one stays.
    """
    classes = stash(near_duplicates(docs), "near-members")
    keep = classes.where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("_n")).withColumnRenamed("doc_id", "_keep")
    keep = stash(keep, "near-kept")
    out = docs.join(keep.select("_keep").hint("shuffle_hash"), docs["doc_id"].cast("long") == F.col("_keep"), "left_semi")
    if not keep.where("_n > 1").isEmpty():
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.where("doc_id IS NULL"))
