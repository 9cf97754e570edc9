"""Subword lattice likelihood: unigram scores over an existing vocabulary weight all segmentations of a text."""

from __future__ import annotations

import functools
import math
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import drop_stash, map_arrow, stash
from siftline.llm.lengths import TOKENIZERS

VOCABULARY = "piece_bpe_32k.model"
#: Training folds; rounds of expectation and maximisation; pseudo-count of each symbol.
FOLDS, HELD_OUT = 7, 2
ROUNDS, SMOOTH = 3, 0.1
#: Words that are scored map-side from a broadcast, as the most frequent ones; distinct words that a task counts before it emits.
FREQUENT, FLUSH = 200_000, 300_000
#: Cells of a lattice that are held at once; longest word, in bytes, that is worked on together with others of its length.
CELLS, TOGETHER = 1 << 20, 96
#: Places of a long word whose pieces are looked up at once.
SLAB = 1 << 14
BUFFER = 200_000
MARK = "▁"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20
_NONE = -np.inf


def _hash(rows: np.ndarray) -> np.uint64:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in rows:
            h = (h + np.uint64(int(c) + 1)) * _BASE
            h ^= h >> np.uint64(29)
    return h


class Pieces:
    """The vocabulary as byte strings (a leading space begins a word) with their scores, and a hash index over them.

    The file scores a piece by its rank alone (0, -1, -2, ...), as merges have no probabilities; `start` takes the probability that
    falls with the rank as words' frequencies do, 1 / (rank + 100), and the end of a text as a symbol of the last rank. Capitals never occur in lower-cased words and special or inner-space pieces never apply, so they are left out; all 256 single
    bytes are pieces, so every word has a segmentation.
    """

    def __init__(self, folder: str = TOKENIZERS, name: str = VOCABULARY):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}")
        found: dict[bytes, int] = {bytes([b]): model.vocab_size() for b in range(256)}
        for i in range(model.vocab_size()):
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
                continue
            p = model.id_to_piece(i)
            b = p.replace(MARK, " ").encode()
            if MARK not in p[1:] and b.lower() == b:
                found[b] = min(i, found.get(b, i))
        self.pieces = list(found)
        ranks = np.array([found[p] for p in self.pieces], float)
        start = np.append(1 / (ranks + 100), 1 / (len(found) + 100))  # the last one: the end of a text
        self.start = np.log(start / start.sum())
        self.longest = max(map(len, self.pieces))
        h = np.array([_hash(np.frombuffer(p, np.uint8)) for p in self.pieces], np.uint64)
        assert len(np.unique(h)) == len(h)
        self.hashes = h
        # Two tables over different bits of the hash: the second one has the pieces that find their slot of the first one taken.
        self.first, self.second = np.full(1 << _SLOTS, -1, np.int32), np.full(1 << _SLOTS, -1, np.int32)
        slot = h >> np.uint64(64 - _SLOTS)
        owner = np.unique(slot, return_index=True)[1]
        self.first[slot[owner]] = owner
        rest = np.setdiff1d(np.arange(len(h)), owner)
        slot2 = self._second(h[rest])
        assert len(np.unique(slot2)) == len(rest)
        self.second[slot2] = rest

    @staticmethod
    def _second(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - 2 * _SLOTS)) & np.uint64((1 << _SLOTS) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = self.first[h >> np.uint64(64 - _SLOTS)]
        taken = np.flatnonzero(out >= 0)
        other = taken[self.hashes[out[taken]] != h[taken]]
        if len(other):
            again = self.second[self._second(h[other])]
            out[other] = np.where((again >= 0) & (self.hashes[again] == h[other]), again, -1)
        return out


@functools.lru_cache(1)
def vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> Pieces:
    return Pieces(folder, name)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words between the six ASCII white-space characters."""
    return (text or b"").lower().split()


def _by_length(words: list[bytes], longest: int):
    """Indices and byte matrices of words of equal length, each word with its leading space, in parts of bounded lattices."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes[sizes <= TOGETHER]).tolist():
        at = np.flatnonzero(sizes == n)
        most = max(1, CELLS // ((n + 1) * min(n + 1, longest)))
        for a in range(0, len(at), most):
            part = at[a : a + most]
            rows = np.frombuffer(b"".join(b" " + words[k] for k in part.tolist()), np.uint8).reshape(len(part), n + 1)
            yield part, rows


def _arcs(rows: np.ndarray, vocab: Pieces) -> dict[tuple[int, int], np.ndarray]:
    """Pieces of all words between places i and j, -1 where there is none; places without any piece are left out."""
    length = rows.shape[1]
    found = {}
    with np.errstate(over="ignore"):
        codes = rows.T.astype(np.uint64) + np.uint64(1)
        for i in range(length):
            h = np.zeros(len(rows), np.uint64)
            for j in range(i + 1, min(length, i + vocab.longest) + 1):
                h = (h + codes[j - 1]) * _BASE
                h ^= h >> np.uint64(29)
                ids = vocab.find(h)
                if (ids >= 0).any():
                    found[i, j] = ids
    return found


def _sum_logs(parts: list[np.ndarray]) -> np.ndarray:
    x = np.stack(parts)
    top = x.max(axis=0)
    return top + np.log(np.exp(x - np.where(np.isfinite(top), top, 0)).sum(axis=0))


def forward(rows: np.ndarray, arcs: dict, scores: np.ndarray, longest: int) -> list[np.ndarray]:
    """Log probability of all segmentations of each prefix; the last is that of the word."""
    alpha = [np.zeros(len(rows))]
    for j in range(1, rows.shape[1] + 1):
        alpha.append(_sum_logs([alpha[i] + scores[arcs[i, j]] for i in range(max(0, j - longest), j) if (i, j) in arcs]))
    return alpha


def backward(rows: np.ndarray, arcs: dict, scores: np.ndarray, longest: int) -> list[np.ndarray]:
    length = rows.shape[1]
    beta = [np.zeros(len(rows))] * (length + 1)
    for i in range(length - 1, -1, -1):
        beta[i] = _sum_logs([beta[j] + scores[arcs[i, j]] for j in range(i + 1, min(length, i + longest) + 1) if (i, j) in arcs])
    return beta


def _long_arcs(word: bytes, vocab: Pieces, step: int = 1):
    """For each place of a long word, forwards or backwards: (place, lengths, pieces) of the pieces that begin there."""
    data = np.frombuffer(b" " + word, np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(data)
    for a in range(0, n, SLAB)[::step]:
        z = min(n, a + SLAB)
        h = np.zeros(z - a, np.uint64)
        at, size, piece = [], [], []
        with np.errstate(over="ignore"):
            for k in range(vocab.longest):
                m = min(z, n - k) - a  # places with k + 1 bytes
                if m <= 0:
                    break
                h = (h[:m] + data[a + k : a + k + m]) * _BASE
                h ^= h >> np.uint64(29)
                ids = vocab.find(h)
                good = np.flatnonzero(ids >= 0)
                at.append(good)
                size.append(np.full(len(good), k + 1))
                piece.append(ids[good])
        at, size, piece = map(np.concatenate, (at, size, piece))
        order = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[order], np.arange(z - a + 1)).tolist()
        size, piece = size[order].tolist(), piece[order].tolist()
        for p in range(z - a)[::step]:
            x, y = edges[p], edges[p + 1]
            yield a + p, size[x:y], piece[x:y]


def long_forward(word: bytes, scores: list[float], vocab: Pieces) -> array:
    """forward() of one long word, in time and memory that grow with its length alone: log probability of each prefix."""
    log, exp = math.log, math.exp
    alpha = array("d", [-math.inf]) * (len(word) + 2)
    alpha[0] = 0.0
    for i, sizes, pieces in _long_arcs(word, vocab):
        a = alpha[i]
        if a == -math.inf:
            continue
        for n, p in zip(sizes, pieces, strict=True):
            x, y = a + scores[p], alpha[i + n]
            alpha[i + n] = x if y == -math.inf else x + log(1 + exp(y - x)) if x >= y else y + log(1 + exp(x - y))
    return alpha


def long_counts(word: bytes, count: float, scores: list[float], vocab: Pieces, out: np.ndarray) -> None:
    """Adds to out the expected counts of pieces in one long word."""
    alpha = long_forward(word, scores, vocab)
    whole, exp, log = alpha[-1], math.exp, math.log
    beta = array("d", [-math.inf]) * len(alpha)
    beta[-1] = 0.0
    for i, sizes, pieces in _long_arcs(word, vocab, -1):
        terms = [scores[p] + beta[i + n] for n, p in zip(sizes, pieces, strict=True)]
        top = max(terms, default=-math.inf)
        if top > -math.inf:
            beta[i] = top + log(sum(exp(t - top) for t in terms))
        for t, p in zip(terms, pieces, strict=True):
            out[p] += count * exp(alpha[i] + t - whole)


def _padded(scores: np.ndarray) -> np.ndarray:
    return np.append(scores, _NONE)  # index -1: no piece


def word_scores(words: list[bytes], scores: np.ndarray, vocab: Pieces) -> np.ndarray:
    """Natural log of each word's marginal probability over all its segmentations into pieces."""
    out = np.empty(len(words))
    table = _padded(scores)
    for at, rows in _by_length(words, vocab.longest):
        out[at] = forward(rows, _arcs(rows, vocab), table, vocab.longest)[-1]
    listed = scores.tolist()
    for k, w in enumerate(words):
        if len(w) > TOGETHER:
            out[k] = long_forward(w, listed, vocab)[-1]
    return out


def expected_counts(words: list[bytes], counts: np.ndarray, scores: np.ndarray, vocab: Pieces) -> np.ndarray:
    """How often each piece is expected over all segmentations of all words, each word `counts` times."""
    out = np.zeros(len(vocab.start) + 1)
    table = _padded(scores)
    for at, rows in _by_length(words, vocab.longest):
        arcs = _arcs(rows, vocab)
        alpha, beta = forward(rows, arcs, table, vocab.longest), backward(rows, arcs, table, vocab.longest)
        for (i, j), ids in arcs.items():
            w = counts[at] * np.exp(alpha[i] + table[ids] + beta[j] - alpha[-1])
            out += np.bincount(ids + 1, w, len(out))
    listed = scores.tolist()
    for w, c in zip(words, counts.tolist(), strict=True):
        if len(w) > TOGETHER:
            long_counts(w, c, listed, vocab, out[1:])
    return out[1:]


def count_words(docs: DataFrame) -> DataFrame:
    """word binary, c (tokens in training rows), t (in all rows) of docs (text, _held)."""

    def count(batches):
        c: Counter = Counter()

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.binary()), pa.array([k[1] for k in c], pa.bool_()), pa.array(list(c.values()), pa.int64())], names=["word", "held", "n"])

        for b in batches:
            for x, held in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist(), strict=True):
                for w, k in Counter(words_of(x.as_py())).items():
                    c[w, held] += k
                if len(c) >= FLUSH:
                    yield emit()
                    c.clear()
        yield emit()

    rows = map_arrow(docs.select("text", "_held"), count, "word binary, held boolean, n long")
    return rows.groupBy("word").agg(F.sum(F.when(F.col("held"), 0).otherwise(F.col("n"))).alias("c"), F.sum("n").alias("t"))


def _buffered(batches, columns: int):
    """Lists of column values over several batches, so that words of one length meet in larger groups."""
    held: list[list] = [[] for _ in range(columns)]
    for b in batches:
        for k in range(columns):
            held[k] += b.column(k).to_pylist()
        if len(held[0]) >= BUFFER:
            yield held
            held = [[] for _ in range(columns)]
    if held[0]:
        yield held


def fit_pieces(words: DataFrame, ends: int, folder: str = TOKENIZERS, name: str = VOCABULARY, rounds: int = ROUNDS) -> np.ndarray:
    """Natural log probabilities of the pieces and, last, of the end: the scores of the existing vocabulary, fitted by expectation
    and maximisation to all training tokens and `ends` ends. Each round is one pass over the distinct words that sums one vector.
    """
    vocab = vocabulary(folder, name)
    scores = vocab.start
    known = words.where("c > 0").select("word", "c")
    for _ in range(rounds):

        def expect(batches, scores=scores):
            v = vocabulary(folder, name)
            total = np.zeros(len(v.start))
            for held in _buffered(batches, 2):
                total += expected_counts(held[0], np.array(held[1], float), scores, v)
            piece = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(total[piece])], names=["piece", "n"])

        sums = map_arrow(known, expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        n = np.full(len(scores), SMOOTH)
        n[sums["piece"].to_numpy()] += sums["n"].to_numpy()
        n[-1] += ends
        if not len(sums) and not ends:
            break
        scores = np.log(n / n.sum())
    return scores


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def score_texts(docs: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Tokens are the lower-cased words of a text and one end. Both models learn from the rows whose crc32(doc_id) is not HELD_OUT
    modulo FOLDS, rows without a doc_id among them. base_score adds log10((c + 1) / (N + V + 1)).

    score is the log10 probability of the text, marginal over all segmentations of its words into pieces of the existing
    vocabulary, with the end as a symbol beside the pieces. No piece spans two words, so the sum over segmentations is the product
    of the words' sums, each found by the forward recursion over the word's lattice, whatever its length. A null or empty text is
    its end alone; rows that repeat a doc_id are scored one by one; other columns are ignored. Without training rows pieces and end
    keep the scores of their ranks, and N and V are 0.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_held", held_out(F.col("doc_id")))
    words = stash(count_words(rows), "lm-words")
    ends = rows.where("NOT _held").count()
    facts = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = facts["n"] + ends, facts["v"] + int(ends > 0)
    pieces = fit_pieces(words, ends, folder, name)
    less, ln10 = math.log10(n + v + 1), math.log(10)
    model = spark.sparkContext.broadcast(pieces)

    def marginal(batches):
        vocab = vocabulary(folder, name)
        for word, c, t in _buffered(batches, 3):
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(c, pa.int64()), pa.array(t, pa.int64()), pa.array(word_scores(word, model.value, vocab) / ln10)], names=["word", "c", "t", "lp"])

    scored = stash(map_arrow(words, marginal, "word binary, c long, t long, lp double"), "lm-scored")
    drop_stash(words)
    top = scored.where(F.octet_length("word") <= TOGETHER).orderBy(F.desc("t"), "word").limit(FREQUENT).drop("t").toArrow()
    frequent = spark.sparkContext.broadcast((top["word"].to_pylist(), top["c"].to_numpy(), top["lp"].to_numpy()))
    start = np.array([1, int(ends > 0), math.log10(ends + 1) - less, pieces[-1] / ln10])
    sums = ["n_tokens", "n_known", "base_score", "score"]

    def first_pass(batches):
        listed, c, lp = frequent.value
        index = {w: k for k, w in enumerate(listed)}
        table = np.column_stack([np.ones(len(c)), c > 0, np.log10(c + 1.0) - less, lp])
        for b in batches:
            row, totals, docs_, held_ = [], [], [], []
            tail_row, tail_word, tail_times = [], [], []
            for i, x, doc, held in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                at, k, more = [], [], 0
                for w, m in Counter(words_of(x.as_py())).items():
                    if (j := index.get(w)) is not None:
                        at.append(j)
                        k.append(m)
                    else:
                        tail_row.append(i)
                        tail_word.append(w)
                        tail_times.append(m)
                        more += m
                sum_ = start + (np.array(k, float) @ table[at] if at else 0)
                sum_[0] += more
                totals.append(sum_)
                row.append(i)
                docs_.append(doc)
                held_.append(held)
            none = [None] * len(tail_row)
            word, times = [None] * len(row) + tail_word, [0] * len(row) + tail_times
            cols = np.array(totals).reshape(len(row), len(start)).T
            values = [pa.concat_arrays([pa.array(x.astype(np.int64)) if k < 2 else pa.array(x), pa.nulls(len(none), pa.int64() if k < 2 else pa.float64())]) for k, x in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([pa.array(row + tail_row, pa.int64()), pa.array(word, pa.binary()), pa.array(times, pa.int64()), pa.array(docs_ + none, pa.int64()), pa.array(held_ + none, pa.bool_()), *values], names=["_row", "word", "k", "doc_id", "held_out", *sums])

    # A row's number ties its words together: one task makes them all, and they are written before they are used.
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    kinds = "_row long, word binary, k long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    parts = stash(map_arrow(numbered.select("_row", "text", "doc_id", "_held"), first_pass, kinds), "lm-parts")
    # The words that are left are none of the most frequent, so none of them is a hot key.
    tail = parts.where("word IS NOT NULL").select("_row", "word", "k").join(scored.drop("t"), "word")
    of_tail = [F.lit(0).cast("long"), F.when(F.col("c") > 0, F.col("k")).otherwise(0), F.col("k") * (F.log10(F.col("c") + 1) - F.lit(less)), F.col("k") * F.col("lp")]
    tail = tail.select("_row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), *(e.alias(x) for e, x in zip(of_tail, sums, strict=True)))
    both = parts.where("word IS NULL").select("_row", "doc_id", "held_out", *sums).unionByName(tail)
    out = both.groupBy("_row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(x).alias(x) for x in sums))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
