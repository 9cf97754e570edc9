"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases."""

import base64
import gzip
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import adaptive_rules, byte_cnn, components, lattice_lm, lengths, line_runs, mixing, order_minhash, page_text, tiling, warc_store
from siftline.llm.common import join_salted, prefix_sums

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ke li mo nu ra se ti vo zu".split() for b in "n r l s t m".split()]


def make_docs(n=60, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lines = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 40))) for _ in range(rnd.randrange(1, 6))]
        rows.append((i, "\n".join(lines), rnd.choice(["en", "fr"]), rnd.choice(["a", "a", "b", "c"]), 0))
    return rows


ODD = [(1000, None, None, None, None), (1001, "", "en", "a", 0), (1002, " \t\n ", None, "a", 3), (None, "ban ban ban", "en", None, 11), (1003, "x" * 50_000, "en", "a", 50_000), (1004, "ban ker lit " * 5000, "en", "b", 60_000), (1005, "same text here", "en", "a", 14), (1005, "same text here", "en", "a", 14)]


@pytest.fixture(scope="module")
def docs(spark):
    """Plain rows, odd rows, and an extra column whose name clashes with what operators add."""
    return spark.createDataFrame([(*r, 7) for r in make_docs() + ODD], DOCS + ", score int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1


def test_mixing(spark, docs, none):
    out = mixing.mix(docs, max_epochs=3.0, block_tokens=500).collect()
    tokens, seen = Counter(), {}
    for d in docs.collect():
        tokens[d.source] += len((d.text or "").split())
    for r in out:
        seen.setdefault((r.doc_id, r.source), []).append(r.epoch)
    assert {k[0] for k in seen} == {d.doc_id for d in docs.collect()}
    drawn = Counter()
    for r in out:
        drawn[r.source] += r.n_tokens
    p = {s: t / sum(tokens.values()) for s, t in tokens.items() if t}
    lo, hi = min(p.values()), max(p.values())
    alpha = round(max(0, 1 - math.log(3) / math.log(hi / lo)), 6)
    for s, t in tokens.items():
        if t:
            quota = math.floor(t * round((p[s] / hi) ** (alpha - 1), 9) + 1e-6)
            most = max(r.n_tokens for r in out if r.source == s)
            assert quota <= drawn[s] < quota + most
    for s in p:  # streams are permutations of whole epochs, without gaps
        own = sorted(((r.start, r.n_tokens) for r in out if r.source == s))
        at = 0
        for start, n in own:
            assert start == at
            at += n
    assert mixing.mix(none).count() == 0


def test_mixing_entropy(spark):
    t = spark.createDataFrame([("a", 1, 900), ("b", 1, 90), ("c", 1, 10)], "_key string, n_docs long, tokens long")
    got = mixing.mixing_table(t, target_entropy=0.8, budget=1000).collect()
    w = [r.weight for r in got]
    assert sum(w) == pytest.approx(1) and -sum(x * math.log(x) for x in w) == pytest.approx(0.8, abs=1e-4) and abs(sum(r.quota for r in got) - 1000) < 4


def test_mixing_budget(spark):
    """A budget realised: sources meet their weights to within one document, in blocks that hold them in these weights."""
    rnd = random.Random(18)
    data = [(i, " ".join(["w"] * rnd.randrange(5, 15)), "big" if i % 10 else "small") for i in range(2000)]
    out = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), max_epochs=3.0, budget=8000, block_tokens=1000).collect()
    drawn = Counter()
    blocks = {}
    for r in out:
        drawn[r.source] += r.n_tokens
        blocks.setdefault(r.block, Counter())[r.source] += r.n_tokens
    total = Counter()
    for _, t, s in data:
        total[s] += len(t.split())
    p = {s: t / sum(total.values()) for s, t in total.items()}
    alpha = 1 - math.log(3) / math.log(p["big"] / p["small"])
    weight = {s: x**alpha / sum(y**alpha for y in p.values()) for s, x in p.items()}
    assert all(8000 * weight[s] - 1 <= drawn[s] < 8000 * weight[s] + 15 for s in p) and len(blocks) == 8
    assert all(abs(b["small"] / sum(b.values()) - weight["small"]) < 0.04 for b in blocks.values())
    assert max(r.epoch for r in out if r.source == "small") >= 0 and {r.epoch for r in out if r.source == "big"} == {0}


def test_prefix_sums(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), (F.col("id") * 7 % 11).alias("v"), F.floor(F.col("id") / 9).alias("_slot"))
    got = prefix_sums(df, ["g"], [F.col("o")], {"before": "v"}, 9).collect()
    for r in got:
        assert r.before == sum(k * 7 % 11 for k in range(r.o) if k % 3 == r.g)


# 2


def test_lengths(spark, docs, none):
    enc = lengths.encoder()
    want = [len(enc.encode_ordinary(d.text or "")) for d in docs.collect()]
    table = lengths.length_report(docs)
    got = sorted(table.collect(), key=lambda r: r.n_tokens)
    assert Counter(want) == {r.n_tokens: r.n_docs for r in got}
    for r in got:
        n = r.n_tokens
        assert (r.docs_from, r.tokens_from, r.docs_upto) == (sum(w >= n for w in want), sum(w for w in want if w >= n), sum(w <= n for w in want))
        assert r.truncated_tokens == sum(min(w, n) for w in want) and r.lost_tokens == sum(max(0, w - n) for w in want)
    for limit in (0, 5, 77, 10**6):
        r = lengths.at_limit(table, limit).first()
        assert (r.docs_cut, r.kept_tokens) == (sum(w > limit for w in want), sum(min(w, limit) for w in want))
    assert lengths.length_at_quantile(table, 0.5).first()[0] == sorted(want)[math.ceil(len(want) / 2) - 1]
    assert lengths.length_report(none).count() == 0


# 3


def test_cnn_scores_whole_texts():
    rng = np.random.default_rng(0)
    m = byte_cnn.Model(rng.normal(size=(byte_cnn.WIDTH, 256, 5)).astype(np.float32), rng.normal(size=5).astype(np.float32), rng.normal(size=5).astype(np.float32), 0.1)
    texts = [b"", b"abc", bytes(rng.integers(0, 256, 512, dtype=np.uint8)), bytes(rng.integers(0, 256, 513, dtype=np.uint8)), bytes(rng.integers(0, 256, 20_000, dtype=np.uint8))]
    got = byte_cnn.scores(texts, m)
    for t, s in zip(texts, got):
        chunks = 1 + max(0, -(-(len(t) - byte_cnn.CHUNK) // byte_cnn.HOP))
        z = []
        padded = t + b"\0" * (chunks * byte_cnn.HOP + byte_cnn.CHUNK + byte_cnn.WIDTH)
        for k in range(chunks):
            at = [sum(m.tables[j][padded[k * byte_cnn.HOP + p + j]] for j in range(byte_cnn.WIDTH)) for p in range(byte_cnn.CHUNK)]
            z.append(np.maximum(np.max(at, axis=0) + m.shift, 0) @ m.out)
        assert s == pytest.approx(1 / (1 + math.exp(-np.clip(np.mean(z) + m.bias, -50, 50))), rel=1e-3)


def test_draws():
    assert byte_cnn.draws(3, 1) == dict.fromkeys(range(3), (1 << byte_cnn.EPOCHS) - 1)
    found = byte_cnn.draws(100, 5)
    for e in range(byte_cnn.EPOCHS):
        assert sum(bits >> e & 1 for bits in found.values()) == byte_cnn.EPOCH_CHUNKS
    assert len(found) > 50 and max(found) > 90  # anew in each epoch, over the whole text


def test_gradients(monkeypatch):
    """One step of training moves every kind of parameter against the slope of the loss, as differences give it."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(byte_cnn, "DECAY", 0.0)
    monkeypatch.setattr(byte_cnn, "BATCH", 4)
    chunks = rng.integers(97, 101, (7, byte_cnn.CHUNK + byte_cnn.WIDTH - 1)).astype(np.uint8)
    owner, labels = np.array([0, 0, 1, 2, 2, 2, 3]), np.array([0, 1, 1, 0])
    before = byte_cnn.train(chunks, owner, labels, 0.5, epochs=0)

    def loss(m):
        z = []
        for r in range(4):
            act = [np.maximum(np.max([sum(m.tables[j][c[p + j]] for j in range(byte_cnn.WIDTH)) for p in range(byte_cnn.CHUNK)], axis=0) + m.shift, 0) for c in chunks[owner == r]]
            z.append(np.mean(act, axis=0) @ m.out + m.bias)
        p = 1 / (1 + np.exp(-np.array(z)))
        return -np.mean(np.where(labels == 1, np.log(p), np.log(1 - p)))

    after = byte_cnn.train(chunks, owner, labels, 0.5, epochs=25)
    assert loss(after) < 0.5 * loss(before)
    seen = []
    for change in (lambda m: m.out, lambda m: m.shift):  # the first step of Adam is the sign of the slope
        one = byte_cnn.train(chunks, owner, labels, 0.5, epochs=1)
        moved = change(one) - change(before)
        for f in range(byte_cnn.FILTERS):
            up = byte_cnn.Model(before.tables, before.shift.copy(), before.out.copy(), before.bias)
            change(up)[f] += 1e-3
            slope = (loss(up) - loss(before)) / 1e-3
            if abs(slope) > 1e-3:
                seen.append(np.sign(moved[f]) == -np.sign(slope))
    assert len(seen) > 8 and all(seen)


def test_quality(spark, docs, none):
    rnd = random.Random(5)
    rows_ = [(i, " ".join(rnd.choice(WORDS) + ("### $$$" if i % 3 == 0 else "") for _ in range(rnd.randrange(20, 200)))) for i in range(240)]
    d = spark.createDataFrame(rows_, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(240)] + [(3, None, None), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    model = byte_cnn.fit(d, labels)
    out = byte_cnn.score_quality(d, model).withColumn("held_out", byte_cnn.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == (r.doc_id % 3 != 0) for r in held]) > 0.95
    odd = byte_cnn.score_quality(docs, model)
    assert odd.count() == docs.count() and all(0 <= r.score <= 1 for r in odd.collect())
    assert byte_cnn.score_quality(none, model).count() == 0
    assert {round(r.score, 6) for r in byte_cnn.score_quality(docs, byte_cnn.fit(docs, labels.limit(0))).collect()} == {0.5}


# 4

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home search">
<header>Site</header><nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head&amp;line</h1><p>One <b>bold</b>word &lt;tag&gt; caf&eacute;<br>next<p>Two&nbsp;three<div class="ad">Buy</div><script>var x = "</p><p>no";</script>
<form>Name <input></form><section id="comments"><p>Nice!</p></section></article><aside>More</aside><footer>(c)</footer></body></html>"""


def marked_text(page):
    p = page_text.parse(page, "h")
    return page_text.main_text(p, np.zeros(len(p.runs), int), 0)


def test_blocks():
    assert marked_text(PAGE) == "Head&line\nOne boldword <tag> café next\nTwo three"
    assert marked_text('<div class="no-sidebar"><p>Text</p><nav>Menu</nav></div>') == "Text"
    assert page_text.blocks(None) == [] and page_text.blocks("plain\n text")[0][0] == "plain text"
    assert page_text.blocks("<p>a<!-- b --><p title='>'>c</p><script>x") == [("a", False, 0), ("c", False, 0)]


def test_selected_runs_cover_shared_blocks():
    """Whole blocks that streams share are covered without a gap, whatever stands around them."""
    rnd = random.Random(2)
    for _ in range(60):
        shared = [[rnd.randrange(10**6) for _ in range(rnd.randrange(1, 30))] for _ in range(rnd.randrange(1, 5))]
        if sum(map(len, shared)) < page_text.LEAST_RUN:
            continue
        seen = []
        for _ in range(2):
            before, after = ([[rnd.randrange(10**6) for _ in range(rnd.randrange(1, 20))] for _ in range(2)] for _ in range(2))
            parts = before + shared + after
            stream, ends = np.array(sum(parts, [])), np.cumsum([len(x) for x in parts])
            at = page_text.selected(stream, ends)
            a = len(before[0]) + len(before[1])
            z = a + sum(map(len, shared))
            inside = [p for p in at.tolist() if a <= p <= z - page_text.LEAST_RUN]
            covered = {q for p in inside for q in range(p, p + page_text.LEAST_RUN)}
            assert covered == set(range(a, z))
            seen.append({p - a for p in inside})
        assert len(seen[0] & seen[1]) >= 2 or len(seen[0]) == 1
        both = {q for p in seen[0] & seen[1] for q in range(p, p + page_text.LEAST_RUN)}
        assert both == set(range(sum(map(len, shared))))


def test_packed_runs():
    runs = np.array([0, 1, 2**48 - 1, 77, 2**40 + 5])
    assert (page_text.unpacked(page_text.packed(runs)) == runs).all() and len(page_text.unpacked(b"")) == 0


def brute_texts(pages):
    """The rules of main_text() from all windows of all pages of a host, counted in a dictionary."""
    parsed = [(i, (re.findall("//([^/]+)", u or "") or [""])[0], [(t, m) for t, off, m in page_text.page_blocks(h) if not off]) for i, u, h in pages]
    n, of_host = Counter(), Counter(h for _, h, _ in parsed)
    stream = lambda b: [w for t, _ in b for w in t.split()]
    k = page_text.LEAST_RUN
    for _, h, b in parsed:
        s = stream(b)
        n.update({(h, *s[i : i + k]) for i in range(len(s) - k + 1)})
    out = []
    for i, h, b in parsed:
        s, best = stream(b), max((m for _, m in b), default=0)
        need = max(page_text.ARTICLE_PAGES, page_text.ARTICLE_SHARE * of_host[h]) if best >= 2 else page_text.LEAST_PAGES
        mask = [False] * len(s)
        for j in range(len(s) - k + 1):
            if n[(h, *s[j : j + k])] >= need:
                mask[j : j + k] = [True] * k
        at, own = 0, []
        for t, m in b:
            size = len(t.split())
            if m == best:
                own.append((t, size, sum(mask[at : at + size]) >= page_text.COVERED * size))
            at += size
        gone, whole = sum(s for _, s, c in own if c), sum(s for _, s, _ in own)
        keep_all = gone > whole / 2 if best >= 2 else gone == whole
        out.append((i, "\n".join(t for t, _, c in own if keep_all or not c)))
    return out


def site(n=60, seed=4):
    """Pages of hosts with unmarked menus and notices, articles with notices of the site, quotations, copies and near copies."""
    rnd = random.Random(seed)
    words = lambda k: " ".join(rnd.choice(WORDS) + rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(k))
    menu, plate, notice, quote = "".join(f"<div>{words(rnd.randrange(1, 4))}</div>" for _ in range(8)), words(13), words(20), words(60)
    pages = []
    for i in range(n):
        pages.append((i, f"http://plain.org/{i}", f"{menu}<div>{words(30)}</div><div>{plate if i % 3 else words(9)}</div>" + (f"<div>{quote}</div>" if i in (7, 9) else "")))
        pages.append((1000 + i, f"http://marked.org/{i}", f"{menu}<article><p>{words(80)}</p>" + (f"<p>{notice}</p>" if i % 4 else "") + (f"<p>{quote}</p>" if i % 5 == 0 else "") + f"<p>{words(40)}</p></article>"))
    copy = f"<article><p>{words(70)}</p><p>{words(50)}</p></article>"
    pages += [(3000 + i, f"http://copies.org/{i}", copy) for i in range(12)]
    pages += [(4000 + i, f"http://few.org/{i}", f"<article><p>{words(40)}</p><p>{notice}</p></article>") for i in range(4)]
    pages += [(5000 + i, "http://same.org/", f"<div>{plate}</div>") for i in range(5)]
    return pages, notice, quote, plate


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_extract(spark, monkeypatch, most):
    """The suffix array decides inside articles and elsewhere, as brute force over whole hosts does, broadcast or joined."""
    monkeypatch.setattr(page_text, "MOST_RUNS", most)
    monkeypatch.setattr(page_text, "BUCKET_BYTES", 5000)
    monkeypatch.setattr(page_text, "FLUSH", 700)
    pages, notice, quote, plate = site()
    pages += [(9050, "http://h.org/a", PAGE), (9051, None, None), (9052, "x", ""), (9050, "http://h.org/a", PAGE)]
    got = page_text.extract_text(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int").repartition(5)).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter(brute_texts(pages))
    by = {r.page_id: r for r in got}
    assert not any(notice in by[1000 + i].text or plate in by[i].text for i in range(50))
    assert quote in by[1000].text and quote in by[7].text and all(len(by[3000 + i].text.split()) == 120 and notice in by[4000 + i % 4].text for i in range(12))
    assert by[9051].text == "" and by[9052].n_chars == 0 and by[5000].text == plate and all(r.n_chars == len(r.text) for r in got)
    assert page_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_large_host(spark, monkeypatch):
    """A host of 5 MB, in many buckets, tasks and flushes, gives what brute force gives."""
    monkeypatch.setattr(page_text, "BUCKET_BYTES", 300_000)
    monkeypatch.setattr(page_text, "FLUSH", 20_000)
    pages = [(i, u.replace("plain", "one").replace("marked", "one"), h) for i, u, h in site(2900, 5)[0]]
    assert sum(len(h) for _, _, h in pages) > 5_000_000
    got = page_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter(brute_texts(pages))


# 5


def brute_word(word, scores):
    """Probability of a word, summed over its segmentations by their ends."""
    x = b" " + word
    a = [1.0] + [0.0] * len(x)
    for j in range(1, len(x) + 1):
        a[j] = sum(a[i] * math.exp(scores[x[i:j]]) for i in range(j) if x[i:j] in scores)
    return math.log(a[-1])


def test_lattice(monkeypatch):
    v = lattice_lm.vocabulary()
    p = dict(zip(v.pieces, v.start))
    words = [b"the", b"a", b"thandable", "été".encode(), bytes([255, 0, 7]), b"x" * 60, b"anding" * 12]

    def slopes(words, counts):
        e = lattice_lm.expected_counts(words, np.array(counts, float), v.start, v)
        step = 1e-4
        for piece in (b" th", b"e", b"able", b"nd"):
            k = v.pieces.index(piece)
            up = v.start.copy()
            up[k] += step
            slope = sum(c * (x - y) for c, x, y in zip(counts, lattice_lm.word_scores(words, up, v), lattice_lm.word_scores(words, v.start, v))) / step
            assert e[k] == pytest.approx(slope, rel=1e-2, abs=1e-6)

    assert np.allclose(lattice_lm.word_scores(words, v.start, v), [brute_word(w, p) for w in words])
    slopes([*words[:3], words[-1]], [1, 2, 3, 4])
    monkeypatch.setattr(lattice_lm, "TOGETHER", 2)  # all words one by one, in slabs of seven places
    monkeypatch.setattr(lattice_lm, "SLAB", 7)
    assert np.allclose(lattice_lm.word_scores(words, v.start, v), [brute_word(w, p) for w in words])
    slopes([*words[:3], words[-1]], [1, 2, 3, 4])


def test_all_pieces_take_part():
    v = lattice_lm.vocabulary()
    assert v.longest == max(map(len, v.pieces)) > 16 and math.exp(v.start[-1]) > 0 and np.exp(v.start).sum() == pytest.approx(1)


def test_long_word():
    rnd = random.Random(16)
    word = "".join(rnd.choice(WORDS) for _ in range(700_000)).encode()
    v = lattice_lm.vocabulary()
    began = time.time()
    got = lattice_lm.word_scores([word], v.start, v)[0]
    assert len(word) > 2_000_000 and time.time() - began < 60 and math.isfinite(got) and got < -len(word) / 10


def brute_em(tokens, ends, rounds=lattice_lm.ROUNDS):
    """Piece scores after some rounds over all tokens, from the sums over whole segmentations."""
    v = lattice_lm.vocabulary()
    p = dict(zip([*v.pieces, None], v.start))
    for _ in range(rounds):
        n = Counter(dict.fromkeys(p, lattice_lm.SMOOTH))
        n[None] += ends
        for w, c in tokens.items():
            x = b" " + w
            m = len(x)
            a, b = [1.0] + [0.0] * m, [0.0] * m + [1.0]
            arcs = [(i, j, math.exp(p[x[i:j]])) for i in range(m) for j in range(i + 1, m + 1) if x[i:j] in p]
            for i, j, s in sorted(arcs, key=lambda t: t[1]):
                a[j] += a[i] * s
            for i, j, s in sorted(arcs, key=lambda t: -t[0]):
                b[i] += s * b[j]
            for i, j, s in arcs:
                n[x[i:j]] += c * a[i] * s * b[j] / a[m]
        total = sum(n.values())
        p = {k: math.log(x / total) for k, x in n.items()}
    return p


def test_lm(spark, docs, none, monkeypatch):
    monkeypatch.setattr(lattice_lm, "FREQUENT", 20)
    got = lattice_lm.score_texts(docs).collect()
    data = docs.collect()
    held = {d.doc_id: d.doc_id is not None and zlib.crc32(str(d.doc_id).encode()) % 7 == 2 for d in data}
    c, ends = Counter(), 0
    for d in data:
        if not held[d.doc_id]:
            c.update((d.text or "").encode().lower().split())
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    blob = b"x" * 50_000  # one row, beyond the brute-force version
    c.pop(blob, None)
    want = Counter()
    for d in data:
        w = (d.text or "").encode().lower().split()
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) if x != blob else math.log10((1 + (not held[1003])) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        known = sum(x in c or x == blob and not held[1003] for x in w) + 1
        want[d.doc_id, held[d.doc_id], len(w) + 1, known, n, round(base, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    small = docs.where("coalesce(doc_id, 0) <> 1003")
    pieces = brute_em(c, ends - (not held[1003]))
    want = Counter()
    cached = {}
    for d in small.collect():
        total = pieces[None]
        for x in (d.text or "").encode().lower().split():
            total += cached.setdefault(x, brute_word(x, pieces))
        want[d.doc_id, round(total / math.log(10), 3)] += 1
    assert Counter((r.doc_id, round(r.score, 3)) for r in lattice_lm.score_texts(small).collect()) == want
    assert lattice_lm.score_texts(none).count() == 0
    only = lattice_lm.score_texts(spark.createDataFrame([(16, "ban ker", "en"), (None, "", "en")], "doc_id long, text string, lang string").where("doc_id = 16" if zlib.crc32(b"16") % 7 == 2 else "doc_id IS NULL")).collect()
    assert len(only) == 1 and only[0].score < 0


# 6


def plain_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_banded_distance():
    rnd = random.Random(1)
    for _ in range(1500):
        al = rnd.choice([2, 4, 30])
        a = [rnd.randrange(al) for _ in range(rnd.randrange(25))]
        b = list(a)
        for _ in range(rnd.randrange(8)):
            b.insert(rnd.randrange(len(b) + 1), rnd.randrange(al))
            del b[rnd.randrange(len(b))]
        k, d = rnd.randrange(12), plain_distance(a, b)
        assert order_minhash.banded_distance(a, b, k) == (d if d <= k else k + 1)


def test_sketch_keeps_order():
    a = list(range(1, 41))
    x, y = order_minhash.sketch(np.array(a, np.uint32)), order_minhash.sketch(np.array(a[20:] + a[:20], np.uint32))
    z = order_minhash.sketch(np.array(a[:-1] + [99], np.uint32))
    assert (x == z).mean() > 0.8 > 0.6 > (x == y).mean() and len(order_minhash.sketch(np.array([], np.uint32))) == 0


def near_rows():
    rnd = random.Random(9)
    rows_, families = [], []
    for f in range(12):
        base = [rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(rnd.randrange(60, 150))]
        own = []
        for _ in range(rnd.randrange(1, 6)):
            w = [rnd.choice(WORDS) + "q" if rnd.random() < 0.06 else x for x in base]
            own.append(len(rows_))
            rows_.append((len(rows_), " ".join(w)))
        own.append(len(rows_))
        rows_.append((len(rows_), rows_[own[0]][1].upper()))
        families.append(own)
    return rows_, families


def test_near_duplicates(spark, docs, none):
    data, _ = near_rows()
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    tokens = {i: t.lower().split() for i, t in data}
    root = {i: i for i in tokens}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = missed = 0
    for i in tokens:
        for j in range(i):
            n = max(len(tokens[i]), len(tokens[j]))
            if abs(len(tokens[i]) - len(tokens[j])) <= n // 5 and plain_distance(tokens[i], tokens[j]) <= 0.2 * n:
                a, b = sorted((find(i), find(j)))
                root[b] = a
                links += 1
                missed += got[i] != got[j]
    assert links > 30 and missed == 0
    assert {i: find(i) for i in tokens} == got
    odd = order_minhash.near_duplicates(docs).collect()
    assert len(odd) == docs.count() and all(r.class_id == r.doc_id for r in odd if r.doc_id in (1000, 1001, 1002, 1005))
    assert order_minhash.near_duplicates(none).count() == 0


def passage_rows():
    """Texts that share a passage of 80 words: twenty that are similar to none, before two near copies, in every bucket of these."""
    rnd = random.Random(21)
    words = lambda n: [rnd.choice(WORDS) + rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n)]
    passage = words(80)
    return [(i, " ".join(passage + words(25 if i < 20 else 20))) for i in range(22)]


@pytest.mark.parametrize("block", [1024, 4])
def test_near_copies_behind_a_foreign_leader(spark, monkeypatch, block):
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    data = passage_rows()
    tokens = {i: t.split() for i, t in data}
    links = {(i, j) for i in tokens for j in range(i) if plain_distance(tokens[i], tokens[j]) <= 0.2 * max(len(tokens[i]), len(tokens[j]))}
    assert links == {(21, 20)}
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: min(i, 20) for i in tokens}


def test_strangers_in_a_bucket_of_copies(spark, monkeypatch):
    """A bucket of many near copies and some strangers, in blocks: only pairs of different classes are compared, none is lost."""
    monkeypatch.setattr(order_minhash, "BLOCK", 5)
    rnd = random.Random(24)
    words = lambda n: [rnd.choice(WORDS) + rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n)]
    passage, own, other = words(60), words(40), words(42)
    vary = lambda w: [x + "q" if rnd.random() < 0.02 else x for x in w]
    data = [(i, " ".join(passage + words(40))) for i in range(3)] + [(10 + i, " ".join(passage + vary(own))) for i in range(23)] + [(40 + i, " ".join(passage + vary(other))) for i in range(4)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: i if i < 10 else 10 if i < 40 else 40 for i, _ in data}
    names = [i for i, _ in data]
    members = spark.createDataFrame([(k, i) for k in (1, 2) for i in names], "key long, node long")
    roots = spark.createDataFrame([(i, 10) for i in range(11, 33)] + [(i, 40) for i in range(41, 44)], "node long, root long")
    codes = spark.createDataFrame([(i, bytearray(order_minhash.word_codes([b"same"] * 9).tobytes())) for i in names], "node long, codes binary")  # nothing is ruled out
    root = {i: 10 if 10 <= i < 33 else 40 if i >= 40 else i for i in names}
    reps = spark.createDataFrame([(i, [7 + i, 1, 2]) for i in names], "node long, keys array<long>")
    pairs = order_minhash.rivals(members, roots, codes, reps).collect()
    assert sorted((r.a, r.b) for r in pairs) == sorted((i, j) for i in names for j in names if j < i and root[i] != root[j])


def similar_at(rnd, n, share):
    """Two word lists of n words of which a share is replaced, at random places."""
    a = [rnd.choice(WORDS) + rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n)]
    b = list(a)
    for k in rnd.sample(range(n), int(n * share)):
        b[k] = rnd.choice(WORDS) + "q"
    return a, b


@pytest.mark.parametrize(("share", "least"), [(0.05, 0.99), (0.10, 0.99), (0.15, 0.98), (0.20, 0.9)])
def test_recall_by_similarity(share, least):
    """How many pairs of an edit similarity of 1 - share meet in a sketch at all (0.20: the threshold itself)."""
    rnd = random.Random(23)
    met = 0
    for _ in range(200):
        a, b = similar_at(rnd, rnd.randrange(80, 300), share)
        x, y = (order_minhash.sketch(np.array([zlib.crc32(w.encode()) for w in c], np.uint32)) for c in (a, b))
        met += bool((x == y).any())
    print("recall", share, met / 200)
    assert met / 200 >= least


def test_word_bits_bound():
    rnd = random.Random(22)
    for _ in range(600):
        a = [rnd.randrange(rnd.choice([4, 500])) for _ in range(rnd.randrange(60))]
        b = list(a)
        for _ in range(rnd.randrange(12)):
            b.insert(rnd.randrange(len(b) + 1), rnd.randrange(500))
            if rnd.random() < 0.7:
                del b[rnd.randrange(len(b))]
        x, y = sorted((order_minhash.word_bits(np.array(c, np.uint32))[None] for c in (a, b)), key=lambda t: t.shape[1])
        while x.shape[1] < y.shape[1]:
            y = order_minhash.folded(y)
        assert max(np.bitwise_count(x & ~y).sum(), np.bitwise_count(y & ~x).sum()) <= plain_distance(a, b)


def test_rivals_lose_no_similar_pair():
    """All similar pairs of different classes come out of a cell, whatever sizes of bits meet there."""
    import pyarrow as pa

    rnd = random.Random(25)
    texts = []
    for n in (1, 3, 7, 8, 9, 15, 16, 17, 30, 31, 33, 60, 64, 66, 130):
        base = [rnd.choice(WORDS) for _ in range(n)]
        for _ in range(4):
            w = list(base)
            for _ in range(rnd.randrange(max(1, n // 5) + 1)):
                if rnd.random() < 0.5 and len(w) > 1:
                    del w[rnd.randrange(len(w))]
                else:
                    w.insert(rnd.randrange(len(w) + 1), rnd.choice(WORDS))
            texts.append(w)
    codes = [order_minhash.word_codes([x.encode() for x in w]) for w in texts]
    ids = list(range(len(texts)))
    for side in ([0] * len(ids), [i % 2 for i in ids]):
        cell = pa.table({"words": [len(c) for c in codes], "node": ids, "root": [i // 3 for i in ids], "side": side, "bits": [order_minhash.word_bits(c).tobytes() for c in codes], "key": [5] * len(ids), "short": [np.array([i, 5], np.uint32).tobytes() for i in ids]})
        got = order_minhash._rivals(cell)
        got = set(zip(got["a"].to_pylist(), got["b"].to_pylist()))
        want = {(i, j) for i in ids for j in range(i) if i // 3 != j // 3 and (not any(side) or side[i] != side[j]) and order_minhash.similar(codes[i], codes[j])}
        assert len(want) > 20 and want <= got


@pytest.mark.parametrize(("nearest", "block"), [(2, 1024), (1, 8)])
def test_rivals_of_one_class_are_not_compared_pair_by_pair(spark, monkeypatch, nearest, block):
    """Texts that all are similar, in buckets that strangers lead, and some that may be: what is verified grows with their number."""
    monkeypatch.setattr(order_minhash, "NEAREST", nearest)
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    seen = []
    verify = order_minhash.verify
    monkeypatch.setattr(order_minhash, "verify", lambda pairs, codes: seen.append(pairs.count()) or verify(pairs, codes))
    rnd = random.Random(26)
    words = lambda n: [rnd.choice(WORDS) + rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n)]
    passage = words(80)
    data = [(i, " ".join(passage + words(40 if i < 2 else 19 if i < 72 else 23))) for i in range(74)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: 2 if 2 <= i < 72 else i for i, _ in data}
    if block > len(data):
        assert 74 < sum(seen) < 74 * 10 < 72 * 71 // 2
    else:
        assert sum(seen) < 72 * 71 // 2


@pytest.mark.parametrize("nearest", [1, 2])
def test_near_copies_at_the_threshold(spark, monkeypatch, nearest):
    """A bucket of texts whose distances lie on either side of the threshold: the classes are those of all similar pairs."""
    monkeypatch.setattr(order_minhash, "NEAREST", nearest)
    monkeypatch.setattr(order_minhash, "BLOCK", 16)
    rnd = random.Random(27)
    passage = [rnd.choice(WORDS) + rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(80)]
    small = [rnd.choice(WORDS) for _ in range(30)]
    data = [(i, " ".join(passage + [rnd.choice(small) for _ in range(60 if i == 0 else rnd.randrange(20, 34))])) for i in range(50)]
    tokens = {i: t.split() for i, t in data}
    root = {i: i for i in tokens}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in tokens:
        for j in range(i):
            if plain_distance(tokens[i], tokens[j]) <= 0.2 * max(len(tokens[i]), len(tokens[j])):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert 5 < len({find(i) for i in tokens}) < 45
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in tokens}


@pytest.mark.parametrize("repeated", [False, True])
def test_leaders_of_other_lengths_are_not_verified(spark, monkeypatch, repeated):
    """Buckets that a much longer text leads: only pairs whose lengths let them be similar are verified, and none of these is lost."""
    seen = []
    verify = order_minhash.verify
    monkeypatch.setattr(order_minhash, "verify", lambda pairs, codes: seen.extend((r.a, r.b) for r in pairs.collect()) or verify(pairs, codes))
    rnd = random.Random(29)
    words = lambda n: [rnd.choice(WORDS) + rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n)]
    passage, own = words(80), words(40)
    data = [(0, passage + words(200)), (1, passage + words(71)), (2, passage + words(70))]
    data += [(i, passage + words(40)) for i in range(3, 30)] + [(30, passage + own), (31, passage + own[:-3])]
    if repeated:  # the text of another length that a leader has as well
        data.append((0, passage + own[3:]))
    lengths = {}
    for i, w in data:
        lengths.setdefault(i, set()).add(len(w))
    rows = [(i, " ".join(w)) for i, w in data]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links = {(i, j) for i, v in data for j, w in data if j < i and abs(len(v) - len(w)) <= 0.2 * max(len(v), len(w)) and plain_distance(v, w) <= 0.2 * max(len(v), len(w))}
    assert links == {(31, 30)} | ({(30, 0), (31, 0)} if repeated else set())
    assert got == {i: {30: 30 * (not repeated), 31: 30 * (not repeated)}.get(i, i) for i in lengths}
    able = {(i, j) for i, j in seen if any(max(m, n) - min(m, n) <= int((1 - order_minhash.SIMILARITY) * max(m, n) + 1e-9) for m in lengths[i] for n in lengths[j])}
    assert able <= set(seen) if repeated else able == set(seen)


def test_near_lengths(spark):
    """Lengths rule a pair out exactly where similar() does so by lengths."""
    reps = spark.createDataFrame([(n, n) for n in range(1, 90)] + [(200, 10), (200, 60)], "node long, words long")
    shares = spark.createDataFrame([(a, b) for a in range(1, 90) for b in [*range(1, 90), 200]], "node long, leader long")
    fits = lambda m, n: max(m, n) - min(m, n) <= int((1 - order_minhash.SIMILARITY) * max(m, n) + 1e-9)
    got = {(r.node, r.leader) for r in order_minhash.near_lengths(shares, reps).collect()}
    assert {x for x in got if x[1] < 200} == {(a, b) for a in range(1, 90) for b in range(1, 90) if fits(a, b)}
    assert {a for a, b in got if b == 200} >= {a for a in range(1, 90) if fits(a, 10) or fits(a, 60)}


def test_word_marks_bound():
    rnd = random.Random(28)
    for _ in range(600):
        a = [rnd.randrange(rnd.choice([4, 500])) for _ in range(rnd.randrange(1, 60))]
        b = list(a)
        for _ in range(rnd.randrange(12)):
            b.insert(rnd.randrange(len(b) + 1), rnd.randrange(500))
            if rnd.random() < 0.7:
                del b[rnd.randrange(len(b))]
        x, y = (order_minhash.word_marks(np.array(c, np.uint32)) for c in (a, b))
        apart = order_minhash._apart_marks(x, [y, x]).tolist()
        assert apart == [max(len(set(x) - set(y)), len(set(y) - set(x))), 0] and apart[0] <= plain_distance(a, b)


def test_nearest_rivals():
    i, j = np.array([0, 0, 0, 1, 1, 2]), np.array([1, 2, 3, 2, 3, 3])
    assert order_minhash._nearest(i, j, np.array([-5, -4, -3, -2, -1, 0]), 1).tolist() == [0, 1, 2]
    assert order_minhash._nearest(i, j, np.array([-5, -4, -3, -2, -1, 0]), 3).tolist() == list(range(6))


@pytest.mark.parametrize(("n", "most", "rows_"), [(40, 30, 40), (100, 90, None), (300, 20, None)])
def test_cells_of_a_bucket(spark, monkeypatch, n, most, rows_):
    """Every two members of different classes meet in a cell, on different sides if it has two; a small bucket is one cell."""
    monkeypatch.setattr(order_minhash, "BLOCK", 64)
    root = {i: 0 if i < most else i for i in range(n)}
    held = spark.createDataFrame([(1, i, r, n, most, 0) for i, r in root.items()], "key long, node long, root long, _n long, _most long, _big long")
    cells = defaultdict(dict)
    for r in order_minhash.dealt(held).collect():
        cells[r._low, r._high][r.node] = r.side
    assert sum(map(len, cells.values())) == (rows_ or sum(map(len, cells.values()))) <= n * -(-n // 64)
    met = Counter()
    for (low, high), own in cells.items():
        met.update((i, j) for i in own for j in own if j < i and root[i] != root[j] and (low == high or own[i] != own[j]))
    assert met == {(i, j): 1 for i in root for j in range(i) if root[i] != root[j]}


def test_keep_one(spark, docs):
    data, families = near_rows()
    d = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, extra string")
    kept = order_minhash.keep_one(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [f[0] for f in families]
    assert Counter(r.doc_id for r in order_minhash.keep_one(docs).collect())[1005] == 1


def test_components(spark, monkeypatch):
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 40)] + [(200, k) for k in range(201, 230)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(40)] + [(7, 7), (3, 2)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    for per in (20_000, 3):  # hubs whole, and dealt over salts
        monkeypatch.setattr(components, "join_salted", lambda left, right, key, per=per: join_salted(left, right, key, per))
        got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {i: find(i) for i in root if find(i) != i}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7


def test_rules(spark, docs, none):
    got = adaptive_rules.apply_rules(docs)
    out = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect())
    want = Counter()
    for d in docs.collect():
        t = d.text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {i + o for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for o in (0, 1, 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[d.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    assert out == want
    assert not any(r.kept and r.base_failed for r in got.collect()) and any(r.kept for r in got.collect())
    assert adaptive_rules.apply_rules(none).count() == 0


def test_sketches_merge(spark, docs):
    m = adaptive_rules.with_base_rule(adaptive_rules.text_metrics(docs))
    whole = adaptive_rules.thresholds(adaptive_rules.sketches(m).withColumn("g", F.lit(1)), ["g"]).first()
    parts = adaptive_rules.sketches(m.where("doc_id % 2 = 0")).unionByName(adaptive_rules.sketches(m.where("coalesce(doc_id % 2, 1) <> 0")))
    assert adaptive_rules.thresholds(parts.withColumn("g", F.lit(1)), ["g"]).first() == whole


def test_thresholds_follow_their_group(spark):
    """What is usual in one source is out of the way in another, and a small group leans on its language."""
    rnd = random.Random(17)
    words = lambda n, sym: " ".join(rnd.choice(WORDS) + rnd.choice(WORDS) + rnd.choice(WORDS) + ("#" if rnd.random() < sym else "") for _ in range(n))
    data = [(k, words(120, 0.1), "en", "code") for k in range(300)] + [(1000 + k, words(120, 0), "en", "news") for k in range(300)] + [(2000, words(120, 0.9), "en", "news"), (3000, words(120, 0), "fr", "few")]
    got = rows(adaptive_rules.apply_rules(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")))
    assert all(got[k].kept for k in range(300)) and all(got[1000 + k].kept for k in range(300))
    assert not got[2000].kept and not got[2000].base_failed and got[3000].kept
    limits = {r.source: r.t_symbols for r in adaptive_rules.apply_rules(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).select("source", "t_symbols").distinct().collect()}
    assert limits["news"] < min(limits["few"], limits["code"]) and max(limits.values()) <= 1000


# 8


def brute_lines(data, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    n, last = Counter(), {}
    for i, t in data:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                n[k] += 1
                last[k] = max(last.get(k, -1), -1 if i is None else i)
    out = []
    for i, t in data:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or not (len(key(x)) >= 40 and n[key(x)] >= min_docs and last[key(x)] != i)]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def test_lines(spark, docs, none):
    rnd = random.Random(6)
    shared = ["é" * 39 + "x", "a" * 39, "  " + "Shared line number one is long enough, yes" + "\t", "sHARED LINE NUMBER ONE IS LONG ENOUGH, YES", "another shared line that is long enough to go"]
    data = [(i, "\n".join(rnd.choice(shared + ["own " + str(i)]) for _ in range(rnd.randrange(1, 7)))) for i in range(40)] + [(99, None), (None, shared[2]), (98, "")]
    d = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, n_lines int")
    got = line_runs.drop_repeated_lines(d).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert Counter(map(tuple, got)) == Counter(brute_lines(data))
    assert sum(r.n_dropped for r in got) > 20
    assert line_runs.drop_repeated_lines(docs).count() == docs.count() and line_runs.drop_repeated_lines(none).count() == 0


def line_batches(spark, batches=7):
    rnd = random.Random(8)
    for batch in range(batches):
        lines = {(rnd.randrange(60), batch * 10 + rnd.randrange(10)) for _ in range(60)}
        yield lines, spark.createDataFrame([(i, bytes([k])) for k, i in lines], "doc_id long, digest binary")


def test_runs_compact(spark):
    store = line_runs.LineRuns(spark, fanout=2, buckets=3)
    want, last, sizes = Counter(), {}, []
    for lines, table in line_batches(spark):
        for k, i in lines:
            want[k] += 1
            last[k] = max(last.get(k, 0), i)
        store.add(table)
        sizes.append([len(x) for x in store.levels])
    assert sizes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1], [0, 1, 1], [1, 1, 1]] and store.merges > 4
    held = [r.digest[0] for n in store.runs() for r in spark.table(n).collect()]
    assert sorted(held) == sorted(want)  # every key in exactly one run
    assert {r.digest[0]: (r.n_docs, r.last_doc) for r in store.keys().collect()} == {k: (n, last[k]) for k, n in want.items()}
    assert [r.digest[0] for r in store.unseen(spark.createDataFrame([(b"\xff",), (bytes([next(iter(want))]),)], "digest binary")).collect()] == [255]
    store.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("siftline_")]


def test_anti_join_decides(spark, monkeypatch):
    """Without the anti-join, keys of several batches would be in several runs and be counted apart."""
    monkeypatch.setattr(line_runs.LineRuns, "unseen", lambda self, batch: batch)
    store = line_runs.LineRuns(spark, fanout=9, buckets=2)
    for _, table in line_batches(spark, 3):
        store.add(table)
    keys = [r.digest for r in store.keys().collect()]
    assert len(keys) > len(set(keys))
    store.close()


def test_merge_without_shuffle(spark):
    store = line_runs.LineRuns(spark, fanout=9, buckets=3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for _, table in line_batches(spark, 3):
            store.add(table)
        names = store.runs()
        for df in (spark.table(names[0]).join(spark.table(names[1]).select("digest"), "digest", "left_anti"), store._merged(names)):
            df.collect()
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString().replace("ReusedExchange", "")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        store.close()


def test_repeated_ids_count_as_rows(spark):
    line = "a line that is long enough to count as boilerplate"
    d = spark.createDataFrame([(1, line), (1, line), (2, line), (2, line), (3, line)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_dropped) for r in line_runs.drop_repeated_lines(d).collect()) == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 0)]


# 9


PAGES = [(5, "http://a/5", "<p>x</p>"), (3, "http://a/3", "<p>x</p>"), (9, None, None), (8, "u\r\nv", ""), (4, "http://a/4", "é" * 10_000), (3, "http://a/3", "<p>x</p>"), (None, "n", "<p>x</p>"), (7, "q", "WARC/1.1\r\n\r\n"), (11, "e", "\r\n"), (12, "e", "a\r\n\r"), (13, "e", "\r\n\r\n\r\nb\r\n\r\n"), (14, "e", "ab " * 200_000)]


def test_archive(spark):
    df = spark.createDataFrame([(*p, 0) for p in PAGES], "page_id long, url string, html string, digest int")
    path = warc_store.write_archive(df)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_store.read_archive(spark, path).collect())
    want = Counter()
    for i, _, h in PAGES:
        b = (h or "").encode()
        first = min(j for j, _, g in PAGES if j is not None and (g or "") == (h or ""))
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else first] += 1
    assert got == want
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in PAGES})
    empty = warc_store.write_archive(df.limit(0))
    assert warc_store.read_archive(spark, empty).count() == 0


def test_warc_files(spark, tmp_path):
    """The files hold every record, exactly framed; what a plain parser and read_warc() find in them are the original pages."""
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = warc_store.export_warc(spark, warc_store.write_archive(df), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    seen = {}
    while data:  # records follow each other exactly
        head, _, rest = data.partition(b"\r\n\r\n")
        h = warc_store.parse_header(head.decode() + "\r\n\r\n")
        size = int(h["content-length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        assert h["warc-block-digest"] == "sha256:" + hashlib.sha256(rest[:size]).hexdigest() and (size == 0 or h["warc-type"] == "response")
        seen.setdefault(h["warc-record-id"], []).append((h["warc-type"], rest[:size].decode()))
        data = rest[size + 4 :]
    assert sum(map(len, seen.values())) == len(PAGES)
    back = warc_store.read_warc(spark, folder, html=True).collect()
    texts = {(r.page_id, r.html) for r in back if r.record_type == "response"}
    assert texts == {(min(j for j, _, g in PAGES if j is not None and (g or "") == (h or "")), h or "") for _, _, h in PAGES}
    assert seen["<urn:page:4>"] == [("response", "é" * 10_000)] and seen["<urn:page:->"] == [("revisit", "")]


def test_damage_is_found(spark):
    path = warc_store.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    bad = spark.read.parquet(f"{path}/payloads").withColumn("packed", F.lit(zlib.compress(b"other")))
    bad.select("digest", "first_id", "copies", "packed").write.parquet(f"{path}/damaged/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}/damaged/headers")
    with pytest.raises(Exception, match="damaged"):
        warc_store.records(spark, f"{path}/damaged").collect()
    parser = warc_store.Records()
    assert list(parser.feed(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab")) == []
    with pytest.raises(ValueError, match="cut off"):
        parser.close()


def test_short_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = rows(warc_store.read_archive(spark, warc_store.write_archive(df, min_bytes=3)), "page_id")
    assert [got[i].record_type for i in (1, 2, 3, 4)] == ["response", "response", "response", "revisit"]


# 10


def brute_tiles(a, b, least):
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and fa[i + n] and fb[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return out
        n, i, j = best
        fa[i : i + n], fb[j : j + n] = [False] * n, [False] * n
        out.append(best)


def test_tiles(monkeypatch):
    rnd = random.Random(11)
    for al, most in ((3, 10**6), (12, 10**6), (3, 0)):
        monkeypatch.setattr(tiling, "MANY_HITS", most)
        for _ in range(40):
            a, b = ([rnd.randrange(al) for _ in range(rnd.randrange(30))] for _ in range(2))
            b = b + a[5:14] + b[:3] + a[:5]
            assert tiling.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3) == brute_tiles(a, b, 3)


def brute_coverage(text, item, least=tiling.LEAST):
    a, b = tiling.words(item), tiling.words(text)
    return sum(n for n, _, _ in brute_tiles(a, b, min(least, len(a)))) / len(a) if a else 0


def test_contamination(spark, docs, none):
    rnd = random.Random(12)
    words = lambda n: " ".join(rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n))
    template = words(12)
    bench = [(k, words(30)) for k in range(6)] + [(10, None), (11, "too short"), (12, ""), (13, " . "), (11, "too short")]
    bench += [(20 + k, template + " " + words(13 + k)) for k in range(8)]  # items that share less than half of their words
    bench += [(40, words(6) + " " + words(6)), (None, words(20))]
    w = bench[1][1].split()
    hit = {1: words(50) + " " + bench[0][1].upper() + ". " + words(20), 2: words(10) + " ".join(w[20:] + ["xx"] + w[10:20] + ["yy"] + w[:10]), 3: words(40) + " ".join(bench[2][1].split()[:10]), 7: "this is Too, short!", 8: words(9) + " " + template + " " + words(9), 9: bench[13][1] + " " + template, 10: " ".join(t for _, t in bench if t), 11: bench[-1][1]}
    for k in range(12, 60):  # pieces of items of any size, in any order
        parts = [words(rnd.randrange(1, 8)) for _ in range(3)]
        for _ in range(rnd.randrange(1, 5)):
            t = (rnd.choice([t for _, t in bench if t]) + " .").split()
            i = rnd.randrange(len(t))
            parts.insert(rnd.randrange(len(parts)), " ".join(t[i : i + rnd.randrange(4, 25)]))
        hit[k] = " ".join(parts)
    data = [(i, t, "o") for i, t in hit.items()] + [(4, None, None), (5, "", ""), (6, words(300), ""), (1, hit[1], None)]
    d = spark.createDataFrame(data, "doc_id long, text string, coverage string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = Counter()
    for i, t, _ in data:
        found = sorted((-c, j is None, j or 0) for j, x in bench if (c := brute_coverage(t, x)) >= 0.5)
        want[i, len(found), (None if found[0][1] else found[0][2]) if found else None, round(-found[0][0], 9) if found else 0] += 1
    got = tiling.score_contamination(d, b).collect()
    assert Counter((r.doc_id, r.n_items, r.item_id, round(r.coverage, 9)) for r in got) == want
    assert sum(r.contaminated for r in got) > 15 and {r.doc_id: r.contaminated for r in got}[8] is False
    kept = Counter(r.doc_id for r in tiling.decontaminate(d.drop("coverage"), b).collect())
    assert kept == Counter(r.doc_id for r in got if not r.contaminated)
    assert tiling.score_contamination(docs, b.limit(0)).where("contaminated").count() == 0 and tiling.score_contamination(none, b).count() == 0
    assert tiling.score_contamination(docs, b).count() == docs.count()


def test_telling_windows():
    rnd = random.Random(15)
    for _ in range(300):
        n, k = rnd.randrange(5, 40), 5
        places, counts = np.arange(n - k + 1), np.array([rnd.randrange(1, 9) for _ in range(n - k + 1)])
        keep = tiling.telling(counts, places, k, n, 0.5)
        left = {p + o for p in places[~keep].tolist() for o in range(k)}
        assert len(left) < 0.5 * n and keep.any()
