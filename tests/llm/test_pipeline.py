"""The pipeline's stages, one after the other, on a small corpus with cases of every kind."""

import hashlib
import math
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from siftline.llm import byte_cnn, mixing

sys.path.insert(0, str(Path(__file__).parent))
from test_llm import brute_coverage, brute_lines, plain_distance  # noqa: E402

WORDS = [a + b for a in "ba ke li mo nu ra se ti vo zu".split() for b in "n r l s t m".split()]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(1)
    folder = tmp_path_factory.mktemp("sf")
    words = lambda n: " ".join(rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n))
    bench = [(k, words(30)) for k in range(3)]
    shared = words(12)
    rows = [(i, words(80) + ("\n" + shared if i % 4 == 0 else "")) for i in range(120)]
    rows += [(200 + k, rows[k][1]) for k in range(10)]  # copies
    rows += [(300 + k, rows[20 + k][1].replace(" ", " q ", 2)) for k in range(10)]  # near copies
    rows += [(400 + k, words(40) + " " + bench[k % 3][1]) for k in range(6)]
    rows += [(500 + k, " ".join(x + "###" for x in words(80).split())) for k in range(60)]
    table = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 500), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), shared


def test_stages(spark, corpus):
    folder, shared = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        if k < len(P.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{folder}/out-{name}")
        docs = spark.read.parquet(f"{folder}/out-{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert not any(i >= 500 for i in kept["quality"]) and sum(i < 500 for i in kept["quality"]) >= 140
    lines = kept["lines"]
    assert sum(shared in r.text for r in lines.values()) == 1 and all(r.n_chars == len(r.text) for r in lines.values())
    assert lines.keys() == kept["quality"].keys()
    near = kept["near_duplicates"]
    assert not any(200 <= i < 210 and i - 200 in near for i in near) and not any(300 <= i < 310 and i - 280 in near for i in near)
    assert not any(400 <= i < 406 for i in kept["decontamination"]) and {i for i in near if i < 120} == {i for i in kept["decontamination"] if i < 120}
    assert kept["mixture"].keys() == kept["decontamination"].keys()


# Brute-force versions of the stages, over plain rows (doc_id, text, lang, source, n_chars).


def plain_scores(texts, m):
    """The network's probabilities, place by place."""
    out = []
    for t in texts:
        t = (t or "").encode()
        chunks = 1 + max(0, -(-(len(t) - byte_cnn.CHUNK) // byte_cnn.HOP))
        data = np.frombuffer(t + b"\0" * (chunks * byte_cnn.HOP + byte_cnn.CHUNK + byte_cnn.WIDTH), np.uint8)
        y = sum(m.tables[j][data[j : len(data) - byte_cnn.WIDTH + j]] for j in range(byte_cnn.WIDTH))
        z = [np.maximum(y[k * byte_cnn.HOP : k * byte_cnn.HOP + byte_cnn.CHUNK].max(axis=0) + m.shift, 0) @ m.out for k in range(chunks)]
        out.append(1 / (1 + math.exp(-float(np.clip(np.mean(z) + m.bias, -50, 50)))))
    return out


def plain_lines(rows):
    return [(i, t, lang, source, len(t)) for (i, t, _, _), (_, _, lang, source, _) in zip(brute_lines([r[:2] for r in rows]), rows, strict=True)]


def plain_near(rows):
    tokens = [(t or "").encode().lower().split() for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            n = max(len(tokens[a]), len(tokens[b]))
            if tokens[a] and tokens[b] and abs(len(tokens[a]) - len(tokens[b])) <= 0.2 * n and (tokens[a] == tokens[b] or len(set(tokens[a]) & set(tokens[b])) * 2 > len(set(tokens[a])) and plain_distance(tokens[a], tokens[b]) <= int(0.2 * n + 1e-9)):
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    kept, seen = [], set()
    for k, r in enumerate(rows):
        if r[0] is None:
            kept.append(r)
        elif (r[0] == least[find(k)] or not tokens[k]) and r[0] not in seen:
            seen.add(r[0])
            kept.append(r)
    return kept


def plain_clean(rows, bench):
    return [r for r in rows if not any(brute_coverage(r[1] or "", t) >= 0.5 for _, t in bench if t)]


def plain_mixture(rows):
    tokens, docs = Counter(), {}
    for r in rows:
        n = len((r[1] or "").split())
        tokens[r[3]] += n
        docs.setdefault(r[3], []).append((r[0], n))
    p = {s: t / sum(tokens.values()) for s, t in tokens.items() if t}
    lo, hi = min(p.values()), max(p.values())
    alpha = round(max(0.0, 1 - math.log(mixing.MAX_EPOCHS) / math.log(hi / lo)), 6) if hi > lo else 0.0
    out = Counter()
    for s, own in docs.items():
        quota = math.floor(tokens[s] * round((p[s] / hi) ** (alpha - 1), 9) + 1e-6) if tokens[s] else 0
        for epoch in range(3):
            start = epoch * tokens[s]
            key = lambda d: hashlib.md5("|".join([mixing.SEED, str(epoch), *([] if d[0] is None else [str(d[0])])]).encode()).hexdigest()  # noqa: E731, B023
            for d in sorted(own, key=lambda d: (key(d), d[1])):
                if start < quota or not tokens[s] and epoch == 0:
                    out[d[0], s, d[1], epoch] += 1
                start += d[1]
    return out


@pytest.fixture(scope="module")
def odd_corpus(spark, corpus, tmp_path_factory):
    """The corpus with nulls in every column, empty and blank texts, repeated rows, ties and a long text."""
    rnd = random.Random(3)
    folder = tmp_path_factory.mktemp("odd")
    words = lambda n: " ".join(rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n))
    rows = [tuple(r) for r in spark.read.parquet(f"{corpus[0]}/documents.parquet").collect()]
    rows += [rows[3], rows[3], (900, None, None, None, None), (901, "", "en", None, 0), (902, " \n\t", None, "s1", 3), (None, words(70), "en", "s2", 1), (903, words(4000), "en", "s0", None), (904, rows[5][1].upper(), None, "s1", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{corpus[0]}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder), rows


def test_run_against_brute_force(spark, odd_corpus):
    folder, rows = odd_corpus
    model = byte_cnn.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    good = [r for r, p in zip(rows, plain_scores([r[1] for r in rows], model), strict=True) if p >= byte_cnn.THRESHOLD]
    want = {"quality": good}
    want["lines"] = plain_lines(want["quality"])
    want["near_duplicates"] = plain_near(want["lines"])
    want["decontamination"] = plain_clean(want["near_duplicates"], bench)
    assert len(rows) > len(good) > len(want["near_duplicates"]) > len(want["decontamination"]) > 100
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(tuple, docs.collect()), key=key) == sorted(want[name], key=key), name
    got = Counter((r.doc_id, r.source, r.n_tokens, r.epoch) for r in P.run(spark, folder).collect())
    assert got == plain_mixture(want["decontamination"])


def test_stages_on_empty_tables(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), corpus[0]).count() == 0, name


def test_stages_keep_further_columns(spark, odd_corpus):
    folder, _ = odd_corpus
    names = ["score", "n_lines", "item_id", "class_id", "digest", "block"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("*", *(F.lit(7).alias(c) for c in names))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and {tuple(r) for r in out.select(*names).distinct().collect()} == {(7,) * 6}, name
    assert mixing.mix(docs).count() >= docs.count()


def test_stages_removed(spark, corpus):
    """Of the tables between stages the last one stays, which the lazy mixture was made from."""
    from siftline.llm.common import shared_dir

    before = set(Path(f"{shared_dir(spark)}/siftline").glob("stage-*"))
    P.run(spark, corpus[0])
    assert len(set(Path(f"{shared_dir(spark)}/siftline").glob("stage-*")) - before) == 1


def test_guard():
    root = Path(P.__file__).parent
    assert "except" not in (root / "corpus_pipeline.py").read_text()
    for f in root.glob("siftline/*/*.py"):
        if f.parent.name != "llm":
            assert "siftline.llm" not in f.read_text(), f
